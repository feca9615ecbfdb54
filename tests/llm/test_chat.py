import hashlib

from hypothesis import given, settings, strategies as st
from pathledger.llm import chat

parts = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "/", " ", "\n", "é", "[INST", "\\["]), max_size=12)


@given(parts.map("".join), st.sampled_from(["system", "user", "assistant", "tool", "", "[ROLE]"]))
@settings(max_examples=300, deadline=None)
def test_turns_round_trip(text, role):
    segments = chat.turn_segments(role, text)
    formatted = "".join(s for s, _ in segments)
    assert chat.parse_turn(formatted) == (role, text)
    assert not any(c in segments[1][0] for c in chat.CONTROLS)


def test_digests_equal_brute_force(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 2, "assistant", "</s>[INST] ok"), (1, 1, "user", None), (2, 0, "assistant", "é\\n"),
        (2, 1, "assistant", ""), (None, 0, "user", "lone"), (3, None, None, "x"), (3, 5, "tool", "<s>"), (4, 0, "user", "a"),
        (4, 0, "user", "a"), (5, 0, "user", "q" * 200_000),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("segment", chat.F.lit(1))
    found = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    assert set(found) == {1, 2, 3, 4, 5, None}
    for conv, row in found.items():
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = [(r[2] or "", r[3] or "") for r in turns]
        whole = "".join(f"{role}\n{text}\n" for role, text in said)
        loss = "".join(text for role, text in said if role == "assistant")
        assert row.n_turns == len(turns)
        assert row.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert row.formatted_chars == sum(len(s) for role, text in said for s, _ in chat.turn_segments(role, text))
    assert {c: r.valid for c, r in found.items()} == {1: True, 2: False, 3: False, 4: False, 5: True, None: True}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digests(chat.format_chats(empty)).collect() == []
