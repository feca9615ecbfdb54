"""Chat formatting: a state machine over roles and a declarative template give text segments."""

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pathledger.llm.text import small_batches

# Per role: what stands before the text, what stands after it, and whether the text counts for
# the loss. A prefix ends and a suffix begins with white space, which no control string contains,
# so that text and marks can not join to a control string.
TEMPLATE = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n", False),
    "user": ("<s>[INST] ", " [/INST]", False),
    "assistant": ("[OUT] ", " </s>", True),
}
# Any other role: its name stands between the marks.
OTHER = ("[ROLE] ", " [/ROLE] ", " </s>", False)
CONTROLS = ("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]")

# Which role may follow which; "" is the start.
TURNS = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}

_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text):
    """No control string stands in the result: backslashes double, and one breaks each control."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text):
    return _ESCAPED.sub(r"\1", text)


def turn_segments(role, text, template=None):
    """(segment, loss) three times: marks before the text, the escaped text, marks after it."""
    template = template or TEMPLATE
    if role in template:
        prefix, suffix, loss = template[role]
    else:
        opening, middle, suffix, loss = OTHER
        prefix = opening + escape(role) + middle
    return [(prefix, False), (escape(text), loss), (suffix, False)]


def parse_turn(formatted, template=None):
    """(role, text) of one formatted turn."""
    template = template or TEMPLATE
    for role, (prefix, suffix, _) in template.items():
        if formatted.startswith(prefix) and formatted.endswith(suffix):
            return role, unescape(formatted[len(prefix) : len(formatted) - len(suffix)])
    opening, middle, suffix, _ = OTHER
    role, _, rest = formatted[len(opening) :].partition(middle)
    return unescape(role), unescape(rest[: len(rest) - len(suffix)])


def _same(a, b):
    return a == b or (pd.isna(a) and pd.isna(b))


def format_chats(chats: DataFrame, template=None, turns=None) -> DataFrame:
    """The text segments of all conversations.

    Returns conv_id, turn_no (from 0, in order), segment_no (0 marks, 1 text, 2 marks), segment,
    loss (the segment counts for the loss) and valid (the turns so far follow the state machine).
    Turns are ordered by turn (null first), then role and text, so repeated rows give a repeated
    turn. A null text is empty, a null role is the role ''. Rows without conv_id are one
    conversation. Other columns are ignored. Rows of a conversation run through one task in
    order, as a stream that holds one batch.
    """
    small_batches(chats.sparkSession)
    turns = turns or TURNS
    width = int(chats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = chats.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.repartition(width, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def emit(frames):
        current, place, state = object(), 0, ""
        for frame in frames:
            out = []
            for conv, role, text in zip(frame.conv_id, frame.role, frame.text, strict=True):
                if not _same(conv, current):
                    current, place, state = conv, 0, ""
                state = role if state is not None and role in turns.get(state, ()) else None
                for n, (segment, loss) in enumerate(turn_segments(role, text, template)):
                    out.append((None if pd.isna(conv) else conv, place, n, segment, loss, state is not None))
                place += 1
            columns = ["conv_id", "turn_no", "segment_no", "segment", "loss", "valid"]
            yield pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64"})

    kind = "conv_id bigint, turn_no bigint, segment_no int, segment string, loss boolean, valid boolean"
    return rows.mapInPandas(emit, kind)


def digests(segments: DataFrame, template=None) -> DataFrame:
    """What the formatted conversations say, read back from their segments.

    Returns conv_id, n_turns, turns_sha256 (of role, newline, text, newline per turn), loss_chars
    and loss_sha256 (of all text under the loss mask, unescaped), formatted_chars and valid.
    A SHA-256 is taken over a conversation in order, so one task reads it; it holds no more than
    a turn.
    """
    width = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn_no", "segment_no"]
    rows = segments.repartition(width, "conv_id").sortWithinPartitions(*order)

    class Seen:
        def __init__(self, conv):
            self.conv, self.turns, self.chars, self.loss_chars, self.valid = conv, 0, 0, 0, True
            self.turn_hash, self.loss_hash, self.open = hashlib.sha256(), hashlib.sha256(), []

        def row(self):
            conv = None if pd.isna(self.conv) else self.conv
            hashes = self.turn_hash.hexdigest(), self.loss_hash.hexdigest()
            return conv, self.turns, hashes[0], self.loss_chars, hashes[1], self.chars, self.valid

        def add(self, segment, last, loss, valid):
            self.open.append(segment)
            self.chars += len(segment)
            self.valid = bool(valid)
            if loss:
                plain = unescape(segment)
                self.loss_chars += len(plain)
                self.loss_hash.update(plain.encode())
            if last:
                role, text = parse_turn("".join(self.open), template)
                self.turn_hash.update(f"{role}\n{text}\n".encode())
                self.turns += 1
                self.open = []

    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def read(frames):
        seen = None
        for frame in frames:
            out = []
            fields = (frame.conv_id, frame.segment, frame.segment_no, frame.loss, frame.valid)
            for conv, segment, n, loss, valid in zip(*fields, strict=True):
                if seen is None or not _same(conv, seen.conv):
                    if seen:
                        out.append(seen.row())
                    seen = Seen(conv)
                seen.add(segment, n == 2, loss, valid)
            yield pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64"})
        if seen:
            yield pd.DataFrame([seen.row()], columns=columns).astype({"conv_id": "Int64"})

    kind = (
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
        " formatted_chars bigint, valid boolean"
    )
    return rows.mapInPandas(read, kind)
