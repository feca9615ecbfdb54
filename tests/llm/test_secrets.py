import random

from pathledger.llm import secrets


def rows_of(prose):
    rng = random.Random(1)
    code = lambda n, chars="0123456789abcdef": "".join(rng.choice(chars) for _ in range(n))
    true, false = [], []
    for i in range(40):
        true.append((i, f'{prose(i)} token = "{code(40)}" {prose(i + 1)}'))
        true.append((100 + i, f"{prose(i)} password={code(18)} {prose(i)}"))
        true.append((200 + i, f"{prose(i)} AKIA{code(16, 'ABCDEFGHIJKLMNOP234567')} {prose(i)}"))
        false.append((300 + i, f"{prose(i)} {code(16, '0123456789')} {prose(i)}"))
    return true, false


def test_false_positives_go(spark, documents, odd, prose):
    true, false = rows_of(prose)
    found = secrets.scan(documents(odd + true + false)).collect()
    assert {r.doc_id for r in found if r.secret} == {i for i, _ in true}
    assert {r.doc_id for r in found if not r.secret} >= {i for i, _ in false}
    words = dict(true + false)
    for r in found:
        assert r.value in words[r.doc_id].split()[r.word_no]


def test_labelled_findings_and_odd_tables(spark, documents, odd, prose):
    true, false = rows_of(prose)
    rows = secrets.materialise(secrets.features(secrets.candidates(documents(true + false)), secrets.dictionary(documents([]), secrets.candidates(documents(true)))))
    one_kind = rows.withColumn("label", secrets.F.lit(0.0))
    assert not any(r.secret for r in secrets.remove_false_positives(rows, one_kind).collect())
    assert all(r.secret for r in secrets.remove_false_positives(rows, one_kind.limit(0)).collect())
    assert secrets.scan(documents([])).collect() == []
    assert secrets.scan(documents(odd)).collect() == []
    plan = secrets.scan(documents(true + false))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_every_run_of_a_word_is_a_candidate(spark, documents):
    one, two = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLE1", "24be0f6c9d1a4b7e8f3021cc"
    rows = [
        (1, f"run aws_secret_access_key={one} now"), (2, f'DATABASE_ACCESS_TOKEN="{two}"'),
        (3, f'x {{"access_token":"{one}","refresh_token":"{two}","again":"{two}"}} y'), (4, "aws_secret_access_key=short1"),
        (5, f"{one},{two}"),
    ]
    found = sorted((r.doc_id, r.word_no, r.head, r.value) for r in secrets.candidates(documents(rows)).collect())
    assert found == sorted([
        (1, 1, "aws_secret_access_key=", one), (2, 0, 'DATABASE_ACCESS_TOKEN="', two),
        (3, 1, '{"access_token":"', one), (3, 1, f'{one}","refresh_token":"', two), (3, 1, f'{two}","again":"', two),
        (5, 0, "", one), (5, 0, f"{one},", two),
    ])


def test_secrets_by_long_names_and_two_in_a_word_are_found(spark, documents, prose):
    true, false = rows_of(prose)
    code = lambda i: f"{random.Random(i).getrandbits(128):032x}"
    true += [(400 + i, f"{prose(i)} aws_secret_access_key={code(i)} {prose(i)}") for i in range(20)]
    pairs = [(500 + i, f'{prose(i)} {{"access_token":"{code(100 + i)}","refresh_token":"{code(200 + i)}"}} {prose(i)}') for i in range(20)]
    found = [(r.doc_id, r.value) for r in secrets.scan(documents(true + false + pairs)).collect() if r.secret]
    assert {i for i, _ in found} == {i for i, _ in true + pairs}
    assert sum(i >= 500 for i, _ in found) == 40


def test_short_values_and_phrases_given_to_a_name_are_found(spark, documents, prose):
    true, false = rows_of(prose)
    given = {
        600: "password = hunter2hunter2", 601: 'DB_PASSWORD="correcthorsebatterystaple"', 602: "token: Xk9$mQ2!vL7@pR4#",
        603: "{'api_key':'s3cr3t!9x'}",
    }
    plain = {700: "the token: nothing here", 701: "a password is required", 702: "password: https://example.com/reset", 703: "token = short1"}
    rows = [(i, f"{prose(i)} {words} {prose(i + 1)}") for i, words in (given | plain).items()]
    values = {(r.doc_id, r.value) for r in secrets.candidates(documents(rows)).collect()}
    assert values == {
        (600, "hunter2hunter2"), (601, "correcthorsebatterystaple"), (602, "Xk9$mQ2!vL7@pR4#"), (603, "s3cr3t!9x"),
    }
    found = secrets.scan(documents(true + false + rows)).collect()
    assert {r.doc_id for r in found if r.secret} == {i for i, _ in true} | set(given)


def test_twice_the_corpus_gives_the_same_findings(spark, documents, prose):
    true, false = rows_of(prose)
    rows = true + false + [(800 + i, f"{prose(i)} quick-brown-fox-release-{2000 + i} {prose(i)} quick brown fox release") for i in range(8)]
    columns = ["doc_id", "value", *secrets.FEATURES, "secret"]
    once = sorted(tuple(r[c] for c in columns) for r in secrets.scan(documents(rows)).collect())
    twice = sorted(tuple(r[c] for c in columns) for r in secrets.scan(documents(rows + rows)).collect())
    assert twice == sorted(once + once)
    assert all(r[2 + secrets.FEATURES.index("coverage")] > 0.5 for r in once if r[0] >= 800)
