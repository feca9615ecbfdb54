import re

from pathledger.llm import decontaminate


def shingles(text, n=5):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows, items):
    out = []
    for doc, text in rows:
        for item, passage in items:
            n = min(5, len(re.findall(r"[^\W_]+", (passage or "").lower())))
            wanted = shingles(passage, n) if n else set()
            shared = len(wanted & shingles(text, n)) if n else 0
            if wanted and shared >= 0.8 * len(wanted) - 1e-9:
                out.append((doc, item, shared, len(wanted)))
    return sorted(out, key=repr)


def found(spark, docs, items):
    table = spark.createDataFrame(items, "item_id bigint, text string").withColumn("key", decontaminate.F.lit(1))
    rows = decontaminate.find_contamination(docs, table).collect()
    return sorted(map(tuple, rows), key=repr)


def items(prose):
    return [(i, prose(1000 + i, 12 + i)) for i in range(30)]


def test_equals_brute_force(spark, documents, odd, prose):
    passages = items(prose)
    rows = list(odd)
    for i, text in passages:
        words = text.split()
        words[i % len(words)] = "edit"
        rows.append((100 + i, f"{prose(i, 40 + 300 * (i % 3))} {text.upper()}, {prose(i + 1, 20)}"))
        rows.append((200 + i, f"{prose(i, 40)} ({' '.join(words)})."))
        rows.append((300 + i, f"{prose(i, 40)} {' '.join(words[: 8 + i // 2])}"))
    rows += [(None, passages[3][1]), (101, rows[12][1])]
    expected = brute(rows, passages)
    assert len(expected) > 40
    assert found(spark, documents(rows), passages) == expected


def test_short_repeated_and_empty_items(spark, documents, prose):
    passages = [(1, "alpha beta"), (2, "one two three four five six"), (3, ""), (4, None), (5, "alpha beta"), (None, "omega")]
    rows = [(1, f"{prose(1)} Alpha, beta {prose(2)}"), (2, "one two three four five six"), (3, "omega"), (4, ""), (5, None)]
    assert found(spark, documents(rows), passages) == brute(rows, passages)


def test_clean_documents_stay(spark, documents, odd, prose):
    passages = items(prose)
    docs = documents([*odd, (50, f"{prose(3)} {passages[0][1]}")])
    table = spark.createDataFrame(passages, "item_id bigint, text string")
    kept = decontaminate.drop_contaminated(docs, table)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == sorted((i or -1) for i, _ in odd)


def test_empty_tables(spark, documents, prose):
    assert found(spark, documents([]), items(prose)) == []
    assert found(spark, documents([(1, prose(1))]), []) == []


def test_built_ins_only(spark, documents, prose):
    table = spark.createDataFrame(items(prose), "item_id bigint, text string")
    plan = decontaminate.drop_contaminated(documents([(1, prose(1))]), table)
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
