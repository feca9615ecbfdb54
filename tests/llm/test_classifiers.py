import re
import zlib
from collections import Counter

import pytest
from pathledger.llm import quality_rules, quality_select, toxicity
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def marked(spark, documents, odd, prose):
    """Every third text is bad: it has one of few words several times, and junk marks."""
    rows, labels = list(odd), [(1, 1, 0), (None, 1, 1), (2, None, None), (4, 1, 0), (10_000, 0, 1)]
    for i in range(100, 700):
        words = prose(i, 70).split()
        bad = i % 3 == 0
        if bad:
            for k in range(0, 60, 9):
                words[k] = ("vile", "Scum,", "grim")[k % 3]
            words = [w + "$$$" * (k % 4 == 0) for k, w in enumerate(words)]
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(not bad), int(bad)))
    return documents(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), rows


def bad(i):
    return i is not None and 100 <= i < 700 and i % 3 == 0


def test_toxicity_on_held_out_rows(spark, marked):
    docs, labels, rows = marked
    found = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(found) == len(rows)
    assert all(0 <= r.score <= 1 for r in found)
    wrong = [r.doc.doc_id for r in found if (r.score >= 0.5) != bad(r.doc.doc_id)]
    assert len(wrong) < 6
    ids = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in ids)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert not any(bad(r.doc_id) for r in kept.collect() if r.doc_id not in wrong)


def test_toxicity_learns_nothing_from_held_out_labels(spark, marked):
    docs, labels, _ = marked
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert a.ids.tolist() == b.ids.tolist() and a.weights.tolist() == b.weights.tolist()


def base(text):
    """The contract's counts, by plain loops."""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_quality_rules(spark, marked, documents, prose):
    docs, labels, rows = marked
    more = [(1000, "a b c a b c a\n\na b c\n \na b c"), (1001, "é ü " * 40), (1002, "x\ny\nx\r\nx\n" * 30), (1003, f"{prose(1)}\n{prose(2)}\n{prose(1)}")]
    found = quality_rules.rate(docs.unionByName(documents(more)), quality_rules.train(docs, labels)).collect()
    texts = sorted([(i, t or "") for i, t in rows + more], key=repr)
    assert sorted([(r.doc.doc_id, r.doc.text or "") for r in found], key=repr) == texts
    for r in found:
        counts = base(r.doc.text or "")
        assert tuple(r[c] for c in quality_rules.BASE) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.kept and r.base_failed)
    judged = [r for r in found if not r.base_failed and r.doc.doc_id and 100 <= r.doc.doc_id < 700]
    assert sum(r.kept == bad(r.doc.doc_id) for r in judged) < 6


def test_quality_selection(spark, marked):
    docs, labels, rows = marked
    found = quality_select.resample(docs, labels, share=0.66).collect()
    assert len(found) == len(rows)
    assert sum(r.kept for r in found) == round(0.66 * len(rows))
    assert sorted(r.place for r in found) == list(range(1, len(rows) + 1))
    mine = [r for r in found if r.doc_id and 100 <= r.doc_id < 700]
    assert sum(r.kept == bad(r.doc_id) for r in mine) < 25
    assert all(r.log_weight == 0 for r in found if r.doc_id in (3, 4, 5))
    keys = sorted(((r.doc_id, r.gumbel_key) for r in found), key=repr)
    again = quality_select.resample(docs.repartition(3), labels, share=0.66).collect()
    assert [(a, pytest.approx(b)) for a, b in keys] == sorted(((r.doc_id, r.gumbel_key) for r in again), key=repr)


def test_no_labels_and_no_documents(spark, documents, odd):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs, none = documents(odd), documents([])
    assert toxicity.drop_toxic(docs, labels).count() == len(odd)
    assert {r.probability for r in quality_rules.rate(docs, quality_rules.train(docs, labels)).collect()} == {1.0}
    assert all(r.kept for r in quality_select.resample(docs, labels).collect())
    assert toxicity.drop_toxic(none, labels).count() == 0
    assert quality_rules.rate(none, quality_rules.train(none, labels)).count() == 0
    assert quality_select.resample(none, labels).count() == 0
