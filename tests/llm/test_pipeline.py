import corpus_pipeline
import pytest


@pytest.fixture
def folder(spark, documents, odd, prose, tmp_path):
    passage = prose(900, 40)
    rows = [*odd, (40, prose(40, 80)), (41, prose(40, 80)), (42, f"{prose(42)} {passage}"), (43, f"{prose(43)} write bob@site.org")]
    labels = []
    for i in range(100, 300):
        toxic = i % 4 == 0
        rows.append((i, prose(i, 40) + " vile scum" * (3 * toxic)))
        labels.append((i, 1, int(toxic)))
    documents(rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_all_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    kept = {r.doc_id: r for r in docs.collect()}
    # Of 3, 4 and 5, all without words, the first stays; 2, 41 and null are copies, 42 is contaminated.
    assert {1, 3, 6, 7, 8, 40, 43} <= set(kept) and not {2, 4, 5, 41, 42, None} & set(kept)
    assert not any(i in kept for i in range(100, 300, 4))
    assert all(i in kept for i in range(100, 300) if i % 4)
    assert kept[43].text.endswith("write [EMAIL]")


def test_the_mix_takes_effect(spark, folder):
    """The words of the rows are those that the mix takes."""
    out = corpus_pipeline.run(spark, folder).collect()
    words = [len(r.text.split()) for r in out]
    taken, sizes = {r.doc_id: r.taken for r in out}, {r.source: r.source_size for r in out}
    assert sum(words) == sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=3)
    assert all(r.taken > 0 and n == min(r["size"], r.taken - (r["copy"] - 1) * r["size"]) for r, n in zip(out, words, strict=True))
    assert len({(r.doc_id, r["copy"]) for r in out}) == len(out) and {r["copy"] for r in out} == {1, 2}
    assert 3 not in taken and sum(n < r["size"] for r, n in zip(out, words, strict=True)) <= len(sizes)


def test_columns_and_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
