"""Quality selection by importance resampling between target and raw text."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pathledger.llm.linear import Weights, labelled_sample
from pathledger.llm.text import SPACE, chunks, grams, mixed, small_batches, texts_of, word_hashes
from pathledger.operators.spread import numbered
from pathledger.session import materialise

BUCKETS = 1 << 16
KINDS = ((), (1,))
MAX_LABELLED = 20_000


def _buckets(texts):
    """Buckets of all words and pairs of words of the texts, and each one's text."""
    hashes, counts = word_hashes(texts, SPACE, fold=False)
    found = [grams(hashes, counts, gaps) for gaps in KINDS]
    ids = [mixed(h + np.uint64(k)) % np.uint64(BUCKETS) for k, (h, _) in enumerate(found)]
    return np.concatenate(ids).astype(np.int64), np.concatenate([owner for _, owner in found])


def gram_counts(texts):
    """How often each bucket occurs in a column of texts: an array of fixed length.

    Counts combine in the tasks before the shuffle.
    """

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            found = texts_of(batch.column(0))
            for first, last in chunks(found):
                total += np.bincount(_buckets(found[first:last])[0], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    sums = texts.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    # A fixed number of rows, BUCKETS.
    sums = sums.toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[sums["bucket"].to_numpy(int)] = sums["n"].to_numpy(int)
    return out


def log_ratios(target, raw):
    """log(target share / raw share) per bucket, one added to each count."""
    return np.log((target + 1) / (target + 1).sum()) - np.log((raw + 1) / (raw + 1).sum())


def resample(
    docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", label="quality", share=None, seed=11,
    max_rows=MAX_LABELLED,
) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, place, kept) per document.

    Target text is documents labelled 1, ``max_rows`` of them at most; raw text is all documents.
    A document's log weight is the sum of log ratios over all its words and pairs of words. With Gumbel noise added, the largest keys are a sample
    without replacement by weight; ``share`` of the documents are kept, by default the share of 1
    among the labels (all without labels). The noise comes from a seeded hash of id and text, so
    reruns agree. Null and empty texts weigh zero; equal keys are ordered by that hash. Repeated
    rows count each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.filter(F.col(label).isin(0, 1))
    row = known.agg(F.avg(label).alias("share")).first()
    share = share if share is not None else (1.0 if row.share is None else row.share)
    packed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    good = labelled_sample(docs, known.filter(F.col(label) == 1), doc_id, label, max_rows)
    target, raw = gram_counts(good.select(f"doc.{text}")), gram_counts(packed.select("text"))
    table = Weights(BUCKETS, np.arange(BUCKETS), log_ratios(target, raw).astype(np.float32))

    @F.arrow_udf(T.DoubleType())
    def weigh(array: pa.Array) -> pa.Array:
        texts = texts_of(array)
        out = np.zeros(len(texts))
        ratios = table.dense()
        for first, last in chunks(texts):
            ids, owner = _buckets(texts[first:last])
            out[first:last] = np.bincount(owner, weights=ratios[ids], minlength=last - first)
        return pa.array(out)

    noise = F.xxhash64("doc_id", "text", F.lit(seed))
    # 53 bits of the hash as a number above 0 and below 1.
    uniform = (F.shiftrightunsigned(noise, 11).cast("double") + 0.5) / float(1 << 53)
    scored = packed.select("doc_id", weigh("text").alias("log_weight"), noise.alias("noise"), uniform.alias("u"))
    scored = scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log("u"))).drop("u")
    scored = materialise(scored, "scores")
    wanted = round(share * scored.count())
    ranked = numbered(scored, [F.desc("gumbel_key"), F.col("noise")], name="place")
    kept = (F.col("place") <= wanted).alias("kept")
    return ranked.select("doc_id", "log_weight", "gumbel_key", "place", kept)
