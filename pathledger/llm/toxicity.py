"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pathledger.llm.linear import INTERCEPT, Weights, fit, labelled_sample, sigmoid
from pathledger.llm.text import chunks, grams, mixed, small_batches, texts_of, word_hashes

DIMS = 1 << 20
# Words, pairs of neighbours, pairs with one word between them.
KINDS = ((), (1,), (2,))
# Without labels nothing is known to be toxic.
UNKNOWN = -4.0
MAX_LABELLED = 12_000


def held_out(doc_id):
    """A fifth of the ids, from which nothing is learnt; a null id is not held out."""
    part = F.crc32(doc_id.cast("string").cast("binary")) % 5
    return F.coalesce(part == 0, F.lit(False))


def _ids(hashes, kind):
    return (1 + mixed(hashes + np.uint64(kind * 7919)) % np.uint64(DIMS - 1)).astype(np.int64)


def feature_ids(text):
    """The distinct features of a text, the intercept first."""
    hashes, counts = word_hashes([text])
    found = [_ids(grams(hashes, counts, gaps)[0], k) for k, gaps in enumerate(KINDS)]
    return np.unique(np.concatenate([[INTERCEPT], *found]))


def margins(texts, weights):
    """The sum of the weights of each text's distinct features."""
    table = weights.dense()
    out = np.full(len(texts), table[INTERCEPT] if len(weights.ids) else UNKNOWN)
    for first, last in chunks(texts):
        hashes, counts = word_hashes(texts[first:last])
        kept = []
        for k, gaps in enumerate(KINDS):
            found, owner = grams(hashes, counts, gaps)
            ids = _ids(found, k)
            # Most weights are zero.
            known = np.flatnonzero(table[ids])
            kept.append(owner[known] * DIMS + ids[known])
        kept = np.unique(np.concatenate(kept))
        out[first:last] += np.bincount(kept // DIMS, weights=table[kept % DIMS], minlength=last - first)
    return out


def train(docs, labels, doc_id="doc_id", text="text", label="toxic", max_rows=MAX_LABELLED):
    """Weights from the labelled documents that are not held out, ``max_rows`` of them at most."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, doc_id, label, max_rows, keep=lambda c: ~held_out(c))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([feature_ids(x).astype(np.int32) for x in texts_of(texts)], pa.list_(pa.int32()))

    rows = sample.select(features(F.col(f"doc.{text}")).alias("ids"), "label")
    # One learner: a feature must gather evidence from the whole sample to get past l1.
    settings = {"alpha": 1.0, "beta": 1.0, "l1": 8.0, "l2": 1.0}
    return Weights(DIMS, *fit(rows, DIMS, shards=1, epochs=6, **settings))


def score(docs: DataFrame, weights, text="text") -> DataFrame:
    """``docs`` packed as column ``doc``, with the toxicity ``score`` from 0 to 1.

    Whole texts are scored; null and empty ones get the score of the intercept alone.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf(T.DoubleType())
    def toxic(texts: pa.Array) -> pa.Array:
        return pa.array(sigmoid(margins(texts_of(texts), weights)))

    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    return packed.withColumn("score", toxic(F.col(f"doc.{text}")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold=0.5, **names) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more. Every other row stays as it is."""
    weights = train(docs, labels, **names)
    scored = score(docs, weights, names.get("text", "text"))
    return scored.filter(F.col("score") < threshold).select("doc.*")
