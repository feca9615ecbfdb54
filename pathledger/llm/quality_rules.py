"""Quality rules: fixed limits, and a calibrated n-gram classifier against a fixed threshold."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pathledger.llm.linear import INTERCEPT, Weights, fit, labelled_sample, sigmoid
from pathledger.llm.text import (
    SPACE, byte_codes, chunks, grams, mixed, prefix_sums, small_batches, span_hashes, texts_of, word_hashes,
)

DIMS = 1 << 18
WORD_KINDS = ((), (1,))
CHAR_GRAM = 4
# Mean weights of a kind of features are small numbers; this brings them to the size of logits.
SCALE = 20.0
MAX_LABELLED = 12_000
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_CODES = byte_codes(2)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _ids(hashes, kind):
    return (1 + mixed(hashes + np.uint64(kind * 104729)) % np.uint64(DIMS - 1)).astype(np.int64)


def _char_grams(texts):
    """Ids of all runs of CHAR_GRAM bytes, and each one's text."""
    joined = b" ".join(texts)
    starts = np.arange(max(0, len(joined) - CHAR_GRAM + 1))
    hashes = span_hashes(prefix_sums(_CODES[np.frombuffer(joined, np.uint8)]), starts, starts + CHAR_GRAM)
    begins = np.cumsum([0] + [len(x) + 1 for x in texts])
    owner = np.searchsorted(begins, starts, side="right") - 1
    # A gram that reaches into the space between two texts belongs to neither.
    inside = starts + CHAR_GRAM <= begins[owner + 1] - 1
    return _ids(hashes[inside], 9), owner[inside]


def _kinds(texts):
    """(ids, owner) per kind of feature, for texts of one chunk."""
    hashes, counts = word_hashes(texts, SPACE, fold=False)
    for k, gaps in enumerate(WORD_KINDS):
        found, owner = grams(hashes, counts, gaps)
        yield _ids(found, k), owner
    yield _char_grams(texts)


def features(text):
    """Ids and values of a text: the share of each feature in its kind, scaled."""
    ids, values = [np.array([INTERCEPT])], [np.array([1.0])]
    for found, _ in _kinds([text]):
        known, times = np.unique(found, return_counts=True)
        ids.append(known)
        values.append(SCALE * times / max(1, len(found)))
    ids, values = np.concatenate(ids), np.concatenate(values)
    known, place = np.unique(ids, return_inverse=True)
    return known, np.bincount(place, weights=values)


def margins(texts, weights):
    table = weights.dense()
    out = np.full(len(texts), table[INTERCEPT])
    for first, last in chunks(texts):
        for ids, owner in _kinds(texts[first:last]):
            n = last - first
            total = np.bincount(owner, weights=table[ids], minlength=n)
            out[first:last] += SCALE * total / np.maximum(1, np.bincount(owner, minlength=n))
    return out


def _repeat_words(texts):
    """Words per text, and those in 3-word windows that the text has twice or more."""
    hashes, counts = word_hashes(texts, SPACE, fold=False)
    covered = np.zeros(len(hashes) + 3, bool)
    owner = np.repeat(np.arange(len(texts)), counts)
    n = len(hashes) - 2
    if n > 0:
        window = mixed(mixed(hashes[:n]) + np.uint64(3) * hashes[1 : n + 1])
        window = mixed(window + np.uint64(5) * hashes[2:] + owner[:n].astype(np.uint64))
        at = np.flatnonzero(owner[:n] == owner[2:])
        _, place, times = np.unique(window[at], return_inverse=True, return_counts=True)
        at = at[times[place] > 1]
        for k in range(3):
            covered[at + k] = True
    return counts, np.bincount(owner, weights=covered[: len(hashes)], minlength=len(texts)).astype(np.int64)


def _dup_lines(text):
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            again += line in seen
            seen.add(line)
    return again


def base_counts(texts):
    """The BASE columns of each text."""
    n_words, repeats = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for first, last in chunks(texts):
        n_words[first:last], repeats[first:last] = _repeat_words(texts[first:last])
    plain = [x.decode() for x in texts]
    chars = [len(x) - sum(map(x.count, SPACES)) for x in plain]
    symbols = [sum(map(x.count, SYMBOLS)) for x in plain]
    return n_words, chars, symbols, [_dup_lines(x) for x in plain], repeats


def _platt(margin, label, rounds=50):
    """Slope and offset that make sigmoid(slope * margin + offset) fit the labels, by Newton steps.

    Targets are pulled a little off 0 and 1, so perfectly separated labels give finite values.
    """
    if not len(label) or label.min() == label.max():
        return 1.0, 0.0
    ones = label.sum()
    aim = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    v = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(x @ v)
        pull = x.T @ (p - aim) + 1e-6 * v
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, pull)
        v = v - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(v[0]), float(v[1])


def train(docs, labels, doc_id="doc_id", text="text", label="quality", max_rows=MAX_LABELLED):
    """(weights, slope, offset): fitted on four fifths of the labelled sample, calibrated on the rest.

    The sample has at most ``max_rows`` labelled documents. Without labels everything passes.
    """
    small_batches(docs.sparkSession)
    kind = T.StructType(
        [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))]
    )

    @F.arrow_udf(kind)
    def hashed(texts: pa.Array) -> pa.Array:
        rows = [features(x) for x in texts_of(texts)]
        ids = pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32()))
        return pa.StructArray.from_arrays([ids, pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["ids", "values"])

    sample = labelled_sample(docs, labels, doc_id, label, max_rows)
    fold = F.pmod(F.xxhash64(F.col(f"doc.{doc_id}"), F.lit(3)), F.lit(5))
    sample = sample.withColumn("fold", fold)
    rows = sample.filter("fold > 0").select(hashed(F.col(f"doc.{text}")).alias("x"), "label")
    settings = {"alpha": 0.5, "beta": 0.1, "l1": 0.0, "l2": 0.01}
    weights = Weights(DIMS, *fit(rows.select("x.ids", "x.values", "label"), DIMS, **settings))

    @F.arrow_udf(T.DoubleType())
    def margin(texts: pa.Array) -> pa.Array:
        return pa.array(margins(texts_of(texts), weights))

    # At most max_rows pairs of numbers.
    rest = sample.filter("fold = 0").select(margin(F.col(f"doc.{text}")).alias("m"), "label").toPandas()
    return weights, *_platt(rest["m"].to_numpy(float), rest["label"].to_numpy(float))


def rate(docs: DataFrame, model, text="text", threshold=0.5) -> DataFrame:
    """``docs`` packed as ``doc``, with the counts of the fixed rules and the classifier's verdict.

    Adds n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words,
    base_failed, probability (of good quality) and kept: not failed by the rules, and at
    least ``threshold`` probable. Null and empty texts have no words and fail the rules.
    """
    small_batches(docs.sparkSession)
    weights, slope, offset = model
    known = len(weights.ids) > 0
    kind = T.StructType([*[T.StructField(c, T.LongType()) for c in BASE], T.StructField("probability", T.DoubleType())])

    @F.arrow_udf(kind)
    def rated(array: pa.Array) -> pa.Array:
        texts = texts_of(array)
        columns = [pa.array(c, pa.int64()) for c in base_counts(texts)]
        p = sigmoid(slope * margins(texts, weights) + offset) if known else np.ones(len(texts))
        return pa.StructArray.from_arrays([*columns, pa.array(p)], [*BASE, "probability"])

    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    out = packed.withColumn("rated", rated(F.col(f"doc.{text}"))).select("doc", "rated.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))
