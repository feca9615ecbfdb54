"""The registered models against plain Python loops over the smallest given tables."""

import heapq
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pathledger.llm import quality_select, text as words, toxicity
from pathledger.llm.queries import QUERIES
from pyspark.sql import functions as F

ALL = (1 << 64) - 1
CODES = [int(c) for c in words.byte_codes(1)]


def spread(h):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> 33)) * factor & ALL
    return h ^ (h >> 33)


def word_hash(word):
    power, total = 1, 0
    for byte in word:
        total, power = total + CODES[byte] * power, power * 0x9E3779B97F4A7C15 & ALL
    return spread(total & ALL)


def tuples(found, gap):
    """Hashes of single words (gap 0), or of pairs that are ``gap`` apart."""
    if not gap:
        return found
    return [spread(a * (0x9FB21C651E98DF25 + 2 * gap) + b & ALL) for a, b in zip(found, found[gap:])]


def rows_of(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic_features(text):
    found = [word_hash(w) for w in re.findall(b"[a-z0-9\x80-\xff]+", (text or "").encode().lower())]
    return {0} | {1 + spread(h + k * 7919 & ALL) % (toxicity.DIMS - 1) for k, gap in enumerate((0, 1, 2)) for h in tuples(found, gap)}


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def plain_ftrl(examples, alpha=1.0, beta=1.0, l1=8.0, l2=1.0, epochs=6):
    z, n = Counter(), Counter()

    def weight(i):
        least = 0.0 if i == 0 else l1
        if abs(z[i]) <= least:
            return 0.0
        return -(z[i] - math.copysign(least, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(5)
    for _ in range(epochs):
        for at in order.permutation(len(examples)):
            ids, label = examples[at]
            w = {i: weight(i) for i in ids}
            g = sigmoid(sum(w.values())) - label
            for i in ids:
                rate = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - rate * w[i]
                n[i] += g * g
    return {i: weight(i) for i in n}


def test_toxicity_equals_a_plain_loop(spark, sf_dir):
    labels = {}
    for r in rows_of(spark, sf_dir, "labels").collect():
        if r.toxic in (0, 1) and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.toxic)
    docs = rows_of(spark, sf_dir, "documents").collect()
    features = {d.doc_id: toxic_features(d.text) for d in docs}
    examples = [(sorted(features[i]), label) for i, label in labels.items() if i in features]
    keyed = spark.createDataFrame(examples, "ids array<int>, label int").orderBy(F.xxhash64("ids", "label"))
    learnt = plain_ftrl([(r.ids, r.label) for r in keyed.collect()])
    found = QUERIES["op10_toxicity"](spark, sf_dir).collect()
    assert len(found) == len(docs) and len(learnt) > 1
    for r in found:
        assert r.score == pytest.approx(sigmoid(sum(learnt.get(i, 0.0) for i in features[r.doc_id])), abs=1e-6)


def test_quality_selection_equals_a_plain_ratio(spark, sf_dir):
    labels = [r for r in rows_of(spark, sf_dir, "labels").collect() if r.quality in (0, 1)]
    good = {r.doc_id for r in labels if r.quality == 1}
    share = sum(r.quality for r in labels) / len(labels)
    noise = F.xxhash64("doc_id", "text", F.lit(11)).alias("noise")
    docs = rows_of(spark, sf_dir, "documents").select("doc_id", "text", noise).collect()
    counts, target, raw = {}, Counter(), Counter()
    for d in docs:
        found = [word_hash(w) for w in (d.text or "").encode().split()]
        ids = (spread(h + k & ALL) % quality_select.BUCKETS for k, gap in enumerate((0, 1)) for h in tuples(found, gap))
        counts[d.doc_id] = Counter(ids)
        raw.update(counts[d.doc_id])
        if d.doc_id in good:
            target.update(counts[d.doc_id])
    wholes = [sum(c.values()) + quality_select.BUCKETS for c in (target, raw)]

    def key(d):
        weight = sum(n * (math.log((target[b] + 1) / wholes[0]) - math.log((raw[b] + 1) / wholes[1])) for b, n in counts[d.doc_id].items())
        uniform = (((d.noise & ALL) >> 11) + 0.5) / (1 << 53)
        return weight - math.log(-math.log(uniform))

    keys = {d.doc_id: key(d) for d in docs}
    found = {r.doc_id: r for r in quality_select.resample(rows_of(spark, sf_dir, "documents"), rows_of(spark, sf_dir, "labels")).collect()}
    assert {i: r.gumbel_key for i, r in found.items()} == pytest.approx(keys, abs=1e-2)
    kept = heapq.nlargest(round(share * len(docs)), keys, key=keys.get)
    assert {i for i, r in found.items() if r.kept} == set(kept)
