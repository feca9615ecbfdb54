"""Near duplicates by SimHash and covering locality-sensitive hashing."""

import functools
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from pathledger.llm.components import components
from pathledger.llm.text import small_batches, texts_of
from pathledger.session import materialise

BITS = 64
# Distinct fingerprints of one bucket that are compared in memory; larger buckets are refined.
BUCKET = 2048
_STRIPE = 1 << 16


def _spread_vectors(bits, n):
    """``n`` non-zero vectors of ``bits`` bits, such that every product with them is odd for many."""
    count = (1 << bits) - 1
    if n >= count:
        return [1 + i % count for i in range(n)]

    def fewest(vectors):
        return min(sum((m & v).bit_count() % 2 for m in vectors) for v in range(1, count + 1))

    rng = random.Random(bits * 1000 + n)
    # The vectors of one bit make no product empty, those with the leading bit set make halves.
    tries = [[1 << i for i in range(min(bits, n))] + rng.sample(range(1, count + 1), max(0, n - bits))]
    tries.append([(1 << (bits - 1)) + i % (1 << (bits - 1)) for i in range(n)])
    tries += [rng.sample(range(1, count + 1), n) for _ in range(60)]
    return max(tries, key=fewest)


@functools.cache
def _products(radius, n):
    vectors = _spread_vectors(radius + 1, n)
    return [[i for i, m in enumerate(vectors) if (m & v).bit_count() % 2] for v in range(1, 1 << (radius + 1))]


def covering_masks(radius, positions):
    """2 ** (radius + 1) - 1 bit masks: any ``radius`` positions are left out by some mask.

    Each position i gets a non-zero vector m(i) of radius + 1 bits. Mask v has the positions whose
    vector has an odd product with v. Some non-zero v is orthogonal to any ``radius`` vectors, so
    fingerprints that differ in at most ``radius`` of the positions agree under that mask. A mask
    keeps about half of the positions, and one at least if there are more than ``radius``.
    """
    positions = list(positions)
    return sorted({sum(1 << positions[i] for i in chosen) for chosen in _products(radius, len(positions))})


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def majority_bits(hashes, words=1):
    """Fingerprint words of ``64 * words`` bits: the bits set in over half of the hashes."""
    rows = hashes.reshape(-1, words)
    if not len(rows):
        return [0] * words
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(rows), _STRIPE):
        part = np.ascontiguousarray(rows[at : at + _STRIPE]).view(np.uint8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(rows), bitorder="little")
    return packed.view(np.uint64).tolist()


def shingle_spans(text, size):
    """The words joined by single spaces, and the spans of its shingles, repeats included."""
    words = text.split()
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1 if words else np.zeros(0, np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1)) if words else ends
    if 0 < len(words) < size:
        return joined, [0], [len(joined)]
    return joined, starts[: len(starts) - size + 1].tolist(), ends[size - 1 :].tolist()


def shingle_fingerprint(text, size=4, seed=42):
    """Majority of the XXH64 of all shingles of lower-cased words; no words: zero."""
    joined, starts, ends = shingle_spans(text.lower(), size)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)]
    return majority_bits(np.array(hashes, np.uint64))[0]


def fingerprints(docs: DataFrame, text="text", size=4) -> DataFrame:
    """``docs`` packed as column ``doc``, with the fingerprint ``fp`` of the text as a long."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(T.LongType())
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array([_signed(shingle_fingerprint(x, size)) for x in texts_of(texts)], pa.int64())

    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    return packed.withColumn("fp", fingerprint(F.col(f"doc.{text}")))


def linked(bucket, values, radius):
    """For each row the first row of its class: rows of equal ``bucket`` that links connect.

    ``bucket`` is sorted. Compares each row with the next, the second next and so on in its
    bucket, all rows at once; pairs that are connected already are left out.
    """
    root = np.arange(len(bucket))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    active = np.arange(len(bucket))
    step = 0
    while len(active):
        step += 1
        active = active[active + step < len(bucket)]
        active = active[bucket[active] == bucket[active + step]]
        apart = active[root[active] != root[active + step]]
        hits = apart[np.bitwise_count(values[apart] ^ values[apart + step]) <= radius]
        for i in hits.tolist():
            a, b = find(i), find(i + step)
            root[max(a, b)] = min(a, b)
        if len(hits):
            while not np.array_equal(root, root[root]):
                root = root[root]
    return root


_FOUND = "hot boolean, t int, mask bigint, a bigint, b bigint"


def _linker(masks, radius, bucket_rows):
    """Links within the buckets of sorted batches; rows of too large buckets come back as hot."""
    table = np.array(masks, np.uint64)

    def out(hot, t, a, b):
        columns = [pa.array(np.full(len(t), hot)), pa.array(t)]
        columns += [pa.array(x.view(np.int64)) for x in (table[t], a, b)]
        return pa.RecordBatch.from_arrays(columns, ["hot", "t", "mask", "a", "b"])

    def solve(t, values):
        key = values & table[t]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (key[1:] != key[:-1])
        bucket = np.cumsum(new)
        shared = np.bincount(bucket)[bucket] > 1
        t, bucket, values = t[shared], bucket[shared], values[shared]
        root = linked(bucket, values, radius)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return out(False, t[moved], values[moved], values[root[moved]])

    def star(t, values, centre):
        hit = np.bitwise_count(values ^ centre) <= radius
        yield out(False, t[hit], values[hit], np.full(int(hit.sum()), centre, np.uint64))
        yield out(True, t, values, values)

    def link(batches):
        t, values = np.zeros(0, np.int32), np.zeros(0, np.uint64)
        hot, centre = None, None
        for batch in batches:
            t = np.concatenate((t, batch.column(0).to_numpy(zero_copy_only=False)))
            values = np.concatenate((values, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if not len(t):
                continue
            if hot is not None:
                same = int(((t == hot[0]) & (values & table[t] == hot[1])).sum())
                if same:
                    yield from star(t[:same], values[:same], centre)
                    t, values = t[same:], values[same:]
                if not len(t):
                    continue
                hot = None
            key = values & table[t]
            ends = int(((t == t[-1]) & (key == key[-1])).sum())
            cut = len(t) - ends
            yield solve(t[:cut], values[:cut])
            t, values = t[cut:], values[cut:]
            if len(t) > bucket_rows:
                hot, centre = (t[0], values[0] & table[t[0]]), values[0]
                yield from star(t, values, centre)
                t, values = t[:0], values[:0]
        if len(t):
            yield solve(t, values)

    return link


def classes(rows: DataFrame, radius=4, bucket_rows=BUCKET) -> DataFrame:
    """(fp, class_id) of distinct fingerprints; class_id is a long that all rows of a class share.

    ``rows`` holds the distinct fingerprints ``fp`` as a stored table. Two link if at most
    ``radius`` bits differ; a class is what links connect. Every row goes into one bucket of each
    covering table. Buckets are compared in a stream of sorted rows, and only a spanning forest of
    their links leaves the task. A bucket with more than ``bucket_rows`` rows links its rows to its
    first one; if the rows then still are of several classes, it is cut by covering masks over the
    bits it does not share yet. Every step leaves at most half of the bits, and as many bits as
    the radius tell 2 ** radius rows apart at most, so this ends, and no link is lost.
    """
    spark = rows.sparkSession
    if bucket_rows < 1 << radius:
        raise ValueError("a bucket must hold as many rows as the radius' bits tell apart")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    masks = covering_masks(radius, range(BITS))
    todo = rows.select(F.explode(F.array(*[F.lit(i) for i in range(len(masks))])).alias("t"), "fp")
    # The first masks stand in the plan, so a short number for the table is all a row carries;
    # finer ones are too many for that and come with the rows.
    mask = F.element_at(F.array(*[F.lit(_signed(m)) for m in masks]), F.col("t") + 1)
    links = None
    while True:
        key = F.col("fp").bitwiseAND(mask)
        dealt = todo.repartition(width, "t", key).sortWithinPartitions("t", key, "fp").select("t", "fp")
        found = materialise(dealt.mapInArrow(_linker(masks, radius, bucket_rows), _FOUND), "found")
        new = found.filter("not hot").select("a", "b")
        links = new if links is None else links.union(new)
        joined = components(links)
        labelled = rows.select(F.col("fp").alias("node")).join(joined, "node", "left")
        labelled = labelled.select(F.col("node").alias("fp"), F.coalesce("root", "node").alias("class_id"))
        hot = found.filter("hot").select("t", "mask", F.col("a").alias("fp"))
        if hot.isEmpty():
            return labelled
        # Buckets of one class are done; the others are cut along bits they do not share.
        key = F.col("fp").bitwiseAND(F.col("mask"))
        held = hot.join(labelled, "fp").groupBy("t", key.alias("key"))
        mixed = held.agg(F.min("class_id").alias("low"), F.max("class_id").alias("high"))
        mixed = materialise(mixed.filter("low <> high").select("t", "key"), "mixed")
        # Numbers of masks: one row per table at most.
        uneven = [row.t for row in mixed.select("t").distinct().orderBy("t").collect()]
        if not uneven:
            return labelled
        hot = materialise(hot.withColumn("key", key).join(mixed, ["t", "key"]), "hot")
        finer, cuts = [], []
        for t in uneven:
            rest = [i for i in range(BITS) if not masks[t] >> i & 1]
            more = [masks[t] | m for m in covering_masks(radius, rest)]
            cuts += [(t, len(finer) + i, _signed(m)) for i, m in enumerate(more)]
            finer += more
        cuts = spark.createDataFrame(cuts, "t int, next int, mask bigint")
        todo = hot.select("t", "fp").join(cuts, "t").select(F.col("next").alias("t"), "mask", "fp")
        masks, mask = finer, F.col("mask")


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", radius=4, bucket_rows=BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) per document.

    The fingerprint has 64 bits from all 4-word shingles of the lower-cased text. Documents link
    if at most ``radius`` bits differ; component_id is the least doc_id reachable. Null and empty
    texts have fingerprint zero and are linked like any other. A null doc_id keeps its row; it
    never is a component_id unless its whole component has none (then null). Repeated rows come
    out as often as they came in.
    """
    rows = fingerprints(docs, text).select(F.col(f"doc.{doc_id}").alias("doc_id"), "fp")
    rows = materialise(rows, "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    named = classes(distinct.select("fp"), radius, bucket_rows).join(distinct, "fp")
    least = named.groupBy("class_id").agg(F.min("least").alias("component_id"))
    named = named.join(least, "class_id").select("fp", "component_id")
    joined = rows.join(named, "fp")
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return joined.select("doc_id", fingerprint, "component_id")


def drop_near_duplicates(
    docs: DataFrame, doc_id="doc_id", text="text", size=4, radius=4, bucket_rows=BUCKET
) -> DataFrame:
    """``docs`` with one document of each component of ``near_duplicates``: that of least doc_id.

    Whole texts of any length count, by all their shingles of ``size`` words. Null, empty and blank
    texts have fingerprint zero and link like any other, so one of them stays. A null doc_id comes
    last within its component; equal ids are decided by the hash of the text, and of rows with
    equal id and text one stays. All columns are kept.
    """
    place = [
        F.col(f"doc.{doc_id}").isNull().alias("none"),
        F.coalesce(F.col(f"doc.{doc_id}"), F.lit(0)).alias("id"),
        F.xxhash64(F.col(f"doc.{text}")).alias("hash"),
    ]
    slim = materialise(fingerprints(docs, text, size).select(F.struct(*place).alias("place"), "fp"), "fingerprints")
    distinct = materialise(slim.groupBy("fp").agg(F.min("place").alias("place")), "distinct")
    named = classes(distinct.select("fp"), radius, bucket_rows).join(distinct, "fp")
    kept = named.groupBy("class_id").agg(F.min("place").alias("place")).select("place.*")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc")).select("doc", *place)
    # Of repeated rows each task passes on one, so a row that repeats often is no hot key.
    first = F.row_number().over(Window.partitionBy("none", "id", "hash").orderBy(F.lit(0)))
    single = packed.withColumn("first", first).filter("first = 1").drop("first")
    return single.join(kept, ["none", "id", "hash"], "left_semi").select("doc.*")
