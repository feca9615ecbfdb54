"""Clustering around centroids, the nearest one found by equal-average equal-variance search."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pathledger.llm.vectors import LONG, exact, longs, magnitude, matrix, scaled, whole
from pathledger.session import materialise

# Vectors that are compared at once.
_BLOCK = 4096


class Centroids:
    """Centroids in the order of their component sums, with what the two inequalities need."""

    def __init__(self, centroids):
        """``centroids``: one list of integers each, all of one length."""
        table = np.array(centroids, object)
        self.largest = magnitude(table)
        sums = table.sum(1)
        self.number = np.array(sorted(range(len(table)), key=lambda i: (sums[i], i)))
        self.x = table[self.number]
        self.sums = sums[self.number].astype(float)
        self.spread = _deviation(self.x, self.sums)

    def nearest(self, x):
        """(number, squared distance) of the nearest centroid of each row; ties: the smaller number.

        A search starts at the centroid whose mean is nearest and goes outwards on both sides. For
        vectors of length d with component sums s and deviations v (the length of what is left
        after the mean is taken away), the squared distance is at least (s - s')^2 / d + (v - v')^2. A
        side ends when its first term is above the best distance, as the means only move away; a
        centroid is passed over when both terms together are. What is left is measured in integers.
        """
        rows, width = x.shape
        bound = (magnitude(x) + self.largest) ** 2 * width
        kind = np.int64 if bound <= LONG.max else object
        x, c = x.astype(kind), self.x.astype(kind)
        best = np.full(rows, -1, kind)
        number = np.full(rows, -1)
        sums = exact(x, bound).sum(1).astype(float)
        spread = _deviation(x, sums)
        # Doubles only reject, so their bounds are taken a little lower.
        slack = 1e-9 * (magnitude(x) + self.largest + 1.0) ** 2 * width
        up = np.searchsorted(self.sums, sums)
        sides = {1: up.copy(), -1: up - 1}
        open_ = {1: np.ones(rows, bool), -1: np.ones(rows, bool)}
        while open_[1].any() or open_[-1].any():
            for side, at in sides.items():
                open_[side] &= (at < len(c)) & (at >= 0)
                i = np.flatnonzero(open_[side])
                j = at[i]
                limit = best[i].astype(float)
                mean = (sums[i] - self.sums[j]) ** 2 / width - slack
                first = limit < 0
                ends = ~first & (mean > limit)
                open_[side][i[ends]] = False
                at[i] += side
                near = first | (mean + (spread[i] - self.spread[j]) ** 2 <= limit)
                near &= ~ends
                i, j = i[near], j[near]
                if not len(i):
                    continue
                apart = x[i] - c[j]
                distance = (apart * apart).sum(1)
                better = (best[i] < 0) | (distance < best[i]) | ((distance == best[i]) & (self.number[j] < number[i]))
                best[i[better]], number[i[better]] = distance[better], self.number[j[better]]
        return number, best


def _deviation(x, sums):
    centred = x.astype(float) - (sums / x.shape[1])[:, None]
    return np.sqrt((centred * centred).sum(1))


def _blocks(batches, width):
    for batch in batches:
        for at in range(0, batch.num_rows, _BLOCK):
            part = batch.slice(at, _BLOCK)
            yield part, matrix(part.column("x"), width)


def _updated(vectors, centroids, width):
    """Each centroid replaced by the exact floor of its vectors' mean; empty ones stay."""
    search = Centroids(centroids)

    def partial(batches):
        k = len(centroids)
        totals, counts = np.zeros((k, width), object), np.zeros(k, np.int64)
        for _, x in _blocks(batches, width):
            number, _ = search.nearest(x)
            x = exact(x, magnitude(x) * len(x))
            order = np.argsort(number, kind="stable")
            found, starts = np.unique(number[order], return_index=True)
            totals[found] += np.add.reduceat(x[order], starts, axis=0)
            counts += np.bincount(number, minlength=k)
        used = np.flatnonzero(counts)
        columns = [pa.array(used, pa.int32()), pa.array(counts[used])]
        columns.append(pa.array([[str(v) for v in totals[i]] for i in used], pa.list_(pa.string())))
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "totals"])

    found = vectors.select("x").mapInArrow(partial, "cluster int, n bigint, totals array<string>")
    total = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    by_place = found.select("cluster", "n", F.posexplode("totals").alias("i", "total"))
    # A number per centroid and component, whatever the rows.
    sums = by_place.groupBy("cluster", "i").agg(F.sum("n").alias("n"), total).collect()
    moved = [list(c) for c in centroids]
    for row in sums:
        moved[row.cluster][row.i] = int(row.total) // row.n
    return moved


def first_centroids(vectors: DataFrame, k, seed) -> list:
    """The ``k`` stored vectors of smallest SHA-256 of ``<seed>:<vec_id>``, in that order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    # k rows; equal ids are told apart by their vectors.
    first = vectors.select(hashed.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k)
    return [list(row.x) for row in first.collect()]


def cluster(
    rows: DataFrame, k=8, rounds=10, seed=3, row_id="vec_id", vector="embedding", width=64, factor=1024, carry=None
) -> DataFrame:
    """``doc`` (the row, or its columns ``carry``) with cluster, distance, cluster_inertia, inertia and centroid_sha256.

    Vectors of exactly ``width`` entries, none null or non-finite, take part, as integers
    floor(``factor`` * entry), beyond a long the nearest long; all other rows are left out. The ``k``
    first centroids are vectors chosen by hash; fewer vectors than that make fewer centroids, and
    rows without an id are chosen last. Each of ``rounds`` rounds gives every vector to its nearest
    centroid (squared Euclidean distance; ties: the smaller number) and moves each centroid to the
    exact floor of its vectors' mean, an empty one not at all; then vectors are assigned once more.
    Repeated rows count and come out as often as they are there. Distances and inertias beyond a
    long are exact inside and shown as the nearest long. An empty table gives no rows.

    A round is one pass over the stored vectors in which each task sums up per centroid; tasks get
    the centroids, k * width numbers, and send back as many sums. No row moves between tasks.
    """
    usable = whole(vector) & (F.size(vector) == width)
    packed = rows.filter(usable).select(
        F.struct(*[rows[c] for c in carry or rows.columns]).alias("doc"), F.col(row_id).alias("vec_id"), scaled(vector, factor).alias("x")
    )
    packed = materialise(packed, "vectors")
    centroids = first_centroids(packed, k, seed)
    out = "cluster int, distance decimal(38,0)"
    if not centroids:
        nothing = {"cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
        return packed.select("doc", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()]).limit(0)
    for _ in range(rounds):
        centroids = _updated(packed, centroids, width)
    search = Centroids(centroids)

    @F.arrow_udf(f"struct<{out.replace(' int', ':int').replace(' decimal', ':decimal')}>")
    def assign(lists: pa.Array) -> pa.Array:
        found = [search.nearest(matrix(lists.slice(at, _BLOCK), width)) for at in range(0, len(lists), _BLOCK)]
        number = np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)])
        distance = pa.concat_arrays([_decimals(f[1]) for f in found] or [pa.array([], pa.decimal128(38, 0))])
        return pa.StructArray.from_arrays([pa.array(number, pa.int32()), distance], ["cluster", "distance"])

    assigned = materialise(packed.select("doc", assign("x").alias("at")).select("doc", "at.*"), "assigned")
    # A row per centroid.
    sums = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    digest = F.sha2(F.array_join(F.transform("c", lambda v: v.cast("string")), ","), 256)
    whole_sum = sum(sums.values())
    figures = [(i, _long(t), _long(whole_sum), centroids[i]) for i, t in sums.items()]
    figures = rows.sparkSession.createDataFrame(
        figures, "cluster int, cluster_inertia bigint, inertia bigint, c array<bigint>"
    ).select("cluster", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))
    distance = F.least("distance", F.lit(int(LONG.max)).cast("decimal(38,0)")).cast("bigint").alias("distance")
    # At most k rows.
    joined = assigned.join(F.broadcast(figures), "cluster")
    return joined.select("doc", "cluster", distance, "cluster_inertia", "inertia", "centroid_sha256")


def _long(value):
    return min(value, int(LONG.max))


def _decimals(values):
    if values.dtype == np.int64:
        return pa.array(values).cast(pa.decimal128(38, 0))
    return pa.array([min(int(v), 10**38 - 1) for v in values], pa.decimal128(38, 0))
