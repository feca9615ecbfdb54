"""Exact search for the largest inner products: a ball tree per shard, branch and bound."""

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pathledger.llm.vectors import LONG, exact, longs, magnitude, matrix, scaled, whole
from pathledger.session import materialise

# Rows of a leaf; bytes of a shard's vectors as longs; queries that a task works on at once.
LEAF = 256
SHARD_BYTES = 32 << 20
_QUERIES = 256

_NODE = (
    "width int, node int, leaf boolean, least bigint, centre array<double>, radius double, "
    "ids array<bigint>, x array<bigint>"
)
_HIT = "query_no bigint, query_id bigint, vec_id bigint, score bigint"
# A null id comes after all others among equal scores.
_LAST = LONG.max


def _split(points, ids):
    """The rows in the order of a direction in which they lie far apart; equal ones by id."""
    centre = points.mean(0)
    far = points[np.argmax(((points - centre) ** 2).sum(1))]
    other = points[np.argmax(((points - far) ** 2).sum(1))]
    return np.lexsort((ids, points @ (other - far)))


def ball_tree(x, ids, leaf_rows=LEAF):
    """(node, rows of the leaf or None, least id, centre, radius) of each node of a ball tree.

    The children of node i are 2 * i + 1 and 2 * i + 2, each with half of its rows, so copies of one
    vector do not deepen the tree.
    """
    points = x.astype(float)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        held = points[rows]
        centre = held.mean(0)
        radius = math.sqrt(((held - centre) ** 2).sum(1).max())
        is_leaf = len(rows) <= leaf_rows
        yield node, rows if is_leaf else None, int(ids[rows].min()), centre, radius
        if not is_leaf:
            rows = rows[_split(held, ids[rows])]
            half = len(rows) // 2
            todo += [(2 * node + 1, rows[:half]), (2 * node + 2, rows[half:])]


def _id_order(ids):
    return ids.fill_null(_LAST).to_numpy(zero_copy_only=False)


def _build(leaf_rows):
    """The rows of one task as nodes of ball trees, one tree for each length of vectors."""

    def build(batches):
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        table = pa.Table.from_batches(table).combine_chunks()
        ids, lists = table.column(0).combine_chunks(), table.column(1).combine_chunks()
        widths = lists.value_lengths().to_numpy(zero_copy_only=False)
        shard = TaskContext.get().partitionId()
        for width in np.unique(widths).tolist():
            own = pa.array(np.flatnonzero(widths == width))
            x, own_ids = matrix(lists.take(own), width), ids.take(own)
            for node, rows, least, centre, radius in ball_tree(x, _id_order(own_ids), leaf_rows):
                leaf = rows is not None
                columns = [[shard], [width], [node], [leaf], [least], [centre], [radius]]
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.float64()), pa.float64()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                for values in (own_ids.take(pa.array(rows)), pa.array(x[rows].ravel())) if leaf else (None, None):
                    if values is None:
                        arrays.append(pa.array([None], pa.list_(pa.int64())))
                    else:
                        arrays.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
                names = ["shard", "width", "node", "leaf", "least", "centre", "radius", "ids", "x"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return build


class _Tree:
    """The tree over the vectors of one length in one shard."""

    def __init__(self, rows):
        self.at = {row["node"]: i for i, row in enumerate(rows)}
        self.node = [row["node"] for row in rows]
        self.least = [row["least"] for row in rows]
        self.centre = np.array([row["centre"] for row in rows], float)
        self.radius = np.array([row["radius"] for row in rows])
        width = self.centre.shape[1]
        self.x = {i: row["x"].reshape(-1, width) for i, row in enumerate(rows) if row["leaf"]}
        self.ids = {i: row["ids"] for i, row in enumerate(rows) if row["leaf"]}
        self.order = {i: _id_order(ids) for i, ids in self.ids.items()}
        self.absent = {i: ids.is_null().to_numpy(zero_copy_only=False) for i, ids in self.ids.items()}
        self.largest = magnitude(*self.x.values())
        self.plain = {}

    def leaf(self, i, bound):
        """The vectors of a leaf in numbers that hold products up to ``bound`` exactly."""
        if bound >= 1 << 53:
            return exact(self.x[i], bound)
        if i not in self.plain:
            self.plain[i] = self.x[i].astype(float)
        return self.plain[i]

    def bounds(self, queries):
        """No score of a query in a node is above these; computed in doubles, and rounded up."""
        q = queries.astype(float)
        length = np.linalg.norm(q, axis=1)[:, None]
        reach = length * self.radius
        slack = 1e-12 * self.centre.shape[1] * (length * np.linalg.norm(self.centre, axis=1) + reach)
        return np.floor(q @ self.centre.T + reach + slack)

    def search(self, query, own, bounds, floor, k):
        """The k best (score, id order, absent) that are not below ``floor``, best first."""
        bound = self.largest * magnitude(query) * len(query)
        q = query.astype(float) if bound < 1 << 53 else exact(query, bound)
        scores, order, absent = np.zeros(0, q.dtype), np.zeros(0, np.int64), np.zeros(0, bool)
        last = None
        root = self.at[0]
        heap = [(-bounds[root], self.least[root], root)]
        while heap:
            upper, least, i = heapq.heappop(heap)
            upper = -upper
            # Nodes come by falling bound, then by rising id: nothing better is left behind this one.
            if upper < floor or (last is not None and upper == floor and least > last):
                break
            if i not in self.x:
                for child in (2 * self.node[i] + 1, 2 * self.node[i] + 2):
                    c = self.at[child]
                    heapq.heappush(heap, (-bounds[c], self.least[c], c))
                continue
            found = self.leaf(i, bound) @ q
            good = (found >= floor) & ((self.order[i] != own) | self.absent[i])
            if not good.any():
                continue
            scores = np.concatenate((scores, found[good]))
            order, absent = np.concatenate((order, self.order[i][good])), np.concatenate((absent, self.absent[i][good]))
            best = np.lexsort((absent, order, -scores))[:k]
            scores, order, absent = scores[best], order[best], absent[best]
            if len(scores) == k:
                # A bound in doubles is compared: the floor may be rounded down, never up.
                last = int(order[-1])
                floor = max(floor, scores[-1])
        return scores, order, absent


def _searcher(k):
    """Streams over a shard's nodes, then over its queries, in which only a batch is held at once."""

    def search(batches):
        shard, rows, trees = None, {}, None
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            shards = column["shard"].to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if shards[a] != shard:
                    shard, rows, trees = shards[a], {}, None
                here = {name: values.slice(a, b - a) for name, values in column.items()}
                asks = here["query_no"].is_valid().to_numpy(zero_copy_only=False)
                nodes = np.flatnonzero(~asks)
                for i in nodes.tolist():
                    row = {n: here[n][i].as_py() for n in ("width", "node", "leaf", "least", "radius")}
                    row["centre"] = here["centre"][i].values.to_numpy()
                    if row["leaf"]:
                        row["ids"], row["x"] = here["ids"][i].values, here["x"][i].values.to_numpy()
                    rows.setdefault(row["width"], []).append(row)
                if len(nodes) == b - a:
                    continue
                if trees is None:
                    trees, rows = {width: _Tree(found) for width, found in rows.items()}, {}
                yield from _answers(trees, {n: v.filter(pa.array(asks)) for n, v in here.items()}, k)

    return search


def _answers(trees, asked, k):
    widths = asked["x"].value_lengths().to_numpy(zero_copy_only=False)
    for width in np.unique(widths).tolist():
        tree = trees.get(width)
        if tree is None:
            continue
        own = pa.array(np.flatnonzero(widths == width))
        queries = matrix(asked["x"].take(own), width)
        number, ids = (asked[n].take(own).to_numpy(zero_copy_only=False) for n in ("query_no", "query_id"))
        floors = asked["floor"].take(own).to_pylist()
        for at in range(0, len(queries), _QUERIES):
            part = slice(at, at + _QUERIES)
            bounds = tree.bounds(queries[part])
            hits = []
            for j, query in enumerate(queries[part], at):
                floor = -math.inf if floors[j] is None else floors[j]
                scores, order, absent = tree.search(query, ids[j], bounds[j - at], floor, k)
                hits.append((np.full(len(scores), j), order, absent, longs(scores.astype(np.int64) if scores.dtype == float else scores)))
            j, order, absent, scores = (np.concatenate(c) for c in zip(*hits, strict=True))
            columns = [pa.array(number[j]), pa.array(ids[j]), pa.array(order, mask=absent), pa.array(scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["query_no", "query_id", "vec_id", "score"])


def shards_of(rows, leaf_rows=LEAF):
    """How many shards the stored vectors make: as many as tasks run well, and none too large for one."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("width")).first()
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size.n * size.width * 8 // SHARD_BYTES), min(width, size.n // (2 * leaf_rows)))


def build_index(rows: DataFrame, shards, leaf_rows=LEAF) -> DataFrame:
    """The nodes of the shards' ball trees as a stored table; rows are dealt evenly, copies as well."""
    built = rows.repartition(shards).mapInArrow(_build(leaf_rows), f"shard int, {_NODE}")
    return materialise(built, "index")


def nearest(
    rows: DataFrame, queries: DataFrame, k=10, row_id="vec_id", vector="embedding", factor=1024, leaf_rows=LEAF
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest integer inner product per query.

    Entries count as floor(``factor`` * entry), beyond a long as the nearest long. Candidates of a
    query are all rows but those of its own id; rows of other lengths have no product with it. Ties
    go to the smaller id, a null id is the last of all. Repeated rows are candidates each for
    itself, while equal queries are answered once; different vectors under one id are queries of their
    own and give a list each. Rows and queries whose vector is null or holds null or non-finite entries
    take no part, nor do queries without an id. A query without candidates has no rows, one with few has
    fewer than ``k``. Products beyond a long are compared exactly and shown as the nearest long.

    Rows are dealt over shards, each with a ball tree that fits a task. A query visits the nodes
    of a tree by falling upper bound q * centre + |q| * radius, until none can hold one of its
    best ``k``. The k-th score goes on to other shards: first each query searches one shard, then
    with that score a few more, then with the best score so far all others, which only look at
    nodes, and return rows, that still matter. Nothing of rows or queries passes through the driver.
    """
    vectors = rows.filter(whole(vector)).select(F.col(row_id).alias("vec_id"), scaled(vector, factor).alias("x"))
    vectors = materialise(vectors.filter(F.size("x") > 0), "vectors")
    shards = shards_of(vectors, leaf_rows)
    index = build_index(vectors, shards, leaf_rows)
    asked = queries.filter(whole(vector)).select(F.col(row_id).alias("query_id"), scaled(vector, factor).alias("x"))
    asked = asked.filter(F.col("query_id").isNotNull() & (F.size("x") > 0)).distinct()
    # Stored, so that a query keeps its number whatever is computed again.
    asked = materialise(asked.select(F.monotonically_increasing_id().alias("query_no"), "query_id", "x"), "queries")
    # Where a query starts; the shards are equal, so any spread will do.
    home = F.pmod(F.xxhash64("query_no"), F.lit(shards))
    nodes = index.select("*", *[F.lit(None).cast("bigint").alias(c) for c in ("query_no", "query_id", "floor")])
    hits = None
    few = math.isqrt(shards)
    for start, stop in ((0, 1), (1, 1 + few), (1 + few, shards)):
        stop = min(stop, shards)
        if start >= stop:
            break
        floor = F.lit(None).cast("bigint")
        todo = asked
        if hits is not None:
            best = _best(hits, k).groupBy("query_no").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
            todo = asked.join(best, "query_no", "left")
            floor = F.when(F.col("n") >= k, F.col("least"))
        step = F.explode(F.sequence(F.lit(start), F.lit(stop - 1))).alias("step")
        todo = todo.select("query_no", "query_id", "x", floor.alias("floor"), step)
        shard = F.pmod(home + F.col("step"), F.lit(shards)).cast("int").alias("shard")
        todo = todo.select(shard, "query_no", "query_id", "x", "floor")
        both = nodes.unionByName(todo, allowMissingColumns=True).repartitionById(shards, F.col("shard"))
        # Nodes have no query number, so they come first.
        dealt = both.sortWithinPartitions("shard", F.col("query_no").asc_nulls_first())
        found = materialise(dealt.mapInArrow(_searcher(k), _HIT), "hits")
        hits = found if hits is None else hits.union(found)
    best = _best(hits, k)
    return best.select("query_id", "rank", "vec_id", "score")


def _best(hits, k):
    """The k best hits of each query; every shard sends ``k`` at most."""
    order = Window.partitionBy("query_no").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
