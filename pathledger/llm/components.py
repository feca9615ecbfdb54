"""Connected components by joins and grouping; no task or driver ever holds the graph."""

from pyspark.sql import DataFrame, functions as F

from pathledger.session import materialise


def _large_star(links):
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    larger = both.filter("b > a").join(least, "a")
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links):
    # Here a > b holds for every link.
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links):
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the least node reachable.

    Alternates two star operations, which point every neighbour of a node to the least one, until
    nothing changes. That takes few rounds (about the logarithm of the longest chain). Each round
    is a written table, so lost executors cost one round. Links with a null end or to itself are
    left out.
    """
    ordered = links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    current = materialise(ordered.distinct(), "links")
    state = _state(current)
    while state[0]:
        current = materialise(_small_star(_large_star(current)), "links")
        previous, state = state, _state(current)
        if state == previous:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
