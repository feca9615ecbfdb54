"""Building blocks that stay balanced when one key holds a large share of the rows."""

from pyspark.sql import DataFrame, Window, functions as F

from pathledger.functions.paths import _col
from pathledger.session import materialise

# The most frequent keys with this many rows count as hot, at most HOT_KEYS of them. Any other
# key holds fewer rows than this, or less than one in HOT_KEYS of all rows.
HOT_ROWS = 200_000
HOT_KEYS = 1_000


def _shuffle_width(df):
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _row_counts(df, keys, name):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def hot_keys(df: DataFrame, keys, hot_rows=None) -> DataFrame:
    """Keys too frequent for one task, at most ``HOT_KEYS``, from exact counts."""
    floor = HOT_ROWS if hot_rows is None else hot_rows
    # NULL keys join nothing. Leaving them out also makes this the shuffle that the join repeats.
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    frequent = _row_counts(df, keys, "_rows").filter(F.col("_rows") >= floor)
    return frequent.orderBy(F.desc("_rows"), *keys).limit(HOT_KEYS).select(*keys)


def lookup(left, right, keys, how="inner", hot_rows=None, left_rows=None) -> DataFrame:
    """Join one row per key of ``right`` to ``left``, where a key may be hot.

    Rows of the hot keys stay where they are and meet a broadcast of their few right rows; all
    other rows meet the right side in a shuffle, where adaptive execution cuts what is left of
    skew on the left side. Both ways give all rows. The right side is reduced to one row per key
    first, which bounds the broadcast; where it comes from an aggregate that costs no shuffle.
    The keys must not be NULL in a left outer join. ``left_rows``, an upper bound of the rows of
    ``left`` if the caller knows one, saves the search for hot keys when it is small.
    """
    right = right.dropDuplicates(keys)
    if left_rows is not None and left_rows < (HOT_ROWS if hot_rows is None else hot_rows):
        return left.join(right, keys, how)
    # At most HOT_KEYS rows each: the hot keys, and their rows of ``right``.
    hot = F.broadcast(hot_keys(left, keys, hot_rows))
    hot_right = F.broadcast(right.join(hot, keys, "left_semi"))
    hot_rows = left.join(hot, keys, "left_semi").join(hot_right, keys, how)
    other_rows = left.join(hot, keys, "left_anti").join(right, keys, how)
    return other_rows.unionByName(hot_rows)


def group_sizes(df: DataFrame, key, name, at_least=1, hot_rows=None) -> DataFrame:
    """Every row of the keys with ``at_least`` rows, with the number of rows of its key."""
    sizes = _row_counts(df, [key], name).filter(F.col(name) >= at_least)
    return lookup(df, sizes, [key], hot_rows=hot_rows)


def _sliced(df, group, order):
    """``df`` cut into ranges of (group, order), sorted inside, with the number of the range.

    The result is stored: all readers must see the same cut.
    """
    cut = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    place = F.monotonically_increasing_id().alias("_place")
    return materialise(cut.select("*", F.spark_partition_id().alias("_slice"), place), "slices")


def _on_slices(sliced, starts, group):
    """Join each row with the figures of its group's slice; a NULL group is a group like any other."""
    named = starts.select(*[F.col(c).alias(f"_of_{c}") if c in [*group, "_slice"] else F.col(c) for c in starts.columns])
    same = F.col("_slice") == F.col("_of__slice")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return sliced.join(named, same)


def _starts(sums, group, names):
    """What the slices before each slice of a group add up to."""
    # A group has at most one row per slice here.
    earlier = Window.partitionBy(*group or [F.lit(0)]).orderBy("_slice")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    return [
        F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_start_{name}")
        for name in names
    ]


def numbered(df: DataFrame, order, group=(), name="row_no") -> DataFrame:
    """Rows numbered from 1 in ``order`` within ``group``, for groups of any size.

    A range shuffle cuts and sorts the rows, and a row's place in its slice is stored with it.
    Its number is that place, counted from the first row of the group in the slice, after the
    rows of the group in earlier slices. ``order`` must be unique within a group.
    """
    group = list(group)
    sliced = _sliced(df, group, list(order))
    sums = sliced.groupBy(*group, "_slice").agg(
        F.count(F.lit(1)).alias("_sum_rows"), F.min("_place").alias("_first")
    )
    starts = sums.select(*group, "_slice", "_first", *_starts(sums, group, ["rows"]))
    number = F.col("_start_rows") + F.col("_place") - F.col("_first") + 1
    joined = _on_slices(sliced, starts, group)
    return joined.select(*df.columns, number.alias(name))


def running_totals(df: DataFrame, order, totals, group=()) -> DataFrame:
    """Running sums over ``order`` within ``group``, for groups of any size.

    Each slice of a range shuffle adds up its own rows and starts from the sum of the earlier
    slices of its group. ``order`` must be unique within a group. ``totals`` maps a new column to
    the number summed.
    """
    group, order = list(group), list(order)
    sliced = _sliced(df, group, order)
    sums = sliced.groupBy(*group, "_slice").agg(
        *[F.sum(_col(value)).alias(f"_sum_{name}") for name, value in totals.items()]
    )
    starts = sums.select(*group, "_slice", *_starts(sums, group, totals))
    inside = Window.partitionBy(*group, "_slice").orderBy("_place")
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    for name, value in totals.items():
        sliced = sliced.withColumn(f"_here_{name}", F.sum(_col(value)).over(inside))
    joined = _on_slices(sliced, starts, group)
    return joined.select(
        *df.columns,
        *[(F.col(f"_start_{name}") + F.col(f"_here_{name}")).alias(name) for name in totals],
    )


def first_rows(df: DataFrame, n, order, group=()) -> DataFrame:
    """The first ``n`` rows per group, thinned in rounds.

    A round keeps ``n`` rows per group within each of many parts of the input, and Spark applies
    that limit before the shuffle as well. Fewer parts follow, then one: no task ever takes in
    the survivors of all input splits at once.
    """
    width = _shuffle_width(df)
    kept = df.withColumn("_split", F.spark_partition_id())
    for parts in [width, 64, 1] if width > 64 else [width, 1]:
        part = F.pmod(F.col("_split"), F.lit(parts))
        window = Window.partitionBy(*group, part).orderBy(*order)
        kept = kept.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n)
    return kept.drop("_split", "_rank")
