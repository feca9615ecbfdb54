"""Counts, totals and rates. All of them combine before the shuffle."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pathledger.functions.values import rate
from pathledger.operators.spread import group_sizes
from pathledger.schema import SHARD_ROWS

ALL = "ALL"


def drive_stats(files: DataFrame) -> DataFrame:
    """Files, archives and bytes per drive."""
    return (
        files.filter(F.col("drive") != "")
        .groupBy("drive")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.count_if("is_archive").alias("archives"),
            F.sum("size").alias("bytes"),
        )
    )


def signed_totals(rows: DataFrame, sign) -> DataFrame:
    """What the rows add to the totals per drive: files, archives, files of a known size, bytes.

    ``sign`` is a column or number, 1 for rows that came and -1 for rows that went.
    """
    sign = sign if isinstance(sign, Column) else F.lit(sign)
    return (
        rows.filter(F.col("drive") != "")
        .groupBy("drive")
        .agg(
            F.sum(sign).cast("bigint").alias("files"),
            F.coalesce(F.sum(F.when(F.col("is_archive"), sign)), F.lit(0)).cast("bigint").alias("archives"),
            F.coalesce(F.sum(F.when(F.col("size").isNotNull(), sign)), F.lit(0)).cast("bigint").alias("sized"),
            F.coalesce(F.sum(F.col("size") * sign), F.lit(0)).cast("bigint").alias("bytes"),
        )
    )


def added_totals(*totals: DataFrame) -> DataFrame:
    """The sum of several ``signed_totals``; a drive without files has no row."""
    every = reduce(DataFrame.unionByName, totals)
    sums = [F.sum(name).alias(name) for name in ("files", "archives", "sized", "bytes")]
    return every.groupBy("drive").agg(*sums).filter("files <> 0")


def total_stats(files: DataFrame) -> DataFrame:
    """The same per drive and, as drive ``ALL``, over all drives."""
    return with_all(drive_stats(files))


def with_all(stats: DataFrame) -> DataFrame:
    """``drive_stats`` with a row ``ALL`` of their sums."""
    # The rollup runs over one row per drive; over the files it would double every row.
    sums = [F.sum(name).alias(name) for name in ("files", "archives", "bytes")]
    totals = stats.rollup("drive").agg(F.grouping_id().alias("level"), *sums)
    drive = F.when(F.col("level") == 1, ALL).otherwise(F.col("drive"))
    return totals.withColumn("drive", drive).drop("level")


def scan_rate(results: DataFrame, at="scanned_at") -> DataFrame:
    """Files per second per drive, and as drive ``ALL`` the sum of the drives' rates.

    ``at`` holds epoch seconds.
    """
    drives = results.groupBy("drive").agg(
        F.count(F.lit(1)).alias("files"), (F.max(at) - F.min(at)).alias("elapsed")
    )
    drives = drives.withColumn("rate", rate("files", "elapsed"))
    total = drives.agg(
        F.lit(ALL).alias("drive"),
        F.sum("files").alias("files"),
        F.max("elapsed").alias("elapsed"),
        F.sum("rate").alias("rate"),
    )
    return drives.unionByName(total)


def scan_summary(results: DataFrame, at="scanned_at") -> DataFrame:
    """Scanned and saved files, errors, elapsed time, rate and success rate of a scan.

    Only successes count as scanned, so the success rate relates errors to successes.
    """
    counts = results.agg(
        F.count_if(F.col("error").isNull()).alias("scanned"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.coalesce(F.max(at) - F.min(at), F.lit(0)).alias("elapsed"),
    )
    success = (1 - F.col("errors") / F.greatest(F.lit(1), F.col("scanned"))) * 100
    return counts.select(
        "scanned",
        F.col("scanned").alias("saved"),
        "errors",
        "elapsed",
        F.round(rate("scanned", "elapsed"), 3).alias("rate"),
        F.round(success, 1).alias("success_pct"),
    )


def duplicate_files(files: DataFrame, hot_rows=None) -> DataFrame:
    """Every path whose content occurs more than once, with the number of copies.

    Rows, not lists: a content that fills a third of the catalog fits no single cell. Contents of
    ``hot_rows`` files or more are counted apart, see ``spread.lookup``.
    """
    hashed = files.filter(F.col("content_hash").isNotNull()).select("content_hash", "path")
    return group_sizes(hashed, "content_hash", "copies", at_least=2, hot_rows=hot_rows)


def paths_by_size(files: DataFrame) -> DataFrame:
    """Every path under its size, with the number of files of that size."""
    return group_sizes(files.select("size", "path"), "size", "files_of_size")


def change_counts(changes: DataFrame) -> DataFrame:
    """Number of changes of each kind."""
    return changes.groupBy("change_type").agg(F.count(F.lit(1)).alias("changes"))


def namespace_totals(files: DataFrame, moves: DataFrame, shard_rows=SHARD_ROWS) -> DataFrame:
    """Files, archives, moves and shards per drive. ``moves`` has the drive of the new path."""
    marked = files.select(
        "drive", F.lit(1).alias("file"), F.col("is_archive").alias("archive"), F.lit(0).alias("move")
    ).unionByName(
        moves.select(
            "drive", F.lit(0).alias("file"), F.lit(False).alias("archive"), F.lit(1).alias("move")
        )
    )
    return marked.groupBy("drive").agg(
        F.sum("file").alias("files"),
        F.count_if("archive").alias("archives"),
        F.sum("move").alias("moves"),
        F.ceil(F.sum("file") / shard_rows).alias("shards"),
    )


def stats_json(files: DataFrame) -> DataFrame:
    """Per-drive and total statistics as one JSON text per row."""
    totals = total_stats(files)
    fields = F.struct("drive", "files", "archives", "bytes")
    return totals.select("drive", F.to_json(fields).alias("json"))
