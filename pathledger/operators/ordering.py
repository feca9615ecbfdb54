"""Numbering, caps, limits, sorted output and progress."""

from pyspark.sql import DataFrame, functions as F

from pathledger.functions.values import rate
from pathledger.operators.spread import first_rows, numbered, running_totals
from pathledger.schema import CHECKPOINT_ROWS, PROGRESS_ROWS, ROOT_CAP, TEST_LIMIT


def checkpoint_batches(files: DataFrame, rows=CHECKPOINT_ROWS, group=("drive",)) -> DataFrame:
    """Batch number of each file, in path order within its drive; a drive has any size."""
    placed = numbered(files, ["path"], group)
    batch = F.floor((F.col("row_no") - 1) / rows).cast("bigint")
    return placed.withColumn("batch", batch).drop("row_no")


def cap_per_root(files: DataFrame, rows=ROOT_CAP, root="drive") -> DataFrame:
    """At most ``rows`` files per root, the first in path order."""
    return first_rows(files, rows, ["path"], [root])


def latest_version(files: DataFrame, version="snapshot_id", key="path", tie=()) -> DataFrame:
    """One row per path, that of the latest version.

    Of equal versions the row with the largest ``tie`` columns holds, by default all columns in
    their order, so that reruns agree. An aggregate, not a window: repeated rows of a hot path
    combine before the shuffle.
    """
    order = F.struct(F.col(version).alias("v"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(tie or files.columns)])
    row = F.max_by(F.struct(*files.columns), order).alias("row")
    return files.groupBy(key).agg(row).select("row.*")


def scan_limit(files: DataFrame, rows=TEST_LIMIT) -> DataFrame:
    """The first ``rows`` files in path order."""
    return first_rows(files, rows, ["path"]).orderBy("path").limit(rows)


def sorted_listing(files: DataFrame) -> DataFrame:
    """The listing in path order."""
    return files.orderBy("path")


def progress_milestones(results: DataFrame, every=PROGRESS_ROWS, at="scanned_at") -> DataFrame:
    """A report at every ``every``-th scanned file: files and errors so far, time and rate.

    ``results`` has a unique ``scan_id`` in scan order, and ``at`` in epoch seconds.
    """
    ok = F.col("error").isNull()
    counted = running_totals(
        results.select("scan_id", at, "error"),
        [at, "scan_id"],
        {"files_scanned": ok.cast("int"), "errors": (~ok).cast("int")},
    )
    elapsed = F.col(at) - results.agg(F.min(at)).scalar()
    return counted.filter(ok & (F.col("files_scanned") % every == 0)).select(
        "files_scanned",
        "errors",
        elapsed.alias("elapsed"),
        F.round(rate("files_scanned", elapsed), 3).alias("rate"),
    )


def peak_rate(results: DataFrame, seconds=3600, at="scanned_at") -> DataFrame:
    """The busiest time bucket: its start (epoch seconds, the first on a tie) and its files."""
    start = (F.col(at) - F.pmod(F.col(at), F.lit(seconds))).alias("bucket")
    buckets = results.groupBy(start).agg(F.count(F.lit(1)).alias("files"))
    best = F.max(F.struct(F.col("files"), (-F.col("bucket")).alias("earlier")))
    return buckets.agg(best.alias("best")).select(
        (-F.col("best.earlier")).alias("bucket"), F.col("best.files").alias("files")
    )


def merge_shards(*shards: DataFrame) -> DataFrame:
    """All rows of several namespaces, columns matched by name."""
    merged, *rest = shards
    for shard in rest:
        merged = merged.unionByName(shard, allowMissingColumns=True)
    return merged


def distinct_dirs(files: DataFrame, directory) -> DataFrame:
    """Each directory once. ``directory`` is a column."""
    return files.select(directory.alias("directory")).distinct()
