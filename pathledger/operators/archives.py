"""Archive contents: nested records, flat members, totals."""

from pyspark.sql import DataFrame, functions as F

from pathledger.operators.ordering import latest_version
from pathledger.operators.spread import lookup

MEMBER = ["internal_path", "compressed_size", "uncompressed_size", "modified", "file_type"]

# Largest number of members in one nested record.
RECORD_MEMBERS = 10_000


def archives_nested(members: DataFrame, per_record=RECORD_MEMBERS) -> DataFrame:
    """One record per archive with its members in archive order and the time of indexing.

    An archive with more than ``per_record`` members takes several records, numbered by
    ``part_no``, so that no cell grows with the archive.
    """
    record = F.floor(F.col("member_no") / per_record).cast("bigint")
    return (
        members.filter(F.col("internal_path").isNotNull())
        .groupBy("archive_path", record.alias("part_no"))
        .agg(F.array_sort(F.collect_list(F.struct("member_no", *MEMBER))).alias("contents"))
        .withColumn("indexed_at", F.current_timestamp())
    )


def explode_archives(nested: DataFrame) -> DataFrame:
    """Flat member rows of nested archive records."""
    return nested.select("archive_path", F.inline("contents"))


def archive_totals(nested: DataFrame) -> DataFrame:
    """Archives with at least one member, and members found."""
    filled = (F.col("part_no") == 0) & (F.size("contents") > 0)
    return nested.agg(
        F.count(F.when(filled, 1)).alias("archives_processed"),
        F.coalesce(F.sum(F.size("contents").cast("bigint")), F.lit(0)).alias("members_found"),
    )


def archive_file_members(files: DataFrame, members: DataFrame) -> DataFrame:
    """Members with the catalog row of their archive; one archive may hold most members.

    Of a path that the catalog repeats, the latest row counts.
    """
    version = "mtime" if "mtime" in files.columns else "path"
    archive = latest_version(files, version).withColumnRenamed("path", "archive_path")
    return lookup(members, archive, ["archive_path"])
