"""Catalog and move tables in Parquet."""

import functools
import uuid

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pathledger.schema import SHARD_ROWS

# Ranks of a column along the curve: 2 ** CURVE_BITS of about equal numbers of rows.
CURVE_BITS = 6
# Bytes of a row group: what a search can skip, and the least that a task reads.
GROUP_BYTES = 4 << 20


def _ranked(df, columns, bits):
    """``df`` with the rank of each column among its quantiles, from 1; NULL has 0."""
    steps = 1 << bits
    # The cuts of each column: a fixed number of values.
    found = df.approxQuantile(columns, [i / steps for i in range(1, steps)], 0.25 / steps)
    for column, cuts in zip(columns, found, strict=True):
        splits = [float("-inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
        rank = Bucketizer(splits=splits, inputCol=f"_as_{column}", outputCol=f"_rank_{column}", handleInvalid="keep")
        df = rank.transform(df.withColumn(f"_as_{column}", F.col(column).cast("double"))).drop(f"_as_{column}")
        df = df.withColumn(f"_rank_{column}", F.coalesce(F.col(f"_rank_{column}").cast("int") + 1, F.lit(0)))
    return df


def _interleaved(ranks, bits) -> Column:
    """The bits of the ranks in turns, the highest ones first: near each other on a curve that fills space."""
    spread = [
        F.shiftleft(F.shiftright(rank, bit).bitwiseAND(1).cast("bigint"), len(ranks) * bit + len(ranks) - 1 - i)
        for i, rank in enumerate(ranks)
        for bit in range(bits + 1)
    ]
    return functools.reduce(Column.bitwiseOR, spread)


def on_curve(df: DataFrame, columns, keys=(), bits=CURVE_BITS) -> DataFrame:
    """``df`` in ranges along a space-filling curve over the columns, within the ``keys``.

    Rows that are near in all columns come to lie in few neighbouring places, so a range test on any of
    them meets few row groups. Ranks instead of values make it work for any distribution; one pass
    finds the quantiles, a range shuffle sorts, and rows of equal place are cut by path.
    """
    ranked = _ranked(df, list(columns), bits)
    place = _interleaved([F.col(f"_rank_{c}") for c in columns], bits).alias("_place")
    placed = ranked.select(*df.columns, place)
    order = [*keys, "_place", *(["path"] if "path" in df.columns else [])]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_place")


def write_catalog(files: DataFrame, location, mode="append", rows=SHARD_ROWS, curve=("mtime", "size")):
    """Write catalog rows partitioned by drive, at most ``rows`` per file.

    Rows of the empty drive name are left out; those without a drive are kept as such. Rows lie
    along a space-filling curve over the columns ``curve``, in small row groups, so that a search
    by day or size skips most of them; columns that the rows lack take no part. Ranges give each drive
    few, full files and split a drive that holds most rows. Without ``curve``, files are dealt by
    size alone, which saves a pass and a sort.
    """
    kept = files.filter("drive IS NULL OR drive <> ''")
    curve = [column for column in curve if column in files.columns]
    dealt = on_curve(kept, curve, ["drive"]) if curve else kept.hint("rebalance", "drive")
    (
        dealt.write.mode(mode)
        .partitionBy("drive")
        .option("maxRecordsPerFile", rows)
        .option("compression", "zstd")
        .option("parquet.block.size", GROUP_BYTES)
        .parquet(location)
    )


def read_table(spark: SparkSession, location) -> DataFrame:
    """A table partitioned by drive, whose names stay text: ``01`` is no number."""
    found = spark.read.parquet(location)
    kinds = [StructField(f.name, StringType()) if f.name == "drive" else f for f in found.schema]
    if found.schema == StructType(kinds):
        return found
    return spark.read.schema(StructType(kinds)).parquet(location)


def read_catalog(spark: SparkSession, *locations) -> DataFrame:
    """Rows of one or more catalogs; columns that one lacks are NULL."""
    first, *rest = [read_table(spark, location) for location in locations]
    for table in rest:
        first = first.unionByName(table, allowMissingColumns=True)
    return first


def write_snapshot(files: DataFrame, location, buckets) -> DataFrame:
    """Store a snapshot in buckets by path, and return the stored table.

    Two snapshots of the same number of buckets meet by path without any exchange: bucket i of one
    is compared with bucket i of the other. Choose ``buckets`` for the size of a bucket at 100 to 200 MB.
    """
    name = f"snapshot_{uuid.uuid4().hex}"
    # The table is only a name for the files of this location; dropping it leaves them.
    files.repartition(buckets, "path").write.bucketBy(buckets, "path").sortBy("path").option("path", location).option(
        "compression", "zstd"
    ).saveAsTable(name)
    return files.sparkSession.table(name)


def read_snapshot(spark: SparkSession, location, buckets) -> DataFrame:
    """A snapshot that ``write_snapshot`` stored in so many buckets, also in another session."""
    name = f"snapshot_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(location).schema)
    place = location.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (path) SORTED BY (path) INTO {buckets} BUCKETS "
        f"LOCATION '{place}'"
    )
    return spark.table(name)


def append_moves(moves: DataFrame, location):
    """Append move records."""
    moves.write.mode("append").option("compression", "zstd").parquet(location)


def write_stats_json(stats: DataFrame, location):
    """Write statistics, one JSON object per line."""
    stats.write.mode("overwrite").json(location)
