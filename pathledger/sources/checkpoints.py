"""Checkpoint text files of a network scan: ``path|size|modified|NETWORK`` lines."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathledger.functions.values import checkpoint_row
from pathledger.operators.filters import only_success
from pathledger.schema import CHECKPOINT_ROWS

# Anchored at the right end: a path may hold the delimiter.
_LINE = r"^(.*)[|]([0-9]+)[|]([0-9]+(?:[.][0-9]*)?(?:[eE][+-]?[0-9]+)?)[|]NETWORK$"


def encode_checkpoint(results: DataFrame) -> DataFrame:
    """One text line per successful scan result."""
    return only_success(results).select(checkpoint_row("path", "size", "modified").alias("value"))


def write_checkpoint_text(results: DataFrame, location, rows=CHECKPOINT_ROWS, mode="append"):
    """Write successful results as compressed text, at most ``rows`` lines per file."""
    (
        encode_checkpoint(results)
        .write.mode(mode)
        .option("maxRecordsPerFile", rows)
        .option("compression", "gzip")
        .text(location)
    )


def decode_checkpoint(lines: DataFrame) -> DataFrame:
    """Path, size and modification time of checkpoint lines; other lines are left out."""
    line = F.col("value")
    return lines.filter(line.rlike(_LINE)).select(
        F.regexp_extract(line, _LINE, 1).alias("path"),
        F.regexp_extract(line, _LINE, 2).cast("bigint").alias("size"),
        F.regexp_extract(line, _LINE, 3).cast("double").alias("modified"),
    )


def read_checkpoint_text(spark: SparkSession, location) -> DataFrame:
    """Scan results saved by ``write_checkpoint_text``."""
    return decode_checkpoint(spark.read.text(location))
