"""Live counts and rates per drive."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathledger.functions.values import rate


def _counts(results, window, at):
    counted = results.groupBy(F.window(at, window), "drive").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
    start, end = F.unix_seconds("window.start"), F.unix_seconds("window.end")
    return counted.select(
        start.alias("window_start"), (end - start).alias("seconds"), "drive", "files", "errors"
    )


def _with_rate(counted):
    return counted.withColumn("rate", rate("files", F.col("seconds"))).drop("seconds")


def windowed_counts(results: DataFrame, window="1 hour", at="scanned_at") -> DataFrame:
    """Files and errors per drive and tumbling window of the timestamp ``at``."""
    return _with_rate(_counts(results, window, at))


def stream_scan_rate(results: DataFrame, root, window="1 hour", trigger=None, at="scanned_at"):
    """Start a stream that keeps the counts of ``windowed_counts`` below ``root``; returns its query.

    Each batch stores the counts of its own rows, and ``live_rates`` adds them up. So no row is
    too late, the stream holds no state, and a batch that is repeated replaces its own counts.
    """

    def store(batch, batch_id):
        _counts(batch, window, at).write.mode("overwrite").parquet(f"{root}/rates/batch_id={batch_id}")

    return (
        results.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def live_rates(spark: SparkSession, root) -> DataFrame:
    """The counts per drive and window of all batches of a ``stream_scan_rate`` so far."""
    stored = spark.read.parquet(f"{root}/rates").groupBy("window_start", "seconds", "drive")
    return _with_rate(stored.agg(F.sum("files").alias("files"), F.sum("errors").alias("errors")))
