"""Queries that run a stream to its end and return what it stored."""

from pyspark.sql import functions as F

from pathledger.plans import fixtures as fx
from pathledger.plans.registry import query
from pathledger.plans.snapshots import change_sql
from pathledger.session import fresh_folder
from pathledger.streaming import monitor, rates


def _sql(text):
    return fx.with_tables(text, fx.SNAPSHOT_SQL, change_sql())


def _polled(spark, sf_dir):
    """A folder in which the monitor has worked off the two snapshots."""
    root = fresh_folder(spark, "monitor")
    listings = [fx.prev_snapshot(spark, sf_dir), fx.curr_snapshot(spark, sf_dir)]
    for number, snapshot in enumerate(listings, start=1):
        _publish(snapshot, number, root)
    monitor.monitor(spark, f"{root}/manifests", root).awaitTermination()
    return root


def _publish(snapshot, number, root):
    monitor.publish_snapshot(
        fx.as_catalog(snapshot), number, f"{root}/snapshots/{number}", f"{root}/manifests"
    )


@query(_sql("SELECT path, change_type, old_path FROM changes"))
def stream_snapshot_diff(spark, sf_dir):
    root = _polled(spark, sf_dir)
    return monitor.changes(spark, root).select("path", "change_type", "old_path")


@query(_sql("SELECT * FROM files WHERE path IN (SELECT path FROM curr)"))
def stream_apply_changes(spark, sf_dir):
    return monitor.current_catalog(spark, _polled(spark, sf_dir))


@query(
    _sql(
        """
        SELECT coalesce(drive, 'ALL') AS drive, count(*) AS files, count(*) FILTER (is_archive) AS archives,
          CAST(sum(size) AS BIGINT) AS bytes
        FROM files WHERE path IN (SELECT path FROM curr) GROUP BY ROLLUP (drive)
        """
    )
)
def stream_totals(spark, sf_dir):
    """Totals after two polls, kept by adding what changed."""
    return monitor.current_totals(spark, _polled(spark, sf_dir))


@query(
    _sql("SELECT old_path, new_path, CAST(0.9 AS DOUBLE) AS confidence, CAST(1 AS BIGINT) AS batch_id FROM moves")
)
def move_history(spark, sf_dir):
    return monitor.move_history(spark, _polled(spark, sf_dir)).drop("detected_at")


def _counts(tag, number):
    return f"""
    SELECT {number} AS snapshot_id, count(*) FILTER (change_type = 'new') AS new,
      count(*) FILTER (change_type = 'modified') AS modified,
      count(*) FILTER (change_type = 'deleted') AS deleted,
      count(*) FILTER (change_type = 'moved') AS moved, {number} AS completed FROM changes{tag}"""


_BASELINE = "SELECT CAST(1 AS BIGINT) AS snapshot_id, 0 AS new, 0 AS modified, 0 AS deleted, 0 AS moved, CAST(1 AS BIGINT) AS completed"


@query(_sql(f"{_BASELINE} UNION ALL {_counts('', 2)}"))
def stream_poll_summary(spark, sf_dir):
    return monitor.polls(spark, _polled(spark, sf_dir)).drop("batch_id")


@query(
    fx.with_tables(
        f"{_BASELINE} UNION ALL {_counts('', 2)} UNION ALL {_counts('_back', 3)}",
        fx.SNAPSHOT_SQL,
        change_sql(),
        change_sql("curr", "prev", "_back"),
    )
)
def stream_resume(spark, sf_dir):
    """Two polls, a stop, and a third poll that goes back to the first snapshot."""
    root = _polled(spark, sf_dir)
    _publish(fx.prev_snapshot(spark, sf_dir), 3, root)
    monitor.monitor(spark, f"{root}/manifests", root).awaitTermination()
    return monitor.polls(spark, root).drop("batch_id")


@query(
    fx.with_tables(
        """
        SELECT scanned_at // 3600 * 3600 AS window_start, drive, count(*) AS files,
          count(error) AS errors, round(count(*) / CAST(3600 AS DOUBLE), 6) AS rate
        FROM scan_results GROUP BY scanned_at // 3600, drive
        """,
        fx.SCAN_SQL,
    )
)
def stream_scan_rate(spark, sf_dir):
    events = spark.readStream.schema(fx.table(spark, sf_dir, "events").schema)
    # A pattern, since a stream takes the files of a folder or a pattern, not one file.
    results = fx.scan_results(events.parquet(f"{sf_dir}/events*.parquet"))
    root = fresh_folder(spark, "rates")
    rates.stream_scan_rate(results.withColumn("scanned_at", F.col("scanned_ts")), root).awaitTermination()
    return rates.live_rates(spark, root).withColumn("rate", F.round("rate", 6))
