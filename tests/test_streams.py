"""The monitor and the live rates, with stops, repeats and late rows."""

import random

import pytest
from pyspark.sql import functions as F

from pathledger.operators import snapshots as ops, stats
from pathledger.plans import fixtures as fx
from pathledger.streaming import monitor, rates

FILE_COLUMNS = ["path", "size", "mtime", "content_hash", "is_archive", "drive", "ext"]


def publish(snapshot, number, root):
    monitor.publish_snapshot(fx.as_catalog(snapshot), number, f"{root}/s/{number}", f"{root}/m")


def run(spark, root, **options):
    monitor.monitor(spark, f"{root}/m", root, **options).awaitTermination()


def table(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def counts(spark, root):
    rows = monitor.polls(spark, root).orderBy("batch_id").collect()
    return [(r["new"], r["modified"], r["deleted"], r["moved"], r["completed"]) for r in rows]


@pytest.fixture()
def pair(spark, sf_dir):
    return fx.prev_snapshot(spark, sf_dir), fx.curr_snapshot(spark, sf_dir)


def test_polls_stop_resume_and_compaction(spark, pair, tmp_path):
    root, (prev, curr) = str(tmp_path), pair
    publish(prev, 1, root)
    run(spark, root)
    # The first poll only stores the baseline.
    assert counts(spark, root) == [(0, 0, 0, 0, 1)]
    assert table(monitor.current_catalog(spark, root), *FILE_COLUMNS) == table(fx.as_catalog(prev), *FILE_COLUMNS)

    publish(curr, 2, root)
    publish(curr, 3, root)
    run(spark, root)
    assert counts(spark, root)[1:] == [(10, 20, 15, 30, 2), (0, 0, 0, 0, 3)]
    assert table(monitor.current_catalog(spark, root), *FILE_COLUMNS) == table(fx.as_catalog(curr), *FILE_COLUMNS)
    assert monitor.move_history(spark, root).count() == 30

    # Nothing new: nothing is repeated.
    run(spark, root)
    assert len(counts(spark, root)) == 3

    monitor.compact(spark, root)
    assert table(monitor.current_catalog(spark, root), *FILE_COLUMNS) == table(fx.as_catalog(curr), *FILE_COLUMNS)
    publish(prev, 4, root)
    run(spark, root)
    assert counts(spark, root)[3][4] == 4
    assert table(monitor.current_catalog(spark, root), *FILE_COLUMNS) == table(fx.as_catalog(prev), *FILE_COLUMNS)


def test_deltas_are_folded_into_a_new_base(spark, pair, tmp_path):
    root, (prev, curr) = str(tmp_path), pair
    for number, snapshot in enumerate((prev, curr, prev, curr), start=1):
        publish(snapshot, number, root)
    run(spark, root, compact_every=2)
    assert sorted(p.name for p in (tmp_path / "base").iterdir()) == ["batch_id=0", "batch_id=1", "batch_id=3"]
    back = ops.moves_name_size(curr, prev).count()
    assert [c[3] for c in counts(spark, root)] == [0, 30, back, 30]
    assert table(monitor.current_catalog(spark, root), *FILE_COLUMNS) == table(fx.as_catalog(curr), *FILE_COLUMNS)


def test_manifest_of_two_snapshots_is_refused(spark, pair, tmp_path):
    root = str(tmp_path)
    lines = spark.createDataFrame([(1, "a"), (2, "b")], "snapshot_id long, location string")
    lines.coalesce(1).write.json(f"{root}/m")
    with pytest.raises(Exception, match="one snapshot"):
        run(spark, root)


def test_repeated_batch_changes_nothing(spark, pair, tmp_path):
    root, (prev, curr) = str(tmp_path), pair
    prev, curr = fx.as_catalog(prev), fx.as_catalog(curr)
    monitor.process_poll(spark, root, 0, 1, prev)
    monitor.process_poll(spark, root, 0, 1, prev)
    monitor.process_poll(spark, root, 1, 2, curr)
    before = table(monitor.changes(spark, root), "path", "change_type", "old_path")
    monitor.process_poll(spark, root, 1, 2, curr)
    assert table(monitor.changes(spark, root), "path", "change_type", "old_path") == before
    assert monitor.move_history(spark, root).count() == 30
    assert counts(spark, root) == [(0, 0, 0, 0, 1), (10, 20, 15, 30, 2)]
    assert table(monitor.current_catalog(spark, root), *FILE_COLUMNS) == table(curr, *FILE_COLUMNS)


def test_batch_that_failed_halfway_is_not_seen(spark, pair, tmp_path):
    root, (prev, curr) = str(tmp_path), pair
    prev, curr = fx.as_catalog(prev), fx.as_catalog(curr)
    monitor.process_poll(spark, root, 0, 1, prev)
    # A delta without the poll's summary, as a crash would leave it.
    monitor._write(prev.withColumn("op", F.lit("delete")), root, "delta", 1)
    assert table(monitor.current_catalog(spark, root), *FILE_COLUMNS) == table(prev, *FILE_COLUMNS)
    monitor.process_poll(spark, root, 1, 2, curr)
    assert table(monitor.current_catalog(spark, root), *FILE_COLUMNS) == table(curr, *FILE_COLUMNS)


def test_verified_polls(spark, pair, tmp_path):
    root, (prev, curr) = str(tmp_path), pair
    publish(prev, 1, root)
    publish(curr, 2, root)
    run(spark, root, verify=True)
    expected = ops.find_changes(prev, curr, verify=True)
    columns = ["path", "change_type", "old_path", "confidence"]
    assert table(monitor.changes(spark, root), *columns) == table(expected, *columns)


def test_listing_read_by_a_function(spark, tmp_path):
    from pathledger.sources import listing

    root = str(tmp_path)
    line = spark.createDataFrame([("a.txt", "C:\\x", "1", "2", "3", "4")], "name string, directory string, size string, mtime string, ctime string, attributes string")
    for number in (1, 2):
        listing.write_listing_csv(line.withColumn("size", F.lit(str(number))), f"{root}/l/{number}")
        manifest = spark.createDataFrame([(number, f"{root}/l/{number}")], "snapshot_id long, location string")
        manifest.coalesce(1).write.mode("append").json(f"{root}/m")
    run(spark, root, read_snapshot=listing.read_listing_csv)
    assert table(monitor.changes(spark, root), "path", "change_type") == [("C:\\x\\a.txt", "modified")]


def test_listings_out_of_order_change_nothing(spark, pair, tmp_path):
    root, (prev, curr) = str(tmp_path), (fx.as_catalog(s) for s in pair)
    prev, curr = prev, curr
    monitor.process_poll(spark, root, 0, 1, prev)
    monitor.process_poll(spark, root, 1, 3, curr)
    monitor.process_poll(spark, root, 2, 2, prev)
    monitor.process_poll(spark, root, 3, 3, prev)
    assert table(monitor.current_catalog(spark, root), *FILE_COLUMNS) == table(curr, *FILE_COLUMNS)
    assert monitor.changes(spark, root).filter("batch_id > 1").count() == 0
    stale = monitor.polls(spark, root).filter("new IS NULL").collect()
    assert sorted(r["batch_id"] for r in stale) == [2, 3] and {r["completed"] for r in stale} == {2}


def test_search_over_the_live_catalog(spark, pair, tmp_path):
    from pathledger import search_files

    root, (prev, curr) = str(tmp_path), map(fx.as_catalog, pair)
    monitor.process_poll(spark, root, 0, 1, prev)
    monitor.process_poll(spark, root, 1, 2, curr)
    found = search_files("*.py", live=root, spark=spark)
    assert [r["path"] for r in found.collect()] == sorted(r["path"] for r in curr.collect() if r["path"].endswith(".py"))


def test_a_listing_that_repeats_a_path(spark, pair, tmp_path):
    root, prev = str(tmp_path), fx.as_catalog(pair[0])
    twice = prev.unionByName(prev.withColumn("mtime", F.col("mtime") - 5))
    monitor.process_poll(spark, root, 5, 1, twice)
    monitor.process_poll(spark, root, 6, 2, twice)
    assert monitor.changes(spark, root).count() == 0
    assert table(monitor.current_catalog(spark, root), *FILE_COLUMNS) == table(prev, *FILE_COLUMNS)


def scans(spark, rows):
    df = spark.createDataFrame(rows, "at long, drive string, error string")
    return df.select(F.timestamp_seconds("at").alias("scanned_at"), "drive", "error")


def test_live_rates_over_several_batches(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    first = [(10, "C:", None), (3590, "C:", "x"), (3601, "D:", None)]
    second = [(20, "C:", None), (7300, "D:", None)]
    for part in (first, second):
        scans(spark, part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(scans(spark, first).schema).parquet(source)
        rates.stream_scan_rate(stream, root).awaitTermination()
    found = table(rates.live_rates(spark, root), "window_start", "drive", "files", "errors")
    assert found == [(0, "C:", 3, 1), (3600, "D:", 1, 0), (7200, "D:", 1, 0)]
    batch = rates.windowed_counts(scans(spark, first + second))
    assert table(batch, "window_start", "drive", "files", "errors") == found


def test_late_files_count(spark, tmp_path):
    """One file per batch, in an order against time: nothing is lost."""
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [[(100_000, "C:", None)], [(200_000, "C:", "x")], [(10, "C:", None)], [(100_001, None, None)]]
    for part in parts:
        scans(spark, part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(scans(spark, part).schema).option("maxFilesPerTrigger", 1).parquet(source)
        rates.stream_scan_rate(stream, root).awaitTermination()
    columns = "window_start", "drive", "files", "errors"
    batch = rates.windowed_counts(scans(spark, [row for part in parts for row in part]))
    assert table(rates.live_rates(spark, root), *columns) == table(batch, *columns)


def test_a_poll_reads_as_many_folders_however_many_were_before(spark, tmp_path, monkeypatch):
    """One poll row, and the deltas since the last base."""
    root = str(tmp_path)
    listing = spark.createDataFrame([(f"C:\\{i}", 1, 2, None, False, "C:", "") for i in range(4)], "path string, size bigint, mtime bigint, content_hash string, is_archive boolean, drive string, ext string")
    read, stored = [], monitor.stored_at
    monkeypatch.setattr(monitor, "stored_at", lambda session, place: read.append(place) or stored(session, place))
    looked = []
    for number in range(7):
        monitor.process_poll(spark, root, number, number, listing.withColumn("size", F.lit(number).cast("bigint")))
        if number % 2:
            monitor.compact(spark, root)
        looked.append(len(read))
        read.clear()
    assert looked[2:4] == looked[4:6] and counts(spark, root)[-1] == (0, 4, 0, 0, 7)
    files = monitor.current_catalog(spark, root).inputFiles()
    assert all("base/batch_id=5" in f or "delta/batch_id=6" in f for f in files)
    assert {r["size"] for r in monitor.current_catalog(spark, root).collect()} == {6}


def test_totals_follow_the_changes(spark, tmp_path, monkeypatch):
    """Random polls, stale ones, sizes that are missing, drives that come and go."""
    rng, root, files, seen = random.Random(3), str(tmp_path), {}, []
    counted = monitor.signed_totals
    monkeypatch.setattr(monitor, "signed_totals", lambda rows, sign: seen.append(1) or counted(rows, sign))
    for poll in range(12):
        for _ in range(4 if poll else 12):
            path = f"p{rng.randrange(16)}"
            drive = rng.choice(["C:", "D:", "E:", None])
            files[path] = (path, rng.choice([None, 3, 5, 2**40]), poll, rng.random() < 0.5, drive)
            files.pop(f"p{rng.randrange(16)}", None)
        listed = spark.createDataFrame(list(files.values()), "path string, size long, mtime long, is_archive boolean, drive string")
        listed = listed.withColumn("content_hash", F.lit(None).cast("string")).coalesce(1)
        stale = poll in (4, 9)
        monitor.process_poll(spark, root, poll, 0 if stale else poll + 1, listed)
        if poll in (0, 3, 6, 9, 11):
            catalog = monitor.current_catalog(spark, root)
            assert table(monitor.current_totals(spark, root), "drive", "files", "archives", "bytes") == table(
                stats.total_stats(catalog), "drive", "files", "archives", "bytes"
            )
    # The catalog was counted once, for the first poll.
    assert len(seen) == 1
