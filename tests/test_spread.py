"""Skew-safe building blocks: both the hot and the plain route give what a plain join gives."""

import random

import pytest
from pyspark.sql import functions as F

from pathledger.operators import ordering, spread, stats


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of 3,000 rows on one key, and keys without a partner on both sides."""
    rng = random.Random(5)
    left = [(("hot" if i % 3 == 0 else f"k{rng.randint(0, 300)}"), f"p{i:05d}") for i in range(3000)]
    right = [(f"k{i}", i) for i in range(150, 400)] + [("hot", -1)]
    return (
        spark.createDataFrame(left, "key string, path string").repartition(5),
        spark.createDataFrame(right, "key string, value long"),
    )


@pytest.mark.parametrize("hot_rows", [None, 1, 100])
@pytest.mark.parametrize("how", ["inner", "left_outer"])
def test_lookup(skewed, hot_rows, how):
    left, right = skewed
    found = spread.lookup(left, right, ["key"], how, hot_rows).select("key", "path", "value")
    expected = left.join(right, "key", how).select("key", "path", "value")
    assert sorted(found.collect(), key=str) == sorted(expected.collect(), key=str)


def test_only_the_hot_key_is_hot(skewed):
    left, _ = skewed
    assert [r[0] for r in spread.hot_keys(left, ["key"], 100).collect()] == ["hot"]
    assert spread.hot_keys(left, ["key"]).count() == 0


@pytest.mark.parametrize("hot_rows", [None, 1, 100])
@pytest.mark.parametrize("at_least", [1, 2, 9])
def test_group_sizes(skewed, hot_rows, at_least):
    rows = skewed[0].collect()
    sizes = {}
    for row in rows:
        sizes[row["key"]] = sizes.get(row["key"], 0) + 1
    expected = {(r["path"], sizes[r["key"]]) for r in rows if sizes[r["key"]] >= at_least}
    found = spread.group_sizes(skewed[0], "key", "n", at_least, hot_rows).select("path", "n").collect()
    assert len(found) == len(expected) and {tuple(r) for r in found} == expected


def test_numbered(skewed):
    expected, seen = {}, {}
    for key, path in sorted(tuple(r) for r in skewed[0].collect()):
        seen[key] = seen.get(key, 0) + 1
        expected[path] = seen[key]
    found = spread.numbered(skewed[0], ["path"], ["key"]).collect()
    assert {r["path"]: r["row_no"] for r in found} == expected


def test_hot_group_is_cut_into_slices(spark, skewed):
    # Small slices would be merged at run time.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sliced = spread._sliced(skewed[0], ["key"], ["path"])
        assert sliced.filter("key = 'hot'").select("_slice").distinct().count() > 1
        test_numbered(skewed)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbered_without_group(skewed):
    found = spread.numbered(skewed[0], ["path"]).orderBy("path").collect()
    assert [r["row_no"] for r in found] == list(range(1, 3001))


def test_running_totals(spark):
    rows = [(i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, n long").repartition(6)
    total, expected = 0, []
    for i, n in rows:
        total += n
        expected.append((i, total))
    found = spread.running_totals(df, ["id"], {"sum": "n"}).orderBy("id").select("id", "sum")
    assert [tuple(r) for r in found.collect()] == expected


@pytest.mark.parametrize("width", ["4", "100"])
def test_first_rows(spark, skewed, width):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        found = spread.first_rows(skewed[0], 7, ["path"], ["key"]).collect()
        limited = ordering.scan_limit(skewed[0].repartition(90), 10).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    groups = {}
    for key, path in sorted(tuple(r) for r in skewed[0].collect()):
        groups.setdefault(key, []).append(path)
    assert {tuple(r) for r in found} == {(k, p) for k, ps in groups.items() for p in ps[:7]}
    assert [r["path"] for r in limited] == [f"p{i:05d}" for i in range(10)]


def test_latest_version_of_a_hot_path(spark):
    rows = [("hot", v, v * 2) for v in range(100)] + [(f"p{i}", 0, i) for i in range(50)]
    df = spark.createDataFrame(rows, "path string, snapshot_id long, size long").repartition(5)
    found = {r["path"]: r["size"] for r in ordering.latest_version(df).collect()}
    assert found == {"hot": 198, **{f"p{i}": i for i in range(50)}}


def test_peak_rate_takes_the_first_bucket_of_a_tie(spark):
    df = spark.createDataFrame([(3600,), (3700,), (7200,), (7300,), (9,)], "scanned_at long")
    assert tuple(ordering.peak_rate(df).first()) == (3600, 2)


def test_progress_counts_successes_only(spark):
    rows = [(i, 100 + i, "bad" if i % 4 == 0 else None) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "scan_id long, scanned_at long, error string")
    found = ordering.progress_milestones(df, every=10).orderBy("files_scanned").collect()
    expected, scanned, errors = [], 0, 0
    for _, at, error in rows:
        scanned, errors = (scanned, errors + 1) if error else (scanned + 1, errors)
        if not error and scanned % 10 == 0:
            expected.append((scanned, errors, at - 101))
    assert [tuple(r)[:3] for r in found] == expected


def test_rates_without_elapsed_time(spark):
    df = spark.createDataFrame([("C:", 5, None)], "drive string, scanned_at long, error string")
    rates = {r["drive"]: r["rate"] for r in stats.scan_rate(df).collect()}
    assert rates == {"C:": 0.0, "ALL": 0.0}
    assert stats.scan_summary(df).first()["success_pct"] == 100.0


def test_summary_of_failures_only(spark):
    df = spark.createDataFrame([("C:", 5, "x"), ("C:", 9, "x")], "drive string, scanned_at long, error string")
    row = stats.scan_summary(df).first()
    assert (row["scanned"], row["errors"], row["success_pct"]) == (0, 2, -100.0)


def test_totals_equal_the_sum_of_the_drives(spark):
    files = spark.range(100).select(
        F.when(F.col("id") % 3 == 0, "C:").when(F.col("id") % 3 == 1, "D:").otherwise("").alias("drive"),
        (F.col("id") % 10 == 0).alias("is_archive"),
        F.col("id").alias("size"),
    )
    rows = {r["drive"]: (r["files"], r["archives"], r["bytes"]) for r in stats.total_stats(files).collect()}
    total = rows.pop("ALL")
    assert set(rows) == {"C:", "D:"}
    assert total == tuple(map(sum, zip(*rows.values())))


def test_a_missing_group_is_a_group(spark):
    files = spark.createDataFrame([("a", "C:"), ("b", None), ("c", None), ("d", "D:")], "path string, drive string")
    found = {r["path"]: r["batch"] for r in ordering.checkpoint_batches(files, rows=1).collect()}
    assert found == {"a": 0, "b": 0, "c": 1, "d": 0}
    totals = spread.running_totals(files, ["path"], {"n": F.lit(1)}, ["drive"])
    assert {r["path"]: r["n"] for r in totals.collect()} == {"a": 1, "b": 1, "c": 2, "d": 1}


def test_equal_versions_are_decided_by_the_columns(spark):
    rows = [("a", 1, 5), ("a", 1, 7), ("a", 0, 9)]
    df = spark.createDataFrame(rows, "path string, snapshot_id int, size int")
    for order in (df, df.orderBy("size"), df.orderBy(F.desc("size"))):
        assert [r["size"] for r in ordering.latest_version(order).collect()] == [7]
    assert [r["size"] for r in ordering.latest_version(df.withColumn("t", -F.col("size")), tie=["t"]).collect()] == [5]
