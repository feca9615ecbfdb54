"""Comparison by digest trees against the full outer join, on random trees of directories."""

import random

import pytest
from pyspark.sql import functions as F

from pathledger.operators import digests, snapshots as ops
from pathledger.sources import catalog
from pathledger.streaming import monitor

SCHEMA = "path string, size bigint, mtime bigint, content_hash string"


def random_trees(seed, folders=25, files=400):
    """A snapshot in nested directories, and a later one in which some of them changed or moved."""
    rng = random.Random(seed)
    dirs = ["C:", "\\\\server\\share", "", "\\", "D:/mixed"]
    for _ in range(folders):
        dirs.append(rng.choice(dirs) + rng.choice("\\/") + rng.choice(["a", "b", "ü", "a b", "c.d"]))
    prev = {}
    for _ in range(files):
        path = rng.choice(dirs) + rng.choice(["\\", "\\", "/"]) + f"f{rng.randint(0, 40)}"
        prev[path] = (rng.choice([None, 1, 2]), rng.choice([None, 1, 5]), rng.choice([None, "x"]))
    prev["bare"] = (1, None, None)
    curr = dict(prev)
    for folder in rng.sample(dirs[5:], 5):
        # Renamed with all below it.
        for path in [p for p in curr if p.startswith(folder + "\\")]:
            curr[f"{folder}_moved" + path[len(folder) :]] = curr.pop(path)
    for path in rng.sample(sorted(curr), 6):
        size, mtime, found = curr[path]
        curr[path] = rng.choice([(mtime, size, found), (None, mtime, found), (size, 9, found), (size, mtime, "y")])
    for path in rng.sample(sorted(curr), 4):
        del curr[path]
    return prev, curr


def frame(spark, snapshot):
    return spark.createDataFrame([(path, *rest) for path, rest in snapshot.items()], SCHEMA)


def stored(spark, snapshot, location):
    digests.write_tree(snapshot, str(location))
    return digests.read_tree(spark, str(location))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_tree_diff_equals_full_outer_join(spark, tmp_path, seed):
    prev, curr = (frame(spark, s) for s in random_trees(seed))
    trees = stored(spark, prev, tmp_path / "p"), stored(spark, curr, tmp_path / "c")
    expected = rows(ops.snapshot_diff(prev, curr))
    assert expected and rows(digests.tree_diff(prev, curr, *trees)) == expected
    # Every changed file is in a changed directory, whatever their share, by broadcast or by shuffle.
    changed = digests.changed_directories(*trees)
    for few in (True, False):
        found = ops.snapshot_diff(*[digests.files_in(s, changed, few) for s in (prev, curr)])
        assert rows(found) == expected


def test_equal_and_empty_snapshots(spark, tmp_path):
    prev, curr = (frame(spark, s) for s in random_trees(9))
    p, c, none = stored(spark, prev, tmp_path / "p"), stored(spark, curr, tmp_path / "c"), stored(spark, prev.limit(0), tmp_path / "n")
    assert digests.changed_directories(p, stored(spark, prev.repartition(7), tmp_path / "again")).count() == 0
    assert rows(digests.tree_diff(prev, prev, p, p)) == rows(digests.tree_diff(prev.limit(0), prev.limit(0), none, none)) == []
    assert rows(digests.tree_diff(prev.limit(0), curr, none, c)) == rows(ops.snapshot_diff(prev.limit(0), curr))
    assert rows(digests.tree_diff(prev, curr.limit(0), p, none)) == rows(ops.snapshot_diff(prev, curr.limit(0)))


def test_values_that_change_places_are_seen(spark, tmp_path):
    prev = frame(spark, {"C:\\a\\x": (None, 5, None), "C:\\a\\y": (5, None, None)})
    curr = frame(spark, {"C:\\a\\x": (5, None, None), "C:\\a\\y": (None, 5, None)})
    trees = stored(spark, prev, tmp_path / "p"), stored(spark, curr, tmp_path / "c")
    assert digests.changed_directories(*trees).count() == 1


def test_only_files_of_changed_directories_are_joined(spark, tmp_path):
    key = F.col("id")
    prev = spark.range(200_000).select(
        F.concat_ws("\\", F.lit("C:"), (key % 8).cast("string"), F.concat(F.lit("d"), (key % 1000).cast("string")), key.cast("string")).alias("path"),
        (key % 99).alias("size"), key.alias("mtime"), F.lit(None).cast("string").alias("content_hash"),
    )
    # 0.5 % of the directories have changes.
    touched = key % 1000 < 5
    curr = prev.withColumn("size", F.when(F.col("path").rlike(r"\\d[0-4]\\"), F.col("size") + 1).otherwise(F.col("size")))
    trees = stored(spark, prev, tmp_path / "p"), stored(spark, curr, tmp_path / "c")
    changed = digests.changed_directories(*trees)
    assert changed.count() == 5 and changed.agg(F.sum("files")).first()[0] == 2 * 1000
    found = digests.tree_diff(prev, curr, *trees)
    assert found.count() == spark.range(200_000).filter(touched).count() == 1000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [_dir" in plan


def test_the_monitor_finds_the_same_by_digests(spark, tmp_path):
    schema = f"{SCHEMA}, drive string, is_archive boolean, ext string"
    polls = [*random_trees(21), *random_trees(22)]
    for way in (False, True):
        root = f"{tmp_path}/{way}"
        for number, snapshot in enumerate(polls):
            listing = spark.createDataFrame([(p, *rest, "C:", False, "") for p, rest in snapshot.items()], schema)
            monitor.process_poll(spark, root, number, number if number != 2 else 0, listing, digests=way)
    plain, by_tree = (f"{tmp_path}/{way}" for way in (False, True))
    assert rows(monitor.changes(spark, by_tree)) == rows(monitor.changes(spark, plain))
    assert rows(monitor.current_catalog(spark, by_tree)) == rows(monitor.current_catalog(spark, plain))
    assert rows(monitor.polls(spark, by_tree)) == rows(monitor.polls(spark, plain))


@pytest.mark.parametrize("parts", [1, 5])
def test_bucketed_snapshots_meet_without_exchange(spark, tmp_path, parts):
    """On one file per bucket, and on several of them."""
    pair = random_trees(31)
    expected = rows(ops.snapshot_diff(*[frame(spark, s) for s in pair]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = []
        for i, snapshot in enumerate(pair):
            location = f"{tmp_path}/{i}"
            df = frame(spark, snapshot)
            if parts == 1:
                stored.append(catalog.write_snapshot(df, location, 4))
            else:
                # Tasks that each write to all buckets.
                df.repartition(parts).write.bucketBy(4, "path").option("path", location).saveAsTable(f"many_{i}_{parts}")
                stored.append(catalog.read_snapshot(spark, location, 4))
        found = ops.snapshot_diff(*stored)
        assert rows(found) == expected
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
