"""Snapshot comparison against brute force on small random catalogs."""

import random

import pytest
from pyspark.sql import functions as F

from pathledger.functions.paths import is_archive_scan
from pathledger.operators import snapshots as ops, spread, stats

SCHEMA = "path string, size long, mtime long, content_hash string"


def frame(spark, snapshot):
    return spark.createDataFrame([(path, *rest) for path, rest in snapshot.items()], SCHEMA)


def random_pair(seed, files=120):
    """Two snapshots with few names, sizes and hashes, so that ties and copies are common."""
    rng = random.Random(seed)

    def some():
        path = f"C:\\d{rng.randint(0, 9)}\\n{rng.randint(0, 5)}"
        return path, (rng.randint(0, 2), rng.randint(0, 1), rng.choice([None, "a", "b"]))

    prev, curr = dict(some() for _ in range(files)), dict(some() for _ in range(files))
    for path in rng.sample(sorted(prev), len(prev) // 2):
        curr[path] = prev[path]
    for path in rng.sample(sorted(prev), len(prev) // 3):
        curr.pop(path, None)
    return prev, curr


def name(path):
    return path.rsplit("\\", 1)[-1]


def brute_moves(prev, curr):
    gone, came = set(prev) - set(curr), set(curr) - set(prev)
    moves = {}
    for new in came:
        old = [p for p in gone if prev[p][0] == curr[new][0] and name(p) == name(new)]
        if old:
            moves[new] = min(old)
    return moves


def brute_changes(prev, curr, verify=False):
    moves = brute_moves(prev, curr)
    if verify:
        moves = {
            new: old for new, old in moves.items()
            if None in (prev[old][2], curr[new][2]) or prev[old][2] == curr[new][2]
        }
    gone, came = set(prev) - set(curr), set(curr) - set(prev)
    changes = {(new, "moved", old) for new, old in moves.items()}
    changes |= {(p, "new", None) for p in came - set(moves)}
    changes |= {(p, "deleted", None) for p in gone - set(moves.values())}
    changes |= {(p, "modified", None) for p in set(prev) & set(curr) if prev[p][:2] != curr[p][:2]}
    return changes


def rows(df, *columns):
    found = [tuple(r) for r in df.select(*columns).collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("hot_rows", [spread.HOT_ROWS, 1])
@pytest.mark.parametrize("verify", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_changes(spark, monkeypatch, seed, verify, hot_rows):
    monkeypatch.setattr(spread, "HOT_ROWS", hot_rows)
    prev, curr = random_pair(seed)
    found = ops.find_changes(frame(spark, prev), frame(spark, curr), verify)
    assert rows(found, "path", "change_type", "old_path") == brute_changes(prev, curr, verify)


def test_pieces(spark):
    prev, curr = random_pair(3)
    p, c = frame(spark, prev), frame(spark, curr)
    assert rows(ops.new_files(p, c), "path") == {(x,) for x in set(curr) - set(prev)}
    assert rows(ops.deleted_files(p, c), "path") == {(x,) for x in set(prev) - set(curr)}
    changed = {x for x in set(prev) & set(curr) if prev[x][:2] != curr[x][:2]}
    assert rows(ops.modified_files(p, c), "path") == {(x,) for x in changed}
    moves = brute_moves(prev, curr)
    assert rows(ops.moves_name_size(p, c), "new_path", "old_path") == set(moves.items())
    wanted = {(x, *curr[x]) for x in changed | (set(curr) - set(prev))}
    assert rows(ops.changed_rows(p, c), "path", "size", "mtime", "content_hash") == wanted


def test_verified_confidence(spark):
    prev, curr = random_pair(4)
    expected = set()
    for new, old in brute_moves(prev, curr).items():
        a, b = prev[old][2], curr[new][2]
        if a is None or b is None or a == b:
            expected.add((old, new, b, 0.9 if None in (a, b) else 1.0))
    found = ops.moves_verified(frame(spark, prev), frame(spark, curr))
    assert rows(found, "old_path", "new_path", "content_hash", "confidence") == expected


def test_same_size_pairs(spark):
    prev, curr = random_pair(5)
    gone, came = sorted(set(prev) - set(curr)), sorted(set(curr) - set(prev))
    expected = set()
    for size in range(3):
        olds = [p for p in gone if prev[p][0] == size]
        news = [p for p in came if curr[p][0] == size]
        expected |= set(zip(olds, news))
    found = rows(ops.moves_same_size(frame(spark, prev), frame(spark, curr)), "old_path", "new_path")
    assert found == expected
    assert len({o for o, _ in found}) == len({n for _, n in found}) == len(found)


@pytest.mark.parametrize("seed", [6, 7])
def test_applying_changes_gives_the_current_snapshot(spark, seed):
    prev, curr = random_pair(seed)
    p, c = frame(spark, prev), frame(spark, curr)
    after = ops.apply_changes(p, c, ops.find_changes(p, c))
    assert rows(after, "path", "size", "mtime") == {(x, *curr[x][:2]) for x in curr}


def test_no_change(spark):
    prev, _ = random_pair(8)
    p = frame(spark, prev)
    assert ops.find_changes(p, p).isEmpty()
    assert {r["found_in"] for r in ops.path_set_ops(p, p).collect()} == {"common"}


def test_one_old_path_serves_several_new_ones_and_the_smallest_wins(spark):
    prev = {"C:\\b\\x": (5, 1, None), "C:\\a\\x": (5, 1, None), "C:\\e\\y": (0, 1, None)}
    curr = {"C:\\n1\\x": (5, 1, None), "C:\\n2\\x": (5, 1, None), "C:\\f\\y": (0, 1, None)}
    found = rows(ops.find_changes(frame(spark, prev), frame(spark, curr)), "path", "change_type", "old_path")
    assert found == {
        ("C:\\n1\\x", "moved", "C:\\a\\x"), ("C:\\n2\\x", "moved", "C:\\a\\x"),
        ("C:\\b\\x", "deleted", None),
        # Empty files match as well.
        ("C:\\f\\y", "moved", "C:\\e\\y"),
    }


def test_set_operations(spark):
    prev, curr = random_pair(9)
    p, c = frame(spark, prev), frame(spark, curr)
    found = {}
    for path, kind in rows(ops.path_set_ops(p, c), "path", "found_in"):
        found.setdefault(kind, set()).add(path)
    paths_p, paths_c = p.select("path"), c.select("path")
    assert found["added"] == {r[0] for r in paths_c.subtract(paths_p).collect()}
    assert found["removed"] == {r[0] for r in paths_p.subtract(paths_c).collect()}
    assert found["common"] == {r[0] for r in paths_p.intersect(paths_c).collect()}


def test_work_comes_by_priority(spark):
    prev = {"C:\\a.zip": (1, 1, None), "C:\\old\\m.zip": (7, 1, None), "C:\\t.txt": (1, 1, None)}
    curr = {
        "C:\\a.zip": (2, 1, None), "C:\\new\\m.zip": (7, 1, None), "C:\\t.txt": (2, 1, None),
        "C:\\n.tgz": (3, 1, None), "C:\\n.txt": (4, 1, None),
    }
    work = ops.archives_to_analyze(frame(spark, prev), frame(spark, curr), is_archive_scan("path"))
    assert [tuple(r) for r in work.collect()] == [
        (2, "verify_move", "C:\\new\\m.zip"),
        (3, "analyze_archive", "C:\\a.zip"),
        (5, "analyze_archive", "C:\\n.tgz"),
    ]


def test_copies_of_a_hot_content(spark, monkeypatch):
    monkeypatch.setattr(spread, "HOT_ROWS", 10)
    files = spark.range(300).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None)
        .otherwise((F.col("id") / 2).cast("int").cast("string")).alias("content_hash"),
    )
    groups = {}
    for path, content in (tuple(r) for r in files.collect()):
        if content is not None:
            groups.setdefault(content, []).append(path)
    expected = {(c, p, len(ps)) for c, ps in groups.items() if len(ps) > 1 for p in ps}
    assert rows(stats.duplicate_files(files), "content_hash", "path", "copies") == expected


def test_fixture_counts(spark, sf_dir):
    """The counts that the fixture description gives for the smallest tables."""
    from pathledger.plans import fixtures as fx

    prev, curr = fx.prev_snapshot(spark, sf_dir), fx.curr_snapshot(spark, sf_dir)
    assert (prev.count(), curr.count()) == (200, 200)
    kinds = {r[0]: r[1] for r in ops.snapshot_diff(prev, curr).groupBy("change_type").count().collect()}
    assert kinds == {"new": 40, "deleted": 40, "modified": 20}
    moves = ops.moves_name_size(prev, curr)
    assert (moves.count(), moves.select("old_path").distinct().count()) == (30, 25)
    assert ops.moves_same_size(prev, curr).count() == 25
    verified = ops.moves_verified(prev, curr)
    assert {r[0]: r[1] for r in verified.groupBy("confidence").count().collect()} == {1.0: 22, 0.9: 3}
    copies = stats.duplicate_files(curr)
    assert copies.select("content_hash").distinct().count() == 13


def _snapshot(spark, rows):
    return spark.createDataFrame(rows, "path string, size bigint, mtime bigint, content_hash string")


def test_verified_moves_look_for_equal_hashes_first(spark):
    prev = _snapshot(spark, [("A\\f", 1, 1, "h1"), ("B\\f", 1, 1, "h2"), ("A\\g", 1, 1, "g1"), ("B\\g", 1, 1, None)])
    curr = _snapshot(spark, [("C\\f", 1, 1, "h2"), ("C\\g", 1, 1, "g2"), ("D\\g", 1, 1, None), ("D\\f", 1, 1, "h9")])
    found = {(r.old_path, r.new_path): r.confidence for r in ops.moves_verified(prev, curr).collect()}
    assert found == {("B\\f", "C\\f"): 1.0, ("B\\g", "C\\g"): 0.9, ("A\\g", "D\\g"): 0.9}
    changes = {r.path: r.change_type for r in ops.find_changes(prev, curr, verify=True).collect()}
    assert changes == {"C\\f": "moved", "C\\g": "moved", "D\\g": "moved", "D\\f": "new", "A\\f": "deleted"}


def test_a_value_that_appears_is_a_change(spark):
    prev = _snapshot(spark, [("a", None, 1, None), ("b", 1, None, None), ("c", None, None, None)])
    curr = _snapshot(spark, [("a", 5, 1, None), ("b", 1, None, None), ("c", None, None, None)])
    assert [r.path for r in ops.modified_files(prev, curr).collect()] == ["a"]
    assert [(r.path, r.change_type) for r in ops.snapshot_diff(prev, curr).collect()] == [("a", "modified")]
    assert [r.path for r in ops.changed_rows(prev, curr).collect()] == ["a"]
