"""Differences between two snapshots of a catalog.

A snapshot has one row per path (see ``ordering.latest_version``), so joins on the path have no
hot keys. Joins on name and size do, and go through ``spread.lookup``.
"""

from pyspark.sql import DataFrame, functions as F

from pathledger.functions.paths import base_name
from pathledger.operators.spread import lookup, numbered
from pathledger.operators.stats import added_totals, signed_totals
from pathledger.session import materialise

NEW, DELETED, MODIFIED, MOVED = "new", "deleted", "modified", "moved"

# What a match by name and size is worth, and one confirmed by content.
NAME_SIZE_CONFIDENCE, VERIFIED_CONFIDENCE = 0.9, 1.0
NAME_SIZE_REASON = "same_name_and_size"

# What a comparison looks at.
_COMPARED = ["path", "size", "mtime"]
# What statistics count beside sizes.
_COUNTED = ["drive", "is_archive"]


def new_files(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Rows of the current snapshot whose path the previous one lacks."""
    return curr.join(prev.select("path"), "path", "left_anti")


def deleted_files(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Rows of the previous snapshot whose path the current one lacks."""
    return prev.join(curr.select("path"), "path", "left_anti")


def _differs():
    """Another size or time; a value that appears or goes is a change as well."""
    return ~F.col("c.size").eqNullSafe(F.col("p.size")) | ~F.col("c.mtime").eqNullSafe(F.col("p.mtime"))


def modified_files(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Paths in both snapshots with another size or modification time."""
    both = prev.alias("p").join(curr.alias("c"), "path").filter(_differs())
    return both.select(
        "path",
        F.col("p.size").alias("old_size"),
        F.col("c.size").alias("new_size"),
        F.col("p.mtime").alias("old_mtime"),
        F.col("c.mtime").alias("new_mtime"),
    )


def snapshot_diff(prev: DataFrame, curr: DataFrame, hashes=True, rows=False) -> DataFrame:
    """New, deleted and modified paths from one full outer join.

    ``size``, ``mtime`` and ``content_hash`` come from the snapshot that has the path, the current
    one first. Without ``hashes`` the last is NULL and the join carries no hash. With ``rows``, a
    struct ``rest`` holds the other columns of new and modified rows, and ``was`` what the totals
    need of deleted and modified rows as they were.
    """
    content_hash = F.col("content_hash") if hashes else F.lit(None).cast("string")
    # The marker tells a missing row from a row with NULL columns.
    columns = [*_COMPARED, content_hash.alias("content_hash"), F.lit(True).alias("there")]
    rest = [F.struct(*_rest(curr)).alias("rest")] if rows else []
    was = [F.struct("size", *(n for n in _COUNTED if n in prev.columns)).alias("was")] if rows else []
    p, c = prev.select(*columns, *was).alias("p"), curr.select(*columns, *rest).alias("c")
    change = (
        F.when(F.col("p.there").isNull(), NEW)
        .when(F.col("c.there").isNull(), DELETED)
        .when(_differs(), MODIFIED)
    )
    present = F.col("c.there").isNotNull()
    return (
        p.join(c, "path", "full_outer")
        .select(
            "path",
            change.alias("change_type"),
            F.coalesce("c.size", "p.size").alias("size"),
            F.coalesce("c.mtime", "p.mtime").alias("mtime"),
            F.when(present, F.col("c.content_hash"))
            .otherwise(F.col("p.content_hash"))
            .alias("content_hash"),
            *(["rest", "was"] if rows else []),
        )
        .filter(F.col("change_type").isNotNull())
    )


def _rest(snapshot):
    return [name for name in snapshot.columns if name not in _COMPARED]


def rows_of_diff(diff: DataFrame, curr: DataFrame) -> DataFrame:
    """Complete current rows of the new and modified paths of a ``snapshot_diff`` with ``rows``."""
    entering = diff.filter(F.col("change_type").isin(NEW, MODIFIED))
    return entering.select(*_COMPARED, "rest.*").select(*curr.columns)


def totals_of_diff(diff: DataFrame, curr: DataFrame) -> DataFrame:
    """What a ``snapshot_diff`` with ``rows`` adds to the totals per drive, see ``stats.added_totals``."""
    came = signed_totals(rows_of_diff(diff, curr), 1)
    went = diff.filter(F.col("change_type").isin(DELETED, MODIFIED)).select("was.*")
    return came.unionByName(signed_totals(went, -1))


def stored_diff(prev: DataFrame, curr: DataFrame, hashes=True, rows=False, folder=None):
    """The rows of ``snapshot_diff`` as a stored table, and their number from its footers."""
    diff = materialise(snapshot_diff(prev, curr, hashes, rows), "diff", folder)
    return diff, diff.count()


def _of(diff, change_type):
    return diff.filter(F.col("change_type") == change_type)


def _matched_new(diff: DataFrame, how, rows, verify=False, hot_rows=None) -> DataFrame:
    """New rows with the smallest deleted path of equal name and size, and both hashes.

    With ``verify``, a path of equal hash comes first; then, where one of the hashes is missing,
    the smallest path that does not contradict; different hashes do not match. The deleted side shrinks to one row per
    key before each join, so no pairs within a group are ever formed and a match costs one row per new path.
    """
    diff = diff.withColumn("name", base_name("path"))
    deleted, old = _of(diff, DELETED), F.min(F.struct("path", "content_hash"))
    unhashed = F.min(F.when(F.col("content_hash").isNull(), F.struct("path", "content_hash")))
    plain = deleted.groupBy("size", "name").agg(
        old.alias("old"), *([unhashed.alias("unhashed")] if verify else [])
    )
    matched = lookup(_of(diff, NEW), plain, ["size", "name"], how, hot_rows, rows)
    if verify:
        # A key that no hash has stands for a missing one.
        hashed = deleted.withColumn("hash_key", F.col("content_hash")).filter("hash_key IS NOT NULL")
        equal = hashed.groupBy("size", "name", "hash_key").agg(old.alias("equal"))
        keyed = matched.withColumn("hash_key", F.coalesce("content_hash", F.lit("")))
        matched = lookup(keyed, equal, ["size", "name", "hash_key"], "left_outer", hot_rows, rows)
        other = F.when(F.col("content_hash").isNull(), F.col("old")).otherwise(F.col("unhashed"))
        matched = matched.withColumn("old", F.coalesce("equal", other))
        if how == "inner":
            matched = matched.filter("old IS NOT NULL")
    return matched.select(
        F.col("old.path").alias("old_path"),
        F.col("path").alias("new_path"),
        "size",
        F.col("old.content_hash").alias("old_hash"),
        F.col("content_hash").alias("new_hash"),
    )


def moves_from_diff(diff: DataFrame, rows=None, verify=False, hot_rows=None) -> DataFrame:
    """Moves among the rows of a ``snapshot_diff``, by equal name and size.

    A new path gets at most one old path, the smallest; one old path may serve several new paths.
    Empty files match as well. ``rows`` is the number of rows of ``diff``, if known. ``verify``
    looks for equal hashes first, see ``_matched_new``. Names and sizes of ``hot_rows`` new paths
    or more are matched apart, see ``spread.lookup``.
    """
    return _matched_new(diff, "inner", rows, verify, hot_rows).select(
        "old_path",
        "new_path",
        "size",
        F.lit(NAME_SIZE_CONFIDENCE).alias("confidence"),
        F.lit(NAME_SIZE_REASON).alias("reason"),
        "old_hash",
        "new_hash",
    )


def moves_name_size(prev: DataFrame, curr: DataFrame, hot_rows=None) -> DataFrame:
    """Moves between two snapshots by equal name and size, see ``moves_from_diff``."""
    diff, rows = stored_diff(prev, curr, hashes=False)
    return moves_from_diff(diff, rows, hot_rows=hot_rows).drop("old_hash", "new_hash")


def _confidence():
    """1.0 for equal hashes, 0.9 while one is missing, NULL for different ones."""
    return F.when(
        F.col("old_hash").isNull() | F.col("new_hash").isNull(), NAME_SIZE_CONFIDENCE
    ).when(F.col("old_hash") == F.col("new_hash"), VERIFIED_CONFIDENCE)


def verified(moves: DataFrame) -> DataFrame:
    """Candidate moves checked by content hash; those with different hashes are dropped."""
    return (
        moves.withColumn("confidence", _confidence())
        .filter(F.col("confidence").isNotNull())
        .select("old_path", "new_path", F.col("new_hash").alias("content_hash"), "confidence")
    )


def moves_verified(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Moves between two snapshots that their content hashes do not contradict."""
    return verified(moves_from_diff(*stored_diff(prev, curr), verify=True))


def changes_from_diff(diff: DataFrame, rows=None, verify=False, folder=None) -> DataFrame:
    """(path, change_type, old_path, confidence) with moves taken out of new and deleted.

    ``diff`` is read several times, so it should be a stored table; ``rows`` is the number of its
    rows, if known. With ``verify``, pairs with different hashes count as one new and one deleted
    file instead of a move.
    """
    kept = F.col("old_path").isNotNull()
    confidence = F.lit(NAME_SIZE_CONFIDENCE)
    if verify:
        confidence = _confidence()
        kept = kept & confidence.isNotNull()
    # Stored, since both the new rows and the old paths they took are read from it.
    arrived = materialise(
        _matched_new(diff, "left_outer", rows, verify).withColumn("kept", kept), "arrived", folder
    )
    appeared = arrived.select(
        F.col("new_path").alias("path"),
        F.when(F.col("kept"), MOVED).otherwise(NEW).alias("change_type"),
        F.when(F.col("kept"), F.col("old_path")).alias("old_path"),
        F.when(F.col("kept"), confidence).alias("confidence"),
    )
    # Many copies may come from one old path: duplicates combine before the shuffle.
    gone = arrived.filter("kept").select(F.col("old_path").alias("path")).distinct()

    def plain(rows):
        return rows.select(
            "path",
            "change_type",
            F.lit(None).cast("string").alias("old_path"),
            F.lit(None).cast("double").alias("confidence"),
        )

    lost = _of(diff, DELETED).join(gone, "path", "left_anti")
    return appeared.unionByName(plain(lost)).unionByName(plain(_of(diff, MODIFIED)))


def find_changes(prev: DataFrame, curr: DataFrame, verify=False) -> DataFrame:
    """The complete change set between two snapshots: new, deleted, modified and moved paths."""
    return changes_from_diff(*stored_diff(prev, curr, hashes=verify), verify)


def residual_new_deleted(prev: DataFrame, curr: DataFrame, verify=False) -> DataFrame:
    """New and deleted paths that no move explains."""
    changes = find_changes(prev, curr, verify)
    return changes.filter(F.col("change_type").isin(NEW, DELETED)).select("path", "change_type")


def moves_same_size(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """One-to-one moves by size alone: the k-th deleted path with the k-th new path of a size.

    Both sides are numbered in path order by one pass; a size may hold any number of files.
    """
    # Stored, since the range shuffle of the numbering looks at it twice.
    diff = stored_diff(prev, curr, hashes=False)[0].filter(F.col("change_type").isin(NEW, DELETED))
    ranked = numbered(
        diff.select("path", "size", "change_type"), ["path"], ["size", "change_type"], "k"
    )

    def side(change_type):
        return F.max(F.when(F.col("change_type") == change_type, F.col("path")))

    pairs = ranked.groupBy("size", "k").agg(
        side(DELETED).alias("old_path"), side(NEW).alias("new_path")
    )
    return pairs.dropna(subset=["old_path", "new_path"]).select("old_path", "new_path", "size")


def changed_rows(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Complete current rows of new and modified paths, from one join."""
    there = prev.select(*_COMPARED, F.lit(True).alias("there")).alias("p")
    joined = curr.alias("c").join(there, "path", "left_outer")
    changed = joined.filter(F.col("p.there").isNull() | _differs())
    return changed.select("path", *[F.col(f"c.{name}") for name in curr.columns if name != "path"])


def apply_changes(catalog: DataFrame, curr: DataFrame, changes: DataFrame) -> DataFrame:
    """The catalog after a change set: moves, then deletions, new and modified rows.

    Rows of moved-from, deleted and modified paths leave; current rows of new, modified and
    moved-to paths enter. ``changes`` comes from ``find_changes``.
    """
    entering = F.col("change_type") != DELETED
    leaving = F.col("change_type").isin(DELETED, MODIFIED)
    gone = changes.select(
        F.explode(
            F.array_compact(
                F.array(F.when(leaving, F.col("path")), F.col("old_path"))
            )
        ).alias("path")
    ).distinct()
    kept = catalog.join(gone, "path", "left_anti")
    entered = curr.join(changes.filter(entering).select("path"), "path", "left_semi")
    return kept.unionByName(entered, allowMissingColumns=True)


def archives_to_analyze(prev: DataFrame, curr: DataFrame, is_archive) -> DataFrame:
    """Work to do after a poll, in order of priority.

    Moves to verify (2), modified archives (3), new archives (5). ``is_archive`` is a column test
    on ``path``.
    """
    changes = find_changes(prev, curr)
    task = (
        F.when(F.col("change_type") == MOVED, "verify_move")
        .when((F.col("change_type").isin(NEW, MODIFIED)) & is_archive, "analyze_archive")
    )
    priority = (
        F.when(F.col("change_type") == MOVED, 2)
        .when(F.col("change_type") == MODIFIED, 3)
        .otherwise(5)
    )
    return (
        changes.select(priority.cast("bigint").alias("priority"), task.alias("task"), "path")
        .filter(F.col("task").isNotNull())
        .orderBy("priority", "path")
    )


def path_set_ops(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Every distinct path with the set it belongs to: added, removed or common.

    The two differences and the intersection come from one aggregation over the union.
    """
    sides = prev.select("path", F.lit(1).alias("old"), F.lit(0).alias("new")).unionByName(
        curr.select("path", F.lit(0).alias("old"), F.lit(1).alias("new"))
    )
    found = sides.groupBy("path").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    kind = F.when(F.col("old") == 0, "added").when(F.col("new") == 0, "removed")
    return found.select("path", kind.otherwise("common").alias("found_in"))
