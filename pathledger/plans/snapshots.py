"""Queries that compare the two snapshots."""

from pyspark.sql import functions as F

from pathledger.functions.paths import drive_of, is_archive_scan
from pathledger.operators import archives, digests, ordering, snapshots as ops, stats
from pathledger.plans import fixtures as fx
from pathledger.plans.registry import query
from pathledger.session import fresh_folder


def change_sql(prev="prev", curr="curr", tag=""):
    """Change-set tables in SQL: diff, moves, and changes with the moves taken out."""
    return f"""
diff{tag} AS (
  SELECT coalesce(c.path, p.path) AS path,
    CASE WHEN p.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'deleted' ELSE 'modified' END AS change_type
  FROM {prev} p FULL OUTER JOIN {curr} c ON p.path = c.path
  WHERE p.path IS NULL OR c.path IS NULL OR p.size <> c.size OR p.mtime <> c.mtime),
moves{tag} AS (
  SELECT min(p.path) AS old_path, c.path AS new_path, c.size, c.content_hash AS new_hash,
    arg_min(p.content_hash, p.path) AS old_hash, c.drive
  FROM {curr} c JOIN {prev} p ON c.size = p.size AND c.name = p.name
  WHERE c.path NOT IN (SELECT path FROM {prev}) AND p.path NOT IN (SELECT path FROM {curr})
  GROUP BY c.path, c.size, c.content_hash, c.drive),
changes{tag} AS (
  SELECT new_path AS path, 'moved' AS change_type, old_path FROM moves{tag}
  UNION ALL
  SELECT path, change_type, NULL FROM diff{tag}
  WHERE NOT (change_type = 'new' AND path IN (SELECT new_path FROM moves{tag}))
    AND NOT (change_type = 'deleted' AND path IN (SELECT old_path FROM moves{tag})))"""


def _sql(text):
    return fx.with_tables(text, fx.SNAPSHOT_SQL, change_sql())


def _pair(spark, sf_dir):
    return fx.prev_snapshot(spark, sf_dir), fx.curr_snapshot(spark, sf_dir)


@query(_sql("SELECT path, size FROM curr WHERE path NOT IN (SELECT path FROM prev)"))
def new_files(spark, sf_dir):
    return ops.new_files(*_pair(spark, sf_dir)).select("path", "size")


@query(_sql("SELECT path, size FROM prev WHERE path NOT IN (SELECT path FROM curr)"))
def deleted_files(spark, sf_dir):
    return ops.deleted_files(*_pair(spark, sf_dir)).select("path", "size")


@query(
    _sql(
        """
        SELECT c.path, p.size AS old_size, c.size AS new_size, p.mtime AS old_mtime, c.mtime AS new_mtime
        FROM curr c JOIN prev p ON c.path = p.path WHERE p.size <> c.size OR p.mtime <> c.mtime
        """
    )
)
def modified_files(spark, sf_dir):
    return ops.modified_files(*_pair(spark, sf_dir))


@query(_sql("SELECT path, change_type FROM diff"))
def snapshot_diff(spark, sf_dir):
    return ops.snapshot_diff(*_pair(spark, sf_dir)).select("path", "change_type")


@query(_sql("SELECT path, change_type FROM diff"))
def digest_tree_diff(spark, sf_dir):
    """The same rows by trees of digests, stored for each snapshot."""
    snapshots, trees = [], []
    for rows in _pair(spark, sf_dir):
        location = fresh_folder(spark, "tree")
        digests.write_tree(rows, location)
        snapshots.append(rows)
        trees.append(digests.read_tree(spark, location))
    return digests.tree_diff(*snapshots, *trees, hashes=False).select("path", "change_type")


_MOVES_SQL = _sql(
    """
    SELECT old_path, new_path, size, CAST(0.9 AS DOUBLE) AS confidence, 'same_name_and_size' AS reason
    FROM moves
    """
)


@query(_MOVES_SQL)
def moves_name_size(spark, sf_dir):
    return ops.moves_name_size(*_pair(spark, sf_dir))


@query(_MOVES_SQL)
def moves_name_size_split(spark, sf_dir):
    """By the way that frequent names take: two copies of a name count as many here."""
    return ops.moves_name_size(*_pair(spark, sf_dir), hot_rows=2)


@query(
    _sql(
        """
        , pairs AS (
          SELECT p.path AS old_path, c.path AS new_path, p.content_hash AS old_hash, c.content_hash AS new_hash
          FROM curr c JOIN prev p ON c.size = p.size AND c.name = p.name
          WHERE c.path NOT IN (SELECT path FROM prev) AND p.path NOT IN (SELECT path FROM curr)),
        best AS (
          SELECT new_path, new_hash, min(old_path) FILTER (old_hash = new_hash) AS equal,
            min(old_path) FILTER (new_hash IS NULL OR old_hash IS NULL) AS unknown
          FROM pairs GROUP BY new_path, new_hash)
        SELECT coalesce(equal, unknown) AS old_path, new_path, new_hash AS content_hash,
          CAST(CASE WHEN equal IS NULL THEN 0.9 ELSE 1.0 END AS DOUBLE) AS confidence
        FROM best WHERE equal IS NOT NULL OR unknown IS NOT NULL
        """
    )
)
def moves_verified(spark, sf_dir):
    return ops.moves_verified(*_pair(spark, sf_dir))


@query(_sql("SELECT path, change_type FROM changes WHERE change_type IN ('new', 'deleted')"))
def residual_new_deleted(spark, sf_dir):
    return ops.residual_new_deleted(*_pair(spark, sf_dir))


@query(_sql("SELECT path, change_type, old_path FROM changes"))
def find_changes(spark, sf_dir):
    return ops.find_changes(*_pair(spark, sf_dir)).drop("confidence")


@query(
    _sql(
        """,
        gone AS (SELECT path, size, row_number() OVER (PARTITION BY size ORDER BY path) AS k FROM prev
          WHERE path NOT IN (SELECT path FROM curr)),
        came AS (SELECT path, size, row_number() OVER (PARTITION BY size ORDER BY path) AS k FROM curr
          WHERE path NOT IN (SELECT path FROM prev))
        SELECT gone.path AS old_path, came.path AS new_path, size FROM gone JOIN came USING (size, k)
        """
    )
)
def moves_same_size(spark, sf_dir):
    return ops.moves_same_size(*_pair(spark, sf_dir))


@query(
    _sql(
        """
        SELECT f.* FROM files f
        WHERE f.path IN (SELECT path FROM diff WHERE change_type IN ('new', 'modified'))
        """
    )
)
def changed_rows(spark, sf_dir):
    return ops.changed_rows(fx.prev_snapshot(spark, sf_dir), fx.files(spark, sf_dir))


@query(
    fx.with_tables(
        """,
        shelf AS (SELECT DISTINCT archive_path, 'C:' AS drive, conv AS size FROM (
          SELECT 'C:' || chr(92) || 'conv' || chr(92) || conv_id
            || CASE WHEN conv_id % 2 = 0 THEN '.zip' ELSE '.tar.gz' END AS archive_path, conv_id AS conv
          FROM conversations WHERE conv_id % 3 <> 0))
        SELECT archive_path, drive, size, internal_path, uncompressed_size FROM members JOIN shelf USING (archive_path)
        """,
        fx.MEMBER_SQL,
    )
)
def archive_file_members(spark, sf_dir):
    members = fx.members(spark, sf_dir)
    # The catalog knows two thirds of the archives.
    conv = F.regexp_extract("archive_path", r"(\d+)[.]", 1).cast("bigint")
    shelf = (
        members.select(F.col("archive_path").alias("path"), conv.alias("size"))
        .filter("size % 3 <> 0")
        .distinct()
        .withColumn("drive", F.lit("C:"))
    )
    return archives.archive_file_members(shelf, members).select(
        "archive_path", "drive", "size", "internal_path", "uncompressed_size"
    )


@query(
    _sql(
        """
        SELECT CAST(CASE change_type WHEN 'moved' THEN 2 WHEN 'modified' THEN 3 ELSE 5 END AS BIGINT) AS priority,
          CASE WHEN change_type = 'moved' THEN 'verify_move' ELSE 'analyze_archive' END AS task, path
        FROM changes
        WHERE change_type = 'moved' OR (change_type IN ('new', 'modified')
          AND regexp_matches(lower(path), '([.]zip|[.]tgz|[.]gz)$'))
        ORDER BY priority, path
        """
    )
)
def archives_to_analyze(spark, sf_dir):
    return ops.archives_to_analyze(*_pair(spark, sf_dir), is_archive_scan("path"))


@query(_sql("SELECT change_type, count(*) AS changes FROM changes GROUP BY change_type"))
def change_counts(spark, sf_dir):
    return stats.change_counts(ops.find_changes(*_pair(spark, sf_dir)))


@query(
    _sql(
        """
        SELECT drive, count(*) AS files, count(*) FILTER (is_archive) AS archives,
          coalesce(any_value(m.n), 0) AS moves, CAST(ceil(count(*) / 100.0) AS BIGINT) AS shards
        FROM files LEFT JOIN (SELECT drive, count(*) AS n FROM moves GROUP BY drive) m USING (drive)
        GROUP BY drive
        """
    )
)
def namespace_totals(spark, sf_dir):
    moves = ops.moves_name_size(*_pair(spark, sf_dir)).select(drive_of("new_path").alias("drive"))
    return stats.namespace_totals(fx.files(spark, sf_dir), moves, shard_rows=100)


@query(
    _sql(
        """
        SELECT coalesce(c.path, p.path) AS path, CASE WHEN p.path IS NULL THEN 'added'
          WHEN c.path IS NULL THEN 'removed' ELSE 'common' END AS found_in
        FROM (SELECT DISTINCT path FROM prev) p FULL OUTER JOIN (SELECT DISTINCT path FROM curr) c USING (path)
        """
    )
)
def path_set_ops(spark, sf_dir):
    return ops.path_set_ops(*_pair(spark, sf_dir))


@query(
    _sql(
        """
        SELECT path, size, mtime, content_hash, version FROM (
          SELECT *, row_number() OVER (PARTITION BY path ORDER BY version DESC) AS rn FROM (
            SELECT path, size, mtime, content_hash, 1 AS version FROM prev
            UNION ALL SELECT path, size, mtime, content_hash, 2 FROM curr))
        WHERE rn = 1
        """
    )
)
def latest_version(spark, sf_dir):
    prev, curr = _pair(spark, sf_dir)
    columns = ["path", "size", "mtime", "content_hash"]
    both = prev.select(*columns, F.lit(1).alias("version")).unionByName(
        curr.select(*columns, F.lit(2).alias("version"))
    )
    return ordering.latest_version(both, "version")


@query(_sql("SELECT path, size, mtime, content_hash FROM curr"))
def apply_changes(spark, sf_dir):
    """The previous snapshot after the change set equals the current one."""
    prev, curr = _pair(spark, sf_dir)
    changes = ops.find_changes(prev, curr)
    return ops.apply_changes(prev, curr, changes).select("path", "size", "mtime", "content_hash")
