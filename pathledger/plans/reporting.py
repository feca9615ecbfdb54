"""Queries for statistics, order and limits."""

from pyspark.sql import functions as F

from pathledger.operators import archives, ordering, stats
from pathledger.plans import fixtures as fx
from pathledger.plans.registry import query

_PER_DRIVE = """
  SELECT {drive} AS drive, count(*) AS files, count(*) FILTER (is_archive) AS archives,
    CAST(sum(size) AS BIGINT) AS bytes FROM files"""


def _results(spark, sf_dir):
    return fx.scan_results(fx.table(spark, sf_dir, "events"))


@query(fx.with_tables(_PER_DRIVE.format(drive="drive") + " GROUP BY drive"))
def drive_stats(spark, sf_dir):
    return stats.drive_stats(fx.files(spark, sf_dir))


@query(
    fx.with_tables(
        _PER_DRIVE.format(drive="drive") + " GROUP BY drive UNION ALL" + _PER_DRIVE.format(drive="'ALL'")
    )
)
def total_stats(spark, sf_dir):
    return stats.total_stats(fx.files(spark, sf_dir))


@query(
    fx.with_tables(
        """,
        drives AS (SELECT drive, count(*) AS files, max(scanned_at) - min(scanned_at) AS elapsed
          FROM scan_results GROUP BY drive),
        rates AS (SELECT *, coalesce(files / CAST(nullif(elapsed, 0) AS DOUBLE), 0) AS rate FROM drives)
        SELECT drive, files, elapsed, round(rate, 6) AS rate FROM rates
        UNION ALL
        SELECT 'ALL', CAST(sum(files) AS BIGINT), max(elapsed), round(sum(rate), 6) FROM rates
        """,
        fx.SCAN_SQL,
    )
)
def scan_rate(spark, sf_dir):
    return stats.scan_rate(_results(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query(
    fx.with_tables(
        """,
        counts AS (SELECT count(*) FILTER (error IS NULL) AS scanned, count(error) AS errors,
          max(scanned_at) - min(scanned_at) AS elapsed FROM scan_results)
        SELECT scanned, scanned AS saved, errors, elapsed,
          round(scanned / CAST(elapsed AS DOUBLE), 3) AS rate,
          round((1 - errors / CAST(greatest(1, scanned) AS DOUBLE)) * 100, 1) AS success_pct
        FROM counts
        """,
        fx.SCAN_SQL,
    )
)
def scan_summary(spark, sf_dir):
    return stats.scan_summary(_results(spark, sf_dir))


_COPIES_SQL = fx.with_tables(
    """
    SELECT content_hash, copies, path FROM (
      SELECT content_hash, path, count(*) OVER (PARTITION BY content_hash) AS copies
      FROM files WHERE content_hash IS NOT NULL) WHERE copies > 1
    """
)


@query(_COPIES_SQL)
def duplicate_files(spark, sf_dir):
    return stats.duplicate_files(fx.files(spark, sf_dir))


@query(_COPIES_SQL)
def duplicate_files_split(spark, sf_dir):
    """By the way that frequent contents take: three copies count as many here."""
    return stats.duplicate_files(fx.files(spark, sf_dir), hot_rows=3)


@query(
    fx.with_tables(
        "SELECT size, path, count(*) OVER (PARTITION BY size) AS files_of_size FROM files"
    )
)
def paths_by_size(spark, sf_dir):
    return stats.paths_by_size(fx.files(spark, sf_dir))


@query(
    fx.with_tables(
        """
        SELECT count(DISTINCT archive_path) AS archives_processed, count(*) AS members_found
        FROM members
        """,
        fx.MEMBER_SQL,
    )
)
def archive_totals(spark, sf_dir):
    return archives.archive_totals(archives.archives_nested(fx.members(spark, sf_dir), 3))


@query(
    fx.with_tables(
        """
        SELECT archive_path, member_no // 3 AS part_no, count(*) AS members,
          CAST(sum(uncompressed_size) AS BIGINT) AS bytes,
          string_agg(internal_path, ',' ORDER BY member_no) AS names
        FROM members GROUP BY archive_path, member_no // 3
        """,
        fx.MEMBER_SQL,
    )
)
def archives_nested(spark, sf_dir):
    nested = archives.archives_nested(fx.members(spark, sf_dir), 3)
    add = lambda total, member: total + member["uncompressed_size"]
    return nested.select(
        "archive_path",
        "part_no",
        F.size("contents").cast("bigint").alias("members"),
        F.aggregate("contents", F.lit(0).cast("bigint"), add).alias("bytes"),
        F.array_join("contents.internal_path", ",").alias("names"),
    )


@query(
    fx.with_tables(
        """
        SELECT archive_path, member_no, internal_path, compressed_size, uncompressed_size,
          modified, file_type FROM members
        """,
        fx.MEMBER_SQL,
    )
)
def explode_archives(spark, sf_dir):
    nested = archives.archives_nested(fx.members(spark, sf_dir))
    flat = archives.explode_archives(nested)
    return flat.withColumn("modified", F.unix_seconds("modified"))


@query(
    fx.with_tables(
        """,
        totals AS ("""
        + _PER_DRIVE.format(drive="drive")
        + " GROUP BY drive UNION ALL"
        + _PER_DRIVE.format(drive="'ALL'")
        + """)
        SELECT drive, '{"drive":"' || drive || '","files":' || files || ',"archives":' || archives
          || ',"bytes":' || bytes || '}' AS json FROM totals
        """
    )
)
def stats_json(spark, sf_dir):
    return stats.stats_json(fx.files(spark, sf_dir))


@query(
    fx.with_tables(
        """
        SELECT path, drive, (row_number() OVER (PARTITION BY drive ORDER BY path) - 1) // 50 AS batch
        FROM files
        """
    )
)
def checkpoint_batches(spark, sf_dir):
    listed = fx.files(spark, sf_dir).select("path", "drive")
    return ordering.checkpoint_batches(listed, rows=50)


@query(
    fx.with_tables(
        """
        SELECT path, drive FROM (SELECT path, drive,
            row_number() OVER (PARTITION BY drive ORDER BY path) AS rn FROM files)
        WHERE rn <= 60
        """
    )
)
def cap_per_root(spark, sf_dir):
    return ordering.cap_per_root(fx.files(spark, sf_dir).select("path", "drive"), 60)


@query(fx.with_tables("SELECT path, size FROM files ORDER BY path LIMIT 100"))
def scan_limit(spark, sf_dir):
    return ordering.scan_limit(fx.files(spark, sf_dir).select("path", "size"), 100)


@query(fx.with_tables("SELECT path, size, mtime FROM files ORDER BY path"))
def sorted_listing(spark, sf_dir):
    return ordering.sorted_listing(fx.files(spark, sf_dir).select("path", "size", "mtime"))


@query(
    fx.with_tables(
        """,
        counted AS (SELECT error, scanned_at - min(scanned_at) OVER () AS elapsed,
            count(*) FILTER (error IS NULL) OVER so_far AS files_scanned,
            count(error) OVER so_far AS errors
          FROM scan_results
          WINDOW so_far AS (ORDER BY scanned_at, scan_id ROWS UNBOUNDED PRECEDING))
        SELECT files_scanned, errors, elapsed,
          round(coalesce(files_scanned / CAST(nullif(elapsed, 0) AS DOUBLE), 0), 3) AS rate
        FROM counted WHERE error IS NULL AND files_scanned % 250 = 0
        """,
        fx.SCAN_SQL,
    )
)
def progress_milestones(spark, sf_dir):
    return ordering.progress_milestones(_results(spark, sf_dir), every=250)


@query(
    fx.with_tables(
        """
        SELECT scanned_at // 3600 * 3600 AS bucket, count(*) AS files FROM scan_results
        GROUP BY scanned_at // 3600 ORDER BY files DESC, bucket LIMIT 1
        """,
        fx.SCAN_SQL,
    )
)
def peak_rate(spark, sf_dir):
    return ordering.peak_rate(_results(spark, sf_dir))


@query(
    fx.with_tables(
        """
        SELECT path, size, content_hash, 'files' AS namespace FROM files
        UNION ALL
        SELECT 'N:' || chr(92) || page_id || '.html', CAST(length(html) AS BIGINT), NULL, 'pages' FROM pages
        """
    )
)
def merge_shards(spark, sf_dir):
    local = fx.files(spark, sf_dir).select("path", "size", "content_hash")
    web = fx.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("N:\\"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.length("html").cast("bigint").alias("size"),
    )
    return ordering.merge_shards(
        local.withColumn("namespace", F.lit("files")), web.withColumn("namespace", F.lit("pages"))
    )
