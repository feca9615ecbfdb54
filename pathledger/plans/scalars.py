"""Queries for the column functions."""

from pyspark.sql import functions as F

from pathledger.functions import content, paths, values
from pathledger.plans import fixtures as fx
from pathledger.plans.registry import query

SHAPED = fx.SHAPE_SQL


@query(
    """
    WITH listed AS (
      SELECT doc_id, 'doc_' || doc_id AS name,
        CASE doc_id % 4 WHEN 0 THEN 'C:' || chr(92) || source WHEN 1 THEN 'C:' || chr(92)
          WHEN 2 THEN 'C:' ELSE source || '/' END AS directory
      FROM documents)
    SELECT doc_id, CASE WHEN directory = 'C:' OR right(directory, 1) IN (chr(92), '/')
      THEN directory || name ELSE directory || chr(92) || name END AS path
    FROM listed
    """
)
def full_path(spark, sf_dir):
    key = F.col("doc_id")
    directory = (
        F.when(key % 4 == 0, F.concat(F.lit("C:\\"), "source"))
        .when(key % 4 == 1, "C:\\")
        .when(key % 4 == 2, "C:")
        .otherwise(F.concat("source", F.lit("/")))
    )
    name = F.concat(F.lit("doc_"), key.cast("string"))
    listed = fx.table(spark, sf_dir, "documents").select(
        "doc_id", directory.alias("directory"), name.alias("name")
    )
    return listed.select("doc_id", paths.full_path("directory", "name").alias("path"))


@query(
    """
    WITH cut AS (SELECT doc_id, left('E:' || chr(92) || source, CAST(doc_id % 6 AS INTEGER)) AS path
      FROM documents)
    SELECT doc_id, CASE WHEN length(path) > 2 THEN left(path, 2) ELSE '' END AS drive FROM cut
    """
)
def drive_of(spark, sf_dir):
    path = F.concat(F.lit("E:\\"), "source")
    length = (F.col("doc_id") % 6).cast("int")
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", paths.drive_of(F.substr(path, F.lit(1), length)).alias("drive")
    )


@query(
    fx.with_tables(
        """
        SELECT doc_id, name, CASE
            WHEN NOT contains(name, '.') OR right(name, 1) = '.' THEN ''
            WHEN length(name) - strpos(reverse(name), '.') = 0 THEN ''
            ELSE lower('.' || split_part(name, '.', -1)) END AS ext
        FROM shaped_names
        """,
        SHAPED,
    )
)
def ext_suffix(spark, sf_dir):
    return fx.shaped_names(spark, sf_dir).withColumn("ext", paths.ext_suffix("name"))


@query(
    fx.with_tables(
        """
        SELECT doc_id, name, CASE WHEN contains(ltrim(name, '.'), '.')
            THEN lower('.' || split_part(name, '.', -1)) ELSE '' END AS ext
        FROM shaped_names
        """,
        SHAPED,
    )
)
def ext_splitext(spark, sf_dir):
    return fx.shaped_names(spark, sf_dir).withColumn("ext", paths.ext_splitext("name"))


@query(
    """
    WITH texts AS (
      SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN CAST(n_chars AS VARCHAR)
        WHEN 2 THEN '-' || n_chars WHEN 3 THEN n_chars || ' ' WHEN 4 THEN '99999999999999999999'
        ELSE '2024-01-01' END AS text FROM documents)
    SELECT doc_id, CASE WHEN regexp_full_match(text, '[0-9]+')
      THEN coalesce(TRY_CAST(text AS BIGINT), 0) ELSE 0 END AS number FROM texts
    """
)
def guarded_int(spark, sf_dir):
    key, chars = F.col("doc_id"), F.col("n_chars").cast("string")
    text = (
        F.when(key % 6 == 0, "")
        .when(key % 6 == 1, chars)
        .when(key % 6 == 2, F.concat(F.lit("-"), chars))
        .when(key % 6 == 3, F.concat(chars, F.lit(" ")))
        .when(key % 6 == 4, "99999999999999999999")
        .otherwise("2024-01-01")
    )
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", values.guarded_int(text).alias("number")
    )


@query(
    fx.with_tables(
        """
        SELECT path, ends_with(path, '.zip') OR ends_with(path, '.gz') AS is_archive FROM curr
        """
    )
)
def is_archive_listing(spark, sf_dir):
    ext = paths.ext_suffix("name")
    return fx.curr_snapshot(spark, sf_dir).select(
        "path", paths.is_archive_listing(ext).alias("is_archive")
    )


@query(
    fx.with_tables(
        """
        SELECT doc_id, path, regexp_matches(lower(path), '([.]zip|[.]rar|[.]7z|[.]tar|[.]gz|[.]tgz)$') AS is_archive
        FROM (SELECT doc_id, 'C:' || chr(92) || 'f' || name AS path FROM shaped_names
          UNION ALL SELECT doc_id, path FROM shaped_paths)
        """,
        SHAPED,
    )
)
def is_archive_scan(spark, sf_dir):
    odd = fx.shaped_names(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("C:\\f"), "name").alias("path")
    )
    scanned = odd.unionByName(fx.shaped_paths(spark, sf_dir).select("doc_id", "path"))
    return scanned.withColumn("is_archive", paths.is_archive_scan("path"))


@query(
    """
    SELECT 'documents' AS kind, doc_id AS id, md5(text) AS content_hash FROM documents
    UNION ALL SELECT 'pages', page_id, md5(html) FROM pages
    """
)
def smart_hash(spark, sf_dir):
    def hashed(name, key, text):
        raw = F.col(text).cast("binary")
        return fx.table(spark, sf_dir, name).select(
            F.lit(name).alias("kind"),
            F.col(key).alias("id"),
            content.smart_hash(raw, F.octet_length(raw)).alias("content_hash"),
        )

    return hashed("documents", "doc_id", "text").unionByName(hashed("pages", "page_id", "html"))


@query(
    fx.with_tables(
        "SELECT path, split_part(path, chr(92), -1) AS name FROM shaped_paths", SHAPED
    )
)
def base_name(spark, sf_dir):
    return fx.shaped_paths(spark, sf_dir).select("path", paths.base_name("path").alias("name"))


@query(
    """
    SELECT doc_id, (1704067200 + doc_id * 86399) * 1000000 AS whole,
      (1704067200 + doc_id) * 1000000 + 250000 AS fraction,
      (1704067200 + doc_id) * 1000000 + 123456 AS nanos
    FROM documents
    """
)
def epoch_to_ts(spark, sf_dir):
    """Timestamps of the three kinds of epoch numbers, shown as microseconds."""
    key = F.col("doc_id")
    seconds = F.lit(1704067200) + key
    whole = values.epoch_seconds(F.lit(1704067200) + key * 86399)
    nanos = values.epoch_nanos(seconds * 1_000_000_000 + 123_456_789)
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.unix_micros(whole).alias("whole"),
        F.unix_micros(values.epoch_seconds(seconds + 0.25)).alias("fraction"),
        F.unix_micros(nanos).alias("nanos"),
    )


@query(
    fx.with_tables(
        """
        SELECT doc_id, len(string_split(relative, chr(92))) AS file_depth,
          CASE WHEN doc_id % 3 = 0 THEN 0 ELSE len(string_split(directory, chr(92))) END AS directory_depth
        FROM shaped_paths
        """,
        SHAPED,
    )
)
def path_depth(spark, sf_dir):
    # Every third directory stands for the root itself.
    directory = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("directory"))
    return fx.shaped_paths(spark, sf_dir).select(
        "doc_id",
        paths.path_depth(paths.below_root("path", F.lit("C:\\"))).alias("file_depth"),
        paths.path_depth(directory).alias("directory_depth"),
    )


@query(
    """
    SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'network' WHEN 2 THEN 'network' WHEN 3 THEN 'unknown'
      ELSE 'ntfs_local' END AS drive_type FROM documents
    """
)
def drive_type(spark, sf_dir):
    key = F.col("doc_id")
    root = (
        F.when(key % 5 == 0, "C:\\")
        .when(key % 5 == 1, "Z:\\")
        .when(key % 5 == 2, F.concat(F.lit("\\\\"), "source", F.lit("\\share")))
        .when(key % 5 == 4, "z:\\")
    )
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", paths.drive_type(root).alias("drive_type")
    )


@query(
    fx.with_tables(
        """
        SELECT scan_id, path || '|' || coalesce(CAST(size AS VARCHAR), '0') || '|' || modified || '|NETWORK' AS line
        FROM scan_results
        """,
        fx.SCAN_SQL,
    )
)
def checkpoint_row(spark, sf_dir):
    results = fx.scan_results(fx.table(spark, sf_dir, "events"))
    return results.select(
        "scan_id", values.checkpoint_row("path", "size", "modified").alias("line")
    )


@query(
    """
    SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 0.0
      ELSE round(CAST(100.0 AS DOUBLE) * doc_id / n_chars, 1) END AS pct FROM documents
    """
)
def progress_pct(spark, sf_dir):
    total = F.when(F.col("doc_id") % 10 == 0, 0).otherwise(F.col("n_chars"))
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", values.progress_pct("doc_id", total).alias("pct")
    )


@query(
    """
    SELECT doc_id, printf('%02d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) AS runtime
    FROM (SELECT doc_id, doc_id * 977 AS s FROM documents)
    """
)
def runtime_hms(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", values.runtime_hms(F.col("doc_id") * 977).alias("runtime")
    )
