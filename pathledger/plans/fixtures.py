"""Catalog tables derived from the given tables, and the same derivation as SQL for the oracles.

``documents`` becomes two snapshots of a catalog: ``doc_id % 20`` decides whether a file stays, is
new, deleted, modified, moved, copied or one of a tie. ``events`` becomes scan results,
``conversations`` archive members.
"""

from pyspark.sql import functions as F

from pathledger.functions.paths import ext_suffix, is_archive_listing

ENDINGS = [".zip", ".tar.gz", ".LOG", ".py", ".TXT", ".tgz", "", ".md"]

# File names with leading, trailing and doubled dots; "a" stands for a part of each file's own.
NAME_SHAPES = ["a.py", ".bashrc", "a.", "a.tar.gz", "..a", "A.ZIP", "noext", "a b.Tgz", "...", ".a.b"]

# Directories that the skip filters treat differently, by doc_id.
DIRECTORY_SHAPES = [
    "data", "node_modules", "robin", "My AppData", "AppData\\Local\\Temp", "Windows",
    "Windows.old", "$x", ".git", "a\\.b\\c", "x\\y\\z", "Program Files (x86)\\v",
]


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key, values):
    """The value at ``key % len(values)``."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int") + 1)


def _base(spark, sf_dir):
    key = F.col("doc_id")
    drive = (
        F.when(F.col("lang") == "en", "C:")
        .when(F.col("lang") == "fr", "D:")
        .when(F.col("lang") == "de", "E:")
        .otherwise("F:")
    )
    folder = F.when(key % 11 == 0, "node_modules").when(key % 13 == 0, "robin").otherwise("data")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        (key % 20).alias("k"),
        F.col("n_chars").alias("size"),
        (F.lit(1704067200) + (key % 90) * 86400).alias("mtime"),
        F.md5(F.col("text").cast("binary")).alias("content_hash"),
        "source",
        drive.alias("drive"),
        folder.alias("folder"),
        F.concat(F.lit("doc_"), key.cast("string"), _pick(key, ENDINGS)).alias("name"),
    )


def _placed(base, folders):
    """One row per folder of the array ``folders``, with the path there."""
    rows = base.withColumn("folder", F.explode(folders))
    path = F.concat_ws("\\", "drive", "source", "folder", "name")
    return rows.select("doc_id", path.alias("path"), "name", "drive", "size", "mtime", "content_hash")


def prev_snapshot(spark, sf_dir, with_id=False):
    base = _base(spark, sf_dir).filter("k <> 1")
    folders = F.when(F.col("k") == 6, F.array("folder", F.lit("dupB")))
    placed = _placed(base, folders.otherwise(F.array("folder")))
    return placed if with_id else placed.drop("doc_id")


def curr_snapshot(spark, sf_dir, with_id=False):
    key, k = F.col("doc_id"), F.col("k")
    base = _base(spark, sf_dir).filter((k != 0) | (key % 40 == 0))
    other = F.when(key % 40 == 4, F.md5(F.concat("content_hash", F.lit("x")).cast("binary")))
    base = (
        base.withColumn("size", F.when(k == 3, F.col("size") + 1).otherwise(F.col("size")))
        .withColumn("mtime", F.when(k == 2, F.col("mtime") + 60).otherwise(F.col("mtime")))
        .withColumn(
            "content_hash", other.when(key % 80 != 24, F.col("content_hash"))
        )
    )
    folders = (
        F.when(k == 0, F.array(F.lit("copyA"), F.lit("copyB")))
        .when(k == 6, F.array(F.lit("dupC")))
        .when(k == 4, F.array(F.lit("moved")))
        .otherwise(F.array("folder"))
    )
    placed = _placed(base, folders)
    return placed if with_id else placed.drop("doc_id")


def as_catalog(snapshot):
    """Catalog columns of a snapshot."""
    ext = ext_suffix("name")
    return snapshot.select(
        "path",
        "size",
        "mtime",
        F.lit(0).cast("bigint").alias("ctime"),
        "content_hash",
        is_archive_listing(ext).alias("is_archive"),
        "drive",
        ext.alias("ext"),
        F.lit(32).cast("bigint").alias("attributes"),
    )


def files(spark, sf_dir):
    """A catalog of all documents: the current snapshot, and the files that it lacks."""
    gone = prev_snapshot(spark, sf_dir, with_id=True).filter("doc_id % 40 = 20").drop("doc_id")
    return as_catalog(curr_snapshot(spark, sf_dir).unionByName(gone))


def shaped_names(spark, sf_dir):
    """doc_id and a file name of one of the shapes."""
    key = F.col("doc_id")
    name = F.replace(
        _pick(key, NAME_SHAPES), F.lit("a"), F.concat(F.lit("f"), key.cast("string"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))


def shaped_paths(spark, sf_dir):
    """doc_id, directory below the root, name, and the whole path; directories of many shapes."""
    key = F.col("doc_id")
    name = F.concat(F.lit("doc_"), key.cast("string"), _pick(key, ENDINGS))
    shaped = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat_ws("\\", "source", _pick(key, DIRECTORY_SHAPES)).alias("directory"),
        name.alias("name"),
        F.col("n_chars").alias("size"),
    )
    relative = F.concat_ws("\\", "directory", "name")
    return shaped.withColumn("relative", relative).withColumn(
        "path", F.concat(F.lit("C:\\"), relative)
    )


def scan_results(events):
    """Scan outcomes: one row per event, an event of type ``error`` is a failed read."""
    # Event times are UTC without a zone.
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts"))
    at = local.cast("timestamp")
    return events.select(
        F.col("event_id").alias("scan_id"),
        at.alias("scanned_ts"),
        F.unix_seconds(at).alias("scanned_at"),
        _pick(F.col("user_id"), ["C:", "D:", "E:", "F:"]).alias("drive"),
        F.concat(
            F.lit("N:\\u"), F.col("user_id").cast("string"),
            F.when(F.col("event_id") % 7 == 0, "\\a|9|8\\e").otherwise("\\e"),
            F.col("event_id").cast("string"),
        ).alias("path"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 4096).alias("size"),
        F.unix_seconds(at).alias("modified"),
        F.when(F.col("event_type") == "error", "timed out").alias("error"),
    )


def members(spark, sf_dir):
    """Archive members: a conversation is an archive, a turn a member."""
    is_zip = F.col("conv_id") % 2 == 0
    size = F.length("text").cast("bigint")
    return table(spark, sf_dir, "conversations").select(
        F.concat(
            F.lit("C:\\conv\\"), F.col("conv_id").cast("string"),
            F.when(is_zip, ".zip").otherwise(".tar.gz"),
        ).alias("archive_path"),
        F.col("turn").alias("member_no"),
        F.concat("role", F.lit("/"), F.col("turn").cast("string"), F.lit(".Txt")).alias(
            "internal_path"
        ),
        F.when(is_zip, F.floor(size / 2)).otherwise(size).alias("compressed_size"),
        size.alias("uncompressed_size"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("turn")).alias("modified"),
        F.lit(".txt").alias("file_type"),
    )


# The two snapshots in SQL that Spark and DuckDB both run.
SNAPSHOT_SQL = """
base AS (
  SELECT doc_id, doc_id % 20 AS k, n_chars AS size, 1704067200 + (doc_id % 90) * 86400 AS mtime,
    md5(text) AS content_hash, source,
    CASE lang WHEN 'en' THEN 'C:' WHEN 'fr' THEN 'D:' WHEN 'de' THEN 'E:' ELSE 'F:' END AS drive,
    CASE WHEN doc_id % 11 = 0 THEN 'node_modules' WHEN doc_id % 13 = 0 THEN 'robin' ELSE 'data' END AS dir,
    concat('doc_', CAST(doc_id AS VARCHAR(20)), CASE doc_id % 8 WHEN 0 THEN '.zip' WHEN 1 THEN '.tar.gz'
      WHEN 2 THEN '.LOG' WHEN 3 THEN '.py' WHEN 4 THEN '.TXT' WHEN 5 THEN '.tgz' WHEN 6 THEN '' ELSE '.md' END) AS name
  FROM documents),
prev AS (
  SELECT doc_id, concat(drive, chr(92), source, chr(92), dir, chr(92), name) AS path, name, drive, size, mtime, content_hash
  FROM base WHERE k <> 1
  UNION ALL
  SELECT doc_id, concat(drive, chr(92), source, chr(92), 'dupB', chr(92), name), name, drive, size, mtime, content_hash
  FROM base WHERE k = 6),
curr AS (
  SELECT doc_id, concat(drive, chr(92), source, chr(92), CASE WHEN k = 4 THEN 'moved' ELSE dir END, chr(92), name) AS path,
    name, drive, CASE WHEN k = 3 THEN size + 1 ELSE size END AS size,
    CASE WHEN k = 2 THEN mtime + 60 ELSE mtime END AS mtime,
    CASE WHEN doc_id % 40 = 4 THEN md5(concat(content_hash, 'x')) WHEN doc_id % 80 = 24 THEN NULL
      ELSE content_hash END AS content_hash
  FROM base WHERE k NOT IN (0, 6)
  UNION ALL
  SELECT doc_id, concat(drive, chr(92), source, chr(92), 'copyA', chr(92), name), name, drive, size, mtime, content_hash
  FROM base WHERE doc_id % 40 = 0
  UNION ALL
  SELECT doc_id, concat(drive, chr(92), source, chr(92), 'copyB', chr(92), name), name, drive, size, mtime, content_hash
  FROM base WHERE doc_id % 40 = 0
  UNION ALL
  SELECT doc_id, concat(drive, chr(92), source, chr(92), 'dupC', chr(92), name), name, drive, size, mtime, content_hash
  FROM base WHERE k = 6),
files AS (
  SELECT path, size, mtime, CAST(0 AS BIGINT) AS ctime, content_hash,
    lower(regexp_extract(name, '^.+([.][^.]+)$', 1)) IN ('.zip', '.rar', '.7z', '.tar', '.gz') AS is_archive,
    drive, lower(regexp_extract(name, '^.+([.][^.]+)$', 1)) AS ext, CAST(32 AS BIGINT) AS attributes
  FROM (SELECT path, name, drive, size, mtime, content_hash FROM curr
    UNION ALL SELECT path, name, drive, size, mtime, content_hash FROM prev WHERE doc_id % 40 = 20))"""

# Scan results and archive members for DuckDB.
SCAN_SQL = """
scan_results AS (
  SELECT event_id AS scan_id, CAST(floor(epoch(ts)) AS BIGINT) AS scanned_at,
    ['C:', 'D:', 'E:', 'F:'][user_id % 4 + 1] AS drive,
    'N:' || chr(92) || 'u' || user_id
      || CASE WHEN event_id % 7 = 0 THEN chr(92) || 'a|9|8' || chr(92) || 'e' ELSE chr(92) || 'e' END
      || event_id AS path,
    CASE WHEN event_id % 5 <> 0 THEN event_id % 4096 END AS size,
    CAST(floor(epoch(ts)) AS BIGINT) AS modified,
    CASE WHEN event_type = 'error' THEN 'timed out' END AS error
  FROM events)"""

MEMBER_SQL = """
members AS (
  SELECT 'C:' || chr(92) || 'conv' || chr(92) || conv_id
      || CASE WHEN conv_id % 2 = 0 THEN '.zip' ELSE '.tar.gz' END AS archive_path,
    turn AS member_no, role || '/' || turn || '.Txt' AS internal_path,
    CAST(CASE WHEN conv_id % 2 = 0 THEN length(text) // 2 ELSE length(text) END AS BIGINT) AS compressed_size,
    CAST(length(text) AS BIGINT) AS uncompressed_size,
    1704067200 + turn AS modified, '.txt' AS file_type
  FROM conversations)"""


def _sql_list(values):
    return "[" + ", ".join("'" + v.replace("\\", "' || chr(92) || '") + "'" for v in values) + "]"


SHAPE_SQL = f"""
shaped_names AS (
  SELECT doc_id, replace({_sql_list(NAME_SHAPES)}[doc_id % {len(NAME_SHAPES)} + 1], 'a', 'f' || doc_id) AS name
  FROM documents),
shaped_paths AS (
  SELECT *, 'C:' || chr(92) || relative AS path FROM (
    SELECT *, directory || chr(92) || name AS relative FROM (
      SELECT doc_id, source || chr(92) || {_sql_list(DIRECTORY_SHAPES)}[doc_id % {len(DIRECTORY_SHAPES)} + 1] AS directory,
        'doc_' || doc_id || {_sql_list(ENDINGS)}[doc_id % {len(ENDINGS)} + 1] AS name, n_chars AS size
      FROM documents)))"""


def with_tables(query, *parts):
    """A query with the derived tables it needs in front."""
    return "WITH " + ",".join(parts or [SNAPSHOT_SQL]) + "\n" + query
