"""Queries that write files and read them back. Each call uses folders of its own."""

import datetime
import io
import tarfile
import zipfile
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from pathledger.operators import snapshots as ops
from pathledger.plans import fixtures as fx
from pathledger.plans.registry import query
from pathledger.plans.snapshots import change_sql
from pathledger.session import fresh_folder, materialise
from pathledger.sources import catalog, checkpoints, listing, scan
from pathledger.sources.archive_members import archive_members as list_members
from pathledger.sources.remote import open_for_writing

# Files that a folder of the tree of documents holds.
_FOLDER_FILES = 1000

# Listing rows: short, long, with quoted comma and quote, without directory, with an empty last
# field, with a date that is no number, and rows that repeat one path.
_LISTING_SQL = """
lines AS (
  SELECT doc_id, doc_id % 10 AS shape, source, n_chars,
    CASE doc_id % 10 WHEN 2 THEN 'na,me_' || doc_id || '.zip' WHEN 6 THEN 'say "x"_' || doc_id || '.PY'
      WHEN 7 THEN 'again.7z' WHEN 8 THEN 'again.7z' ELSE 'doc_' || doc_id || '.md' END AS name,
    CASE doc_id % 10 WHEN 3 THEN '' ELSE 'D:' || chr(92) || source END AS directory
  FROM documents),
usable AS (
  SELECT doc_id, name, directory, n_chars AS size,
    CASE WHEN shape = 5 THEN 0 ELSE 1704067200 + doc_id END AS mtime,
    CAST(1704000000 AS BIGINT) AS ctime,
    CAST(CASE WHEN shape = 4 THEN 0 ELSE 32 END AS BIGINT) AS attributes
  FROM lines WHERE shape NOT IN (0, 3))"""


def _written_listing(spark, sf_dir):
    key, shape = F.col("doc_id"), F.col("doc_id") % 10
    number = key.cast("string")

    def line(name, directory, mtime, last):
        return F.concat_ws(
            ",", name, directory, F.col("n_chars").cast("string"), mtime, F.lit("1704000000"), last
        )

    named = F.concat(F.lit("doc_"), number, F.lit(".md"))
    directory = F.concat(F.lit("D:\\"), "source")
    mtime, flags = (F.lit(1704067200) + key).cast("string"), F.lit("32")
    quoted_comma = F.concat(F.lit('"na,me_'), number, F.lit('.zip"'))
    quoted_quote = F.concat(F.lit('"say ""x""_'), number, F.lit('.PY"'))
    text = (
        F.when(shape == 0, F.concat_ws(",", named, directory, F.lit("12")))
        .when(shape == 1, line(named, directory, mtime, F.lit("32,more")))
        .when(shape == 2, line(quoted_comma, directory, mtime, flags))
        .when(shape == 3, line(named, F.lit(""), mtime, flags))
        .when(shape == 4, line(named, directory, mtime, F.lit("")))
        .when(shape == 5, line(named, directory, F.lit("2024-01-01"), flags))
        .when(shape == 6, line(quoted_quote, directory, mtime, flags))
        .when(shape.isin(7, 8), line(F.lit("again.7z"), directory, mtime, flags))
        .otherwise(line(named, directory, mtime, flags))
    )
    location = fresh_folder(spark, "listing")
    # One raw column and no quoting: the lines land in the files as they are, below a header.
    (
        fx.table(spark, sf_dir, "documents")
        .orderBy("doc_id")
        .select(text.alias("Name,Path,Size,Date Modified,Date Created,Attributes"))
        .write.option("header", True)
        .option("sep", "\x01")
        .option("quote", "\x00")
        .csv(location)
    )
    return location


@query(fx.with_tables("SELECT name, directory, CAST(size AS VARCHAR) AS size FROM usable", _LISTING_SQL))
def valid_listing_rows(spark, sf_dir):
    raw = listing.read_raw_listing(spark, _written_listing(spark, sf_dir))
    return raw.select("name", "directory", "size")


@query(
    fx.with_tables(
        """,
        last AS (SELECT * FROM usable QUALIFY
          row_number() OVER (PARTITION BY directory, name ORDER BY doc_id DESC) = 1)
        SELECT directory || chr(92) || name AS path, size, mtime, ctime, CAST(NULL AS VARCHAR) AS content_hash,
          regexp_matches(name, '[.](zip|7z)$') AS is_archive, 'D:' AS drive,
          lower('.' || split_part(name, '.', -1)) AS ext, attributes
        FROM last
        """,
        _LISTING_SQL,
    )
)
def read_listing_csv(spark, sf_dir):
    return listing.read_listing_csv(spark, _written_listing(spark, sf_dir))


@query(
    """
    SELECT CAST(doc_id AS BIGINT) AS size, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS name_md5
    FROM documents WHERE text IS NOT NULL
    """
)
def listing_line_breaks(spark, sf_dir):
    """A listing whose names are whole texts, with their line breaks, commas and quotes."""
    documents = fx.table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    zero = [F.lit("0").alias(name) for name in ("mtime", "ctime", "attributes")]
    place = F.concat(F.lit("D:\\"), F.coalesce("source", F.lit(""))).alias("directory")
    location = fresh_folder(spark, "listing")
    listing.write_listing_csv(
        documents.select(F.col("text").alias("name"), place, F.col("doc_id").cast("string").alias("size"), *zero), location
    )
    raw = listing.read_raw_listing(spark, location)
    return raw.select(F.col("size").cast("bigint").alias("size"), F.md5(F.col("name").cast("binary")).alias("name_md5"))


def _written_checkpoint(spark, sf_dir):
    location = fresh_folder(spark, "checkpoint-text")
    checkpoints.write_checkpoint_text(fx.scan_results(fx.table(spark, sf_dir, "events")), location)
    return location


@query(
    fx.with_tables(
        """
        SELECT path, coalesce(size, 0) AS size, CAST(modified AS DOUBLE) AS modified
        FROM scan_results WHERE error IS NULL
        """,
        fx.SCAN_SQL,
    )
)
def read_checkpoint_text(spark, sf_dir):
    return checkpoints.read_checkpoint_text(spark, _written_checkpoint(spark, sf_dir))


@query(
    fx.with_tables(
        """
        SELECT path || '|' || coalesce(CAST(size AS VARCHAR), '0') || '|' || modified || '|NETWORK' AS value
        FROM scan_results WHERE error IS NULL
        """,
        fx.SCAN_SQL,
    )
)
def write_checkpoint_text(spark, sf_dir):
    return spark.read.text(_written_checkpoint(spark, sf_dir))


def _text_tree(spark, sf_dir):
    """The documents as text files: one per language and hundred of ids, in folders by both."""
    location = fresh_folder(spark, "tree")
    shard = F.floor(F.col("doc_id") / 100)
    documents = fx.table(spark, sf_dir, "documents").select("lang", shard.alias("shard"), "text")
    (
        documents.repartition("lang", "shard")
        .write.partitionBy("lang", "shard")
        .text(location)
    )
    return location


_TREE_SQL = """
    SELECT lang, doc_id // 100 AS shard, CAST(sum(strlen(text) + 1) AS BIGINT) AS size, {extra}
    FROM documents GROUP BY lang, doc_id // 100
"""


def _tree_rows(found, extra):
    return found.filter(~F.col("path").endswith("_SUCCESS") & ~F.col("path").contains(".crc")).select(
        F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang"),
        F.regexp_extract("path", "shard=([0-9]+)/", 1).cast("bigint").alias("shard"),
        "size",
        extra,
    )


@query(_TREE_SQL.format(extra="TRUE AS dated"))
def scan_files(spark, sf_dir):
    found = scan.scan_files(spark, _text_tree(spark, sf_dir))
    return _tree_rows(found, (F.col("mtime") > 1704067200).alias("dated"))


@query(_TREE_SQL.format(extra="'.txt' AS ext"))
def walk_files(spark, sf_dir):
    found = scan.walk_files(spark, _text_tree(spark, sf_dir), skip_hidden=True)
    return _tree_rows(found, F.col("ext"))


def _shelf_writer(location):
    """Writes the rows of a task, sorted by id, as one file per id, in folders of _FOLDER_FILES files."""

    def write(batches):
        task, written = TaskContext.get().partitionId(), 0
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for doc, texts in groupby(rows, lambda row: row[0]):
            name = "__HIVE_DEFAULT_PARTITION__" if doc is None else doc
            with open_for_writing(f"{location}/{task}-{written // _FOLDER_FILES}/doc={name}.txt") as handle:
                for _, text in texts:
                    handle.write(text.encode() + b"\n")
            written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["files"])

    return write


def _document_tree(spark, sf_dir):
    """A folder with a text file per document. Tasks write the files in place: no one moves them one by one afterwards."""
    location = fresh_folder(spark, "tree")
    documents = fx.table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text")
    written = documents.sortWithinPartitions("doc_id").mapInArrow(_shelf_writer(location), "files long")
    written.agg(F.sum("files")).first()
    return location


@query(
    """
    SELECT doc_id, md5(text || chr(10)) AS content_hash, copies
    FROM (SELECT doc_id, text, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE text IS NOT NULL)
    WHERE copies > 1
    """
)
def duplicates_from_scan(spark, sf_dir):
    """Copies among files of one document each, found by opening only files that may have one."""
    location = _document_tree(spark, sf_dir)
    found = scan.duplicates_from_scan(scan.walk_files(spark, location).filter(F.col("ext") == ".txt"))
    doc_id = F.regexp_extract("path", "/doc=([0-9]+)[.]txt$", 1).cast("bigint")
    return found.select(doc_id.alias("doc_id"), "content_hash", "copies")


@query(fx.with_tables("SELECT * FROM files"))
def write_catalog(spark, sf_dir):
    location = fresh_folder(spark, "catalog")
    catalog.write_catalog(fx.files(spark, sf_dir), location)
    return spark.read.parquet(location)


@query(fx.with_tables("SELECT * FROM files"))
def read_catalog(spark, sf_dir):
    files, location = fx.files(spark, sf_dir), fresh_folder(spark, "catalog")
    system = F.col("drive") == "C:"
    catalog.write_catalog(files.filter(system), f"{location}/0")
    catalog.write_catalog(files.filter(~system).drop("ctime"), f"{location}/1")
    merged = catalog.read_catalog(spark, f"{location}/0", f"{location}/1")
    return merged.withColumn("ctime", F.coalesce("ctime", F.lit(0).cast("bigint")))


@query(fx.with_tables("SELECT path, change_type FROM diff", fx.SNAPSHOT_SQL, change_sql()))
def bucketed_snapshot_diff(spark, sf_dir):
    """The comparison of two snapshots stored in the same buckets."""
    stored = []
    for rows in (fx.prev_snapshot(spark, sf_dir), fx.curr_snapshot(spark, sf_dir)):
        location = fresh_folder(spark, "snapshot")
        catalog.write_snapshot(rows, location, 8)
        stored.append(catalog.read_snapshot(spark, location, 8))
    return ops.snapshot_diff(*stored, hashes=False).select("path", "change_type")


@query(
    fx.with_tables(
        """
        SELECT old_path, new_path, new_hash AS content_hash,
          CAST(CASE WHEN new_hash IS NULL THEN 0.9 ELSE 1.0 END AS DOUBLE) AS confidence
        FROM moves WHERE new_hash IS NULL OR new_hash = old_hash
        """,
        fx.SNAPSHOT_SQL,
        change_sql(),
    )
)
def move_table(spark, sf_dir):
    """Verified moves, appended in two parts."""
    moves = ops.moves_verified(fx.prev_snapshot(spark, sf_dir), fx.curr_snapshot(spark, sf_dir))
    stamped = moves.withColumn("detected_at", F.current_timestamp())
    location = fresh_folder(spark, "moves")
    sure = F.col("confidence") == 1.0
    catalog.append_moves(stamped.filter(sure), location)
    catalog.append_moves(stamped.filter(~sure), location)
    return spark.read.parquet(location).drop("detected_at")


def _packed(doc_id, text):
    """An archive of two members and a directory; every tenth is cut short."""
    data, stamp = text.encode(), datetime.datetime(2024, 1, 2, 3, 4, 6, tzinfo=datetime.timezone.utc)
    name, out = f"a/{doc_id}.TXT", io.BytesIO()
    if doc_id % 2 == 0:
        with zipfile.ZipFile(out, "w") as archive:
            for member, content in (("a/", b""), (name, data), ("b.md", b"tail")):
                archive.writestr(zipfile.ZipInfo(member, stamp.timetuple()[:6]), content)
    else:
        with tarfile.open(fileobj=out, mode="w:gz", compresslevel=1) as archive:
            folder = tarfile.TarInfo("a")
            folder.type = tarfile.DIRTYPE
            archive.addfile(folder)
            for member, content in ((name, data), ("b.md", b"tail")):
                info = tarfile.TarInfo(member)
                info.size, info.mtime = len(content), stamp.timestamp()
                archive.addfile(info, io.BytesIO(content))
    packed = out.getvalue()
    return packed[: len(packed) // 2] if doc_id % 10 == 7 else packed


def _archive_rows(batches):
    for batch in batches:
        contents = [_packed(i, t) for i, t in zip(batch["doc_id"], batch["text"])]
        paths = [f"{i}.zip" if i % 2 == 0 else f"{i}.tar.gz" for i in batch["doc_id"]]
        yield pd.DataFrame(
            {"path": paths, "size": [len(c) for c in contents], "content": contents}
        )


@query(
    """
    WITH sound AS (SELECT *, doc_id || CASE WHEN doc_id % 2 = 0 THEN '.zip' ELSE '.tar.gz' END AS archive_path
      FROM documents)
    SELECT archive_path, CAST(0 AS BIGINT) AS member_no, 'a/' || doc_id || '.TXT' AS internal_path,
      CAST(strlen(text) AS BIGINT) AS compressed_size, CAST(strlen(text) AS BIGINT) AS uncompressed_size,
      CAST(1704164646 AS BIGINT) AS modified, '.txt' AS file_type, FALSE AS damaged
    FROM sound WHERE doc_id % 10 <> 7
    UNION ALL
    SELECT archive_path, 1, 'b.md', 4, 4, 1704164646, '.md', FALSE FROM sound WHERE doc_id % 10 <> 7
    UNION ALL
    SELECT archive_path, NULL, NULL, NULL, NULL, NULL, NULL, TRUE FROM sound WHERE doc_id % 10 = 7
    """
)
def archive_members(spark, sf_dir):
    """Members of archives made from the documents; the bytes are a column, not files."""
    documents = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = documents.mapInPandas(_archive_rows, "path string, size bigint, content binary")
    return list_members(packed, content="content").select(
        "archive_path",
        "member_no",
        "internal_path",
        "compressed_size",
        "uncompressed_size",
        F.unix_seconds("modified").alias("modified"),
        "file_type",
        F.col("error").isNotNull().alias("damaged"),
    )


def _shelver(folder):
    """Writes the texts of a batch of documents as members of one zip in the shared folder."""

    def shelve(rows):
        rows, out = rows.sort_values("doc_id"), io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            for number, text in zip(rows["doc_id"], rows["text"]):
                info = zipfile.ZipInfo(f"{number}/PK\x01\x02/{'n' * int(number % 90)}.txt", (2024, 1, 2, 3, 4, 6))
                archive.writestr(info, (text or "").encode())
        path = f"{folder}/{rows['shelf'].iloc[0]}.zip"
        with open_for_writing(path) as handle:
            handle.write(out.getvalue())
        return pd.DataFrame({"path": [path], "size": [len(out.getvalue())]})

    return shelve


@query(
    """
    SELECT doc_id // 200 AS shelf, row_number() OVER (PARTITION BY doc_id // 200 ORDER BY doc_id) - 1 AS member_no,
      doc_id || '/PK' || chr(1) || chr(2) || '/' || repeat('n', CAST(doc_id % 90 AS INTEGER)) || '.txt' AS internal_path,
      CAST(strlen(coalesce(text, '')) AS BIGINT) AS uncompressed_size
    FROM documents
    """
)
def archive_directories(spark, sf_dir):
    """Members of zip files at paths, their directories read in ranges by several tasks."""
    documents = fx.table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 200).alias("shelf"))
    shelver = _shelver(fresh_folder(spark, "shelf"))
    shelves = materialise(documents.groupBy("shelf").applyInPandas(shelver, "path string, size bigint"), "shelves")
    members = list_members(shelves, range_bytes=1 << 12)
    shelf = F.regexp_extract("archive_path", r"(\d+)[.]zip$", 1).cast("bigint")
    return members.select(shelf.alias("shelf"), "member_no", "internal_path", "uncompressed_size")
