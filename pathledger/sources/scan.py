"""File metadata from storage."""

import os
import stat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pathledger.functions.content import SAMPLED_WHOLE, content_md5_at, sample_md5_at
from pathledger.functions.paths import drive_of, ext_splitext, is_archive_scan
from pathledger.operators.filters import only_success, skip_dirs_substring, skip_extensions
from pathledger.operators.spread import group_sizes
from pathledger.operators.stats import duplicate_files
from pathledger.session import fresh_folder, materialise, stored_at
from pathledger.sources.remote import listed_at, local_path

_LISTED = (
    "path string, name string, is_dir boolean, size bigint, mtime_ns bigint, ctime_ns bigint, "
    "error string"
)
_COLUMNS = [field.split()[0] for field in _LISTED.split(", ")]
# Rows leave a task as Arrow's own: pandas would make floats of numbers beside nulls.
_ARROW = pa.schema(
    zip(_COLUMNS, [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()])
)
_BATCH = 10_000


def scan_files(spark: SparkSession, *roots, glob=None) -> DataFrame:
    """Path, size and modification time below the roots, on any file system Spark reads.

    Only metadata is read. Spark's own listing leaves out empty files and names that start with
    ``.`` or ``_``, follows links, and keeps the list on the driver; ``walk_files`` does not.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(list(roots))
    return found.select(
        "path",
        F.col("length").alias("size"),
        F.unix_seconds("modificationTime").alias("mtime"),
        F.col("modificationTime").alias("mtime_ts"),
    )


def _names(directory):
    """Entries directly in ``directory``; of a mounted one only names and kinds, links left out."""
    try:
        remote = listed_at(directory)
        if remote is not None:
            for path, name, is_dir, size, modified in remote:
                yield path, name, is_dir, None if is_dir else size, modified, None, None
            return
        with os.scandir(directory) as listing:
            for entry in listing:
                try:
                    is_dir = entry.is_dir(follow_symlinks=False)
                    if not is_dir and not entry.is_file(follow_symlinks=False):
                        continue
                except OSError as error:
                    yield entry.path, entry.name, False, None, None, None, str(error)
                    continue
                yield entry.path, entry.name, is_dir, None, None, None, None
    except (OSError, pa.ArrowException) as error:
        yield directory, os.path.basename(directory), True, None, None, None, str(error)


def _list_directories(batches):
    rows = []
    for batch in batches:
        for directory in batch.column("path").to_pylist():
            for row in _names(directory):
                rows.append(dict(zip(_COLUMNS, row)))
                if len(rows) == _BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows = []
    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _measured(row):
    """The entry, a dict, with size and times; as it is where the listing brought them or an error."""
    if row["error"] is not None or row["mtime_ns"] is not None:
        return row
    try:
        info = os.stat(row["path"], follow_symlinks=False)
    except OSError as error:
        return {**row, "is_dir": False, "error": str(error)}
    size = None if row["is_dir"] else info.st_size
    times = {"mtime_ns": info.st_mtime_ns, "ctime_ns": info.st_ctime_ns}
    return {**row, "is_dir": stat.S_ISDIR(info.st_mode), "size": size, **times}


def _stat_entries(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pylist([_measured(row) for row in batch.to_pylist()], schema=_ARROW)


def walk_files(spark: SparkSession, *roots, depth=None, skip_names=(), skip_hidden=False, store=None):
    """Scan results of file trees that every executor has mounted or reaches by a ``scheme://`` address.

    One Spark job per directory level: tasks list the directories of the level, and the stored
    listing gives the directories of the next. A directory is listed once, by one task; its names are
    then dealt to all tasks, which ask for size and times, so one hot directory of millions of files keeps all cores
    at work. Addresses are those of stores that Arrow knows (hdfs, s3, gs, abfs); their listing brings size and
    time along, and has no ``ctime``. Entries that cannot be read keep an ``error``.
    ``depth`` limits the levels below a root, ``skip_names`` and ``skip_hidden`` (names starting
    with ``$`` or ``.``) leave whole directories out. With ``store``, a folder in shared storage, a
    scan that broke off goes on after the last level it finished, given the same arguments.
    """
    # A directory below another root is listed once, with that one.
    roots = sorted({local_path(root).rstrip("/") or "/" for root in roots})
    roots = [r for r in roots if not any(r != o and f"{r}/".startswith(o.rstrip("/") + "/") for o in roots)]
    store = store or fresh_folder(spark, "walk")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = 0
    frontier = spark.createDataFrame([(root,) for root in roots], "path string")
    waiting = len(roots)
    while waiting:
        target = f"{store}/level={level}"
        if not stored_at(spark, target):
            # Directories are few bytes but much work each: spread them by count.
            spread = frontier.repartition(min(width, waiting), "path")
            names = spread.mapInArrow(_list_directories, _LISTED)
            # One directory may hold most files: its names are spread again for their stat calls.
            listed = names.repartition(width, "path").mapInArrow(_stat_entries, _LISTED)
            listed.write.mode("overwrite").parquet(target)
        if depth and level >= depth:
            break
        inner = spark.read.schema(_LISTED).parquet(target)
        frontier = inner.filter("is_dir AND error IS NULL")
        if skip_names:
            frontier = frontier.filter(~F.col("name").isin(list(skip_names)))
        if skip_hidden:
            frontier = frontier.filter(~F.col("name").rlike("^[$.]"))
        frontier = frontier.select("path")
        waiting = frontier.count()
        level += 1
    found = spark.read.schema(_LISTED).option("recursiveFileLookup", True).parquet(store)
    return found.filter("NOT is_dir OR error IS NOT NULL").select(
        "path",
        "size",
        F.col("mtime_ns").alias("modified_ns"),
        F.expr("mtime_ns div 1000000000").alias("mtime"),
        F.expr("ctime_ns div 1000000000").alias("ctime"),
        ext_splitext("name").alias("ext"),
        "error",
    )


def files_from_scan(results: DataFrame, drive=None, hash_limit=None) -> DataFrame:
    """Catalog rows of the files that a ``walk_files`` found, skip lists applied.

    Files get the MD5 of their whole content, read block by block inside the tasks; with
    ``hash_limit``, only files below that size. An unreadable file has none. ``drive`` is the
    name of the scanned root; by default the start of each path.
    """
    kept = skip_extensions(skip_dirs_substring(only_success(results)))
    # Reading is work per file: spread the files by count.
    width = int(results.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = kept.repartition(width, "path")
    content_hash = content_md5_at("path")
    if hash_limit is not None:
        small = F.col("size") < hash_limit
        content_hash = F.when(small, content_md5_at(F.when(small, F.col("path"))))
    return kept.select(
        "path",
        "size",
        "mtime",
        "ctime",
        content_hash.alias("content_hash"),
        is_archive_scan("path").alias("is_archive"),
        (drive_of("path") if drive is None else F.lit(drive)).alias("drive"),
        "ext",
        F.lit(0).cast("bigint").alias("attributes"),
    )


def content_classes(results: DataFrame) -> DataFrame:
    """(path, size, sample_hash, content_hash) of the files that a ``walk_files`` found, read no further than needed.

    Classes of files that may be equal are refined in steps: by size; by a digest of at most 12 KiB from start, middle
    and end; by the MD5 of the whole content. A file alone in its class goes no step further and has NULL from
    there on: with a size of its own it is never opened, with a sample of its own never read whole. Where the sample
    covers the file, it is the content's MD5 and the file is read once. Skip lists apply; a file without size or
    that cannot be read is in no class.
    """
    kept = skip_extensions(skip_dirs_substring(only_success(results))).select("path", "size")
    width = int(results.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = F.col("alike") > 1
    sized = group_sizes(kept, "size", "alike").withColumn("alike", F.when(F.col("size").isNotNull(), F.col("alike")))
    # Reading is work per file: spread the files by count. Each step is stored, so no file is read twice for it.
    sample = sample_md5_at(F.when(shared, F.col("path")), "size")
    sampled = sized.repartition(width, "path").select("path", "size", sample.alias("sample_hash"))
    sampled = materialise(sampled.withColumn("class", F.concat_ws(":", "size", "sample_hash")), "sampled")
    opened = F.col("sample_hash").isNotNull()
    classed = group_sizes(sampled.filter(opened), "class", "alike")
    covered = F.col("size") <= SAMPLED_WHOLE
    whole = content_md5_at(F.when(shared & ~covered, F.col("path")))
    hashed = classed.repartition(width, "path").withColumn("whole", whole)
    content_hash = F.when(shared, F.when(covered, F.col("sample_hash")).otherwise(F.col("whole")))
    hashed = hashed.select("path", "size", "sample_hash", content_hash.alias("content_hash"))
    alone = sampled.filter(~opened).select("path", "size", "sample_hash", F.lit(None).cast("string").alias("content_hash"))
    return materialise(hashed.unionByName(alone), "classes")


def duplicates_from_scan(results: DataFrame) -> DataFrame:
    """(content_hash, path, copies) of every scanned file whose whole content occurs more than once."""
    return duplicate_files(content_classes(results))
