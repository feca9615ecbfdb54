"""An inverted index over the trigrams of file names, beside a stored catalog.

The index lies in the folder ``_names`` of the catalog, which Spark passes over when it lists the
catalog. A version of it has ``postings``, the catalog rows of each trigram, sorted by trigram in
buckets, and ``meta``, one text cell with what a search must know beforehand. Postings hold whole
rows: names that contain a given text lie scattered over a catalog in any order, so places in the
catalog would lead back to reading most of it.
"""

import json
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pathledger.functions.globs import tokens
from pathledger.functions.paths import base_name
from pathledger.session import materialise
from pathledger.sources.catalog import read_table

FOLDER = "_names"
GRAM = 3
# A trigram of more than one in POSTED rows is not posted: reading its rows would save little, and
# no key of the index is hot. One search reads at most this share of the rows.
POSTED = 64
# Trigrams of more than one in KNOWN rows are known by number before a search; their counts add up to the
# rows times the trigrams of a name, so there are at most KNOWN times the mean length of a name of them.
KNOWN = 4096
BUCKET_ROWS = 4_000_000
# Small row groups, so that a search reads little beside its trigram.
_GROUP_BYTES = 1 << 20
# So many rows are sorted by one task without a sample of them first.
FEW_ROWS = 200_000
_START, _END = "\x02", "\x03"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)

_opened = {}


def name_grams(path="path"):
    """Distinct trigrams of the file name between marks for its start and end, A-Z in lower case."""
    padded = F.concat(F.lit(_START), F.translate(base_name(path), _UPPER, _LOWER), F.lit(_END))
    starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - (GRAM - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda at: F.substring(padded, at, F.lit(GRAM))))


def glob_grams(glob):
    """Trigrams that every name has that matches the glob; without regard to the case of A-Z."""
    runs, run = [], _START
    for kind, text in tokens(glob):
        if kind == "char":
            run += text
        else:
            runs.append(run)
            run = ""
    runs.append(run + _END)
    folded = [run.translate(_FOLD) for run in runs]
    return sorted({run[i : i + GRAM] for run in folded for i in range(len(run) - GRAM + 1)})


def _bucket_of(gram, buckets):
    return zlib.crc32(gram.encode()) % buckets


def _folder(spark, location):
    """The file system and path of a location, on any storage that Spark reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _versions(spark, catalog):
    """Finished versions of a catalog's index, the newest one first."""
    system, folder = _folder(spark, f"{catalog}/{FOLDER}")
    if not system.exists(folder):
        return []
    found = []
    for status in system.listStatus(folder):
        mark = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "meta/_SUCCESS")
        if system.exists(mark):
            found.append((system.getFileStatus(mark).getModificationTime(), status.getPath().toString()))
    return [path for _, path in sorted(found, reverse=True)]


@dataclass(frozen=True)
class NameIndex:
    """A finished version of an index: where it is, and what it covers."""

    location: str
    catalog: str
    rows: int
    buckets: int
    known: dict
    schema: StructType
    files: frozenset

    def gram_for(self, glob):
        """The rarest posted trigram that matching names must have; None if there is no such."""
        posted = [g for g in glob_grams(glob) if self.known.get(g, 0) * POSTED <= self.rows]
        return min(posted, key=lambda g: self.known.get(g, 0), default=None)

    def postings(self, spark, gram) -> DataFrame:
        """The catalog rows whose name has the trigram, as of the build of the index."""
        place = f"{self.location}/postings/bucket={_bucket_of(gram, self.buckets)}"
        system, folder = _folder(spark, place)
        if not system.exists(folder):
            return spark.createDataFrame([], self.schema)
        stored = StructType([StructField("gram", StringType()), *self.schema])
        return spark.read.schema(stored).parquet(place).filter(F.col("gram") == gram).drop("gram")

    def candidates(self, spark, glob) -> tuple[DataFrame, bool] | None:
        """Catalog rows among which are all whose name matches; None if only the catalog can tell.

        With them whether they are ``FEW_ROWS`` at most, by the numbers counted when it was built.
        Files that came to the catalog after the index was built are read whole. If files that it
        covers are gone, the index says nothing about the catalog any more.
        """
        gram = self.gram_for(glob)
        if gram is None:
            return None
        reader = spark.read.schema(self.schema)
        there = set(reader.parquet(self.catalog).inputFiles())
        if not self.files <= there:
            return None
        found = self.postings(spark, gram)
        later = sorted(there - self.files)
        if later:
            newer = reader.option("basePath", self.catalog).parquet(*map(unquote, later))
            found = found.unionByName(newer.select(*found.columns))
        # A trigram that is not known is rarer than those that are.
        return found, not later and self.known.get(gram, self.rows // KNOWN) <= FEW_ROWS


def open_name_index(spark: SparkSession, catalog) -> NameIndex | None:
    """The newest finished index of a stored catalog, if it has one."""
    versions = _versions(spark, catalog.rstrip("/"))
    if not versions:
        return None
    if versions[0] not in _opened:
        meta = json.loads(spark.read.option("wholetext", True).text(f"{versions[0]}/meta").first()[0])
        schema = StructType.fromJson(meta.pop("schema"))
        _opened[versions[0]] = NameIndex(
            versions[0], catalog.rstrip("/"), schema=schema, files=frozenset(meta.pop("files")), **meta
        )
    return _opened[versions[0]]


def build_name_index(spark: SparkSession, catalog, bucket_rows=BUCKET_ROWS) -> NameIndex:
    """Index the names of a stored catalog; the version before stays for searches that still read it.

    Counting the trigrams combines before the shuffle and tells the frequent ones; the rows of all others go
    through one range shuffle by bucket, trigram and path, which cuts large trigrams as well. Rows
    without a path have no name and are in no posting.
    """
    catalog = catalog.rstrip("/")
    files = read_table(spark, catalog)
    covered = files.inputFiles()
    rows = files.count()
    posted = files.select(F.explode(name_grams()).alias("gram"), "*")
    counts = materialise(posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "grams")
    known = {r.gram: r.n for r in counts.filter(F.col("n") * KNOWN > rows).collect()}
    common = [gram for gram, n in known.items() if n * POSTED > rows]
    total = (counts.agg(F.sum("n")).first()[0] or 0) - sum(known[g] for g in common)
    buckets = max(1, -(-total // bucket_rows))
    location = f"{catalog}/{FOLDER}/{uuid.uuid4().hex}"
    order = ["bucket", "gram", "path"]
    if common:
        # At most POSTED times the mean length of a name.
        posted = posted.filter(~F.col("gram").isin(common))
    posted = posted.withColumn("bucket", F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(buckets)))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        posted.repartitionByRange(max(buckets, width), *order)
        .sortWithinPartitions(*order)
        .write.partitionBy("bucket")
        .option("compression", "zstd")
        .option("parquet.block.size", _GROUP_BYTES)
        .parquet(f"{location}/postings")
    )
    meta = {"rows": rows, "buckets": buckets, "known": known, "schema": files.schema.jsonValue(), "files": covered}
    # The last table of a version: its marker makes the version count.
    spark.range(1, numPartitions=1).select(F.lit(json.dumps(meta)).alias("value")).write.text(f"{location}/meta")
    system, _ = _folder(spark, catalog)
    for old in _versions(spark, catalog)[2:]:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(old), True)
    return open_name_index(spark, catalog)
