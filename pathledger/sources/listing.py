"""Listings exported as CSV: name, path, size, mtime, ctime, attributes, with a header row."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pathledger.functions.paths import drive_of, ext_suffix, full_path, is_archive_listing
from pathledger.functions.values import guarded_int
from pathledger.operators.filters import valid_listing_rows
from pathledger.session import materialise

RAW = (
    "name string, directory string, size string, mtime string, ctime string, "
    "attributes string, _malformed string"
)
_TEXT = ["name", "directory", "size", "mtime", "ctime", "attributes"]


_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_malformed",
    "quote": '"',
    "escape": '"',
    "nullValue": "\x00",
    "emptyValue": "",
}
# Characters of one row; a row of more is a quote that was never closed.
ROW_LIMIT = 1_000_000

# A quoted field without its last quote, a whole field, and lines that end inside quotes: begun outside, begun inside.
_INSIDE = '[^"]*+(?:""[^"]*+)*+'
_FIELDS = f'(?:(?:[^",][^,]*+|"{_INSIDE}"[^,]*+|),)*+'
_OPENS = f'^{_FIELDS}"{_INSIDE}\\z'
_STAYS = f'^{_INSIDE}(?:\\z|"[^,]*+,{_FIELDS}"{_INSIDE}\\z)'


def _lines(spark, location):
    """Lines with their place, and whether each ends inside quotes if it begins outside or inside."""
    lines = spark.read.text(location).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )
    # An undecodable byte becomes U+FFFD here as in Spark's own CSV reader.
    text = F.col("value")
    return lines.withColumn("opens", text.rlike(_OPENS)).withColumn("stays", text.rlike(_STAYS))


def _in_quotes(lines):
    """``lines`` with ``inside``: whether each begins within the quotes of an earlier one.

    A line maps the state before it to the state after it. Each split composes its lines, a running
    composition over the splits of a file gives the state at which a split begins, and that settles its lines. A line
    with one outcome for both states fixes it; one that swaps them counts.
    """
    split = Window.partitionBy("file", "block")
    before = split.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("opens") == F.col("stays"), F.col("opens").cast("int"))
    swaps = (F.col("opens") & ~F.col("stays")).cast("int")
    lines = lines.withColumn("fixed", fixed).withColumn("swaps", swaps)
    lines = lines.withColumn("swapped", F.coalesce(F.sum("swaps").over(before), F.lit(0)))
    # The state after the last fixed line, reckoned back to the start of the split.
    base = F.when(F.col("fixed").isNotNull(), F.pmod(F.col("fixed") + F.col("swapped"), F.lit(2)))
    lines = lines.withColumn("base", base)
    lines = materialise(lines.withColumn("known", F.last("base", True).over(before)), "lines")

    ends = lines.groupBy("file", "block").agg(
        F.max_by("base", F.when(F.col("base").isNotNull(), F.col("row"))).alias("base"),
        F.sum("swaps").alias("swaps"),
    )
    # One row per split: a few hundred for each 100 GB of a file.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("swaps").over(earlier), F.lit(0))
    ends = ends.withColumn("total", total)
    ends = ends.withColumn("base", F.pmod(F.col("base") + F.col("total"), F.lit(2)))
    starts = ends.select(
        "file", "block", F.pmod(F.coalesce(F.last("base", True).over(earlier), F.lit(0)) + F.col("total"), F.lit(2)).alias("start")
    )
    state = F.pmod(F.coalesce("known", "start") + F.col("swapped"), F.lit(2))
    return lines.join(starts, ["file", "block"]).withColumn("inside", state == 1)


def _records(spark, location):
    """(file, block, row, value) of the rows of a listing, those that go over lines put together."""
    lines = _in_quotes(_lines(spark, location))
    place = F.struct("block", "row")
    lines = lines.withColumn("head", F.when(~F.col("inside"), place))
    heads = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("head", F.last("head", True).over(heads))
    ends = lines.groupBy("file", "block").agg(F.max("head").alias("last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "block", F.last("last", True).over(earlier).alias("last"))
    lines = lines.join(ends, ["file", "block"]).withColumn("head", F.coalesce("head", "last"))
    lines = lines.select("file", "block", "row", "value", "head", (F.col("inside") | F.col("opens")).alias("long"))
    lines = materialise(lines, "lines")

    group = [F.col("file"), F.col("head.block").alias("block"), F.col("head.row").alias("row")]
    parts = lines.filter("long")
    size = parts.groupBy(*group).agg(F.sum(F.length("value")).alias("size")).agg(F.max("size")).first()[0]
    if size and size > ROW_LIMIT:
        raise ValueError(f"a row of the listing has {size} characters: a quote is not closed")
    pieces = F.array_sort(F.collect_list(F.struct("block", "row", "value")))
    joined = F.array_join(F.transform(pieces, lambda piece: piece["value"]), "\n")
    records = parts.withColumn("at", F.struct(*group)).groupBy("at").agg(joined.alias("value"))
    records = records.select("at.*", "value")
    return records.unionByName(lines.filter(~F.col("long")).select("file", "block", "row", "value"))


def _parsed(spark, location):
    """Fields of a listing whose rows go over lines."""
    records = _records(spark, location)
    header = records.filter("block = 0").groupBy("file").agg(F.min("row").alias("row"))
    rows = records.join(header, ["file", "row"], "left_anti").filter(F.trim("value") != "")
    fields = F.from_csv("value", RAW, {**_OPTIONS, "maxCharsPerColumn": "-1"})
    return rows.select(fields.alias("fields"), F.struct("file", "block", "row").alias("_row_order")).select(
        "fields.*", "_row_order"
    )


def _split_at_lines(spark, location):
    """Fields of a listing of one row per line, by Spark's own reader."""
    raw = (
        spark.read.schema(RAW)
        .option("header", True)
        # A row is judged by all its fields, not only by the columns a query asks for.
        .option("columnPruning", False)
        .options(**_OPTIONS)
        .csv(location)
    )
    place = [
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    ]
    return raw.withColumn("_row_order", F.struct(*place))


def read_raw_listing(spark: SparkSession, location) -> DataFrame:
    """Text fields of the usable rows, with ``_row_order``: their place among the input files.

    Undecodable bytes are dropped; so is U+FFFD, which Spark reads in their place. A quoted field may hold line
    breaks, which become line feeds. One pass looks for lines that end inside quotes; without any, rows are lines and
    Spark's reader splits the files. Otherwise lines are put together across lines and splits, see ``_in_quotes``.
    """
    broken = not _lines(spark, location).filter("opens").isEmpty()
    raw = _parsed(spark, location) if broken else _split_at_lines(spark, location)
    clean = [
        F.replace(F.coalesce(F.col(name), F.lit("")), F.lit("\ufffd"), F.lit("")).alias(name)
        for name in _TEXT
    ]
    return valid_listing_rows(raw).select(*clean, "_row_order").filter("directory <> ''")


def files_from_listing(raw: DataFrame) -> DataFrame:
    """Catalog columns derived from the text fields of a listing."""
    path = full_path("directory", "name")
    extra = [name for name in raw.columns if name not in _TEXT]
    ext = ext_suffix("name")
    return raw.select(
        path.alias("path"),
        guarded_int("size").alias("size"),
        guarded_int("mtime").alias("mtime"),
        guarded_int("ctime").alias("ctime"),
        F.lit(None).cast("string").alias("content_hash"),
        is_archive_listing(ext).alias("is_archive"),
        drive_of(path).alias("drive"),
        ext.alias("ext"),
        guarded_int("attributes").alias("attributes"),
        *extra,
    )


def read_listing_csv(spark: SparkSession, location) -> DataFrame:
    """Catalog rows of a listing; the last row wins where a path repeats."""
    files = files_from_listing(read_raw_listing(spark, location))
    row = F.max_by(F.struct(*[n for n in files.columns if n != "_row_order"]), "_row_order")
    return files.groupBy("path").agg(row.alias("row")).select("row.*")


def write_listing_csv(raw: DataFrame, location):
    """Write text fields as listing files that ``read_listing_csv`` reads."""
    writer = raw.select(*_TEXT).write.option("header", True).option("escape", '"')
    # Blanks at the ends of a name are part of it.
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    writer.options(**blanks).csv(location)
