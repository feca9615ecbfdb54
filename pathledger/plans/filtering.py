"""Queries for filters and search."""

from pyspark.sql import functions as F

from pathledger.functions.paths import directory_of
from pathledger.operators import filters, ordering, search as searching
from pathledger.plans import fixtures as fx
from pathledger.plans.registry import query
from pathledger.session import fresh_folder
from pathledger.sources import catalog, name_index


def _shaped(where):
    return fx.with_tables(f"SELECT doc_id, path FROM shaped_paths WHERE {where}", fx.SHAPE_SQL)


def _any(test, texts):
    quoted = ("'" + text.replace("\\", "' || chr(92) || '") + "'" for text in texts)
    return " OR ".join(test.format(text) for text in quoted)


_DIRS = "list_slice(string_split(path, chr(92)), 1, -2)"


@query(_shaped(f"NOT ({_any('contains(path, {})', filters.SKIP_TEXTS)})"))
def skip_dirs_substring(spark, sf_dir):
    return filters.skip_dirs_substring(fx.shaped_paths(spark, sf_dir)).select("doc_id", "path")


@query(_shaped(f"NOT ({_any('list_contains(' + _DIRS + ', {})', filters.SKIP_DIRECTORIES)})"))
def skip_dirs_component(spark, sf_dir):
    return filters.skip_dirs_component(fx.shaped_paths(spark, sf_dir)).select("doc_id", "path")


@query(_shaped(f"NOT ({_any('ends_with(lower(path), {})', filters.SKIP_EXTENSIONS)})"))
def skip_extensions(spark, sf_dir):
    return filters.skip_extensions(fx.shaped_paths(spark, sf_dir)).select("doc_id", "path")


@query(_shaped(f"len(list_filter({_DIRS}, lambda d: left(d, 1) IN ('$', '.'))) = 0"))
def skip_hidden_dirs(spark, sf_dir):
    return filters.skip_hidden_dirs(fx.shaped_paths(spark, sf_dir)).select("doc_id", "path")


@query(_shaped("len(string_split(relative, chr(92))) - 1 <= 2"))
def max_depth(spark, sf_dir):
    return filters.max_depth(fx.shaped_paths(spark, sf_dir), 2).select("doc_id", "path")


@query(
    """
    SELECT 'scanner' AS cap, doc_id, n_chars FROM documents WHERE n_chars < 2000
    UNION ALL SELECT 'calculator', doc_id, n_chars FROM documents WHERE n_chars <= 2000
    UNION ALL SELECT 'archive', doc_id, n_chars FROM documents WHERE n_chars <= 4000
    """
)
def size_caps(spark, sf_dir):
    """The three size limits, at sizes that occur in the table."""
    sized = fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    capped = {
        "scanner": filters.hashable(sized, "n_chars", 2000, inclusive=False),
        "calculator": filters.hashable(sized, "n_chars", 2000),
        "archive": filters.listable_archives(sized, "n_chars", 4000),
    }
    first, *rest = [rows.withColumn("cap", F.lit(cap)) for cap, rows in capped.items()]
    for rows in rest:
        first = first.unionByName(rows)
    return first


@query(fx.with_tables("SELECT path, size FROM files WHERE ext IN ('.zip', '.gz')"))
def only_archives(spark, sf_dir):
    return filters.only_archives(fx.files(spark, sf_dir)).select("path", "size")


@query(
    fx.with_tables(
        "SELECT scan_id, path FROM scan_results WHERE error IS NULL", fx.SCAN_SQL
    )
)
def only_success(spark, sf_dir):
    results = fx.scan_results(fx.table(spark, sf_dir, "events"))
    return filters.only_success(results).select("scan_id", "path")


@query(fx.with_tables("SELECT path, drive FROM files WHERE drive IN ('C:', 'E:')"))
def configured_drives(spark, sf_dir):
    # Rows spell the drive in both ways.
    drive = F.when(F.col("size") % 2 == 0, F.concat("drive", F.lit("\\")))
    rows = fx.files(spark, sf_dir).select("path", drive.otherwise(F.col("drive")).alias("drive"))
    return filters.configured_drives(rows, {"C:\\": {}, "E:": {}})


@query(fx.with_tables("SELECT path, size FROM curr WHERE name GLOB 'doc_*[0-4].t[gG]?'"))
def search_glob(spark, sf_dir):
    found = searching.search_glob(fx.files(spark, sf_dir), "doc_*[0-4].t[gG]?")
    return found.select("path", "size")


@query(
    fx.with_tables(
        "SELECT path, mtime FROM files WHERE mtime // 86400 = CAST(epoch(DATE '2024-01-15') AS BIGINT) // 86400"
    )
)
def search_modified(spark, sf_dir):
    found = searching.search_modified(fx.files(spark, sf_dir), "today", as_of="2024-01-15")
    return found.select("path", "mtime")


@query(fx.with_tables("SELECT path, size FROM files WHERE size > 2048"))
def search_size(spark, sf_dir):
    return searching.search_size(fx.files(spark, sf_dir), ">2KB").select("path", "size")


@query(
    fx.with_tables(
        """
        SELECT path, size, mtime FROM files
        WHERE ends_with(path, '.py') AND size >= 512 AND mtime // 86400 = 19723 + 19 ORDER BY path
        """
    )
)
def search_combined(spark, sf_dir):
    found = searching.search(
        fx.files(spark, sf_dir), "*.py", modified="2024-01-20", size=">=0.5KB"
    )
    return found.select("path", "size", "mtime")


@query(fx.with_tables("SELECT path, size FROM files WHERE regexp_matches(path, 'doc_12[0-9]*[.]py$')"))
def search_name_index(spark, sf_dir):
    """A search by the trigrams of names; some files came to the catalog after they were indexed."""
    files, location = fx.files(spark, sf_dir), fresh_folder(spark, "catalog")
    catalog.write_catalog(files.filter("size % 5 <> 0"), location)
    name_index.build_name_index(spark, location)
    catalog.write_catalog(files.filter("size % 5 = 0"), location)
    return searching.search_files("*_12*.py", catalog=location, spark=spark).select("path", "size")


@query(
    fx.with_tables(
        "SELECT path, size, mtime FROM files WHERE size > 1024 AND mtime // 86400 = CAST(epoch(DATE '2024-01-15') AS BIGINT) // 86400"
    )
)
def search_on_curve(spark, sf_dir):
    """A search by day and size over a catalog that lies along a curve over both."""
    location = fresh_folder(spark, "catalog")
    catalog.write_catalog(fx.files(spark, sf_dir), location, curve=("mtime", "size"))
    found = searching.search_files(modified="2024-01-15", size=">1KB", catalog=location, spark=spark)
    return found.select("path", "size", "mtime")


@query(fx.with_tables("SELECT DISTINCT directory FROM shaped_paths", fx.SHAPE_SQL))
def distinct_dirs(spark, sf_dir):
    return ordering.distinct_dirs(fx.shaped_paths(spark, sf_dir), directory_of("relative"))
