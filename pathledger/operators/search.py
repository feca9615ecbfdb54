"""Search over a catalog by name, day of change and size."""

import datetime
import re
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathledger.functions.globs import glob_regex
from pathledger.functions.paths import base_name
from pathledger.sources.catalog import read_catalog, read_table
from pathledger.sources.name_index import open_name_index
from pathledger.streaming.monitor import current_catalog

# Binary multiples of the size units.
UNITS = {"": 1, "B": 1, "KB": 1024, "MB": 1024**2, "GB": 1024**3, "TB": 1024**4}

_COMPARE = {
    ">": lambda size, n: size > n,
    ">=": lambda size, n: size >= n,
    "<": lambda size, n: size < n,
    "<=": lambda size, n: size <= n,
    "=": lambda size, n: size == n,
}


def search_glob(df: DataFrame, glob, path="path", ignore_case=False) -> DataFrame:
    """Files whose name matches the glob. ``*`` plus plain text compiles to a suffix test."""
    plain_end = re.fullmatch(r"\*([^*?\[\\/]*)", glob)
    if plain_end and not ignore_case:
        return df.filter(F.col(path).endswith(plain_end[1]))
    pattern = glob_regex(glob)
    return df.filter(base_name(path).rlike(f"(?i){pattern}" if ignore_case else pattern))


def search_modified(df: DataFrame, modified, as_of=None, mtime="mtime") -> DataFrame:
    """Files changed on a UTC day: ``today``, a date or an ISO date text."""
    today = as_of or datetime.datetime.now(datetime.timezone.utc).date()
    if isinstance(today, str):
        today = datetime.date.fromisoformat(today)
    day = today if modified == "today" else modified
    if isinstance(day, str):
        day = datetime.date.fromisoformat(day)
    start = (day - datetime.date(1970, 1, 1)).days * 86400
    return df.filter((F.col(mtime) >= start) & (F.col(mtime) < start + 86400))


def search_size(df: DataFrame, size, column="size") -> DataFrame:
    """Files that meet a size test such as ``>100MB``, ``<=2KB`` or ``=0``."""
    found = re.fullmatch(r"\s*(>=|<=|>|<|=)\s*(\d+(?:\.\d+)?)\s*([KMGT]?B?)\s*", size.upper())
    if not found:
        raise ValueError(f"not a size test: {size!r}")
    sign, number, unit = found.groups()
    unit = unit if unit.endswith("B") or not unit else unit + "B"
    amount = Decimal(number) * UNITS[unit]
    # Sizes are whole numbers; a fraction only moves the limit of an inequality.
    amount = int(amount) if amount == int(amount) else float(amount)
    return df.filter(_COMPARE[sign](F.col(column), amount))


def search(df: DataFrame, name=None, modified=None, size=None, as_of=None, ignore_case=False, few=False):
    """All given criteria together, in path order. ``few`` tells that one task can sort the rows of ``df``."""
    if name is not None:
        df = search_glob(df, name, ignore_case=ignore_case)
    if modified is not None:
        df = search_modified(df, modified, as_of)
    if size is not None:
        df = search_size(df, size)
    return df.coalesce(1).sortWithinPartitions("path") if few else df.orderBy("path")


def _stored_rows(spark, location, name, read):
    """The rows of a stored catalog that a search for ``name`` must look at, and whether they are few.

    They come from the catalog's index of names if it has one.
    """
    index = open_name_index(spark, location) if name is not None else None
    found = index.candidates(spark, name) if index else None
    return (read(spark, location), False) if found is None else found


def search_files(name=None, modified=None, size=None, *, catalog=None, live=None, spark=None, **options):
    """``search`` over a stored catalog: ``search_files("*.py")``, ``search_files(size=">100MB")``.

    ``catalog`` is its location, by default the session setting ``spark.pathledger.catalog``.
    ``live``, the folder of a ``streaming.monitor``, searches what the last completed poll left. A
    name search reads only the rows of one trigram where the catalog has a ``name_index`` and the
    glob holds three plain characters in a row, counting its fixed start and end, that are not in
    too many names; it reads all rows otherwise. Both give the same.
    """
    spark = spark or SparkSession.active()
    if live is not None:
        base = lambda session, location: _stored_rows(session, location, name, read_table)[0]
        return search(current_catalog(spark, live, read_base=base), name, modified, size, **options)
    catalog = catalog or spark.conf.get("spark.pathledger.catalog")
    rows, few = _stored_rows(spark, catalog, name, read_catalog)
    return search(rows, name, modified, size, few=few, **options)
