"""Row filters over catalogs and scan results."""

import re

from pyspark.sql import DataFrame, functions as F

from pathledger.functions.paths import (
    _col,
    base_name,
    directory_of,
    drive_key,
    ext_splitext,
    path_depth,
)
from pathledger.schema import ARCHIVE_LIMIT, DRIVES, HASH_LIMIT

# Text that excludes a path wherever it occurs in it.
SKIP_TEXTS = [
    "Windows", "Program Files", "Program Files (x86)", "ProgramData",
    "System Volume Information", "$Recycle.Bin", "$RECYCLE.BIN",
    "node_modules", ".git", "__pycache__", ".vs", "obj", "bin",
    "AppData\\Local\\Temp", "AppData\\Local\\Microsoft\\WindowsApps",
]

# Names of directories whose content is left out.
SKIP_DIRECTORIES = [
    "Windows", "Program Files", "Program Files (x86)", "ProgramData",
    "System Volume Information", "$Recycle.Bin", "$RECYCLE.BIN",
    "AppData", "node_modules", ".git", "__pycache__",
]

# Extensions that are left out.
SKIP_EXTENSIONS = [
    ".dll", ".exe", ".sys", ".msi", ".cab", ".msp",
    ".log", ".tmp", ".temp", ".cache", ".lock", ".pid",
]


def skip_dirs_substring(df: DataFrame, path="path", texts=SKIP_TEXTS) -> DataFrame:
    """Drop paths that contain any of the texts, also inside a longer name."""
    pattern = "|".join(re.escape(text) for text in texts)
    return df.filter(~F.col(path).rlike(pattern))


def skip_dirs_component(df: DataFrame, path="path", names=SKIP_DIRECTORIES) -> DataFrame:
    """Drop paths below a directory of one of the names, whole names only."""
    pattern = "|".join(re.escape(name) for name in names)
    return df.filter(~F.col(path).rlike(rf"(?:^|[\\/])(?:{pattern})[\\/]"))


def skip_extensions(df: DataFrame, path="path", extensions=SKIP_EXTENSIONS) -> DataFrame:
    """Drop files with one of the extensions."""
    return df.filter(~ext_splitext(base_name(path)).isin(extensions))


def skip_hidden_dirs(df: DataFrame, path="path") -> DataFrame:
    """Drop paths below a directory whose name starts with ``$`` or ``.``."""
    return df.filter(~F.col(path).rlike(r"(?:^|[\\/])[$.][^\\/]*[\\/]"))


def max_depth(df: DataFrame, depth, relative="relative") -> DataFrame:
    """Keep files whose directory lies at most ``depth`` below the root; no limit for 0 or None.

    ``relative`` is the path below the root. A file in a directory at ``depth`` stays.
    """
    if not depth:
        return df
    return df.filter(path_depth(directory_of(relative)) <= depth)


def valid_listing_rows(df: DataFrame, record="_malformed", path="directory") -> DataFrame:
    """Keep listing rows with six fields or more and a directory.

    Spark fills the column ``record`` for rows with too few *or* too many fields; the comma count
    outside leading-quote fields tells them apart.
    """
    unquoted = F.regexp_replace(F.col(record), r'(^|,)"(?:[^"]|"")*"', "$1")
    commas = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit("")))
    enough = F.col(record).isNull() | (commas >= 5)
    return df.filter(enough & (F.coalesce(F.col(path), F.lit("")) != ""))


def hashable(df: DataFrame, size="size", limit=HASH_LIMIT, inclusive=True) -> DataFrame:
    """Keep files small enough for a fingerprint; a scan leaves out the limit itself."""
    return df.filter(F.col(size) <= limit) if inclusive else df.filter(F.col(size) < limit)


def listable_archives(df: DataFrame, size="size", limit=ARCHIVE_LIMIT) -> DataFrame:
    """Keep archives of at most 5 GiB."""
    return df.filter(F.col(size) <= limit)


def only_archives(df: DataFrame) -> DataFrame:
    """Keep rows flagged as archives."""
    return df.filter("is_archive")


def archives_to_scan(df: DataFrame, drives=DRIVES) -> DataFrame:
    """Keep archives of the drives whose configuration asks for their contents."""
    wanted = {key: value for key, value in drives.items() if value.get("scan_archives")}
    return configured_drives(only_archives(df), wanted)


def only_success(df: DataFrame) -> DataFrame:
    """Keep scan results without an error."""
    return df.filter(F.col("error").isNull())


def configured_drives(df: DataFrame, drives=DRIVES, drive="drive") -> DataFrame:
    """Keep rows of the configured drives, however their keys are spelled (``C:`` or ``C:\\``).

    The configuration is a dict of the caller, so the literal list prunes partitions by drive.
    """
    names = {key.rstrip("\\/") for key in drives}
    return df.filter(_col(drive).isin([*names, *(name + "\\" for name in names)])).withColumn(
        drive, drive_key(drive)
    )
