"""Column functions over paths and file names."""

from pyspark.sql import Column, functions as F

SEPARATOR = "\\"

# Extensions that count as archives, for listings and for scans.
LISTING_ARCHIVES = [".zip", ".rar", ".7z", ".tar", ".gz"]
SCAN_ARCHIVES = [".zip", ".rar", ".7z", ".tar", ".gz", ".tgz"]
LONG_ARCHIVE_ENDING = ".tar.gz"

# Drive kinds.
LOCAL, NETWORK, UNKNOWN = "ntfs_local", "network", "unknown"


def _col(value):
    return value if isinstance(value, Column) else F.col(value)


def full_path(directory, name):
    """Directory and name joined by one backslash; none after a separator or a bare ``C:``."""
    directory, name = _col(directory), _col(name)
    closed = directory.rlike(r"(^|^[A-Za-z]:|[\\/])\z")
    gap = F.when(closed, F.lit("")).otherwise(F.lit(SEPARATOR))
    return F.concat(directory, gap, name)


def drive_of(path):
    """``C:`` of ``C:\\x``; empty for paths of two characters or fewer."""
    path = _col(path)
    return F.when(F.length(path) > 2, F.substring(path, 1, 2)).otherwise(F.lit(""))


def drive_key(drive):
    """``C:`` for ``C:`` and for ``C:\\``, so that both spellings meet."""
    return F.regexp_replace(_col(drive), r"[\\/]+$", "")


def base_name(path):
    """Last component of a path with separators of either kind."""
    return F.substring_index(F.translate(_col(path), "/", SEPARATOR), SEPARATOR, -1)


def directory_of(path):
    """The part before the last separator; empty if there is none."""
    return F.regexp_extract(_col(path), r"(?s)^(.*)[\\/][^\\/]*$", 1)


def ext_suffix(name):
    """Lower-case suffix as listings have it: no suffix for ``a.`` and ``.bashrc``, ``.a`` for ``..a``."""
    return F.lower(F.regexp_extract(_col(name), r"(?s)^.+(\.[^.]+)$", 1))


def ext_splitext(name):
    """Lower-case extension as scans have it: ``.`` for ``a.``, none for ``.bashrc`` and ``..a``."""
    return F.lower(F.regexp_extract(_col(name), r"(?s)^\.*[^.].*(\.[^.]*)$", 1))


def is_archive_listing(ext):
    """Archive flag of a listing row, from its extension."""
    return _col(ext).isin(LISTING_ARCHIVES)


def is_archive_scan(path):
    """Archive flag of a scanned file, from its path; knows ``.tgz`` and ``.tar.gz`` as well."""
    path = _col(path)
    long_ending = F.lower(path).endswith(LONG_ARCHIVE_ENDING)
    return long_ending | ext_suffix(base_name(path)).isin(SCAN_ARCHIVES)


def path_depth(relative):
    """Number of components of a path below a root; 0 for the root itself."""
    relative = _col(relative)
    parts = F.size(F.split(relative, r"[\\/]")).cast("bigint")
    return F.when(relative == "", F.lit(0).cast("bigint")).otherwise(parts)


def below_root(path, root):
    """The part of ``path`` below ``root``, without the separator between them."""
    path, root = _col(path), _col(root)
    return F.regexp_replace(F.substr(path, F.length(root) + 1), r"^[\\/]+", "")


def drive_type(root):
    """Network for ``Z:`` and UNC roots, local for other roots, unknown without a root."""
    root = _col(root)
    network = root.startswith("Z:") | root.startswith("\\\\")
    return F.when(root.isNull(), UNKNOWN).when(network, NETWORK).otherwise(LOCAL)
