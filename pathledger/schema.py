"""Table schemas and the default configuration."""

from pyspark.sql import types as T


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


FILES = _struct(
    ("path", T.StringType(), False),
    ("size", T.LongType(), False),
    ("mtime", T.LongType(), False),
    ("ctime", T.LongType(), True),
    ("content_hash", T.StringType(), True),
    ("is_archive", T.BooleanType(), False),
    ("drive", T.StringType(), False),
    ("ext", T.StringType(), False),
    ("attributes", T.LongType(), True),
)

# One row per archive member. member_no is the member's place in its archive.
ARCHIVE_MEMBERS = _struct(
    ("archive_path", T.StringType(), False),
    ("member_no", T.LongType(), True),
    ("internal_path", T.StringType(), True),
    ("compressed_size", T.LongType(), True),
    ("uncompressed_size", T.LongType(), True),
    ("modified", T.TimestampType(), True),
    ("file_type", T.StringType(), True),
    ("error", T.StringType(), True),
)

# One line of a snapshot manifest: where a complete listing of all drives lies.
SNAPSHOT_MANIFEST = _struct(
    ("snapshot_id", T.LongType(), False),
    ("location", T.StringType(), False),
)

# Fixed values.
SHARD_ROWS = 1_000_000
CHECKPOINT_ROWS = 10_000
PROGRESS_ROWS = 1_000
ROOT_CAP = 50_000
TEST_LIMIT = 10_000
POLL_SECONDS = 300
HASH_LIMIT = 100 * 1024 * 1024
ARCHIVE_LIMIT = 5 * 1024**3

DRIVES = {
    "C:": {"scan_archives": False},
    "D:": {"scan_archives": True},
    "E:": {"scan_archives": True},
    "F:": {"scan_archives": True},
}
