"""Session settings, and the shared folder that holds intermediate tables."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders = {}


def build_session(app="pathledger", master=None, **conf):
    """A session with the settings the operators count on; cluster sizes stay the caller's."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Lets the runtime planner hash small shuffle partitions instead of sorting them.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark):
    """The cluster's ``spark.checkpoint.dir``; in local mode without one, a fresh temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="run-")
    return _local_folders[app]


def file_batches(spark, rows=256, size=4 << 20):
    """Few rows and bytes per Arrow batch, one row at least, since one row may be a whole file."""
    records = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(records)) <= rows:
        spark.conf.set(records, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def fresh_folder(spark, label):
    """A new, unused location in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored_at(spark, location):
    """Whether Spark finished writing a table at ``location``, on any storage that it reaches."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{location}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def materialise(df: DataFrame, label="table", folder=None) -> DataFrame:
    """Write ``df`` once and return the stored table.

    Used where several later steps need the same rows: they read a columnar table instead of
    repeating the joins, and a lost executor costs a re-read, not a recomputation. The table gets
    a new place in the shared folder, or replaces the one of the same label in ``folder``.
    """
    location = f"{folder}/{label}" if folder else fresh_folder(df.sparkSession, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(location)
    return df.sparkSession.read.schema(df.schema).parquet(location)
