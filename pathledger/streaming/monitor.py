"""Continuous change capture from a stream of snapshot manifests.

Every poll writes a complete listing of all drives, any number of files, and then one small
manifest line that says where it lies. The stream reads one manifest per micro-batch, compares the
listing with the stored catalog and writes tables below one folder:

- ``base/batch_id=N``: a whole catalog, from the first poll or from ``compact``; ``bases`` marks
  the finished ones
- ``delta/batch_id=N``: changed catalog rows of poll N, ``op`` is ``upsert`` or ``delete``
- ``changes/batch_id=N``, ``move_history/batch_id=N``: what poll N found
- ``digests/batch_id=N``: the digest tree of listing N, where the monitor compares by digests
- ``totals/batch_id=N``: files, archives and bytes per drive after poll N, those before it plus what it changed
- ``polls/batch_id=N``: counts of poll N, written last, so that it marks the poll as complete

A batch that is repeated after a failure reads only what earlier batches wrote and overwrites its
own folders.
"""

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pathledger.operators.digests import read_tree, tree_diff, write_tree
from pathledger.operators.ordering import latest_version
from pathledger.operators.snapshots import (
    DELETED,
    MODIFIED,
    MOVED,
    NEW,
    changes_from_diff,
    rows_of_diff,
    stored_diff,
    totals_of_diff,
)
from pathledger.operators.stats import added_totals, signed_totals, with_all
from pathledger.schema import POLL_SECONDS, SNAPSHOT_MANIFEST
from pathledger.session import materialise, stored_at
from pathledger.sources.catalog import read_table, write_catalog
from pathledger.sources.name_index import build_name_index

_UPSERT, _DELETE = "upsert", "delete"
_BATCH = "batch_id"

# Tables of fixed columns; a delta has those of the base.
_SCHEMAS = {
    "polls": "snapshot_id long, new long, modified long, deleted long, moved long, completed long",
    "bases": "kind string",
    "changes": "path string, change_type string, old_path string, confidence double",
    "totals": "drive string, files long, archives long, sized long, bytes long",
    "move_history": "old_path string, new_path string, confidence double, detected_at timestamp",
}


def _one_row(spark, schema, values):
    """A DataFrame of one row, planned without Python data."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.range(1, numPartitions=1).select(
        *[F.lit(value).cast(f.dataType).alias(f.name) for f, value in zip(fields, values)]
    )


def publish_snapshot(files: DataFrame, snapshot_id, location, manifests):
    """Store a complete listing and announce it with one manifest line."""
    files.write.mode("overwrite").option("compression", "zstd").parquet(location)
    line = _one_row(files.sparkSession, SNAPSHOT_MANIFEST, [snapshot_id, location])
    line.write.mode("append").json(manifests)


def _stored(spark, root, kind, schema=None):
    """A table of the monitor, with the batch that wrote each row."""
    fields = schema or T.StructType.fromDDL(_SCHEMAS[kind])
    fields = T.StructType([*fields, T.StructField(_BATCH, T.LongType())])
    return spark.read.schema(fields).parquet(f"{root}/{kind}")


def _batches(spark, root, kind):
    """Batch ids of a table's folders, the last one first, from one listing of their names."""
    files = spark._jvm.org.apache.hadoop.fs
    folder = files.Path(f"{root}/{kind}")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    # One text of all names, as each name by itself would be a call.
    found = files.FileUtil.stat2Paths(system.listStatus(folder))
    names = spark._jvm.org.apache.commons.lang3.ArrayUtils.toString(found)
    return sorted((int(i) for i in re.findall(rf"/{_BATCH}=(-?[0-9]+)[}},]", names)), reverse=True)


def _finished(spark, root, kind, before=None):
    """Batch ids of the finished folders of a table, the last one first; only as many are looked at as are used."""
    for batch in _batches(spark, root, kind):
        if batch >= 0 and (before is None or batch < before) and stored_at(spark, f"{root}/{kind}/{_BATCH}={batch}"):
            yield batch


def _latest(spark, root, kind, before=None):
    """Largest finished batch id of a table; None without one."""
    return next(_finished(spark, root, kind, before), None)


def _last_counted(spark, root, before):
    """(batch id, row) of the last poll that was not stale; its snapshot is the newest."""
    for batch in _finished(spark, root, "polls", before):
        row = spark.read.schema(_SCHEMAS["polls"]).parquet(f"{root}/polls/{_BATCH}={batch}").first()
        if row and row["new"] is not None:
            return batch, row
    return None, None


def polls(spark: SparkSession, root) -> DataFrame:
    """One row per completed poll, with the number of polls completed by then."""
    return _stored(spark, root, "polls")


def changes(spark: SparkSession, root) -> DataFrame:
    """All changes found so far, by poll."""
    return _stored(spark, root, "changes")


def move_history(spark: SparkSession, root) -> DataFrame:
    """All moves found so far, by poll."""
    return _stored(spark, root, "move_history")


def _totals(spark, root, batch):
    """The stored totals after a poll; None if it stored none."""
    location = f"{root}/totals/{_BATCH}={batch}"
    if batch is None or not stored_at(spark, location):
        return None
    return spark.read.schema(_SCHEMAS["totals"]).parquet(location)


def current_totals(spark: SparkSession, root) -> DataFrame:
    """``stats.total_stats`` of the current catalog, from the totals that the last poll stored."""
    stored = _totals(spark, root, _last_counted(spark, root, None)[0])
    if stored is None:
        return None
    size = F.when(F.col("sized") > 0, F.col("bytes")).alias("bytes")
    return with_all(stored.select("drive", "files", "archives", size))


def current_catalog(spark: SparkSession, root, before=None, read_base=read_table) -> DataFrame:
    """The catalog after the last completed poll, or after the polls before ``before``.

    The latest base, without the paths that later deltas name, plus the rows that those upsert.
    ``read_base(spark, location)`` may leave out rows of the base that the caller has no use for.
    """
    last = _latest(spark, root, "polls", before)
    if last is None:
        return None
    start = _latest(spark, root, "bases", last + 1)
    base = read_base(spark, f"{root}/base/{_BATCH}={start}")
    columns = T.StructType([*base.schema, T.StructField("op", T.StringType())])
    # Only the folders since the base, however many there were before.
    since = [f"{root}/delta/{_BATCH}={b}" for b in _batches(spark, root, "delta") if start < b <= last]
    columns = T.StructType([*columns, T.StructField(_BATCH, T.LongType())])
    reader = spark.read.schema(columns).option("basePath", f"{root}/delta")
    later = reader.parquet(*since) if since else spark.createDataFrame([], columns)
    row = F.max_by(F.struct(*[c for c in later.columns if c != _BATCH]), _BATCH).alias("row")
    latest = later.groupBy("path").agg(row).select("row.*")
    kept = base.join(latest.select("path"), "path", "left_anti")
    entered = latest.filter(F.col("op") == _UPSERT).drop("op")
    return kept.unionByName(entered)


def compact(spark: SparkSession, root, index=False):
    """Write the current catalog as a new base, so that reading needs no earlier deltas."""
    last = _latest(spark, root, "polls")
    if last is not None and last != _latest(spark, root, "bases"):
        _write_base(current_catalog(spark, root), root, last, index)


def _write(df, root, kind, batch_id):
    df.write.mode("overwrite").option("compression", "zstd").parquet(
        f"{root}/{kind}/{_BATCH}={batch_id}"
    )


def _write_empty(curr, root):
    """Tables without rows, so that all readers find them from the first poll on."""
    for kind, schema in _SCHEMAS.items():
        nothing = [None] * len(T.StructType.fromDDL(schema))
        _write(_one_row(curr.sparkSession, schema, nothing).limit(0), root, kind, -1)
    _write(curr.limit(0).withColumn("op", F.lit(_UPSERT)), root, "delta", -1)


def _write_base(catalog, root, batch_id, index):
    location = f"{root}/base/{_BATCH}={batch_id}"
    # Written for the next comparison more than for searches, so without the passes for an order.
    write_catalog(catalog, location, mode="overwrite", curve=())
    if index:
        # Searches take later changes from the deltas, so the index holds until the next base.
        build_name_index(catalog.sparkSession, location)
    # The marker comes last: a base that was not finished is never read.
    marker = _one_row(catalog.sparkSession, _SCHEMAS["bases"], ["base"])
    _write(marker, root, "bases", batch_id)


def _delta(diff, curr):
    """Catalog rows to write for a diff: upserts with all columns, deletes by path.

    The diff brings the rows along, so the listing is not joined a second time. Moved files are
    among its new and deleted paths.
    """
    entered = rows_of_diff(diff, curr).withColumn("op", F.lit(_UPSERT))
    gone = diff.filter(F.col("change_type") == DELETED).select("path", F.lit(_DELETE).alias("op"))
    return entered.unionByName(gone, allowMissingColumns=True)


def _poll_diff(spark, root, batch_id, prev, curr, last, verify, digests, work):
    """The stored diff of a poll, and the number of its rows."""
    tree = f"{root}/digests/{_BATCH}={batch_id}"
    if digests:
        write_tree(curr, tree)
    before = f"{root}/digests/{_BATCH}={last}"
    if not digests or last is None or not stored_at(spark, before):
        return stored_diff(prev, curr, hashes=verify, rows=True, folder=work)
    found = tree_diff(prev, curr, read_tree(spark, before), read_tree(spark, tree), hashes=verify, rows=True)
    diff = materialise(found, "diff", work)
    return diff, diff.count()


def process_poll(
    spark: SparkSession, root, batch_id, snapshot_id, curr: DataFrame, verify=False, index=False, digests=False
):
    """Compare one listing with the stored catalog and store what changed.

    A listing whose id is not above that of the last completed poll is stale: it came out of order
    and changes nothing; its poll has NULL counts. Of a path that a listing repeats, the
    newest row holds.
    """
    curr = latest_version(curr.filter("drive IS NULL OR drive <> ''"), "mtime")
    if not _batches(spark, root, "polls"):
        _write_empty(curr, root)
    last, done = _last_counted(spark, root, batch_id)
    if done and snapshot_id <= done["snapshot_id"]:
        stale = _one_row(spark, _SCHEMAS["polls"], [snapshot_id, None, None, None, None, done["completed"]])
        _write(stale, root, "polls", batch_id)
        return
    prev = current_catalog(spark, root, before=batch_id)
    counts = {}
    if prev is None:
        # The first listing is only the baseline.
        if digests:
            write_tree(curr, f"{root}/digests/{_BATCH}={batch_id}")
        _write_base(curr, root, batch_id, index)
        totals = [signed_totals(curr, 1)]
    else:
        # Intermediate tables of a poll replace those of the poll before.
        work = f"{root}/work"
        diff, rows = _poll_diff(spark, root, batch_id, prev, curr, last, verify, digests, work)
        _write(changes_from_diff(diff, rows, verify, work), root, "changes", batch_id)
        # Only the folder of this poll, however many there are.
        found = spark.read.schema(_SCHEMAS["changes"]).parquet(f"{root}/changes/{_BATCH}={batch_id}")
        moves = found.filter(F.col("change_type") == MOVED)
        _write(
            moves.select(
                "old_path",
                F.col("path").alias("new_path"),
                "confidence",
                F.current_timestamp().alias("detected_at"),
            ),
            root,
            "move_history",
            batch_id,
        )
        _write(_delta(diff, curr), root, "delta", batch_id)
        # Totals follow the changes alone; only a monitor that has none yet counts the catalog.
        before = _totals(spark, root, last)
        totals = [signed_totals(prev, 1) if before is None else before, totals_of_diff(diff, curr)]
        # At most four rows.
        rows = found.groupBy("change_type").agg(F.count(F.lit(1)).alias("n")).collect()
        counts = {row["change_type"]: row["n"] for row in rows}
    # One row per drive.
    _write(added_totals(*totals).coalesce(1), root, "totals", batch_id)
    completed = (done["completed"] if done else 0) + 1
    found = [counts.get(kind, 0) for kind in (NEW, MODIFIED, DELETED, MOVED)]
    summary = _one_row(spark, _SCHEMAS["polls"], [snapshot_id, *found, completed])
    _write(summary, root, "polls", batch_id)


def monitor(
    spark: SparkSession,
    manifests,
    root,
    read_snapshot=None,
    verify=False,
    compact_every=86_400 // POLL_SECONDS,
    trigger=None,
    index=False,
    digests=False,
):
    """Start the stream over ``manifests`` and return its query.

    ``read_snapshot(spark, location)`` gives the listing as a catalog table; Parquet by default.
    The deltas of ``compact_every`` polls, by default those of a day, are folded into a new base,
    which with ``index`` gets an index of its names. With ``digests`` each poll stores the digest tree of
    its listing, and only files of directories that differ from the poll before are joined.
    ``trigger`` defaults to working off what is there and stopping; pass
    ``{"processingTime": "300 seconds"}`` to keep polling. Stopped or failed, the stream continues
    after the last completed poll.
    """
    read_snapshot = read_snapshot or (lambda session, location: session.read.parquet(location))

    def poll(batch, batch_id):
        lines = batch.take(2)
        if len(lines) > 1:
            raise ValueError("a manifest file must announce one snapshot")
        session = batch.sparkSession
        for line in lines:
            curr = read_snapshot(session, line["location"])
            process_poll(session, root, batch_id, line["snapshot_id"], curr, verify, index, digests)
        if (batch_id + 1) % compact_every == 0:
            compact(session, root, index)

    return (
        spark.readStream.schema(SNAPSHOT_MANIFEST)
        .option("maxFilesPerTrigger", 1)
        .json(manifests)
        .writeStream.foreachBatch(poll)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
