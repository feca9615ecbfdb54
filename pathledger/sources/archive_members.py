"""Members of zip and tar archives, listed without extraction."""

import calendar
import io
import struct
import tarfile
import zipfile
from contextlib import ExitStack
from itertools import chain, islice
from pathlib import PurePosixPath

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pathledger.functions.paths import is_archive_scan
from pathledger.schema import ARCHIVE_MEMBERS
from pathledger.session import file_batches, materialise
from pathledger.sources.remote import open_for_reading

_BATCH = 10_000
# Directories of zip files above this many bytes are read in ranges of as many.
RANGE = 4 << 20
# Fixed values of the zip format: signatures, and the longest entry of a directory.
_ENTRY, _END, _LOCATOR, _END64 = b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06"
_ENTRY_BYTES, _END_BYTES, _LOCATOR_BYTES, _END64_BYTES = 46, 22, 20, 56
_LONGEST = _ENTRY_BYTES + 3 * 65535
_COLUMNS = ARCHIVE_MEMBERS.fieldNames()


def _zip_members(handle):
    with zipfile.ZipFile(handle) as archive:
        for info in archive.infolist():
            if not info.is_dir():
                try:
                    modified = calendar.timegm(info.date_time)
                except ValueError:
                    modified = None
                yield info.filename, info.compress_size, info.file_size, modified


def _tar_members(handle):
    with tarfile.open(fileobj=handle, mode="r:*") as archive:
        for info in archive:
            if info.isfile():
                yield info.name, info.size, info.size, info.mtime
            # Keeps the list of headers seen so far from growing with the archive.
            archive.members = []


def _members(path, handle):
    name = path.lower()
    if name.endswith(".zip"):
        return _zip_members(handle)
    if name.endswith((".tar", ".gz", ".tgz")):
        return _tar_members(handle)
    raise ValueError("no reader for this kind of archive")


def _timestamp(seconds):
    try:
        return pd.Timestamp(int(seconds * 1_000_000), unit="us", tz="UTC")
    except (TypeError, ValueError, OverflowError):
        return None


def _row(path, count, member):
    name, packed, size, modified = member
    return path, count, name, packed, size, _timestamp(modified), PurePosixPath(name).suffix.lower(), None


def _rows(path, content):
    """Member rows of one archive, or one row with ``error`` if it cannot be read to its end.

    A zip is sound if its directory is, which is read once. Another archive is read to its end before
    any row comes out; only one of more members than a batch holds is read again for the rest.
    """

    def opened():
        return open_for_reading(path) if content is None else io.BytesIO(content)

    with ExitStack() as handles:
        try:
            members = _members(path, handles.enter_context(opened()))
            held = list(islice(members, _BATCH))
            more = 0 if path.lower().endswith(".zip") else sum(1 for _ in members)
        except Exception as error:  # Damaged archives fail in many ways; none may stop the job.
            yield path, None, None, None, None, None, None, f"{type(error).__name__}: {error}"
            return
        if more:
            members = islice(_members(path, handles.enter_context(opened())), len(held), None)
        for count, member in enumerate(chain(held, members)):
            yield _row(path, count, member)


def _directory(handle):
    """(first byte, byte after) of a zip's directory by its end records, None if they do not tell."""
    size = handle.seek(0, io.SEEK_END)
    begin = max(0, size - _END_BYTES - 65535)
    handle.seek(begin)
    tail = handle.read()
    at = tail.rfind(_END)
    if at < 0 or len(tail) - at < _END_BYTES:
        return None
    length, _, comment = struct.unpack_from("<LLH", tail, at + 12)
    if at + _END_BYTES + comment != len(tail):
        return None
    end = begin + at
    if end >= _LOCATOR_BYTES + _END64_BYTES:
        handle.seek(end - _LOCATOR_BYTES - _END64_BYTES)
        record = handle.read(_LOCATOR_BYTES + _END64_BYTES)
        if record[_END64_BYTES:].startswith(_LOCATOR):
            if not record.startswith(_END64):
                return None
            (length,) = struct.unpack_from("<Q", record, 40)
            end -= len(record)
    return (end - length, end) if length <= end else None


def _planner(step):
    """The archives with the span of their directory where it is longer than ``step``."""

    def span_of(path, size):
        if path.lower().endswith(".zip") and (size is None or size > step):
            try:
                with open_for_reading(path) as handle:
                    span = _directory(handle)
            except Exception:  # Told by an error row when its members are listed.
                span = None
            if span and span[1] - span[0] > step:
                return span
        return None, None

    def plan(batches):
        for batch in batches:
            spans = [span_of(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            columns = [batch.column(0), *(pa.array([x[k] for x in spans], pa.int64()) for k in range(2))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "begin", "finish"])

    return plan


def _entries_end(data, at, last):
    """Where the entries that follow each other from ``at`` on reach ``last``, None if they break off."""
    while at < last:
        if data[at : at + 4] != _ENTRY or at + _ENTRY_BYTES > len(data):
            return None
        at += _ENTRY_BYTES + sum(struct.unpack_from("<HHH", data, at + 28))
    return at if at <= len(data) else None


def _members_of(entries):
    """Members of a stretch of whole directory entries, read as the directory of a zip without contents."""
    end = struct.pack("<4s4HLLH", _END, 0, 0, 0, 0, len(entries), 0, 0)
    return _zip_members(io.BytesIO(entries + end))


def _stretch(path, begin, finish, first, step):
    """(start, end, members) of the entries that begin in the range of a directory at ``first``.

    Where the first entry begins is guessed by its signature, which a name may hold as well; the guess
    holds if entries follow each other from there to the end of the range, and ends where the next range starts.
    """
    last = min(first + step, finish)
    try:
        with open_for_reading(path) as handle:
            handle.seek(first)
            data = handle.read(min(last + _LONGEST, finish) - first)
        at = 0
        while 0 <= at < last - first:
            end = _entries_end(data, at, last - first)
            if end is not None:
                return first + at, first + end, sum(1 for _ in _members_of(data[at:end]))
            at = -1 if first == begin else data.find(_ENTRY, at + 1)
    except Exception:  # The archive is then listed as a whole, which tells the error.
        pass
    return None, None, None


def _measurer(step):
    def measure(batches):
        for batch in batches:
            spans = zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)
            found = [_stretch(*span, step) for span in spans]
            columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(3)]
            names = ["archive", "path", "begin", "finish", "first", "start", "end", "members"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names)

    return measure


def _list_stretches(batches):
    for batch in batches:
        for path, start, end, before in batch.itertuples(index=False):
            with open_for_reading(path) as handle:
                handle.seek(start)
                entries = handle.read(end - start)
            rows = (_row(path, before + i, member) for i, member in enumerate(_members_of(entries)))
            while found := list(islice(rows, _BATCH)):
                yield _frame(found)


def _by_path(wanted, width, step):
    """Members of archives at paths: large directories of zip files by ranges, other archives one by one."""
    # A path is a few bytes but opening it is work: spread archives and ranges by count, not by bytes.
    planned = wanted.repartition(width, "path").mapInArrow(_planner(step), "path string, begin long, finish long")
    planned = materialise(planned.withColumn("archive", F.monotonically_increasing_id()), "archives")
    ranges = planned.filter("begin IS NOT NULL").select(
        "archive", "path", "begin", "finish", F.explode(F.sequence("begin", F.col("finish") - 1, F.lit(step))).alias("first")
    )
    fields = ("begin", "finish", "first", "start", "end", "members")
    ranges = ranges.repartition(width, "archive", "first").mapInArrow(
        _measurer(step), ", ".join(["archive long, path string", *(f"{c} long" for c in fields)])
    )
    # A row per range of a directory; those of one archive are few.
    archive = Window.partitionBy("archive")
    order = archive.orderBy("first")
    joins = F.coalesce(F.col("start") == F.coalesce(F.lag("end").over(order), F.col("begin")), F.lit(False))
    before = (F.sum("members").over(order) - F.col("members")).cast("long")
    ranges = ranges.select("*", joins.alias("joins"), before.alias("before"))
    whole = materialise(ranges.withColumn("whole", F.min("joins").over(archive)), "ranges").filter("whole")
    stretches = whole.repartition(width, "archive", "first").select("path", "start", "end", "before")
    single = planned.join(whole.select("archive"), "archive", "left_anti").select("path").repartition(width, "path")
    listed = single.mapInPandas(_list_batches, ARCHIVE_MEMBERS)
    return listed.unionByName(stretches.mapInPandas(_list_stretches, ARCHIVE_MEMBERS))


def _frame(rows):
    frame = pd.DataFrame(rows, columns=_COLUMNS)
    whole = {name: "Int64" for name in ("member_no", "compressed_size", "uncompressed_size")}
    return frame.astype({**whole, "modified": "datetime64[us, UTC]"})


def _list_batches(batches):
    rows = []
    for batch in batches:
        contents = batch["content"] if "content" in batch else [None] * len(batch)
        for path, content in zip(batch["path"], contents):
            for row in _rows(path, content):
                rows.append(row)
                if len(rows) == _BATCH:
                    yield _frame(rows)
                    rows = []
    if rows:
        yield _frame(rows)


def archive_members(archives: DataFrame, path="path", size="size", content=None, limit=None, range_bytes=RANGE) -> DataFrame:
    """One row per member of the archives among the given files, directories left out.

    Archives are opened at ``path`` inside the tasks, so of a zip only its directory is read. One of more
    than ``range_bytes`` is read by several tasks, each of which finds the first entry of its range; if the
    ranges do not fit together the archive is listed by one task. ``size``, where there is such a column, spares
    looking at the ends of small files.
    With ``content``, a binary column, the bytes come from the table instead. Archives of any size
    are opened; with ``limit``, one of more bytes yields a row with the error ``skipped: size``.
    Formats are zip and tar, plain or compressed; a file of another archive kind, or a damaged one,
    yields one ``error`` row and no members.
    """
    found = archives.filter(is_archive_scan(path))
    skipped = F.lit(False) if limit is None else F.coalesce(F.col(size) > limit, F.lit(False))
    wanted = found.filter(~skipped)
    if content is None:
        known = F.col(size).cast("long") if size in archives.columns else F.lit(None).cast("long")
        width = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        members = _by_path(wanted.select(F.col(path).alias("path"), known.alias("size")), width, range_bytes)
    else:
        # A task holds a batch of contents at a time, however many rows there are.
        file_batches(archives.sparkSession)
        wanted = wanted.select(F.col(path).alias("path"), F.col(content).alias("content"))
        members = wanted.mapInPandas(_list_batches, ARCHIVE_MEMBERS)
    if limit is None:
        return members
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in ARCHIVE_MEMBERS.fields[1:-1]]
    error = F.lit("skipped: size").alias("error")
    left_out = found.filter(skipped).select(F.col(path).alias("archive_path"), *empty, error)
    return members.unionByName(left_out)


def refresh_members(members: DataFrame, changes: DataFrame, curr: DataFrame, limit=None) -> DataFrame:
    """The members of all archives after a change set of ``find_changes``.

    Members of deleted, modified and moved archives leave; archives at new, modified and moved-to
    paths of the current snapshot are listed again. All other archives stay unopened.
    """
    kind = F.col("change_type")
    stale = F.explode(F.array_compact(F.array(F.when(kind != "moved", F.col("path")), F.col("old_path"))))
    kept = members.join(changes.select(stale.alias("archive_path")).distinct(), "archive_path", "left_anti")
    entered = changes.filter(kind != "deleted").select("path")
    listed = archive_members(curr.join(entered, "path", "left_semi"), limit=limit)
    return kept.unionByName(listed)
