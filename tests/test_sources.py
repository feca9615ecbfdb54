"""Files written and read: listings, checkpoints, trees, archives, catalogs."""

import csv
import datetime
import gzip
import hashlib
import io
import os
import random
import tarfile
import zipfile
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from pathledger.functions import content
from pathledger.functions.paths import is_archive_scan, path_depth
from pathledger.operators import archives, filters
from pathledger.plans import fixtures as fx, storage
from pathledger.schema import ARCHIVE_MEMBERS, FILES
from pathledger.sources import catalog, checkpoints, listing, remote, scan
from pathledger.sources.archive_members import archive_members, refresh_members
from pathledger.sources.remote import _Handle

HEADER = b"Name,Path,Size,Date Modified,Date Created,Attributes\r\n"


def by_path(df):
    return {row["path"]: row for row in df.collect()}


def test_listing_rows(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes(
        HEADER
        + b"a.ZIP,C:\\x,12,100,90,32\r\n"
        + b"short,C:\\x,12\r\n"
        + b"long.md,C:\\x,13,100,90,32,extra,more\r\n"
        + b'"com,ma.tar.gz","C:\\y,z",14,100,90,32\r\n'
        + b'"quo""te.7z",C:\\x,15,100,90,32\r\n'
        + b"nopath.txt,,16,100,90,32\r\n"
        + b"tail.txt,C:\\x,17,100,90,\r\n"
        + b"date.txt,C:\\x,18,2024-01-01,90,32\r\n"
        + b"six.txt,C:\\x,,,,,\r\n"
        + b"four.txt,C:\\x,19,100\r\n"
        + b'mid"quote,C:\\x,21,100,90,32\r\n'
        + b"bad\xff\xfe.txt,D:,20,100,90,32\r\n"
        + b",C:\\noname,1,2,3,4\r\n"
    )
    rows = by_path(listing.read_listing_csv(spark, str(tmp_path)))
    assert sorted(rows) == sorted(
        [
            "C:\\x\\a.ZIP", "C:\\x\\long.md", "C:\\y,z\\com,ma.tar.gz", 'C:\\x\\quo"te.7z',
            "C:\\x\\tail.txt", "C:\\x\\date.txt", "C:\\x\\six.txt", 'C:\\x\\mid"quote', "D:bad.txt",
            "C:\\noname\\",
        ]
    )
    zipped = rows["C:\\x\\a.ZIP"]
    assert (zipped["size"], zipped["mtime"], zipped["ctime"], zipped["attributes"]) == (12, 100, 90, 32)
    assert (zipped["ext"], zipped["drive"], zipped["is_archive"]) == (".zip", "C:", True)
    assert rows["C:\\y,z\\com,ma.tar.gz"]["ext"] == ".gz"
    assert rows["C:\\x\\tail.txt"]["attributes"] == 0
    assert rows["C:\\x\\date.txt"]["mtime"] == 0
    assert rows["C:\\x\\six.txt"]["size"] == 0


def test_counting_listing_rows_judges_whole_rows(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes(HEADER + b"a,C:\\x,1,2,3,4\r\nshort,C:\\x,1\r\n")
    assert listing.read_listing_csv(spark, str(tmp_path)).count() == 1


def test_last_listing_row_wins_within_and_across_files(spark, tmp_path):
    for number in (1, 2):
        lines = [b"same.txt,C:\\x,%d,1,1,1\r\n" % (number * 1000 + i) for i in range(50)]
        (tmp_path / f"part{number}.csv").write_bytes(HEADER + b"".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        rows = listing.read_listing_csv(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["path"], r["size"]) for r in rows] == [("C:\\x\\same.txt", 2049)]


def test_lines_that_end_inside_quotes(spark):
    from pathledger.sources.listing import _OPENS, _STAYS

    # Outcome of a line that begins outside and inside quotes.
    known = {
        "a,b": (False, True), '"a,b': (True, False), '"a","b': (True, True), '"a",b': (False, False),
        'a"b,c': (False, False), '"a""b': (True, False), '"a"b"c,"': (True, True), "": (False, True), '"': (True, False), '""': (False, True),
    }
    lines = spark.createDataFrame([(k,) for k in known], "value string")
    rows = lines.select("value", F.col("value").rlike(_OPENS).alias("o"), F.col("value").rlike(_STAYS).alias("s"))
    assert {r["value"]: (r["o"], r["s"]) for r in rows.collect()} == known


def test_names_with_line_breaks_across_splits(spark, tmp_path):
    rng, rows = random.Random(5), []
    for number in range(60):
        middle = "".join(rng.choice(['"', "\n", ",", "x", "\n\n", ' "', "é"]) for _ in range(rng.randrange(6)))
        rows.append([f"{number}{middle}.md", "C:\\d", str(number), "5", "6", "7"])
    text = io.StringIO()
    csv.writer(text).writerows(rows)
    for part in ("a", "b"):
        (tmp_path / f"{part}.csv").write_bytes(HEADER + text.getvalue().replace("C:", f"{part}:").encode())
    plain = [[*row] for row in csv.reader(io.StringIO(text.getvalue().replace("\r\n", "\n")))]
    wanted = sorted([row[0], f"{part}:\\d", *row[2:]] for part in "ab" for row in plain)
    assert any("\n" in row[0] and '"' in row[0] for row in wanted)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for size in (37, 38, 211, 100_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            found = listing.read_raw_listing(spark, str(tmp_path)).drop("_row_order").collect()
            assert sorted(list(r) for r in found) == wanted, size
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_quote_that_is_never_closed_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "ROW_LIMIT", 100)
    (tmp_path / "l.csv").write_bytes(HEADER + b'"open,C:\\x,1,2,3,4\r\n' + b"a,C:\\x,1,2,3,4\r\n" * 10)
    with pytest.raises(ValueError, match="not closed"):
        listing.read_raw_listing(spark, str(tmp_path))


def test_listing_round_trip(spark, tmp_path):
    raw = spark.createDataFrame(
        [('a "b", c.zip', "C:\\x", "5", "6", "7", "8"), ("é.py", "D:\\y\\", "1", "2", "3", "4")],
        "name string, directory string, size string, mtime string, ctime string, attributes string",
    )
    listing.write_listing_csv(raw, str(tmp_path / "out"))
    rows = by_path(listing.read_listing_csv(spark, str(tmp_path / "out")))
    assert set(rows) == {'C:\\x\\a "b", c.zip', "D:\\y\\é.py"}


def test_checkpoint_files(spark, tmp_path):
    given = [("N:\\a|b|7|NETWORK", 5, 1.5, None), ("N:\\c d", None, None, None), ("N:\\e", 1, 2.0, "gone")]
    results = spark.createDataFrame(given, "path string, size long, modified double, error string")
    target = str(tmp_path / "c")
    checkpoints.write_checkpoint_text(results, target)
    found = by_path(checkpoints.read_checkpoint_text(spark, target))
    assert set(found) == {"N:\\a|b|7|NETWORK", "N:\\c d"}
    assert tuple(found["N:\\a|b|7|NETWORK"])[1:] == (5, 1.5)
    assert tuple(found["N:\\c d"])[1:] == (0, 0.0)


def test_checkpoint_times_survive_exponents(spark):
    results = spark.createDataFrame([("p", 1, 1704067200.25, None)], "path string, size long, modified double, error string")
    encoded = checkpoints.encode_checkpoint(results)
    assert checkpoints.decode_checkpoint(encoded).first()["modified"] == 1704067200.25


def test_checkpoint_file_size(spark, tmp_path):
    results = spark.range(0, 2500, numPartitions=1).select(
        F.col("id").cast("string").alias("path"), F.col("id").alias("size"),
        F.lit(1).alias("modified"), F.lit(None).cast("string").alias("error"),
    )
    target = tmp_path / "c"
    checkpoints.write_checkpoint_text(results, str(target), rows=1000)
    sizes = [len(gzip.open(f, "rt").readlines()) for f in target.glob("*.txt.gz")]
    assert sorted(sizes) == [500, 1000, 1000]


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "root"
    for name in ("a.txt", ".dot", "_low", "sub/b.LOG", "sub/deep/c.py", "$bin/d", ".git/e", "sub/empty.txt"):
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"" if "empty" in name else name.encode())
    os.symlink(root / "a.txt", root / "link.txt")
    os.symlink(root / "sub", root / "linked")
    return root


def below(root, df):
    return sorted(os.path.relpath(row["path"], root) for row in filters.only_success(df).collect())


def test_walk_sees_every_file_and_no_link(spark, tree):
    found = scan.walk_files(spark, str(tree))
    assert below(tree, found) == sorted(
        ["a.txt", ".dot", "_low", "sub/b.LOG", "sub/deep/c.py", "$bin/d", ".git/e", "sub/empty.txt"]
    )
    row = found.filter(F.col("path").endswith("/a.txt")).first()
    info = os.stat(tree / "a.txt")
    assert (row["size"], row["mtime"], row["ctime"]) == (5, int(info.st_mtime), int(info.st_ctime))
    assert (row["modified_ns"], row["ext"]) == (info.st_mtime_ns, ".txt")


def test_catalog_of_a_walk(spark, tree):
    (tree / "sub" / "p.tar.gz").write_bytes(b"x" * 2000)
    (tree / "sub" / "q.DLL").write_bytes(b"x")
    (tree / "robin").mkdir()
    (tree / "robin" / "r.txt").write_bytes(b"r")
    found = scan.files_from_scan(scan.walk_files(spark, str(tree)), drive="N:")
    rows = {os.path.relpath(r["path"], tree): r for r in found.collect()}
    # "bin" is part of robin and of $bin, ".git" of .git; logs and libraries are left out.
    assert set(rows) == {"a.txt", ".dot", "_low", "sub/deep/c.py", "sub/empty.txt", "sub/p.tar.gz"}
    for name, row in rows.items():
        assert row["content_hash"] == hashlib.md5((tree / name).read_bytes()).hexdigest()
        assert row["is_archive"] == (name == "sub/p.tar.gz") and row["drive"] == "N:"
    assert [f.name for f in found.schema] == FILES.fieldNames()


def test_walk_prunes_directories(spark, tree):
    hidden = scan.walk_files(spark, str(tree), skip_hidden=True)
    assert below(tree, hidden) == sorted(["a.txt", ".dot", "_low", "sub/b.LOG", "sub/deep/c.py", "sub/empty.txt"])
    named = scan.walk_files(spark, str(tree), skip_names=["sub", ".git"])
    assert below(tree, named) == sorted(["a.txt", ".dot", "_low", "$bin/d"])
    flat = scan.walk_files(spark, str(tree), depth=1, skip_hidden=True)
    assert below(tree, flat) == sorted(["a.txt", ".dot", "_low", "sub/b.LOG", "sub/empty.txt"])


def test_walk_reports_what_it_cannot_read(spark, tree):
    found = scan.walk_files(spark, str(tree), "/no/such/root")
    errors = found.filter("error IS NOT NULL").collect()
    assert [row["path"] for row in errors] == ["/no/such/root"]


def test_names_of_a_hot_directory_are_dealt_to_many_tasks(spark, tmp_path):
    hot = tmp_path / "tree" / "hot"
    hot.mkdir(parents=True)
    for number in range(3000):
        (hot / f"f{number}").touch()
    store = str(tmp_path / "store")
    found = scan.walk_files(spark, f"file://{tmp_path}/tree", store=store)
    assert found.count() == 3000 and found.filter("size = 0 AND mtime IS NOT NULL AND ctime IS NOT NULL").count() == 3000
    files = spark.read.parquet(f"{store}/level=1").groupBy(F.input_file_name()).count().collect()
    assert len(files) == 4 and max(r["count"] for r in files) < 1000


def test_walk_of_an_address(tree, monkeypatch):
    """The entries of a store that only an address reaches, level by level."""
    local = pyarrow.fs.LocalFileSystem()
    arrow = SimpleNamespace(**{n: getattr(pyarrow.fs, n) for n in ("FileSelector", "FileType")})
    arrow.FileSystem = SimpleNamespace(from_uri=lambda uri: (local, f"{tree}/"))
    monkeypatch.setattr(remote, "fs", arrow)
    seen, waiting = {}, ["s3a://bucket"]
    while waiting:
        listed = list(scan._names(waiting.pop()))
        rows = [dict(zip(scan._COLUMNS, row)) for row in listed]
        assert [scan._measured(row) for row in rows] == rows
        waiting += [row[0] for row in listed if row[2]]
        seen.update({row[0]: row[3] for row in listed if not row[2]})
    assert {p: s for p, s in seen.items() if "link" not in p} == {
        "s3a://bucket/a.txt": 5, "s3a://bucket/.dot": 4, "s3a://bucket/_low": 4, "s3a://bucket/sub/b.LOG": 9,
        "s3a://bucket/sub/deep/c.py": 13, "s3a://bucket/$bin/d": 6, "s3a://bucket/.git/e": 6, "s3a://bucket/sub/empty.txt": 0,
    }
    with remote.open_for_reading("s3a://bucket/sub/b.LOG") as handle:
        assert handle.read() == b"sub/b.LOG"
    gone = list(scan._names("s3a://bucket/none"))
    assert [row[0] for row in gone] == ["s3a://bucket/none"] and gone[0][-1]


def test_scan_of_two_roots(spark, tree):
    found = scan.scan_files(spark, str(tree / "sub"), str(tree / "$bin"))
    assert sorted(os.path.basename(r["path"]) for r in found.collect()) == ["b.LOG", "c.py", "d"]
    only = scan.scan_files(spark, str(tree), glob="*.py")
    # Spark's listing follows the linked directory, so the file shows twice.
    assert [os.path.basename(r["path"]) for r in only.collect()] == ["c.py", "c.py"]


def test_scan_reads_no_content(spark, tree):
    found = scan.scan_files(spark, str(tree)).filter("size < 5")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(length,5)" in plan and "content" not in plan.split("FileScan")[1].split("]")[0]


def test_handle_on_an_arrow_file(tmp_path):
    (tmp_path / "f").write_bytes(b"0123456789")
    handle = io.BufferedReader(_Handle(pyarrow.fs.LocalFileSystem().open_input_file(str(tmp_path / "f"))))
    with handle:
        assert handle.seek(-4, io.SEEK_END) == 6 and handle.read() == b"6789"
        assert handle.seek(2) == 2 and handle.read(3) == b"234" and handle.tell() == 5
        with pytest.raises(OSError):
            handle.seek(-11, io.SEEK_END)
    empty = tmp_path / "none.zip"
    empty.write_bytes(zip_bytes([]))
    raw = pyarrow.fs.LocalFileSystem().open_input_file(str(empty))
    assert zipfile.ZipFile(io.BufferedReader(_Handle(raw))).infolist() == []


def zip_bytes(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in members:
            info = zipfile.ZipInfo(name, (2024, 1, 2, 3, 4, 6))
            archive.writestr(info, data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def tar_bytes(members, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as archive:
        for name, data in members:
            info = tarfile.TarInfo(name)
            if name.endswith("/"):
                info.type = tarfile.DIRTYPE
                archive.addfile(info)
            else:
                info.size, info.mtime = len(data), 1_700_000_000
                archive.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.fixture()
def shelf(tmp_path):
    whole = zip_bytes([("d/", b""), ("d/a.TXT", b"x" * 1000), ("b", b"yy")])
    packed = tar_bytes([("d/", b""), ("d/c.py", b"abc"), ("e.tar.gz", b"")])
    files = {
        "one.zip": whole,
        "two.tar.gz": packed,
        "three.TGZ": packed,
        "four.tar": tar_bytes([("f.x", b"12345")], "w"),
        "plain.gz": gzip.compress(b"no tar"),
        "cut.zip": whole[: len(whole) // 2],
        "cut.tar.gz": packed[: len(packed) // 2],
        "none.zip": zip_bytes([]),
        "r.rar": b"Rar!",
        "text.txt": b"no archive",
        "sp ace#1?%41.zip": zip_bytes([("q.md", b"q")]),
    }
    folder = tmp_path / "shelf"
    folder.mkdir()
    for name, data in files.items():
        (folder / name).write_bytes(data)
    return folder


EXPECTED_MEMBERS = {
    ("one.zip", "d/a.TXT", 1000, ".txt"), ("one.zip", "b", 2, ""),
    ("two.tar.gz", "d/c.py", 3, ".py"), ("two.tar.gz", "e.tar.gz", 0, ".gz"),
    ("three.TGZ", "d/c.py", 3, ".py"), ("three.TGZ", "e.tar.gz", 0, ".gz"),
    ("four.tar", "f.x", 5, ".x"), ("sp ace#1?%41.zip", "q.md", 1, ".md"),
}


def check_members(members):
    rows = [r.asDict() for r in members.collect()]
    for row in rows:
        row["name"] = os.path.basename(row["archive_path"])
    found = {
        (r["name"], r["internal_path"], r["uncompressed_size"], r["file_type"])
        for r in rows if r["error"] is None
    }
    assert found == EXPECTED_MEMBERS
    bad = {r["name"] for r in rows if r["error"] is not None}
    assert bad == {"plain.gz", "cut.zip", "cut.tar.gz", "r.rar"}
    stamped = next(r for r in rows if r["internal_path"] == "d/a.TXT")
    assert stamped["modified"].replace(tzinfo=None) == datetime.datetime(2024, 1, 2, 3, 4, 6)
    assert stamped["compressed_size"] < 100


def test_members_of_scanned_archives(spark, shelf):
    check_members(archive_members(scan.scan_files(spark, str(shelf))))


def test_members_of_walked_archives(spark, shelf):
    check_members(archive_members(filters.only_success(scan.walk_files(spark, str(shelf)))))


def test_members_from_content(spark, shelf):
    files = spark.read.format("binaryFile").load(str(shelf))
    check_members(archive_members(files, size="length", content="content"))


def test_archives_of_any_size_are_opened_or_reported(spark, shelf):
    listed = scan.scan_files(spark, str(shelf))
    whole = archive_members(listed).count()
    for size in (F.lit(5 * 1024**3 + 1), F.lit(None).cast("bigint")):
        assert archive_members(listed.withColumn("size", size)).count() == whole
    large = listed.withColumn("size", F.lit(5 * 1024**3 + 1))
    found = archive_members(large, limit=5 * 1024**3).collect()
    archives = large.filter(is_archive_scan("path")).count()
    assert len(found) == archives and {r["error"] for r in found} == {"skipped: size"}


def test_contents_that_differ_in_the_middle_differ(spark, tmp_path):
    block = 1024 * 1024
    for name, middle in (("a.dat", b"x"), ("b.dat", b"y")):
        (tmp_path / name).write_bytes(b"0" * block + middle * block + b"1" * block)
    walked = scan.walk_files(spark, str(tmp_path))
    rows = scan.files_from_scan(walked).collect()
    assert len({r["content_hash"] for r in rows}) == 2
    assert all(r["content_hash"] == hashlib.md5(Path(r["path"]).read_bytes()).hexdigest() for r in rows)
    assert {r["content_hash"] for r in scan.files_from_scan(walked, hash_limit=block).collect()} == {None}
    # The sampled fingerprint goes by its own name.
    assert walked.select(content.smart_hash_at("path", "size")).distinct().count() == 1


def test_only_files_that_may_have_a_copy_are_read(spark, tmp_path):
    sizes = [*range(20_000, 20_030), *[30_000] * 30, *[5_000] * 30]
    wanted = {}
    for number, size in enumerate(sizes):
        data = bytearray(random.Random(number).randbytes(size) if number % 3 else b"s" * size)
        if size == 30_000 and number % 6 == 0:
            data[6_000] = number  # Outside of the sample.
        path = tmp_path / f"f{number}"
        path.write_bytes(data)
        wanted[str(path)] = hashlib.md5(data).hexdigest()
    results = scan.walk_files(spark, str(tmp_path))
    for number in range(30):
        (tmp_path / f"f{number}").unlink()  # Alone in their size, so nobody misses them.
    rows = {r["path"]: r for r in scan.content_classes(results).collect()}
    assert len(rows) == 90
    unopened = {p for p, r in rows.items() if r["sample_hash"] is None}
    assert unopened == {str(tmp_path / f"f{n}") for n in range(30)}
    # Of the files of one size only those of equal samples are read whole.
    whole = {p for p, r in rows.items() if r["content_hash"] is not None}
    assert whole == {str(tmp_path / f"f{n}") for n in range(30, 90) if n % 3 == 0}
    assert all(rows[p]["content_hash"] == wanted[p] for p in whole)
    counts = Counter(wanted.values())
    found = scan.duplicates_from_scan(results).collect()
    assert {(r["path"], r["content_hash"], r["copies"]) for r in found} == {
        (p, h, counts[h]) for p, h in wanted.items() if counts[h] > 1
    }


def test_a_root_given_twice_or_below_another_is_walked_once(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.txt").write_text("f")
    found = scan.walk_files(spark, str(tmp_path), f"{tmp_path}/", str(tmp_path / "d"))
    assert [r["path"] for r in found.collect()] == [str(tmp_path / "d" / "f.txt")]


def test_members_follow_the_changes(spark, tmp_path):
    from pathledger.operators.snapshots import find_changes

    def pack(name, *members):
        with zipfile.ZipFile(tmp_path / name, "w") as archive:
            for member in members:
                archive.writestr(member, member)

    def snapshot(rows):
        rows = [(str(tmp_path / name), size, 1, None) for name, size in rows]
        return spark.createDataFrame(rows, "path string, size bigint, mtime bigint, content_hash string")

    (tmp_path / "to").mkdir()
    for name in ("same.zip", "changed.zip", "gone.zip", "moved.zip"):
        pack(name, f"old-{name}")
    prev = snapshot([("same.zip", 1), ("changed.zip", 2), ("gone.zip", 3), ("moved.zip", 4), ("x.txt", 5)])
    members = spark.createDataFrame(archive_members(prev).collect(), ARCHIVE_MEMBERS)
    pack("same.zip", "not looked at")
    pack("changed.zip", "a", "b")
    pack("new.zip", "n")
    os.replace(tmp_path / "moved.zip", tmp_path / "to" / "moved.zip")
    curr = snapshot([("same.zip", 1), ("changed.zip", 9), ("new.zip", 7), ("to/moved.zip", 4), ("x.txt", 6)])
    found = refresh_members(members, find_changes(prev, curr), curr)
    assert sorted((os.path.relpath(r["archive_path"], tmp_path), r["internal_path"]) for r in found.collect()) == [
        ("changed.zip", "a"), ("changed.zip", "b"), ("new.zip", "n"), ("same.zip", "old-same.zip"), ("to/moved.zip", "old-moved.zip"),
    ]


def test_a_broken_scan_goes_on(spark, tmp_path, monkeypatch):
    deep = tmp_path / "tree" / "a" / "b" / "c"
    deep.mkdir(parents=True)
    for folder in (deep, deep.parent, deep.parent.parent):
        (folder / "f.txt").write_text("f")
    store, root = str(tmp_path / "store"), str(tmp_path / "tree")
    whole = sorted(r["path"] for r in scan.walk_files(spark, root).collect())
    scan.walk_files(spark, root, depth=1, store=store)
    (tmp_path / "tree" / "late.txt").write_text("not seen: its level is done")
    monkeypatch.setattr(scan, "fresh_folder", None)
    found = scan.walk_files(spark, root, store=store)
    assert sorted(r["path"] for r in found.collect()) == whole


def test_drive_names_stay_text_and_missing_drives_stay(spark, tmp_path):
    columns = "path string, drive string"
    files = spark.createDataFrame([("a", "01"), ("b", "02"), ("c", None), ("d", "")], columns)
    catalog.write_catalog(files, f"{tmp_path}/c")
    found = {r["path"]: r["drive"] for r in catalog.read_catalog(spark, f"{tmp_path}/c").collect()}
    assert found == {"a": "01", "b": "02", "c": None}


def test_many_members_cross_batches(spark, tmp_path):
    (tmp_path / "big.zip").write_bytes(zip_bytes([(f"m{i}", b"") for i in range(25_000)]))
    members = archive_members(scan.scan_files(spark, str(tmp_path)))
    nested = archives.archives_nested(members)
    assert sorted((r["part_no"], len(r["contents"])) for r in nested.collect()) == [
        (0, 10_000), (1, 10_000), (2, 5_000),
    ]
    totals = archives.archive_totals(nested).first()
    assert (totals["archives_processed"], totals["members_found"]) == (1, 25_000)
    flat = archives.explode_archives(nested)
    assert flat.select("member_no", "internal_path").exceptAll(
        members.select("member_no", "internal_path")
    ).isEmpty()


def directory_cases(tmp_path):
    """Zip files whose directories hold names and comments that look like entries, and damaged ones."""
    plain = zip_bytes([(f"d{i}/" if i % 5 == 0 else f"m{i}.txt", b"") for i in range(300)])
    named = zip_bytes([(f"{i}PK\x01\x02{'PK' * (i % 40)}\x01\x02", b"") for i in range(120)])
    inner = zip_bytes([(f"in{i}", b"") for i in range(4)])
    fake = inner[inner.index(b"PK\x01\x02") : inner.rindex(b"PK\x05\x06")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for i in range(60):
            info = zipfile.ZipInfo(f"x{i}")
            info.comment = fake
            archive.writestr(info, b"")
        archive.comment = b"a comment"
    files = {"plain": plain, "named": named, "entries": out.getvalue(), "prefixed": b"#!run\n" + plain}
    at = plain.index(b"PK\x01\x02", plain.rindex(b"PK\x01\x02") - 2000)
    files["broken"] = plain[:at] + b"PX" + plain[at + 2 :]
    for name, data in files.items():
        (tmp_path / f"{name}.zip").write_bytes(data)
    return spark_rows(tmp_path)


def spark_rows(folder):
    return [(str(p), p.stat().st_size) for p in sorted(folder.iterdir())]


def test_directories_in_ranges_equal_those_read_whole(spark, tmp_path):
    listed = directory_cases(tmp_path)
    files = spark.createDataFrame([*listed, listed[-1]], "path string, size long")
    whole = sorted(archive_members(files).collect(), key=str)
    assert {r.archive_path.rpartition("/")[2] for r in whole if r.error} == {"broken.zip"}
    for step in (50, 173, 1000, 4096):
        assert sorted(archive_members(files, range_bytes=step).collect(), key=str) == whole
    assert sorted(archive_members(files.drop("size"), range_bytes=700).collect(), key=str) == whole


def test_ranges_of_a_directory_are_many_tasks(spark, tmp_path):
    (tmp_path / "big.zip").write_bytes(zip_bytes([(f"member{i}", b"") for i in range(30_000)]))
    files = spark.createDataFrame(spark_rows(tmp_path), "path string, size long")
    members = archive_members(files, range_bytes=1 << 16).withColumn("task", F.spark_partition_id())
    rows = members.agg(F.count("*"), F.countDistinct("member_no"), F.max("member_no"), F.countDistinct("task")).first()
    assert tuple(rows)[:3] == (30_000, 30_000, 29_999) and rows[3] > 3


def test_large_tars_are_complete_and_damaged_ones_give_one_row(spark, tmp_path):
    data = tar_bytes([(f"m{i}", b"") for i in range(12_000)], "w")
    (tmp_path / "a.tar").write_bytes(data)
    (tmp_path / "b.tgz").write_bytes(gzip.compress(data)[:-2000])
    rows = archive_members(spark.createDataFrame(spark_rows(tmp_path), "path string, size long")).collect()
    assert sorted(r.member_no for r in rows if r.error is None) == list(range(12_000))
    assert [r.archive_path.endswith("b.tgz") for r in rows if r.error] == [True]


def test_catalog_files(spark, sf_dir, tmp_path):
    files, target = fx.files(spark, sf_dir), str(tmp_path / "catalog")
    catalog.write_catalog(files.repartition(8), target, rows=50)
    found = catalog.read_catalog(spark, target)
    assert sorted(found.select(*files.columns).collect()) == sorted(files.collect())
    per_drive = {}
    for folder in (tmp_path / "catalog").glob("drive=*"):
        shards = [spark.read.parquet(str(f)).count() for f in folder.glob("*.parquet")]
        assert max(shards) <= 50
        per_drive[folder.name] = len(shards)
    assert len(per_drive) == 4 and per_drive["drive=C%3A"] == 3


def test_catalog_reads_prune_drives(spark, sf_dir, tmp_path):
    target = str(tmp_path / "catalog")
    catalog.write_catalog(fx.files(spark, sf_dir), target)
    found = filters.configured_drives(catalog.read_catalog(spark, target), {"C:\\": {}, "Q:\\": {}})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "drive" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r[0] for r in found.select("drive").distinct().collect()} == {"C:"}


def test_empty_drive_is_not_stored(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1, ""), ("C:\\x", 1, "C:")], "path string, size long, drive string")
    catalog.write_catalog(rows, str(tmp_path / "c"))
    assert [r["path"] for r in catalog.read_catalog(spark, str(tmp_path / "c")).collect()] == ["C:\\x"]


def test_stats_files(spark, sf_dir, tmp_path):
    from pathledger.operators import stats

    target = str(tmp_path / "stats")
    catalog.write_stats_json(stats.total_stats(fx.files(spark, sf_dir)), target)
    rows = {r["drive"]: r["files"] for r in spark.read.json(target).collect()}
    assert rows["ALL"] == 205 and len(rows) == 5


def test_depth_of_a_walk_equals_the_depth_filter(spark, tree):
    every = filters.only_success(scan.walk_files(spark, str(tree)))
    relative = F.substr("path", F.lit(len(str(tree)) + 2))
    every = every.withColumn("relative", F.replace(relative, F.lit("/"), F.lit("\\")))
    kept = filters.max_depth(every, 1)
    assert below(tree, kept) == below(tree, scan.walk_files(spark, str(tree), depth=1))
    assert every.select(F.max(path_depth("relative"))).first()[0] == 3


def test_tasks_write_the_tree_of_documents_in_place(spark, tmp_path):
    """A file per document in few folders; ids that repeat within a task share a file, as do those without one."""
    texts = [(i, f"text {i % 500}\né") for i in range(2500)] + [(7, "again"), (None, "no id"), (2600, None), (-1, "")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    place = Path(remote.local_path(storage._document_tree(spark, str(tmp_path))))
    files = [p for p in place.rglob("*") if p.is_file() and p.suffix == ".txt"]
    assert len(files) == 2502 and len({p.parent for p in files}) == 3
    found = {p.name: p.read_bytes().decode() for p in files}
    assert sorted(found.pop("doc=7.txt").split("\n")) == sorted(["text 7", "é", "again", ""])
    assert found.pop("doc=__HIVE_DEFAULT_PARTITION__.txt") == "no id\n" and found.pop("doc=-1.txt") == "\n"
    assert found == {f"doc={i}.txt": f"text {i % 500}\né\n" for i in range(2500) if i != 7}
    copies = {(r.doc_id, r.copies) for r in storage.duplicates_from_scan(spark, str(tmp_path)).collect()}
    assert copies == {(i, 5 - (i % 500 == 7)) for i in range(2500) if i != 7}


def test_contents_come_in_batches_of_bounded_size(spark):
    """A task that lists archives by content holds few of them at a time, however many there are."""
    sizes = F.expr("CASE WHEN id < 20000 THEN 10 ELSE 1000000 END")
    files = spark.range(20_020).coalesce(1).select(
        F.concat("id", F.lit(".zip")).alias("path"), F.lit(0).alias("size"), F.repeat(F.lit("x"), sizes.cast("int")).cast("binary").alias("content")
    )
    assert archive_members(files, content="content").filter("error IS NOT NULL").count() == 20_020

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    found = files.mapInArrow(measure, "rows long, bytes long").agg(F.max("rows"), F.max("bytes")).first()
    assert found[0] <= 256 and found[1] < 6_000_000
