"""Column functions against the standard library."""

import hashlib
import ntpath
import os
import random
from pathlib import PurePosixPath, PureWindowsPath

import pytest
from pyspark.sql import functions as F

from pathledger.functions import content, paths, values
from pathledger.sources.scan import scan_files, walk_files

EDGE_NAMES = ["a.py", ".bashrc", "a.", "a.tar.gz", "..a", "A.ZIP", "noext", "a b.Tgz", "...", ".a.b", "..", "."]


def random_names(count=3000, alphabet="ab.A é\n-"):
    rng = random.Random(7)
    return ["".join(rng.choices(alphabet, k=rng.randint(1, 7))) for _ in range(count)]


def one_column(spark, values, kind="string"):
    return spark.createDataFrame([(value,) for value in values], f"v {kind}")


def apply(spark, function, values, kind="string"):
    return [row[0] for row in one_column(spark, values, kind).select(function("v")).collect()]


def test_suffix_is_that_of_pathlib(spark):
    names = [n for n in EDGE_NAMES + random_names() if n not in (".", "..")]
    assert apply(spark, paths.ext_suffix, names) == [PurePosixPath(n).suffix.lower() for n in names]


def test_splitext_is_that_of_os_path(spark):
    names = EDGE_NAMES + random_names()
    assert apply(spark, paths.ext_splitext, names) == [os.path.splitext(n)[1].lower() for n in names]


def test_full_path_joins_like_windows(spark):
    pairs = [(d, n) for d in ("C:", "C:\\", "C:\\x", "C:\\x\\", "x/", "\\\\s\\h", "") for n in ("a.b", "c d")]
    rows = spark.createDataFrame(pairs, "d string, n string").select(paths.full_path("d", "n"))
    assert [row[0] for row in rows.collect()] == [ntpath.join(d, n) for d, n in pairs]


def test_base_name_and_directory(spark):
    given = ["C:\\a\\b.txt", "b.txt", "C:\\a\\", "\\\\s\\h\\f"]
    assert apply(spark, paths.base_name, given) == [ntpath.basename(p) for p in given]
    assert apply(spark, paths.directory_of, given) == ["C:\\a", "", "C:\\a", "\\\\s\\h"]
    assert apply(spark, paths.base_name, ["/a.b/c", "C:/x\\y/z"]) == ["c", "z"]
    assert apply(spark, paths.directory_of, ["/a.b/c", "C:/x\\y/z"]) == ["/a.b", "C:/x\\y"]


def test_drive(spark):
    assert apply(spark, paths.drive_of, ["C:\\x", "C:", "", "\\\\s\\h"]) == ["C:", "", "", "\\\\"]
    assert apply(spark, paths.drive_key, ["C:", "C:\\", "C:/"]) == ["C:"] * 3
    roots = ["C:\\", "Z:\\", "\\\\s\\h", None, "z:\\"]
    kinds = ["ntfs_local", "network", "network", "unknown", "ntfs_local"]
    assert apply(spark, paths.drive_type, roots) == kinds


def test_archive_flags_differ_for_tgz(spark):
    names = ["a.zip", "a.TGZ", "a.tar.gz", "a.7z", "a.bz2", "zip", ".zip"]
    listed = apply(spark, lambda v: paths.is_archive_listing(paths.ext_suffix(v)), names)
    assert listed == [True, False, True, True, False, False, False]
    scanned = apply(spark, paths.is_archive_scan, [f"C:\\x.y\\{n}" for n in names])
    assert scanned == [True, True, True, True, False, False, False]
    assert apply(spark, paths.is_archive_scan, ["C:\\.tar.gz"]) == [True]


def test_guarded_int(spark):
    given = ["12", "007", "", "-1", "1.5", " 3", "12\n", "9223372036854775807", "9223372036854775808", None]
    expected = [12, 7, 0, 0, 0, 0, 0, 9223372036854775807, 0, 0]
    assert apply(spark, values.guarded_int, given) == expected


def test_depth(spark):
    given = ["", "a", "a\\b", "a/b\\c"]
    assert apply(spark, paths.path_depth, given) == [0, 1, 2, 3]


def test_below_root(spark):
    rows = spark.createDataFrame([("C:\\a\\b", "C:\\"), ("C:\\a", "C:\\a"), ("/r/x", "/r")], "p string, r string")
    assert [r[0] for r in rows.select(paths.below_root("p", "r")).collect()] == ["a\\b", "", "x"]


def test_times(spark):
    whole = apply(spark, lambda v: F.unix_micros(values.epoch_seconds(v)), [1.5, 0.0], "double")
    assert whole == [1_500_000, 0]
    nanos = [1_704_067_200_123_456_789, 999, 9_007_199_254_740_993_001]
    found = apply(spark, lambda v: F.unix_micros(values.epoch_nanos(v)), nanos, "bigint")
    assert found == [n // 1000 for n in nanos]


def test_runtime_and_progress(spark):
    assert apply(spark, values.runtime_hms, [0, 59, 3600, 360_061], "bigint") == [
        "00:00:00", "00:00:59", "01:00:00", "100:01:01",
    ]
    shares = spark.createDataFrame([(1, 3), (5, 0), (0, 4)], "p long, t long")
    assert [r[0] for r in shares.select(values.progress_pct("p", "t")).collect()] == [33.3, 0.0, 0.0]


MIB = 1024 * 1024
SIZES = [0, 10, MIB - 1, MIB, MIB + MIB // 2, 2 * MIB, 2 * MIB + 1, 3 * MIB]


def expected_hash(data):
    if len(data) < MIB:
        return hashlib.md5(data).hexdigest()
    tail = data[-MIB:] if len(data) > 2 * MIB else b""
    return hashlib.md5(data[:MIB] + tail + str(len(data)).encode()).hexdigest()


@pytest.fixture(scope="module")
def sized_files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("sized")
    rng, wanted = random.Random(3), {}
    for size in SIZES:
        data = rng.randbytes(size)
        (folder / f"f {size}.bin").write_bytes(data)
        wanted[f"f {size}.bin"] = expected_hash(data)
    return str(folder), wanted


def test_smart_hash_of_content(spark, sized_files):
    folder, wanted = sized_files
    files = spark.read.format("binaryFile").load(folder)
    rows = files.select("path", content.smart_hash("content", "length")).collect()
    # Spark does not list empty files.
    wanted = {name: value for name, value in wanted.items() if name != "f 0.bin"}
    assert {os.path.basename(r[0]): r[1] for r in rows} == wanted


def test_smart_hash_at_path(spark, sized_files):
    folder, wanted = sized_files
    rows = walk_files(spark, folder).select("path", content.smart_hash_at("path", "size")).collect()
    assert {os.path.basename(r[0]): r[1] for r in rows} == wanted
    rows = scan_files(spark, folder).select("path", content.smart_hash_at("path", "size")).collect()
    found = {os.path.basename(r[0]): r[1] for r in rows}
    assert len(found) == len(SIZES) - 1 and found.items() <= wanted.items()


def test_smart_hash_limits(spark):
    rows = spark.createDataFrame([(b"", 0), (b"abc", 100 * MIB + 1)], "c binary, s long")
    assert rows.select(content.smart_hash("c", "s")).first()[0] == expected_hash(b"")
    rows = rows.filter("s > 0")
    assert rows.select(content.smart_hash("c", "s")).first()[0] is None
    gone = spark.createDataFrame([("/no/such/file", 5), ("/etc/hostname", 100 * MIB + 1)], "p string, s long")
    assert [r[0] for r in gone.select(content.smart_hash_at("p", "s")).collect()] == [None, None]


def test_windows_suffix_of_listed_names(spark):
    names = ["x.PY", "a.b.c", "no", ".hidden", "a."]
    assert apply(spark, paths.ext_suffix, names) == [PureWindowsPath(n).suffix.lower() for n in names]
