"""Search against the standard library's matching."""

import datetime
import fnmatch
import random
import re

import pytest

from pathledger import search
from pathledger.operators import filters
from pathledger.functions.globs import glob_regex
from pathledger.operators.search import search_glob, search_modified, search_size
from pathledger.plans import fixtures as fx

GLOBS = [
    "*.py", "*", "?.py", "a*", "*a*b*", "[ab].py", "[!ab].py", "x[0-9].*", "a.b", "[]]x", "[!]]x",
    "[a", "*.p?", "a+b", "(x)", "^a$", "[\\]x", "[a-c-]x", "[c-a]x", "[!c-a]x", "[a&&b]x", "[^b]x", "{a}", "a|b", "", "[[]x",
]
NAMES = [
    "a.py", "b.py", "c.py", "x1.txt", "x.txt", "a", "", "a.b", "axb", "]x", "[a", "a+b", "aab", "(x)",
    "^a$", "A.PY", "\\x"[1:], "-x", "bx", "{a}", "a|b", "[x", "ab\n.py", "ax",
]


@pytest.mark.parametrize("glob", GLOBS)
def test_globs(spark, glob):
    paths = [f"C:\\d.py\\{n}" for n in NAMES]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    found = sorted(r[0] for r in search_glob(df, glob).collect())
    assert found == sorted(p for p, n in zip(paths, NAMES) if fnmatch.fnmatchcase(n, glob))


def test_glob_ignoring_case(spark):
    df = spark.createDataFrame([("C:\\A.PY",), ("C:\\b.py",), ("C:\\c.pyc",)], "path string")
    assert search_glob(df, "*.Py", ignore_case=True).count() == 2


def test_random_globs_match_like_fnmatch():
    rng = random.Random(11)
    for _ in range(3000):
        glob = "".join(rng.choices("ab*?[]!-.^", k=rng.randint(1, 6)))
        wanted = re.compile(fnmatch.translate(glob))
        ours = re.compile(glob_regex(glob).replace(r"\z", r"\Z").replace("(?s)^", "(?s)"))
        for _ in range(5):
            name = "".join(rng.choices("ab.]!-[^", k=rng.randint(0, 4)))
            assert bool(ours.match(name)) == bool(wanted.match(name)), (glob, name)


@pytest.mark.parametrize(
    "test,kept",
    [
        (">1KB", [1025, 104857601]), (">=1kb", [1024, 1025, 104857601]), ("<2", [0, 1]),
        ("<=1B", [0, 1]), ("=1024", [1024]), (">100MB", [104857601]), ("> 0.5 K", [1024, 1025, 104857601]),
    ],
)
def test_sizes(spark, test, kept):
    df = spark.createDataFrame([(s,) for s in (0, 1, 1024, 1025, 104857601)], "size long")
    assert sorted(r[0] for r in search_size(df, test).collect()) == kept


@pytest.mark.parametrize("test", ["100MB", ">", ">1XB", ">>1", ">-1"])
def test_wrong_sizes(spark, test):
    with pytest.raises(ValueError):
        search_size(spark.createDataFrame([(1,)], "size long"), test)


def test_days(spark):
    day = 19737 * 86400  # 2024-01-15
    df = spark.createDataFrame([(day - 1,), (day,), (day + 86399,), (day + 86400,)], "mtime long")
    assert [r[0] for r in search_modified(df, "2024-01-15").collect()] == [day, day + 86399]
    assert search_modified(df, "today", as_of="2024-01-14").count() == 1
    assert search_modified(df, datetime.date(2024, 1, 16)).count() == 1
    assert search_modified(df, "today").count() == 0


def test_combined_is_sorted(spark, sf_dir):
    files = fx.files(spark, sf_dir)
    paths = [r["path"] for r in search(files, "*.py", size=">1KB").collect()]
    assert paths and paths == sorted(paths) and all(p.endswith(".py") for p in paths)
    assert search(files).count() == files.count()


def test_stored_catalog_search_is_pushed_down(spark, sf_dir, tmp_path):
    from pathledger import search_files
    from pathledger.sources.catalog import write_catalog

    write_catalog(fx.files(spark, sf_dir), str(tmp_path / "c"))
    found = search_files("*.py", size=">1KB", spark=spark, catalog=str(tmp_path / "c"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThan(size,1024)" in pushed and "StringEndsWith(path,.py)" in pushed
    assert found.count() > 0
    spark.conf.set("spark.pathledger.catalog", str(tmp_path / "c"))
    assert search_files("*.py", size=">1KB").collect() == found.collect()
    assert search_files(modified="today").count() == 0


def test_substring_and_component_skips_differ(spark):
    df = spark.createDataFrame(
        [("C:\\robin\\x",), ("C:\\bin\\x",), ("C:\\AppData\\x",), ("C:\\Windows",), ("C:\\Windows\\x",), ("C:/node_modules/x",)],
        "path string",
    )
    kept = [r[0] for r in filters.skip_dirs_substring(df).collect()]
    assert kept == ["C:\\AppData\\x"]
    kept = [r[0] for r in filters.skip_dirs_component(df).collect()]
    assert kept == ["C:\\robin\\x", "C:\\bin\\x", "C:\\Windows"]


def test_archives_of_drives_that_ask_for_it(spark):
    rows = [("C:", True), ("D:", True), ("D:", False), ("Q:", True)]
    df = spark.createDataFrame(rows, "drive string, is_archive boolean")
    assert [tuple(r) for r in filters.archives_to_scan(df).collect()] == [("D:", True)]


def test_depth_limit_keeps_files_at_the_limit(spark):
    df = spark.createDataFrame([("f",), ("a\\f",), ("a\\b\\f",), ("a\\b\\c\\f",)], "relative string")
    assert filters.max_depth(df, 2).count() == 3
    assert filters.max_depth(df, 0).count() == filters.max_depth(df, None).count() == 4


def test_large_sizes_are_exact(spark):
    df = spark.createDataFrame([(9007199254740992,), (9007199254740993,)], "size bigint")
    assert [r["size"] for r in search_size(df, "=9007199254740993").collect()] == [9007199254740993]
