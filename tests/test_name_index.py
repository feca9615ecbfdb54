"""Search by the trigrams of names, and along the curve, against plain matching of all rows."""

import fnmatch
import glob as files
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pathledger import search_files
from pathledger.operators.search import search
from pathledger.sources import catalog, name_index
from pathledger.streaming import monitor

SCHEMA = "path string, size bigint, mtime bigint, ctime bigint, content_hash string, is_archive boolean, drive string, ext string, attributes bigint"
WORDS = ["alpha", "Beta", "gamma", "über", "Δelta", "x", "", "a.b", "12", "日本語", "İx", "e\x02f", "q😀q"]


def rows_of(names, seed=1):
    rng = random.Random(seed)
    return [
        (f"{d}:\\dir{i % 7}\\{name}", rng.randint(0, 10**6), 1704067200 + rng.randint(0, 90) * 86400, 0, None, False, f"{d}:", "", 32)
        for i, name in enumerate(names)
        for d in rng.choice("CD")
    ]


def random_names(n, seed=2):
    rng = random.Random(seed)
    return ["_".join(rng.choices(WORDS, k=rng.randint(1, 3))) + f"{i}" + rng.choice([".py", ".TXT", "", "\n.md"]) for i in range(n)]


def grams(name):
    padded = f"\x02{name.translate(name_index._FOLD)}\x03"
    return {padded[i : i + 3] for i in range(max(1, len(padded) - 2))}


def test_every_match_has_the_grams_of_its_glob():
    rng = random.Random(5)
    names = random_names(300) + ["", "a", "ab", "]x", "[a"]
    for _ in range(4000):
        name = rng.choice(names)
        a, b = sorted(rng.choices(range(len(name) + 1), k=2))
        glob = rng.choice(["*", "", "?", "[!z]*"]) + name[a:b] + rng.choice(["*", "", "?"])
        if fnmatch.fnmatchcase(name, glob):
            assert set(name_index.glob_grams(glob)) <= grams(name), (glob, name)
    assert name_index.glob_grams("*.Py") == [".py", "py\x03"] and name_index.glob_grams("*[a]b*") == []


@pytest.fixture(scope="module")
def shelf(spark, tmp_path_factory):
    """An indexed catalog, and its rows; a tenth came after the index."""
    location = str(tmp_path_factory.mktemp("catalog"))
    df = spark.createDataFrame([*rows_of(random_names(3000)), ("C:", 1, 2, 3, None, False, "C:", "", 1)], SCHEMA)
    late = F.pmod(F.xxhash64("path"), F.lit(10)) == 0
    catalog.write_catalog(df.filter(~late), location)
    name_index.build_name_index(spark, location, bucket_rows=2000)
    catalog.write_catalog(df.filter(late), location)
    return location, catalog.read_catalog(spark, location).cache()


@pytest.mark.parametrize(
    ("glob", "indexed"),
    [
        ("*Beta_alpha*", False), ("*gamma13*", True), ("*277.py", True), ("*日本語_x_*", None), ("*_über_*", False), ("q😀q1*.md", None),
        ("*.py", False), ("a*", False), ("*[0-4]?", False), ("*no such name*", True), ("", False), ("*İx_Δ*", None), ("*Δelta13*", True),
    ],
)
def test_search_by_index_equals_search_of_all(spark, shelf, glob, indexed):
    location, rows = shelf
    index = name_index.open_name_index(spark, location)
    assert index.buckets > 3 and indexed in (None, index.gram_for(glob) is not None)
    for options in ({}, {"ignore_case": True}, {"size": ">1KB"}):
        found = search_files(glob, catalog=location, spark=spark, **options).collect()
        assert found == search(rows, glob, **options).collect()
        assert found or "no such" in glob or glob == "" or options


def test_rare_trigram_reads_a_small_share(spark, tmp_path):
    location = str(tmp_path)
    key = F.col("id")
    df = spark.range(300_000).select(
        F.concat(F.lit("C:\\d"), (key % 500).cast("string"), F.lit("\\f"), key.cast("string")).alias("path"),
        (key * 7919 % 1_000_003).alias("size"), (F.lit(1704067200) + key * 104729 % 90 * 86400).alias("mtime"),
        F.md5(key.cast("string").cast("binary")).alias("content_hash"), F.lit("C:").alias("drive"),
    )
    catalog.write_catalog(df, location)
    index = name_index.build_name_index(spark, location)
    gram = index.gram_for("*234*")
    assert gram == "234" and index.gram_for("f123456") and index.gram_for("f1*") is None
    found = search_files("*234*", catalog=location, spark=spark)
    assert [r.path for r in found.collect()] == sorted(r.path for r in df.collect() if "234" in r.path.split("\\")[-1])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    # Of the row groups whose range holds the trigram, one page per column at most is read beside its rows.
    bucket = name_index._bucket_of(gram, index.buckets)
    read = index.postings(spark, gram).count()
    stored = sum(pq.ParquetFile(f).metadata.num_rows for f in files.glob(f"{index.location.removeprefix('file:')}/postings/bucket={bucket}/*.parquet"))
    assert read * name_index.POSTED <= index.rows and read < stored / 50


def test_a_catalog_that_lost_files_is_read_whole(spark, tmp_path):
    location = str(tmp_path)
    df = spark.createDataFrame(rows_of(random_names(200)), SCHEMA)
    catalog.write_catalog(df, location)
    name_index.build_name_index(spark, location)
    catalog.write_catalog(df.filter("path LIKE '%gamma%'"), location, mode="overwrite")
    # Overwriting a catalog takes its index along, which must not be missed either.
    found = search_files("*gamma_12*", catalog=location, spark=spark)
    assert found.count() == sum("gamma_12" in r.path.split("\\")[-1] for r in df.collect() if "gamma" in r.path)


def test_index_of_an_empty_catalog_and_old_versions(spark, tmp_path):
    location = str(tmp_path)
    catalog.write_catalog(spark.createDataFrame(rows_of(["abcdef"]), SCHEMA), location)
    for _ in range(3):
        name_index.build_name_index(spark, location)
    assert len(files.glob(f"{location}/_names/*")) == 2
    assert search_files("abcdef", catalog=location, spark=spark).count() == 1
    index = name_index.open_name_index(spark, location)
    assert index.postings(spark, "zzz").collect() == []


def test_live_search_by_index_sees_later_polls(spark, tmp_path):
    root, rows = f"{tmp_path}/root", rows_of(random_names(400))
    first = spark.createDataFrame(rows, SCHEMA)
    later = [r for r in rows if "gamma_12" not in r[0]] + rows_of(["new_gamma_12.py", "other.py"])
    monitor.process_poll(spark, root, 0, 1, first, index=True)
    monitor.process_poll(spark, root, 1, 2, spark.createDataFrame(later, SCHEMA), index=True)
    for step in range(2):
        assert files.glob(f"{root}/base/batch_id={step}/_names/*/meta/_SUCCESS")
        for glob in ("*gamma_12*", "*alpha_alpha*", "*.py"):
            found = [r.path for r in search_files(glob, live=root, spark=spark).collect()]
            assert found == sorted(r[0] for r in later if fnmatch.fnmatchcase(r[0].split("\\")[-1], glob)) and found
        if not step:
            monitor.compact(spark, root, index=True)


def _groups(location):
    for f in files.glob(f"{location}/drive=*/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            yield {n: meta.row_group(g).column(i).statistics for i, n in enumerate(names)}


def test_a_day_and_a_size_skip_most_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "GROUP_BYTES", 64 << 10)
    key, location = F.col("id"), str(tmp_path)
    df = spark.range(200_000).select(
        F.concat(F.lit("C:\\"), F.md5(key.cast("string").cast("binary"))).alias("path"),
        F.when(key % 50 != 0, F.pow(F.lit(2.0), key * 7919 % 1009 / 40).cast("bigint")).alias("size"),
        F.when(key % 70 != 0, F.lit(1704067200) + key * 104729 % 90 * 86400).alias("mtime"),
        F.when(key % 3 != 0, "C:").otherwise("D:").alias("drive"),
    )
    catalog.write_catalog(df, location)
    groups, day = list(_groups(location)), 1704067200 + 10 * 86400
    assert len(groups) >= 16
    by_day = sum(g["mtime"].has_min_max and g["mtime"].min <= day <= g["mtime"].max for g in groups)
    by_size = sum(g["size"].has_min_max and g["size"].max >= 10 << 20 for g in groups)
    assert by_day < len(groups) / 3 and by_size < len(groups) / 3
    stored = catalog.read_catalog(spark, location)
    assert sorted(stored.collect()) == sorted(df.collect())
    assert search_files(modified="2024-01-11", catalog=location, spark=spark).count() == df.filter(F.col("mtime") == day).count()


def test_curve_of_nulls_and_of_one_value(spark, tmp_path):
    df = spark.createDataFrame([(f"C:\\{i}", None if i % 2 else 5, None, "C:") for i in range(10)], "path string, size bigint, mtime bigint, drive string")
    for location, rows in ((f"{tmp_path}/a", df), (f"{tmp_path}/b", df.limit(0))):
        catalog.write_catalog(rows, location)
        if rows is df:
            assert catalog.read_catalog(spark, location).count() == 10
