"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_ROWS (enlarged catalog).
"""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

from pathledger import search_files
from pathledger.operators import snapshots, stats
from pathledger.plans import QUERIES
from pathledger.session import build_session, fresh_folder
from pathledger.sources import catalog, name_index, scan

HEADLINE = [
    "read_listing_csv", "read_checkpoint_text", "write_catalog", "archive_members", "archives_nested",
    "smart_hash", "ext_splitext", "skip_dirs_substring", "skip_dirs_component", "search_glob",
    "search_combined", "new_files", "modified_files", "snapshot_diff", "moves_name_size",
    "moves_same_size", "find_changes", "archive_file_members", "apply_changes", "drive_stats",
    "total_stats", "scan_summary", "duplicate_files", "paths_by_size", "latest_version",
    "checkpoint_batches", "cap_per_root", "scan_limit", "sorted_listing", "progress_milestones",
    "path_set_ops", "distinct_dirs", "stream_snapshot_diff", "stream_scan_rate",
]
REPEATS = 2


def seconds(build):
    """Best time of a query, from building it to its last row."""
    times = []
    for _ in range(REPEATS):
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return round(min(times), 3)


def enlarged(spark, rows, later):
    """A stored snapshot of ``rows`` files; the later one has 1.5 % new, gone, moved and newer files."""
    key = F.col("id")
    change = F.when(key % 200 < 3, key % 200) if later else F.lit(None)
    folder = F.when(change == 0, "moved").otherwise(F.concat(F.lit("d"), (key % 5000).cast("string")))
    location = fresh_folder(spark, "bench")
    (
        spark.range(rows)
        .filter(F.lit(True) if not later else key % 200 != 1)
        .select(
            F.concat_ws("\\", F.lit("C:"), folder, F.concat(F.lit("f"), key.cast("string"))).alias("path"),
            (key * 7919 % 1_000_003).alias("size"),
            (F.lit(1_704_067_200) + F.coalesce(change, F.lit(0))).alias("mtime"),
            # A third of all files share one content.
            F.md5(F.when(key % 3 == 0, "same").otherwise(key.cast("string")).cast("binary")).alias("content_hash"),
        )
        .write.parquet(location)
    )
    return spark.read.parquet(location)


def tree(files=20_000, folders=200):
    """A folder of small files on the local disk."""
    root = tempfile.mkdtemp(prefix="run-bench-")
    for k in range(folders):
        os.mkdir(f"{root}/d{k}")
    for k in range(files):
        with open(f"{root}/d{k % folders}/f{k}.txt", "w") as file:
            file.write(str(k) * 20)
    return root, files


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    rows = int(os.environ.get("BENCH_ROWS", "2000000"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus.replace("*", "8"),
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in HEADLINE:
        timings[name] = seconds(lambda: QUERIES[name](spark, sf_dir))
        print(f"{name:28s} {timings[name]:8.3f}", file=sys.stderr, flush=True)

    prev, curr = enlarged(spark, rows, False), enlarged(spark, rows, True)
    large = {
        "large_snapshot_diff": lambda: snapshots.snapshot_diff(prev, curr, hashes=False),
        "large_find_changes": lambda: snapshots.find_changes(prev, curr),
        "large_duplicate_files": lambda: stats.duplicate_files(curr),
    }
    for name, build in large.items():
        timings[name] = seconds(build)
        print(f"{name:28s} {timings[name]:8.3f}", file=sys.stderr, flush=True)

    shelf = fresh_folder(spark, "bench-catalog")
    catalog.write_catalog(curr.selectExpr("*", "substr(path, 1, 2) AS drive"), shelf)
    start = time.perf_counter()
    name_index.build_name_index(spark, shelf)
    built = round(time.perf_counter() - start, 3)
    root, files = tree()
    published = {
        "search_stored_catalog": lambda: search_files("f1234567", catalog=shelf, spark=spark),
        "search_stored_substring": lambda: search_files("*234*", catalog=shelf, spark=spark),
        "search_stored_size": lambda: search_files(size=">990000", catalog=shelf, spark=spark),
        "scan_tree": lambda: scan.files_from_scan(scan.walk_files(spark, root), "N:"),
    }
    for name, build in published.items():
        timings[name] = seconds(build)
        print(f"{name:28s} {timings[name]:8.3f}", file=sys.stderr, flush=True)

    total = round(sum(timings.values()), 3)
    rate = round(2 * rows / timings["large_find_changes"])
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": total,
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "catalog_rows": rows,
                "catalog_rows_diffed_per_sec": rate,
                "name_index_build_sec": built,
                "scanned_files_per_sec": round(files / timings["scan_tree"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
