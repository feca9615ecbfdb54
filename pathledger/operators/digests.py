"""Snapshot comparison by a tree of digests over directories.

Each directory has a digest of the files directly in it and one of all files below it. Two trees
are compared from the root down; below equal digests nothing is looked at. Only files whose own
directory differs are joined, so the work of a comparison grows with what changed, and with one
pass over the new listing that computes its tree.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathledger.functions.paths import SEPARATOR, directory_of
from pathledger.operators.snapshots import snapshot_diff
from pathledger.operators.spread import lookup
from pathledger.session import materialise

# A directory at a depth: two digests and the number of files, of all below it and of its own.
TREE = (
    "node string, parent string, below_0 bigint, below_1 bigint, below_files bigint, "
    "own_0 bigint, own_1 bigint, own_files bigint, depth int"
)
_BELOW, _OWN = ("below_0", "below_1", "below_files"), ("own_0", "own_1", "own_files")
# Names of changed directories that are sent to all tasks take so many bytes at most.
BROADCAST_BYTES = 16 << 20


def _directory(path="path"):
    """The directory of a file, with one kind of separator."""
    return F.translate(directory_of(path), "/", SEPARATOR)


def _file_digest(seed):
    """64 bits of what a comparison looks at. Flags tell NULLs apart, which hashes pass over."""
    fields = [F.col("path"), F.lit(seed)]
    for column in ("size", "mtime"):
        fields += [F.col(column).isNull(), F.coalesce(column, F.lit(0))]
    return F.xxhash64(*fields)


def _line():
    """All directories from the root to ``dir``, as (depth, node, parent)."""
    parts = F.split("dir", SEPARATOR * 2)

    def node(depth):
        return F.array_join(F.slice(parts, F.lit(1), F.greatest(depth, F.lit(0))), SEPARATOR)

    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda d: F.struct(d.alias("depth"), node(d).alias("node"), node(d - 1).alias("parent")),
    )


def digest_tree(snapshot: DataFrame) -> DataFrame:
    """The digests of all directories of a snapshot, from the root at depth 0 down.

    Digests are combined by exclusive or, so the files of a directory of any size are added up before
    each shuffle, and the second shuffle is of directories. A digest has 128 bits and the number of
    files, for snapshots of one row per path.
    """
    own = snapshot.groupBy(_directory().alias("dir")).agg(
        F.bit_xor(_file_digest(0)).alias("h0"), F.bit_xor(_file_digest(1)).alias("h1"), F.count(F.lit(1)).alias("n")
    )
    lines = own.select("*", F.explode(_line()).alias("at"), F.size(F.split("dir", SEPARATOR * 2)).alias("last"))
    here = F.col("at.depth") == F.col("last")
    return lines.groupBy("at.depth", "at.node", "at.parent").agg(
        F.bit_xor("h0").alias("below_0"),
        F.bit_xor("h1").alias("below_1"),
        F.sum("n").alias("below_files"),
        F.bit_xor(F.when(here, F.col("h0"))).alias("own_0"),
        F.bit_xor(F.when(here, F.col("h1"))).alias("own_1"),
        F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias("own_files"),
    )


def write_tree(snapshot: DataFrame, location):
    """Store the tree of a snapshot by depth, so that a descent reads level by level."""
    tree = digest_tree(snapshot).select(*[name.split()[0] for name in TREE.split(", ")])
    tree.hint("rebalance", "depth").write.mode("overwrite").partitionBy("depth").parquet(location)


def read_tree(spark: SparkSession, location) -> DataFrame:
    """A stored tree."""
    return spark.read.schema(TREE).parquet(location)


def _differs(columns):
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in columns]
    return ~(same[0] & same[1] & same[2])


def changed_directories(prev_tree: DataFrame, curr_tree: DataFrame) -> DataFrame:
    """(dir, files) of the directories whose own files differ, ``files`` on both sides together.

    One step per depth compares the children of the directories that differ at the depth above.
    It ends at the depth where all digests are equal, or that has no directories.
    """
    depth, above, found = 0, None, None
    while True:
        sides = []
        for tree in (prev_tree, curr_tree):
            level = tree.filter(F.col("depth") == depth)
            if above is not None:
                level = level.join(above.select(F.col("node").alias("parent")), "parent", "left_semi")
            sides.append(level)
        p, c = sides[0].alias("p"), sides[1].alias("c")
        files = F.coalesce("p.own_files", F.lit(0)) + F.coalesce("c.own_files", F.lit(0))
        joined = p.join(c, "node", "full_outer").filter(_differs(_BELOW))
        above = materialise(joined.select("node", _differs(_OWN).alias("own"), files.alias("files")), "level")
        changed = above.filter("own").select(F.col("node").alias("dir"), "files")
        found = changed if found is None else found.union(changed)
        if above.isEmpty():
            return found
        depth += 1


def files_in(snapshot: DataFrame, directories: DataFrame, broadcast=False) -> DataFrame:
    """The rows of a snapshot directly in the given directories (``dir``, each once)."""
    placed = snapshot.withColumn("_dir", _directory())
    wanted = directories.select(F.col("dir").alias("_dir"))
    if broadcast:
        return placed.join(F.broadcast(wanted), "_dir", "left_semi").drop("_dir")
    # A directory may hold a large share of all files.
    return lookup(placed, wanted, ["_dir"]).drop("_dir")


def tree_diff(prev: DataFrame, curr: DataFrame, prev_tree: DataFrame, curr_tree: DataFrame, hashes=True, rows=False):
    """The rows of ``snapshot_diff``, with only files of changed directories joined.

    ``prev_tree`` and ``curr_tree`` are the stored trees of the two snapshots. Where changed
    directories hold most files, nothing would be saved, and all files are joined.
    """
    changed = materialise(changed_directories(prev_tree, curr_tree), "changed")
    name_bytes, files = changed.agg(
        F.coalesce(F.sum(F.octet_length("dir")), F.lit(0)), F.coalesce(F.sum("files"), F.lit(0))
    ).first()
    roots = prev_tree.union(curr_tree).filter("depth = 0")
    total = roots.agg(F.coalesce(F.sum("below_files"), F.lit(0))).first()[0]
    if 2 * files > total:
        return snapshot_diff(prev, curr, hashes, rows)
    few = name_bytes <= BROADCAST_BYTES
    return snapshot_diff(files_in(prev, changed, few), files_in(curr, changed, few), hashes, rows)
