"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingles.

Built-in functions only.
"""

from pyspark.sql import DataFrame, functions as F

from pathledger.session import materialise

SHINGLE = 5
CONTAINMENT = 0.8
_NOT_WORD = "[^\\p{L}\\p{N}]+"
# Chance that one shingle of a document is the least of its bin, at up to 1, 1/4 bins' load.
_LOADS = ((9, 0), (4, 2))


def _words(text):
    """Lower-cased runs of letters and digits."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), _NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def _windows(words, size, make):
    places = F.sequence(F.lit(0), F.size(words) - size)
    empty = F.transform(F.array().cast("array<int>"), make)
    return F.when(F.size(words) >= size, F.transform(places, make)).otherwise(empty)


def _hashes(words, sizes):
    """Hashes of all runs of words of the given sizes, in one array."""

    def runs(n):
        return _windows(words, n, lambda i: F.xxhash64(F.lit(n), *[words[i + k] for k in range(n)]))

    return F.concat(*map(runs, sizes))


def _shingles(words, sizes):
    def runs(n):
        return _windows(words, n, lambda i: F.array_join(F.slice(words, i + 1, n), " "))

    return F.array_distinct(F.concat(*map(runs, sizes)))


def _key(text):
    """Contamination depends on the text alone, so a text stands for its documents."""
    body = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(body).alias("a"), F.md5(body).alias("b"))


def _bin_shift(n, extra):
    """By how many bits to shift a hash to get its bin: a power of two of bins, ``n`` or more."""
    return 64 - F.least(F.lit(62), F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int") + extra + 1)


def sketch(hashes, n, extra):
    """The least hash of each bin: a one-permutation MinHash with as many bins as the size class has shingles.

    ``hashes`` is sorted, so a bin, the hashes of equal leading bits, is one run in it.
    """

    def first_of_bin(h, i):
        earlier = F.get(hashes, i - 1)
        shift = _bin_shift(n, extra)
        return (i == 0) | (F.call_function("shiftright", h, shift) != F.call_function("shiftright", earlier, shift))

    return F.filter(hashes, first_of_bin)


def contaminated_texts(docs: DataFrame, items: DataFrame, item_id="item_id", text="text") -> DataFrame:
    """(key, item_id, shared, total) of the texts that hold at least CONTAINMENT of an item's shingles.

    A long document shares few of its shingles with a short item, so a MinHash of fixed length
    would miss it. Documents therefore are partitioned by size, in powers of two, and a class gets
    as many bins as it has shingles: about 0.63 to 0.79 of a document's shingles are the least of
    their bin, and an item of nine shared shingles or more is missed with a chance below 2 in
    10,000. Where the smallest item has fewer shingles, all classes get four times the bins, and
    below four shingles every shingle is kept. An item and a document that share a kept hash are
    candidates; candidates are decided by their exact distinct shingles. Items of fewer than five
    words are one shingle, looked for among runs of as many words. Items without words are in no text.
    """
    known = items.select(F.col(item_id).alias("item_id"), _words(F.col(text)).alias("words"))
    known = known.filter(F.size("words") > 0)
    short = F.when(F.size("words") < SHINGLE, F.size("words"))
    # One row with at most four sizes.
    row = known.agg(F.collect_set(short).alias("sizes"), F.min(F.size("words")).alias("least")).first()
    sizes = [SHINGLE, *sorted(row.sizes)]
    least = max(1, (row.least or SHINGLE) - SHINGLE + 1)
    extra = next((bits for floor, bits in _LOADS if CONTAINMENT * least >= floor - 1), None)
    # An item is looked up by the runs of its own size.
    item_words = F.col("words")
    own = F.coalesce(*[F.when(F.size(item_words) == n, _shingles(item_words, [n])) for n in sizes[1:]], _shingles(item_words, [SHINGLE]))
    item_shingles = known.select("item_id", own.alias("shingles"))
    item_shingles = item_shingles.select("item_id", F.size("shingles").alias("total"), F.explode("shingles").alias("shingle"))
    item_shingles = materialise(item_shingles.distinct(), "item_shingles")
    pieces = F.split("shingle", " ")
    one = F.coalesce(*[F.when(F.size(pieces) == n, F.xxhash64(F.lit(n), *[pieces[k] for k in range(n)])) for n in sizes])
    item_hashes = materialise(item_shingles.select(one.alias("h")).distinct(), "item_hashes")

    texts = docs.select(_key(F.col(text)).alias("key"), _words(F.col(text)).alias("words"))
    hashed = texts.select("key", F.sort_array(_hashes(F.col("words"), sizes)).alias("hashes"))
    kept = F.col("hashes") if extra is None else sketch(F.col("hashes"), F.size("hashes"), extra)
    found = hashed.select("key", F.explode(kept).alias("h"))
    candidates = materialise(found.join(item_hashes, "h").select("key").distinct(), "candidates")

    again = docs.select(_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    again = again.join(candidates, "key", "left_semi").dropDuplicates(["key"])
    again = again.select("key", _words(F.col("text")).alias("words"))
    exact = again.select("key", F.explode(_shingles(F.col("words"), sizes)).alias("shingle"))
    shared = exact.join(item_shingles, "shingle").groupBy("key", "item_id", "total")
    shared = shared.agg(F.count(F.lit(1)).alias("shared"))
    # Integers, so that the limit itself counts whatever the rounding.
    return shared.filter(F.col("shared") * 10 >= F.col("total") * round(CONTAINMENT * 10))


def find_contamination(
    docs: DataFrame, items: DataFrame, doc_id="doc_id", item_id="item_id", text="text"
) -> DataFrame:
    """(doc_id, item_id, shared, total) for each document and benchmark item it contains.

    Repeated documents and null ids give a row each; null and empty texts contain nothing;
    repeated items count once per item_id and text.
    """
    hits = materialise(contaminated_texts(docs, items, item_id, text), "contaminated")
    rows = docs.select(F.col(doc_id).alias("doc_id"), _key(F.col(text)).alias("key"))
    return rows.join(hits, "key").select("doc_id", "item_id", "shared", "total")


def drop_contaminated(docs: DataFrame, items: DataFrame, text="text", **names) -> DataFrame:
    """``docs`` without the documents that contain an item; all others stay, with all columns."""
    hits = materialise(contaminated_texts(docs, items, text=text, **names).select("key").distinct(), "contaminated")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    packed = packed.withColumn("key", _key(F.col(f"doc.{text}")))
    return packed.join(hits, "key", "left_anti").select("doc.*")
