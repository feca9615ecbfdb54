"""Removal of repeated byte strings by prefix-free parsing.

Every start of a string of LENGTH bytes has a trigger: the k-gram of least rolling hash among those
inside the string. Starts in a row with the same trigger form a phrase, the bytes from the first
of them to the end of the last string. Neighbouring phrases overlap by LENGTH - 1 bytes, so each
string lies in exactly one phrase, and equal strings have the same trigger at the same offset,
wherever they stand. A corpus of repetitive text has few distinct phrases: these are the
dictionary, and the texts are its parse. An occurrence of a phrase that stands elsewhere earlier
is removed as a whole, from the parse alone. Only where different phrases of one trigger agree
beside it, at the ends of repeated passages, are the suffixes of dictionary phrases put in order,
up to the LENGTH bytes that matter, and each but the first of equal ones in corpus order is removed.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from pathledger.llm.text import byte_codes, chunks, mixed, prefix_sums, small_batches, span_hashes, texts_of
from pathledger.session import materialise

LENGTH = 100
GRAM = 24
# The bytes of a string beside its trigger, LENGTH - GRAM, in quarters.
QUARTER = (LENGTH - GRAM) // 4
# Starts of strings in one array; a phrase that is cut there gives two, which the order of
# suffixes puts right.
BLOCK = 1 << 20
_CODES = byte_codes(6)
_PLACE_BITS = 22
# ``spot`` packs first, n, ahead and sure.
_PARSED = {"id": "bigint", "hash": "int", "trigger": "int", "phrase": "bigint", "spot": "bigint", "sides": "bigint"}


def _least(values, width):
    """Minimum of each run of ``width`` values."""
    n = len(values) - width + 1
    pad = -len(values) % width
    full = np.concatenate((values, np.full(pad, np.iinfo(np.uint64).max))).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def phrases(buf, ends_of_start, begins):
    """(trigger, phrase, first, n, ahead, sides) of the phrases in ``buf``.

    ``ends_of_start[p]`` is true if a string of LENGTH bytes may start at p, and ``begins[p]`` is
    where p's text begins. ``first`` is the first start of a phrase and ``n`` the number of starts;
    the trigger stands ``ahead`` of it. ``sides`` packs four hashes of 16 bits: of the trigger with
    three, two, one and no quarters of the bytes before it, and as many quarters after it as make
    three. A string that has so much before its trigger holds all these bytes, so two phrases
    that differ in them do not have it in common.
    """
    if len(buf) < LENGTH:
        return [np.zeros(0, np.int64)] * 6
    sums = prefix_sums(_CODES[buf])
    at = np.arange(len(buf) - GRAM + 1)
    grams = span_hashes(sums, at, at + GRAM)
    # The place in the low bits: equal hashes are decided by the earlier one.
    keys = (grams >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | at.astype(np.uint64)
    place = (_least(keys, LENGTH - GRAM + 1) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | ~ends_of_start[: len(place) - 1]
    new &= ends_of_start[: len(place)]
    firsts = np.flatnonzero(new)
    stop = np.flatnonzero(~ends_of_start[: len(place)])
    later = np.append(firsts[1:], len(place))
    if len(stop):
        halt = np.append(stop, len(place))[np.searchsorted(stop, firsts)]
        later = np.minimum(later, halt)
    n = later - firsts
    where = place[firsts]
    whole = span_hashes(sums, firsts, later + LENGTH - 1)
    whole = mixed(whole + (where - firsts).astype(np.uint64) * np.uint64(1_000_003) + n.astype(np.uint64))
    sides, reach = np.zeros(len(where), np.uint64), later + LENGTH - 1
    for c in range(4):
        start, end = where - (3 - c) * QUARTER, where + GRAM + c * QUARTER
        # Too near an end for these bytes: no string of the phrase has them.
        there = (start >= begins[firsts]) & (end <= reach)
        part = span_hashes(sums, np.maximum(start, 0), np.minimum(end, len(buf)))
        part = np.where(there, part % np.uint64(65535) + np.uint64(1), np.uint64(0))
        sides |= part << np.uint64(16 * c)
    trigger = grams[where].astype(np.uint32).view(np.int32)
    return trigger, whole.view(np.int64), firsts, n, where - firsts, sides.view(np.int64)


def _blocks(texts):
    """(buffer, allowed starts, text number, offset to subtract, begin of the text in it), of bounded size."""
    for first, last in chunks(texts, BLOCK):
        part = texts[first:last]
        if last - first == 1 and len(part[0]) > BLOCK:
            for at in range(0, len(part[0]), BLOCK):
                buf = np.frombuffer(part[0][at : at + BLOCK + LENGTH - 1], np.uint8)
                allowed = np.arange(len(buf)) + LENGTH <= len(buf)
                yield buf, allowed, np.full(len(buf), first), np.full(len(buf), -at), np.zeros(len(buf), np.int64)
            continue
        buf = np.frombuffer(b"".join(part), np.uint8)
        sizes = np.array([len(t) for t in part])
        begins = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(part)), sizes)
        left = np.repeat(begins + sizes, sizes) - np.arange(len(buf))
        starts = np.repeat(begins, sizes)
        yield buf, left >= LENGTH, owner + first, starts, starts


def _sure(phrase, *place):
    """Which phrases of a block stand elsewhere in it, at an earlier place."""
    order = np.lexsort((*place[::-1], phrase))
    ahead = np.zeros(len(order), np.int64)
    new = np.flatnonzero(phrase[order][1:] != phrase[order][:-1]) + 1
    ahead[new] = new
    first = order[np.maximum.accumulate(ahead)]
    sure = np.zeros(len(order), bool)
    sure[order] = np.logical_or.reduce([x[order] != x[first] for x in place])
    return sure


def _parse(batches):
    """Rows (id, hash, trigger, phrase, spot, sides) of the phrases of rows (id, hash, text).

    A phrase that stands earlier in the block is ``sure`` to be repeated. It needs no comparison,
    so it gets a trigger of its own, and a frequent line does not meet in one task.
    """
    for batch in batches:
        texts = texts_of(batch.column(2))
        ids = pc.fill_null(batch.column(0), np.iinfo(np.int64).max).to_numpy()
        text_hashes = batch.column(1).to_numpy()
        for buf, allowed, owner, offset, begins in _blocks(texts):
            trigger, phrase, first, n, ahead, sides = phrases(buf, allowed, begins)
            if not len(first):
                continue
            rows, first = owner[first], first - offset[first]
            sure = _sure(phrase, ids[rows], text_hashes[rows].astype(np.int64), first)
            own = mixed(ids[rows].astype(np.uint64) * np.uint64(31) + first.astype(np.uint64))
            trigger = np.where(sure, own.astype(np.uint32).view(np.int32), trigger)
            spot = first << 16 | n << 9 | ahead << 1 | sure
            arrays = [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows))]
            arrays += [pa.array(x) for x in (trigger, phrase, spot, np.where(sure, 0, sides))]
            yield pa.RecordBatch.from_arrays(arrays, [*_PARSED])


def _heads(batches):
    """Rows (id, hash, head, first) for each string in the given phrases of a text.

    ``head`` is the hash of the LENGTH bytes from ``first``.
    """
    for batch in batches:
        texts = texts_of(batch.column(2))
        for i, text in enumerate(texts):
            spans = batch.column(3)[i].values
            firsts = spans.field("first").to_numpy(zero_copy_only=False)
            places = spans.field("places")
            steps = places.flatten().to_numpy(zero_copy_only=False)
            starts = np.unique(np.repeat(firsts, pc.list_value_length(places).to_numpy()) + steps)
            for at in range(0, len(text), BLOCK):
                mine = starts[(starts >= at) & (starts < at + BLOCK)] - at
                if not len(mine):
                    continue
                sums = prefix_sums(_CODES[np.frombuffer(text[at : at + BLOCK + LENGTH], np.uint8)])
                heads = span_hashes(sums, mine, mine + LENGTH).view(np.int64)
                rows = pa.array(np.full(len(mine), i))
                arrays = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(heads), pa.array(mine + at)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "hash", "head", "first"])


def merged(spans):
    """Maximal runs of the union of (start, end) spans."""
    out = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def cut(text, runs):
    """The bytes outside the runs."""
    at, out = 0, []
    for start, end in runs:
        out.append(text[at:start])
        at = end
    return b"".join([*out, text[at:]])


def _corpus_order():
    """By id, null last, then by the text's hash, then by place."""
    return [F.col("id").asc_nulls_last(), F.col("hash"), F.col("first")]


def _elsewhere_first(*group):
    """Whether an equal row of the group stands at an earlier place (repeated rows share a place)."""
    first = F.first(F.struct("id", "hash", "first")).over(Window.partitionBy(*group).orderBy(*_corpus_order()))
    return ~first.eqNullSafe(F.struct("id", "hash", "first"))


def _with_lists(texts, rows, fields, how):
    """``texts`` with the ``rows`` of each text as a list of structs; as long as the text at most."""
    lists = rows.groupBy(F.col("id").alias("of_id"), F.col("hash").alias("of_hash"))
    lists = lists.agg(F.collect_list(F.struct(*fields)).alias("list"))
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash"))
    return texts.join(lists, same, how).select(*texts.columns, "list")


def _repeat_spans(texts):
    """(id, hash, start, end): spans of ``texts`` (id, hash, text) that also start earlier."""
    spark = texts.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parse = texts.filter(F.octet_length("text") >= LENGTH).mapInArrow(
        _parse, ", ".join(f"{c} {kind}" for c, kind in _PARSED.items())
    )

    def differs(c):
        side = F.shiftright("sides", 16 * c).bitwiseAND(65535)
        alike = Window.partitionBy("trigger", side)
        return (side != 0) & (F.min("phrase").over(alike) != F.max("phrase").over(alike))

    marks = parse.repartition(width, "trigger").withColumn("first", F.shiftright("spot", 16)).select(
        "id", "hash", "first",
        F.shiftright("spot", 9).bitwiseAND(127).cast("int").alias("n"),
        F.shiftright("spot", 1).bitwiseAND(255).cast("int").alias("ahead"),
        ((F.col("spot").bitwiseAND(1) == 1) | _elsewhere_first("trigger", "phrase")).alias("repeated"),
        F.array(*[differs(c) for c in range(4)]).alias("differ"),
    )
    # Phrases that occur once, under a trigger of their own, are most of the corpus and end here.
    marks = materialise(marks.filter("repeated or array_contains(differ, true)"), "marks")
    repeated = marks.filter("repeated").select("id", "hash", F.col("first").alias("start"), (F.col("first") + F.col("n") + (LENGTH - 1)).alias("end"))
    dictionary = marks.filter("array_contains(differ, true) and not repeated")

    def quarter(k):
        return 3 - F.least(F.lit(3), F.floor((F.col("ahead") - k) / QUARTER).cast("int"))

    # Of a phrase, the strings that agree with another one as far as these hashes tell.
    places = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.get("differ", quarter(k)))
    dictionary = dictionary.select("id", "hash", "first", F.transform(places, lambda k: k.cast("byte")).alias("places"))
    dictionary = dictionary.filter(F.size("places") > 0)
    chosen = _with_lists(texts, dictionary, ["first", "places"], "inner")
    heads = chosen.mapInArrow(_heads, "id bigint, hash int, head bigint, first bigint")
    heads = heads.withColumn("repeated", _elsewhere_first("head")).filter("repeated")
    return repeated.unionByName(heads.select("id", "hash", F.col("first").alias("start"), (F.col("first") + LENGTH).alias("end")))


def find_repeats(docs: DataFrame, doc_id="doc_id", text="text", carry=None) -> DataFrame:
    """``docs`` packed as ``doc``, with n_bytes, n_removed, n_spans, kept_sha256 and kept.

    ``kept`` is the UTF-8 text (null is empty) without every byte that is covered by a string of
    LENGTH bytes that also starts earlier: in a document of smaller doc_id, or in the same one
    further ahead. Strings are judged on the input and may overlap. Null ids come last; documents of
    equal id come in the order of their texts' hashes, and of rows with equal id and text one is the earlier.
    ``carry`` names the columns to pack, all by default.
    """
    small_batches(docs.sparkSession)
    body = F.coalesce(docs[text], F.lit(""))
    columns = docs.columns if carry is None else carry
    # Both joins with the spans ask for this table by the same keys, so texts are shuffled once.
    texts = docs.select(docs[doc_id].cast("bigint").alias("id"), F.hash(body).alias("hash"), body.alias("text"))
    spans = _repeat_spans(texts)
    only_id = columns == [doc_id]
    if only_id:
        rows = _with_lists(texts, spans, ["start", "end"], "left")
        rows = rows.withColumn("doc", F.struct(F.col("id").cast(docs.schema[doc_id].dataType).alias(doc_id)))
    else:
        packed = docs.select(
            docs[doc_id].cast("bigint").alias("id"), F.hash(body).alias("hash"), body.alias("text"),
            F.struct(*[docs[c] for c in columns]).alias("doc"),
        )
        rows = _with_lists(packed, spans, ["start", "end"], "left")
    kind = T.StructType(
        [
            *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
            T.StructField("kept_sha256", T.StringType()),
            T.StructField("kept", T.BinaryType()),
        ]
    )

    @F.arrow_udf(kind)
    def judged(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts_of(texts), lists, strict=True):
            runs = merged((s["start"], s["end"]) for s in spans.as_py() or ())
            kept = cut(text, runs)
            out.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], kind.names)

    rows = rows.withColumn("judged", judged("text", "list")).select("id", "hash", "doc", "judged.*")
    if only_id:
        rows = rows.drop("kept")
    # Of equal rows one keeps what is left; the others repeat it from their first byte.
    copy = F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.lit(0))) > 1
    gone = copy & (F.col("n_bytes") >= LENGTH)
    rows = rows.withColumn("gone", gone)
    empty = hashlib.sha256().hexdigest()
    changes = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1), "kept_sha256": F.lit(empty), "kept": F.lit(b"")}
    out = [F.when(F.col("gone"), value).otherwise(F.col(c)).alias(c) for c, value in changes.items() if c in rows.columns]
    return rows.select("doc", "n_bytes", *out)
