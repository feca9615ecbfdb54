"""Personal data: fixed kinds by pattern, and terms that reveal them by corpus co-occurrence."""

import re
from bisect import bisect_right
from collections import Counter, deque
from itertools import accumulate, combinations, groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from pathledger.llm.text import located_words, small_batches, texts_of, word_hashes
from pathledger.session import materialise

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", TERM: "[TERM]"}

# Words on either side of a mention that make its context.
WINDOW = 6
# A term reveals an entity if it occurs in this many different contexts of it ...
SUPPORT = 3
# ... which share less than this part of the words of the larger one ...
NEAR = 0.4
# ... looked for in as many parts of a pair's contexts at a time, first among as many of a part ...
PARTS = 64
FIRST = 16
# ... which lets a context go for as many of the last LAST passed on: see _passed_on. What all parts
# pass on is looked through in blocks of about BLOCK contexts, by three blocks that differ: see _in_cells ...
STANDING = 4 * WINDOW + 1
LAST = 256
BLOCK = 512
# ... and its pointwise mutual information with the entity is this share of what the entity
# itself would tell, log(contexts of all / contexts of the entity).
DISCLOSURE = 0.8
# The set of hashes that tells which words are looked up; its size does not depend on the data.
FILTER_BITS = 1 << 20
# Stands for the sum over all words.
ALL_WORDS = 0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins, so none is tried twice.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_DIGIT_BYTE = re.compile(b"[0-9]")
# The words of text.located_words.
_WORD = re.compile("[A-Za-z0-9\x80-\U0010ffff]+")


def _emails(text):
    end, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                yield start, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits):
    total = 0
    for i, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text):
    return "".join(c for c in text if "0" <= c <= "9")


def _is_ip(match):
    # A number of more than three digits may be at most 255 by leading zeros.
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match.split("."))


def _is_card(match):
    digits = _digits(match)
    return 13 <= len(digits) <= 19 and _luhn(digits)


def _is_phone(match):
    return 9 <= len(_digits(match)) <= 15


def base_spans(text):
    """(kind, start, end) of all fixed kinds, kind by kind; code points, end exclusive."""
    found = [("email", *span) for span in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, pattern, valid in (("ip", _IP, _is_ip), ("card", _CARD, _is_card), ("phone", _PHONE, _is_phone)):
            found += [(kind, *m.span()) for m in pattern.finditer(text) if valid(m[0])]
    return found


def _joined(spans):
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _entity(kind, value):
    """An entity is a kind and its value without separators and case."""
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else _digits(value)}"


def _hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 3)
    return h - (1 << 64) if h >= 1 << 63 else h


def _terms(words):
    """(place, hash) of those (place, word) that may tell something: three bytes or more, no digits."""
    chosen = [(at, w) for at, w in words if len(w) > 2 and not _DIGIT_BYTE.search(w)]
    return list(zip((at for at, _ in chosen), word_hashes([w for _, w in chosen])[0].view(np.int64).tolist(), strict=True))


def _words_before(text, at):
    """(place, word) of the last WINDOW words that end at ``at`` or before it, however long they are."""
    reach = 16 * WINDOW
    while True:
        first = max(0, at - reach)
        found = [*_WORD.finditer(text, first, at)]
        # The first one may have begun earlier, so it only counts at the beginning of the text.
        if first == 0 or len(found) > WINDOW:
            return found[-WINDOW:]
        reach *= 2


def contexts(text, spans):
    """The contexts of the mentions, and how often each term stands near mentions.

    A context holds the hashes of the entity and then of the terms around it, in order. Terms are
    the words around a mention, not those of this or another mention or with digits. A word near
    several mentions counts once, however many entities they name, and words near one mention
    count once for it.
    """
    out, places, mentions = [], {}, Counter()
    starts = sorted(start for _, start, _ in spans)
    ends = [*accumulate((end for _, _, end in sorted(spans, key=lambda x: x[1])), max)]

    def mentioned(at):
        i = bisect_right(starts, at)
        return i > 0 and at < ends[i - 1]

    for kind, start, end in spans:
        found = [*_words_before(text, start), *islice(_WORD.finditer(text, end), WINDOW)]
        near = [(m.start(), m[0].encode()) for m in found]
        hashed = _terms([x for x in near if not mentioned(x[0])])
        terms = sorted({t for _, t in hashed})
        out.append([_hash(_entity(kind, text[start:end])), *terms])
        mentions.update(terms)
        for at, t in hashed:
            places.setdefault(t, set()).add(at)
    return out, [[t, min(n, len(places[t]))] for t, n in mentions.items()]


_BASE = T.StructType(
    [
        *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
        T.StructField("base", T.StringType()),
        T.StructField("contexts", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("beside", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def _based(packed):
    @F.arrow_udf(_BASE)
    def based(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            spans = base_spans(t)
            counts = [sum(s[0] == k for s in spans) for k in KINDS]
            rows.append((*counts, _joined(spans), *contexts(t, spans)))
        columns = list(zip(*rows, strict=True)) or [()] * len(_BASE)
        kinds = [pa.int64()] * len(KINDS) + [pa.string(), *[pa.list_(pa.list_(pa.int64()))] * 2]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.StructArray.from_arrays(arrays, _BASE.names)

    return packed.withColumn("found", based("body"))


def _differ(a, b):
    return a != b and len(a & b) < NEAR * max(len(a), len(b))


def _grouped(batches, n):
    """The rows of sorted batches by their first ``n`` columns: the key, and the words other than the term."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(n + 1)), strict=True)

    for key, group in groupby(rows(), lambda row: row[:n]):
        yield key, (frozenset(row[n]) - {key[1]} for row in group)


def _stood_for(words, last):
    """Whether STANDING of the contexts ``last`` stand for this one, wherever it may count.

    They have as many words, and share none with each other but the words of this one. Two contexts that differ
    from this one have at most 4 * WINDOW words, so one that stands for it shares with them no word but what it
    shares with this one, and differs from both as well.
    """
    taken, standing = set(), 0
    for other in last:
        if len(other) >= len(words):
            more = other - words
            if taken.isdisjoint(more):
                taken |= more
                standing += 1
                if standing == STANDING:
                    return True
    return False


def _passed_on(batches):
    """Of the contexts of each (entity, term, part) SUPPORT mutually different ones, or all but those stood for.

    SUPPORT different ones are looked for among the first FIRST, and one that differs from all of these: a
    second one makes up SUPPORT with it and any other. A context that STANDING ones passed on stand for can be
    replaced by one of them in any set of SUPPORT different contexts, of this part or others, so letting it go
    changes no answer. Any other context is passed on, however many there are: FIRST and LAST bound how long an
    early answer or those that stand for a context are looked for, and none goes for want of room.
    """

    def batch(key, found):
        rows = [[*x, key[1]] for x in found]
        arrays = [pa.array([k] * len(rows), pa.int64()) for k in key[:2]]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(rows, pa.list_(pa.int64()))], ["entity", "term", "words"])

    for key, contexts in _grouped(batches, 3):
        first, others, last, passed = [], [], deque(maxlen=LAST), []
        for words in contexts:
            apart = [i for i, x in enumerate(first) if _differ(x, words)]
            found = _among(apart, others)
            if found:
                passed = [*(first[i] for i in found), words]
                break
            if len(first) < FIRST or len(apart) == len(first):
                for i in apart:
                    others[i].add(len(first))
                first.append(words)
                others.append(set(apart))
            if not _stood_for(words, last):
                last.append(words)
                passed.append(words)
                if len(passed) == BLOCK:
                    yield batch(key, passed)
                    passed = []
        yield batch(key, passed)


def _among(apart, others):
    """SUPPORT - 1 of the numbers ``apart`` that differ from each other, if there are any."""
    chosen = combinations(apart, SUPPORT - 1)
    return next((c for c in chosen if all(b in others[a] for a, b in combinations(c, 2))), None)


def _differences(contexts):
    """The contexts by the contexts: which of them differ."""
    sizes = np.array([len(x) for x in contexts])
    _, places, counts = np.unique(
        np.concatenate([np.fromiter(x, np.int64, len(x)) for x in contexts]), return_inverse=True, return_counts=True
    )
    # A word of one context is shared with none.
    column = np.cumsum(counts > 1) - 1
    shown = counts[places] > 1
    held = np.zeros((len(contexts), int((counts > 1).sum())), np.float32)
    held[np.repeat(np.arange(len(contexts)), sizes)[shown], column[places[shown]]] = 1
    larger = np.maximum.outer(sizes, sizes)
    return (held @ held.T < NEAR * larger) & ~np.eye(len(contexts), dtype=bool)


def _has_support(contexts):
    """Whether SUPPORT of the contexts differ from each other: all of them are looked at."""
    differ = _differences(contexts)
    # Those that differ from too few others, alone or two together, are in no such set, nor count for the rest.
    while len(differ):
        links = differ.astype(np.float32)
        left = differ & (links @ links >= SUPPORT - 2)
        some = left.sum(1) >= SUPPORT - 1
        if some.all() and (left == differ).all():
            break
        differ = left[some][:, some]
    others = [set(np.flatnonzero(row).tolist()) for row in differ]
    return any(_among([j for j in x if j > i], others) for i, x in enumerate(others))


def _with_support(batches):
    """(entity, term) of the groups of contexts that have SUPPORT different ones."""
    for key, contexts in _grouped(batches, 3):
        if _has_support([*contexts]):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()) for k in key[:2]], ["entity", "term"])


def _linked(batches):
    """(entity, term, a, b) of the two blocks, or one, in which a context of ``a`` differs from one of ``b``."""
    for key, sides in groupby(_grouped(batches, 5), lambda group: group[0][:4]):
        first, *second = ([*contexts] for _, contexts in sides)
        found = _differences(first + second[0])[: len(first), len(first) :] if second else _differences(first)
        if found.any():
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [pa.array([k], kind) for k, kind in zip(key, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["entity", "term", "a", "b"])


def _in_blocks(contexts):
    """The contexts with a ``core`` and a ``block`` of about BLOCK contexts; no two of a core differ.

    The core of a context is as many of the pair's most frequent words as make two contexts near that share
    them: of the same core, they have as many words at most as that allows. Cores of fewer than BLOCK contexts
    have blocks in common, and these an empty core.
    """
    pair = ["entity", "term"]
    each = contexts.select(*pair, "words", F.explode("words").alias("word"))
    # A core of BLOCK contexts has words that are in as many, at most 2 * WINDOW for each BLOCK contexts.
    often = each.filter(F.col("word") != F.col("term")).groupBy(*pair, "word").agg(F.count(F.lit(1)).alias("n"))
    each = each.join(F.broadcast(often.filter(F.col("n") >= BLOCK)), [*pair, "word"], "left")
    frequent = F.when(F.col("n").isNotNull(), F.struct((-F.col("n")).alias("rank"), "word"))
    each = each.groupBy(*pair, "words").agg(F.sort_array(F.collect_list(frequent))["word"].alias("frequent"))
    least = F.ceil(F.lit(NEAR) * (F.size("words") - 1)).cast("int")
    core = F.when(F.size("frequent") >= least, F.sort_array(F.slice("frequent", 1, least)))
    cored = each.select(*pair, "words", F.coalesce(core, F.array().cast("array<bigint>")).alias("core"))
    # At most one row for each BLOCK contexts, and one for each pair.
    count = F.count(F.lit(1))
    large = cored.groupBy(*pair, "core").agg(count.alias("n")).filter((F.size("core") > 0) & (F.col("n") >= BLOCK))
    cored = cored.join(F.broadcast(large), [*pair, "core"], "left")
    cored = cored.withColumn("core", F.when(F.col("n").isNotNull(), F.col("core")).otherwise(F.array())).drop("n")
    blocks = cored.groupBy(*pair, "core").agg(F.ceil(count / BLOCK).cast("int").alias("blocks"))
    dealt = cored.join(F.broadcast(blocks), [*pair, "core"])
    number = F.pmod(F.hash("words"), F.col("blocks"))
    block = F.concat_ws(":", F.concat_ws(",", F.col("core").cast("array<string>")), number.cast("string"))
    return dealt.select(*pair, "words", "core", block.alias("block"))


def _in_cells(passed):
    """The contexts with a ``cell``: any SUPPORT contexts of an (entity, term) that differ meet in one.

    A pair of few contexts is one cell. Those of more are dealt to blocks. Blocks are linked if contexts of one
    differ from some of the other, and a cell holds three blocks that are linked with each other, or fewer if a
    block is linked with itself. All two blocks are compared but those of one core, which hold no different ones.
    """
    pair = ["entity", "term"]
    few = F.count(F.lit(1)) <= SUPPORT * BLOCK
    # At most one row for each SUPPORT * BLOCK contexts.
    large = materialise(passed.groupBy(*pair).agg(few.alias("few")).filter(~F.col("few")).select(*pair), "large")
    small = passed.join(F.broadcast(large), pair, "left_anti").withColumn("cell", F.lit(""))
    if large.isEmpty():
        return small
    dealt = materialise(_in_blocks(passed.join(F.broadcast(large), pair)), "blocks")
    blocks = dealt.select(*pair, "core", "block").distinct()
    two = blocks.toDF(*pair, "core", "a").join(blocks.toDF(*pair, "other", "b"), pair)
    two = two.filter((F.col("a") <= F.col("b")) & ((F.size("core") == 0) | (F.col("core") != F.col("other"))))
    two = two.select(*pair, "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    keys = [*pair, "a", "b", "block"]
    rows = dealt.join(two, [*pair, "block"]).repartition(*keys[:4]).sortWithinPartitions(*keys).select(*keys, "words")
    linked = materialise(rows.mapInArrow(_linked, "entity bigint, term bigint, a string, b string"), "linked")
    three = linked.join(linked.toDF(*pair, "b", "c"), [*pair, "b"]).join(linked.toDF(*pair, "a", "c"), [*pair, "a", "c"])
    cells = three.select(*pair, F.array_distinct(F.array("a", "b", "c")).alias("cell")).distinct()
    cells = cells.select(*pair, F.explode("cell").alias("block"), F.concat_ws(" ", "cell").alias("cell"))
    return small.unionByName(dealt.join(cells, [*pair, "block"]).select(*pair, "words", "cell"))


def _supported(flat):
    """(entity, term) that go together in SUPPORT different contexts.

    Contexts are dealt to parts, so that a frequent pair is not one task; a part lets go only contexts that
    others stand for, and what the parts pass on is looked through in cells of bounded size. The answer is that
    of a search through all contexts, so a pair that has support keeps it whatever rows are added.
    """
    keys = ["entity", "term", "part"]
    dealt = flat.withColumn("part", F.pmod(F.xxhash64("words"), F.lit(PARTS)))
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "words")
    passed = materialise(dealt.mapInArrow(_passed_on, "entity bigint, term bigint, words array<bigint>"), "passed")
    keys = ["entity", "term", "cell"]
    cells = _in_cells(passed).repartition(*keys).sortWithinPartitions(*keys).select(*keys, "words")
    return cells.mapInArrow(_with_support, "entity bigint, term bigint").distinct()


def revealing_terms(found: DataFrame, packed: DataFrame) -> tuple:
    """Terms that reveal an entity, as a table of term hashes, and the filter of their hashes.

    Statistics are over all documents. ``found`` holds the contexts of all mentions. Term t
    reveals entity e if it goes with e in SUPPORT different contexts and its information on e is
    DISCLOSURE of all there is: log((n(t, e) / n(e)) / expected(t)) >= DISCLOSURE * log(N / n(e)),
    with n(e) mentions of e, n(t, e) of them near t, N mentions in all, and expected(t) the
    chance of t among as many words of the corpus or near a mention of anything, the larger one;
    there an occurrence of t near several mentions counts once, so a name by someone's address and
    telephone tells as much as by one of them.
    Contexts differ if they share less than NEAR of their words other than the term. A group of
    copies, exact or edited, is one context by that, however large it is: it adds no
    evidence and takes none of the others away. A frequent word is expected and tells little.
    """
    flat = found.select(F.explode("contexts").alias("c"))
    flat = flat.select(F.col("c")[0].alias("entity"), F.expr("slice(c, 2, size(c))").alias("words"))
    counts = materialise(flat.groupBy("entity", "words").agg(F.count(F.lit(1)).alias("n")), "contexts")
    flat = counts.select("entity", F.explode("words").alias("term"), "words", "n")
    pairs = flat.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("least"))
    near = found.select(F.explode("beside").alias("b")).select(F.col("b")[0].alias("term"), F.col("b")[1].alias("n"))
    beside = near.groupBy("term").agg(F.sum("n").alias("n_t"))
    pairs = pairs.filter(F.col("least") >= SUPPORT).select("entity", "term", "n_te")
    flat = flat.select("entity", "term", "words").join(pairs.select("entity", "term"), ["entity", "term"])
    pairs = pairs.join(_supported(flat), ["entity", "term"])
    total = counts.groupBy("entity").agg(F.sum("n").alias("n_e"))
    everything = counts.agg(F.sum("n")).first()[0] or 0
    pairs = materialise(pairs.join(total, "entity").join(beside, "term"), "pairs")
    wanted = pairs.select("term").distinct()
    mask = _filter(wanted)
    often = _counts(packed, mask)
    often = materialise(often.groupBy("term").agg(F.sum("n").alias("n")), "often")
    words = often.filter(F.col("term") == ALL_WORDS).agg(F.sum("n")).first()[0] or 1
    joined = pairs.join(often, "term")
    everywhere = F.lit(2.0 * WINDOW) * F.col("n") / F.lit(float(words))
    by_mentions = F.col("n_t") / F.lit(float(max(everything, 1)))
    expected = F.least(F.lit(1.0), F.greatest(everywhere, by_mentions))
    information = F.log(F.col("n_te") / F.col("n_e") / expected)
    whole = F.log(F.lit(float(max(everything, 1))) / F.col("n_e"))
    reveals = (information > 0) & (information >= DISCLOSURE * whole)
    terms = materialise(joined.filter(reveals).select("term").distinct(), "terms")
    return terms, _filter(terms)


def _filter(terms):
    """A bit per hash of ``terms``: FILTER_BITS bits, whatever the number of terms."""
    bits = terms.select(F.pmod("term", F.lit(FILTER_BITS)).cast("int").alias("bit")).distinct().toPandas()
    mask = np.zeros(FILTER_BITS, bool)
    mask[bits["bit"].to_numpy(int)] = True
    return np.packbits(mask)


def _key():
    """Spans depend on the text alone, so texts stand for their documents."""
    return F.xxhash64("body").alias("a"), F.md5("body").alias("b")


def _passing(texts, passes):
    """Of all words of the texts those that pass the filter, as located_words gives them, and how many there are."""
    for hashes, *where in located_words(texts):
        hit = np.flatnonzero(passes[(hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)])
        yield len(hashes), hashes[hit].view(np.int64), *[x[hit] for x in where]


def _counts(packed, mask):
    """(term, n) per batch of texts: how often each word that passes occurs, and ALL_WORDS."""

    def count(batches):
        passes = np.unpackbits(mask).astype(bool)
        for batch in batches:
            words, found = 0, [np.zeros(0, np.int64)]
            for n, terms, *_ in _passing(texts_of(batch.column(0)), passes):
                words += n
                found.append(terms)
            terms, counts = np.unique(np.concatenate(found), return_counts=True)
            columns = [pa.array(np.append(terms, ALL_WORDS)), pa.array(np.append(counts, words))]
            yield pa.RecordBatch.from_arrays(columns, ["term", "n"])

    return packed.select("body").mapInArrow(count, "term bigint, n bigint")


def _places(packed, mask):
    """(a, b, term, start, end) of the words that pass: a, b stand for the text, offsets in code points."""

    def place(batches):
        passes = np.unpackbits(mask).astype(bool)
        for batch in batches:
            texts = texts_of(batch.column(2))
            for _, terms, owner, starts, ends in _passing(texts, passes):
                spans = []
                for i, start, end in zip(owner.tolist(), starts.tolist(), ends.tolist(), strict=True):
                    at = len(texts[i][:start].decode())
                    spans.append((at, at + len(texts[i][start:end].decode())))
                rows = pa.array(owner)
                columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(terms)]
                columns += [pa.array([s[k] for s in spans], pa.int64()) for k in range(2)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "term", "start", "end"])

    rows = packed.select(*_key(), "body")
    return rows.mapInArrow(place, "a bigint, b string, term bigint, start bigint, end bigint")


def find_personal_data(docs: DataFrame, text="text", carry=None) -> DataFrame:
    """``docs`` packed as ``doc``, with n_email, n_ip, n_card, n_phone, base and spans.

    ``base`` lists kind:start:end of the fixed kinds (email, ip, card, phone, then start), ``spans``
    these and then the terms that reveal such an entity anywhere in the corpus. Offsets are
    code points, end exclusive. Null and empty texts have no spans. Whole texts count, however long
    they or their words are. Spans that begin together are in order of their ends. Repeated rows come out as often
    as they came in. ``carry`` names the columns to pack, all by default.
    """
    small_batches(docs.sparkSession)
    columns = docs.columns if carry is None else carry
    body = F.coalesce(docs[text], F.lit(""))
    packed = docs.select(F.struct(*[docs[c] for c in columns]).alias("doc"), body.alias("body"))
    based = _based(packed)
    # Few texts have any; they are looked at several times.
    found = materialise(based.filter(F.length("found.base") > 0).select("found.contexts", "found.beside"), "mentions")
    terms, mask = revealing_terms(found, packed)
    places = _places(packed, mask).join(terms, "term", "left_semi").distinct()
    # As many as a text has words at most.
    listed = places.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("terms"))
    # Stored, so that its size is known: few rows are broadcast, many are not.
    listed = materialise(listed, "terms")
    joined = based.select("doc", "found", *_key()).join(listed, ["a", "b"], "left")
    shown = F.transform("terms", lambda t: F.concat_ws(":", F.lit(TERM), t.start, t.end))
    parts = F.concat(F.array("found.base"), F.coalesce(shown, F.array().cast("array<string>")))
    spans = F.array_join(F.filter(parts, lambda x: x != ""), ",")
    return joined.select("doc", *[f"found.n_{k}" for k in KINDS], "found.base", spans.alias("spans"))


def sanitise(text, spans):
    """The text with each span replaced by its placeholder; of overlapping spans the first, longest."""
    rows = [x.split(":") for x in spans.split(",")] if spans else []
    out, at = [], 0
    for start, _, end, kind in sorted((int(s), -int(e), int(e), kind) for kind, s, e in rows):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join([*out, text[at:]])


def remove_personal_data(docs: DataFrame, text="text", n_chars="n_chars") -> DataFrame:
    """``docs`` with personal data replaced by placeholders; texts without any stay as they are.

    ``n_chars``, where there is such a column, follows the text. A null text stays null.
    """

    @F.arrow_udf(T.StringType())
    def clean(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([t if not s else sanitise(t, s) for t, s in rows], pa.string())

    found = find_personal_data(docs, text)
    cleaned = clean(F.col(f"doc.{text}"), F.col("spans"))
    out = found.withColumn("clean", F.when(F.length("spans") > 0, cleaned).otherwise(F.col(f"doc.{text}")))
    columns = []
    for c in docs.columns:
        kept = F.col(f"doc.`{c}`")
        if c == text:
            kept = F.col("clean")
        elif c == n_chars:
            kept = F.when(F.length("spans") > 0, F.length("clean").cast(docs.schema[c].dataType)).otherwise(kept)
        columns.append(kept.alias(c))
    return out.select(*columns)
