"""Words and hashed n-grams of whole texts, vectorised over Arrow batches."""

import numpy as np
import pyarrow as pa

# A word is a run of characters other than space and the controls 9 to 13.
WORD = "[^\\x20\\x09-\\x0D]+"
# Python's bytes.split() splits at exactly these characters.

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {}


def small_batches(spark, rows=256):
    """Few rows per Arrow batch, since one row may be a long text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def texts_of(array: pa.Array):
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in array.cast(pa.binary()).to_pylist()]


def chunks(texts, limit=CHUNK_BYTES):
    """Consecutive slices of the list that hold about ``limit`` bytes, one text at least."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield first, i
            first, held = i, 0
        held += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def mixed(h):
    """Spread every bit of 64-bit hashes over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n):
    """Powers of the base of the rolling hash and of its inverse, ``n`` at least."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"], _powers["down"]


def byte_codes(seed):
    """A random 64-bit code for each byte value."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def prefix_sums(codes):
    """The sums from which ``span_hashes`` takes the hash of any span."""
    up, _ = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return sums


def span_hashes(sums, starts, ends):
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts])


_CODES = byte_codes(1)
_CODES_FOLDED = _CODES.copy()
_CODES_FOLDED[65:91] = _CODES[97:123]

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
# For features, ASCII punctuation separates words as well.
BREAK = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])


def _spans(buf, breaks):
    """Starts and ends of the words in an array of bytes."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~breaks[buf]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def _hashed_block(block, breaks, codes):
    buf = np.frombuffer(block, np.uint8)
    starts, ends = _spans(buf, breaks)
    return starts, ends, span_hashes(prefix_sums(codes[buf]), starts, ends)


def _hashed_text(text, breaks, codes, limit):
    """``_hashed_block`` of a long text in slices; a word that goes on in the next slice is carried over."""
    begun, total, length = None, np.zeros(1, np.uint64), 0
    for at in range(0, len(text), limit):
        buf = np.frombuffer(text, np.uint8, min(limit, len(text) - at), at)
        starts, ends = _spans(buf, breaks)
        sums = prefix_sums(codes[buf])
        # Sums of the words as if each began at zero; what was carried stands before the first one.
        found = (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]
        starts, ends = starts + at, ends + at
        if begun is not None:
            if len(starts) and starts[0] == at:
                shift = np.array([pow(int(_BASE), length, 1 << 64)], np.uint64)
                found[:1] = total + found[:1] * shift
                starts[0] = begun
            else:
                starts, ends = np.append(begun, starts), np.append(at, ends)
                found = np.append(total, found)
        begun = None
        if len(ends) and ends[-1] == at + len(buf) < len(text):
            begun, total, length = int(starts[-1]), found[-1:], int(ends[-1] - starts[-1])
            starts, ends, found = starts[:-1], ends[:-1], found[:-1]
        yield starts, ends, mixed(found)


def located_words(texts, breaks=BREAK, fold=True, limit=CHUNK_BYTES):
    """Hashes of all words with the text's number and the span in its bytes, in parts of bounded size.

    A word is what stands between two separators, however long; ``limit``, the bytes looked at together,
    changes no result.
    """
    codes = _CODES_FOLDED if fold else _CODES
    for first, last in chunks(texts, limit):
        part = texts[first:last]
        if last - first == 1 and len(part[0]) > limit:
            for starts, ends, hashes in _hashed_text(part[0], breaks, codes, limit):
                yield hashes, np.full(len(starts), first), starts, ends
            continue
        starts, ends, hashes = _hashed_block(b" ".join(part), breaks, codes)
        begins = np.cumsum([0] + [len(x) + 1 for x in part[:-1]])
        owner = np.searchsorted(begins, starts, side="right") - 1
        yield hashes, owner + first, starts - begins[owner], ends - begins[owner]


def word_hashes(texts, breaks=BREAK, fold=True):
    """Hashes of all words of the texts in order, and the number of words of each text."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for found, owner, _, _ in located_words(texts, breaks, fold):
        hashes.append(found)
        counts += np.bincount(owner, minlength=len(texts))
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def grams(hashes, counts, gaps):
    """Hashes of the word tuples (i, i + gap, ...) that stay in one text, and each one's text.

    ``gaps`` lists the offsets of a tuple after its first word: () words, (1,) pairs, (2,) pairs
    with one word left out.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    reach = gaps[-1] if gaps else 0
    n = len(hashes) - reach
    if n <= 0:
        return hashes[:0], owner[:0]
    found = hashes[:n].copy()
    for gap in gaps:
        found = mixed(found * np.uint64(0x9FB21C651E98DF25 + 2 * gap) + hashes[gap : gap + n])
    same = owner[:n] == owner[reach : reach + n]
    return found[same], owner[:n][same]
