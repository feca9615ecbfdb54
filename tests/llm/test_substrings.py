import hashlib
import random

import pytest
from pathledger.llm import substrings

LENGTH = substrings.LENGTH


def brute(rows):
    """(n_bytes, n_removed, n_spans, sha) by looking up every string, in corpus order."""
    seen, out = set(), []
    for _, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - LENGTH + 1):
            piece = data[p : p + LENGTH]
            if piece in seen:
                gone[p : p + LENGTH] = [True] * LENGTH
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def judged(docs):
    found = substrings.find_repeats(docs).collect()
    return sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)


def test_odd_rows(spark, documents, odd):
    assert judged(documents(odd)) == brute(odd)


def test_passages_edits_and_periods(spark, documents, prose):
    rng = random.Random(4)
    passages = [prose(50 + i, 30) for i in range(4)]
    rows = [(0, "ha " * 400), (1, "ha " * 90 + prose(99, 8))]
    for i in range(2, 40):
        parts = [prose(200 + i, 10), rng.choice(passages), prose(300 + i, 5), rng.choice(passages)[7:190]]
        rows.append((i, "é\n".join(parts)))
    rows += [(50 + i, text[:300] + "#" + text[301:]) for i, (_, text) in enumerate(rows[5:15])]
    assert judged(documents(rows)) == brute(rows)


def test_texts_longer_than_a_block(spark, documents, prose, monkeypatch):
    """A document that is cut in blocks gives the same phrases' worth of repeats."""
    shared = prose(5, 150)
    rows = [(1, prose(6, 700) + shared + prose(7, 500)), (2, prose(8, 300) + shared), (3, shared + prose(6, 700))]
    monkeypatch.setattr(substrings, "BLOCK", 700)
    texts = [t.encode() for _, t in rows]
    blocks = list(substrings._blocks(texts))
    assert len(blocks) > 6
    starts = sorted((int(o), int(p - f)) for _, ok, owner, off, _ in blocks for p, (o, f, k) in enumerate(zip(owner, off, ok, strict=True)) if k)
    assert starts == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - LENGTH + 1)]


def test_equal_ids_and_kept_text(spark, documents, prose):
    rows = [(1, prose(1)), (1, prose(1)), (1, prose(2)), (2, prose(1) + prose(2))]
    found = substrings.find_repeats(documents(rows)).collect()
    assert {r.doc.fp for r in found} == {"kept"}
    assert sorted(len(r.kept) for r in found)[0] == 0
    assert sum(len(r.kept) for r in found) == pytest.approx(len(prose(1)) + len(prose(2)), abs=2)


def test_empty_table(spark, documents):
    assert substrings.find_repeats(documents([])).collect() == []
