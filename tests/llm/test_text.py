"""Words of long texts: blocks change nothing."""

import random

import numpy as np
import pytest
from pathledger.llm import quality_rules, text


@pytest.mark.parametrize("limit", [1, 2, 7, 64])
def test_blocks_cut_no_word(limit):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab\t\n \x0b\rÄ,", [9, 9, 1, 1, 1, 1, 1, 2, 1], k=rng.choice([0, 1, 50, 400]))).encode() for _ in range(30)]
    for breaks in (text.BREAK, text.SPACE):

        def found(limit, breaks=breaks):
            parts = [np.array(p, dtype=object) for p in text.located_words(texts, breaks, limit=limit)]
            return [list(map(int, c)) for c in np.concatenate(parts, axis=1)]

        assert found(limit) == found(1 << 20)


@pytest.mark.parametrize(("one", "n"), [(b"ab\t", 700_000), (b"abc", 1_000_000), (b"ab\x0bc ", 400_000)])
def test_long_texts_have_the_words_of_their_pattern(one, n):
    hashes, counts = text.word_hashes([b"x", one * n, b""], text.SPACE)
    assert counts.tolist() == [1, len((one * n).split()), 0] and len(hashes) == counts.sum()
    # Equal words have equal hashes, wherever the blocks end.
    assert len(set(hashes[1:].tolist())) == len(set((one * n).split()))


def test_quality_counts_of_a_long_text(spark, documents):
    docs = documents([(1, "ab\t" * 700_000), (2, "a" * 3_000_000), (3, "")])
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    rated = quality_rules.rate(docs, quality_rules.train(docs, labels))
    assert sorted(r.n_words for r in rated.select("n_words").collect()) == [0, 1, 700_000]
