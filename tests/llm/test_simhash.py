import random
import re

import numpy as np
import pytest
import xxhash
from pathledger.llm import simhash
from pathledger.llm.components import components


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    n = max(1, len(words) - 3)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), seed=42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def classes(values, radius):
    """Least index reachable, by comparing all."""
    root = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (a ^ b).bit_count() <= radius and root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


@pytest.mark.parametrize(("radius", "bits"), [(4, 64), (6, 64), (2, 9)])
def test_masks_cover_every_radius(radius, bits):
    masks = simhash.covering_masks(radius, range(bits))
    rng = random.Random(3)
    for _ in range(3000):
        apart = sum(1 << p for p in rng.sample(range(bits), radius))
        assert any(not apart & m for m in masks)


def test_fingerprints_and_components_equal_brute_force(spark, documents, odd, prose):
    rows = list(odd)
    words = prose(1).split()
    for i in range(12):
        edited = list(words)
        edited[5 * i] = "edit"
        rows.append((100 + i, " ".join(edited).upper() if i % 2 else " ".join(edited)))
    found = simhash.near_duplicates(documents(rows)).collect()
    assert len(found) == len(rows)
    values = [fingerprint(t) for _, t in rows]
    roots = classes(values, 4)
    least = {}
    for (i, _), root in zip(rows, roots, strict=True):
        if i is not None:
            least[root] = min(i, least.get(root, i))
    expected = [(i, f"{v:016x}", least.get(r)) for (i, _), v, r in zip(rows, values, roots, strict=True)]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_no_link_is_lost_in_hot_buckets(spark):
    """A cluster far larger than a bucket may hold, with chains and stragglers."""
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    values = {centre}
    for _ in range(180):
        values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 9))))
    values |= {rng.getrandbits(64) for _ in range(30)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    folder = simhash.materialise(spark.createDataFrame([(v,) for v in signed], "fp bigint"))
    found = {r.fp % (1 << 64): r.class_id for r in simhash.classes(folder, 4, bucket_rows=16).collect()}
    roots = classes(values, 4)
    same = {(found[a] == found[b]) == (roots[i] == roots[j]) for i, a in enumerate(values) for j, b in enumerate(values)}
    assert same == {True} and len(found) == len(values)


def test_one_of_each_group_stays(spark, documents, odd, prose):
    near = " ".join(["edit", *prose(1, 400).split()[1:]])
    rows = [*odd, (20, prose(1, 400)), (21, near), (22, prose(3, 400))]
    docs = documents(rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    found = sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr)
    expected = [(1, prose(1)), (3, None), (6, "one"), (7, odd[9][1]), (8, odd[10][1]), (20, prose(1, 400)), (22, prose(3, 400))]
    assert found == sorted(expected, key=repr)


def test_empty_table(spark, documents):
    assert simhash.near_duplicates(documents([])).collect() == []
    assert simhash.drop_near_duplicates(documents([])).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7), (None, 4)], "a bigint, b bigint")
    found = {r.node: r.root for r in components(links).collect()}
    assert found == {**{i: 1 for i in range(2, 61)}, 101: 100}


def test_linked_compares_within_buckets_only():
    bucket = np.array([0, 0, 0, 1, 1])
    values = np.array([0, 1, 255, 0, 1], np.uint64)
    assert simhash.linked(bucket, values, 4).tolist() == [0, 0, 2, 3, 3]


def test_groups_that_stay_are_those_of_the_operator(spark, documents, odd, prose):
    """Edits of one text at all distances: one document of each component stays."""
    rng = random.Random(5)
    words = prose(77, 900).split()
    rows = list(odd)
    for i in range(60):
        edited = list(words)
        for p in rng.sample(range(900), rng.choice((1, 2, 4, 30, 90))):
            edited[p] = f"w{i}x"
        rows.append((200 + i, " ".join(edited)))
    docs = documents(rows)
    wanted = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    kept = [r.doc_id for r in simhash.drop_near_duplicates(docs, bucket_rows=16).collect()]
    assert sorted(kept) == sorted(wanted) and 15 < len(kept) < 55


def test_too_small_buckets_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.classes(spark.createDataFrame([(1,)], "fp bigint"), 4, bucket_rows=8)
