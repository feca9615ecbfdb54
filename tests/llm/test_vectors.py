"""Whitening, top-k search and clustering against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest
from pathledger.llm import centroids, queries, topk, whitening
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<float>, label int"


@pytest.fixture(scope="module")
def embeddings(spark):
    """A maker of embeddings from (vec_id, vector) pairs, with columns that clash with internal names."""

    def make(rows, clash=True):
        df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
        if clash:
            for name in ("doc", "x", "n", "cluster", "score", "rank", "shard", "distance", "component", "query_id"):
                df = df.withColumn(name, F.lit("kept"))
        return df

    return make


def odd_rows(width, seed, n=150, copies=40):
    """Clustered vectors, many copies of one, repeated rows, and rows that cannot take part."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)]) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(copies)]
    rows += [rows[5], rows[0], rows[100]]
    bad = [None, math.nan, math.inf, -math.inf]
    rows += [(2000 + i, [b, *[0.5] * (width - 1)]) for i, b in enumerate(bad)]
    return [*rows, (2100, None), (2200, []), (2300, [0.25] * (width + 1)), (None, rows[9][1]), (None, None)]


def kept(rows, width, factor):
    """(id, integer vector) of the rows that take part, floats as Spark stores them."""
    out = []
    for i, v in rows:
        if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v):
            out.append((i, tuple(math.floor(factor * float(np.float32(c))) for c in v)))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
@pytest.mark.parametrize("kind", ["plain", "identity", "pairs", "rank one", "zero"])
def test_leading_components_are_those_of_the_matrix(n, kind):
    a = np.random.default_rng(n).standard_normal((n, n))
    matrix = {
        "plain": a @ a.T, "identity": np.eye(n), "pairs": np.diag(np.repeat(np.arange(n) + 1.0, 2)[:n]),
        "rank one": a[:, :1] @ a[:, :1].T, "zero": np.zeros((n, n)),
    }[kind]
    values, vectors = whitening.leading_components(matrix, 4)
    expected = np.linalg.eigvalsh(matrix)[::-1][:4]
    scale = max(1.0, np.abs(matrix).max())
    assert np.allclose(values, expected, atol=1e-12 * scale * n, rtol=0)
    assert np.allclose(matrix @ vectors.T, vectors.T * values, atol=1e-12 * scale * n, rtol=0)
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12, rtol=0)


def test_whitening_equals_a_plain_computation(embeddings):
    rows = odd_rows(6, 1)
    docs = embeddings(rows)
    found = whitening.whiten(docs).collect()
    alive = kept(rows, 6, 256)
    distinct = sorted({x for _, x in alive})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array(distinct, float) - np.array(sums) / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:4], vectors.T[::-1][:4]
    assert len(found) == 4 * len(alive) and found[0].doc.doc == "kept"
    signs = {}
    got = sorted((r.doc.vec_id is None, r.doc.vec_id, r.component, int(r.deviation), r.n) for r in found)
    expected = [(i is None, i, c, sum((n * e - s) ** 2 for e, s in zip(x, sums, strict=True)), n) for i, x in alive for c in range(1, 5)]
    assert got == sorted(expected)
    by_id = {i: x for i, x in alive}
    for r in found:
        c = r.component - 1
        plain = vectors[c] @ (np.array(by_id[r.doc.vec_id], float) - np.array(sums) / n) / math.sqrt(values[c])
        sign = signs.setdefault(c, math.copysign(1, plain * r.whitened))
        assert r.whitened == pytest.approx(sign * plain, rel=1e-9, abs=1e-9)
        assert r.explained == pytest.approx(values[c] / np.trace(covariance), rel=1e-9)
        assert 0 <= r.identity_error < 1e-9


def test_whitening_of_little_and_of_large(embeddings):
    assert whitening.whiten(embeddings([])).collect() == []
    assert whitening.whiten(embeddings([(1, None), (2, [])])).collect() == []
    # A single vector has no spread, two have one component.
    assert whitening.whiten(embeddings([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    two = whitening.whiten(embeddings([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert sorted((r.doc.vec_id, r.component, abs(r.whitened)) for r in two) == [(1, 1, 1.0), (2, 1, 1.0), (2, 1, 1.0)]
    huge = [(i, [float(i) * 1e15, 1e30 * i, 1.0]) for i in range(4)]
    found = whitening.whiten(embeddings(huge)).collect()
    # Multiples beyond a long are the nearest long, and deviations of over 38 digits are null.
    alive = [tuple(min(math.floor(256 * float(np.float32(c))), 2**63 - 1) for c in v) for _, v in huge]
    sums = [sum(c) for c in zip(*alive, strict=True)]
    exact = [sum((4 * e - s) ** 2 for e, s in zip(x, sums, strict=True)) for x in alive]
    assert {r.doc.vec_id: r.deviation for r in found} == {i: (e if e < 10**38 else None) for i, e in enumerate(exact)}


def brute_search(rows, width, k, wanted):
    alive = kept(rows, width, 1024)
    out = []
    for i, q in sorted({(i, x) for i, x in alive if i is not None and wanted(i)}):
        scored = [(-sum(a * b for a, b in zip(q, x, strict=True)), j is None, j) for j, x in alive if j != i]
        for rank, (score, _, j) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1):
            out.append((i, rank, j, -score))
    return out


@pytest.mark.parametrize("leaf", [1, 4, 256])
def test_search_equals_all_products(embeddings, leaf):
    rows = odd_rows(5, 2)
    docs = embeddings(rows)
    found = topk.nearest(docs, docs.filter("vec_id % 10 = 0"), k=7, leaf_rows=leaf)
    expected = brute_search(rows, 5, 7, lambda i: i % 10 == 0)
    # A null id among equal scores comes last.
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_search_among_other_lengths_and_huge_entries(embeddings):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [5.0]), (3, [1e30, -1e30]), (4, [1e30, 1e30]), (5, [2.0]), (100, [1.0])]
    docs = embeddings(rows)
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.nearest(docs, docs.filter("vec_id % 100 = 0")).collect()}
    most = 2**63 - 1
    assert found[0, 1] == (4, most) and found[0, 2] == (1, 5 * 1024**2)
    assert found[0, 3] == (3, max(-(2**63), 1024 * most - 2048 * 2**63))
    assert found[100, 1] == (2, 5 * 1024**2) and found[100, 2] == (5, 2 * 1024**2) and len(found) == 5
    assert topk.nearest(docs.limit(0), docs).collect() == topk.nearest(docs, docs.limit(0)).collect() == []


def test_a_search_leaves_most_of_a_clustered_table_unread():
    rng = np.random.default_rng(4)
    x = (rng.normal(0, 400, (40, 1, 16)) + rng.normal(0, 9, (40, 200, 16))).astype(np.int64).reshape(-1, 16)
    ids = np.arange(len(x))
    rows = []
    for node, held, least, centre, radius in topk.ball_tree(x, ids, 64):
        row = {"node": node, "least": least, "centre": centre, "radius": radius, "leaf": held is not None}
        if row["leaf"]:
            row |= {"ids": topk.pa.array(ids[held]), "x": x[held].ravel()}
        rows.append(row)
    tree = topk._Tree(rows)
    scores, order, _ = tree.search(x[5], 5, tree.bounds(x[5:6])[0], -math.inf, 10)
    expected = sorted((-int(x[5] @ x[j]), j) for j in range(len(x)) if j != 5)[:10]
    assert [(-int(s), int(i)) for s, i in zip(scores, order, strict=True)] == expected
    assert len(tree.plain) < len(tree.x) / 4


def brute_clusters(rows, width, k=8, rounds=10):
    alive = kept(rows, width, 1024)

    def key(row):
        return ("~" if row[0] is None else hashlib.sha256(f"3:{row[0]}".encode()).hexdigest(), row[1])

    table = [list(x) for _, x in sorted(alive, key=key)[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(table))

    for _ in range(rounds):
        groups = {}
        for _, x in alive:
            groups.setdefault(nearest(x)[1], []).append(x)
        for j, held in groups.items():
            table[j] = [sum(c) // len(held) for c in zip(*held, strict=True)]
    out = [(i, *nearest(x)[::-1]) for i, x in alive]
    inertia = [sum(d for _, j, d in out if j == c) for c in range(len(table))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in table]
    return [(i, j, d, inertia[j], sum(inertia), digest[j]) for i, j, d in out]


@pytest.mark.parametrize(("width", "k"), [(4, 8), (16, 3), (4, 60)])
def test_clusters_equal_plain_rounds(embeddings, width, k):
    rows = odd_rows(width, 3)
    found = centroids.cluster(embeddings(rows), k=k, width=width)
    assert found.first().doc.cluster == "kept"
    names = ["doc.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = sorted(map(tuple, found.select(*names).collect()), key=repr)
    assert got == sorted(brute_clusters(rows, width, k), key=repr)


def test_clusters_of_little_and_of_large(embeddings):
    assert centroids.cluster(embeddings([]), width=2).collect() == []
    few = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-0.5, 0.0])]
    found = centroids.cluster(embeddings(few), width=2, carry=["vec_id"])
    names = ["doc.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(brute_clusters(few, 2))
    huge = [(i, [1e18 * i, -1e12 * i]) for i in range(9)]
    found = centroids.cluster(embeddings(huge), width=2, k=2, factor=1)
    assert found.count() == 9 and found.agg(F.max("distance")).first()[0] == 2**63 - 1


def test_nearest_centroid_search_equals_all_distances():
    rng = np.random.default_rng(7)
    for width, k in ((1, 5), (3, 40), (64, 200)):
        table = rng.integers(-30, 30, (k, width))
        x = rng.integers(-30, 30, (500, width))
        number, distance = centroids.Centroids(table.tolist()).nearest(x)
        every = ((x[:, None] - table[None]) ** 2).sum(2)
        assert (distance == every.min(1)).all() and (number == every.argmin(1)).all()


def test_registered_queries_name_every_row(spark, sf_dir):
    """What the contracts fix, on the smallest given table."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    white = queries.op11_whitening(spark, sf_dir)
    assert dict(white.dtypes)["deviation"] == "bigint" and white.count() == 4 * rows
    assert queries.op13_centroid_clustering(spark, sf_dir).count() == rows
