"""Whitening of embeddings: leading components of a distributed covariance, and the projection on them.

The covariance is summed up in tasks; only its d * (d + 1) / 2 entries reach the driver, whatever
the number of rows. There its leading eigenpairs are found: Householder reflections make it
tridiagonal, Sturm counts bisect the wanted eigenvalues, inverse iteration gives their vectors, and
those of close eigenvalues are orthogonalised against each other.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pathledger.llm.vectors import exact, magnitude, matrix, scaled, whole
from pathledger.session import materialise

# Rows that one task multiplies at once.
_BLOCK = 4096
_DECIMAL = pa.decimal128(38, 0)


def tridiagonal(a):
    """(diagonal, off-diagonal, reflections) of a symmetric matrix under Householder reflections.

    Reflection j is a unit vector that is zero up to place j, or None where there was nothing to clear.
    """
    a = np.array(a, float)
    n = len(a)
    reflections = []
    for j in range(n - 2):
        column = a[j + 1 :, j]
        largest = np.abs(column[1:]).max()
        if not largest:
            reflections.append(None)
            continue
        scale = max(largest, abs(column[0]))
        v = column / scale
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        inner = a[j + 1 :, j + 1 :]
        # (I - 2vv') A (I - 2vv') as an update of rank two.
        p = inner @ v
        q = 2 * (p - (v @ p) * v)
        inner -= np.outer(v, q) + np.outer(q, v)
        a[j + 1 :, j] -= 2 * (v @ column) * v
        a[j, j + 1 :] = a[j + 1 :, j]
        whole_vector = np.zeros(n)
        whole_vector[j + 1 :] = v
        reflections.append(whole_vector)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def counts_below(diagonal, off, points):
    """Sturm counts: how many eigenvalues of the tridiagonal matrix lie below each point."""
    least = np.finfo(float).tiny / np.finfo(float).eps
    found = np.zeros(len(points), int)
    pivot = np.ones(len(points))
    for i, value in enumerate(diagonal):
        square = off[i - 1] ** 2 if i else 0.0
        pivot = value - points - square / pivot
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        found += pivot < 0
    return found


def leading_eigenvalues(diagonal, off, k):
    """The k largest eigenvalues, falling, by bisection down to neighbouring doubles."""
    n = len(diagonal)
    beside = np.abs(np.concatenate(([0.0], off, [0.0])))
    reach = beside[:-1] + beside[1:]
    low, high = (diagonal - reach).min(), (diagonal + reach).max()
    slack = np.finfo(float).eps * max(abs(low), abs(high)) * n + np.finfo(float).tiny
    low, high = np.full(k, low - slack), np.full(k, high + slack)
    # The j-th largest has exactly n - j smaller ones, counted with repeats.
    wanted = n - 1 - np.arange(k)
    while True:
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any():
            return middle
        above = counts_below(diagonal, off, middle) > wanted
        low, high = np.where(above, low, middle), np.where(above, middle, high)


def _factored(diagonal, off, value):
    """Elimination with row exchanges of T - value: the upper bands and the steps taken."""
    n = len(diagonal)
    least = np.finfo(float).eps * max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    main, first, second = diagonal - value, np.append(off, 0.0), np.zeros(n)
    steps = []
    for i in range(n - 1):
        below = off[i]
        swap = abs(below) > abs(main[i])
        if swap:
            main[i], below = below, main[i]
            first[i], main[i + 1] = main[i + 1], first[i]
            second[i], first[i + 1] = first[i + 1], 0.0
        if main[i] == 0:
            main[i] = least
        factor = below / main[i]
        main[i + 1] -= factor * first[i]
        first[i + 1] -= factor * second[i]
        steps.append((swap, factor))
    if abs(main[-1]) < least:
        main[-1] = math.copysign(least, main[-1])
    return main, first, second, steps


def _solved(factors, right):
    main, first, second, steps = factors
    y, n = right.copy(), len(right)
    for i, (swap, factor) in enumerate(steps):
        if swap:
            y[i], y[i + 1] = y[i + 1], y[i]
        y[i + 1] -= factor * y[i]
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            y[i] -= first[i] * y[i + 1]
        if i + 2 < n:
            y[i] -= second[i] * y[i + 2]
        y[i] /= main[i]
        # A nearly singular matrix makes huge solutions; only their direction counts.
        if abs(y[i]) > 1e150:
            y *= 1e-150
    return y / np.linalg.norm(y)


def tridiagonal_vectors(diagonal, off, values, rounds=4):
    """Unit eigenvectors, a row per eigenvalue (falling), by inverse iteration.

    Vectors of a cluster, eigenvalues closer than a thousandth of the largest, are orthogonalised
    against the earlier ones of it in each round.
    """
    rng = np.random.default_rng(11)
    close = 1e-3 * max(np.abs(values).max(), np.finfo(float).tiny)
    found, first = np.zeros((len(values), len(diagonal))), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > close:
            first = j
        factors = _factored(diagonal, off, value)
        y = rng.standard_normal(len(diagonal))
        for _ in range(rounds):
            y = _solved(factors, y)
            for _ in range(2):
                y -= found[first:j].T @ (found[first:j] @ y)
            y /= np.linalg.norm(y)
        found[j] = y
    return found


def leading_components(covariance, k):
    """(eigenvalues, unit eigenvectors as rows) of the k largest eigenvalues, falling.

    The largest entry of a vector, the first one of equals, is positive.
    """
    k = min(k, len(covariance))
    if not k:
        return np.zeros(0), np.zeros((0, 0))
    scale = np.abs(covariance).max()
    if not scale:
        return np.zeros(k), np.eye(len(covariance))[:k]
    diagonal, off, reflections = tridiagonal(covariance / scale)
    values = leading_eigenvalues(diagonal, off, k)
    vectors = tridiagonal_vectors(diagonal, off, values)
    for v in reversed([v for v in reflections if v is not None]):
        vectors -= 2 * np.outer(vectors @ v, v)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    largest = np.argmax(np.abs(vectors), axis=1)
    vectors *= np.sign(vectors[np.arange(k), largest])[:, None]
    return values * scale, vectors


def _blocks(batches, column=0):
    """The vectors of a task as matrices of at most ``_BLOCK`` rows."""
    for batch in batches:
        lists = batch.column(column)
        for at in range(0, len(lists), _BLOCK):
            part = lists.slice(at, _BLOCK)
            yield matrix(part, len(part[0]))


def _sums(fit, width):
    """(n, S): the number of rows and exact sums by dimension, from a row per task and dimension."""

    def partial(batches):
        total = np.zeros(width, object)
        rows = 0
        for x in _blocks(batches):
            total = total + exact(x, magnitude(x) * len(x)).sum(0)
            rows += len(x)
        columns = [pa.array([rows] * width, pa.int64()), pa.array(range(width), pa.int32())]
        columns.append(pa.array([str(v) for v in total]))
        yield pa.RecordBatch.from_arrays(columns, ["rows", "i", "total"])

    found = fit.mapInArrow(partial, "rows bigint, i int, total string").groupBy("i")
    # A number per dimension.
    found = found.agg(F.sum("rows").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    sums = {row.i: int(row.total) for row in found}
    return (found[0].n if found else 0), [sums.get(i, 0) for i in range(width)]


def _products(fit, width, of):
    """The sum over all rows of the outer product of ``of(rows)`` with itself, and of ``of(rows)``."""

    def partial(batches):
        square, plain = np.zeros((width, width)), np.zeros(width)
        for x in _blocks(batches):
            centred = of(x)
            square += centred.T @ centred
            plain += centred.sum(0)
        i, j = np.triu_indices(width)
        columns = [pa.array(np.append(i, np.full(width, -1)), pa.int32())]
        columns += [pa.array(np.append(j, np.arange(width)), pa.int32()), pa.array(np.append(square[i, j], plain))]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "v"])

    summed = fit.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    square, plain = np.zeros((width, width)), np.zeros(width)
    # width * (width + 3) / 2 numbers.
    for row in summed.collect():
        if row.i < 0:
            plain[row.j] = row.v
        else:
            square[row.i, row.j] = square[row.j, row.i] = row.v
    return square, plain


@dataclass
class Whitening:
    """What was learnt from the fit list: all that is sent to the tasks."""

    n: int
    sums: list
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def width(self):
        return len(self.sums)

    def centred(self, x):
        """x - S / n, without losing the digits in which large entries differ."""
        whole_part = [s // self.n for s in self.sums]
        rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole_part, strict=True)])
        bound = magnitude(x) + max(map(abs, whole_part), default=0)
        return (exact(x, bound) - np.array(whole_part, object if bound > 1 << 62 else np.int64)).astype(float) - rest

    def projected(self, x):
        return self.centred(x) @ self.vectors.T / np.sqrt(self.values)

    def deviations(self, x):
        """sum((n * x - S) ** 2) of each row, exact; None beyond 38 digits."""
        apart = self.n * magnitude(x) + max(map(abs, self.sums), default=0)
        kind = np.int64 if apart * apart * self.width < 1 << 63 else object
        scaled_up = x.astype(kind) * self.n - np.array(self.sums, kind)
        total = (scaled_up * scaled_up).sum(1)
        if kind is np.int64:
            return pa.array(total).cast(_DECIMAL)
        return pa.array([int(t) if t < 10**38 else None for t in total], _DECIMAL)


def quantised(rows: DataFrame, vector="embedding", factor=256) -> DataFrame:
    """``rows`` packed as column ``doc``, with ``x``, the entries times ``factor`` rounded down.

    Rows whose vector is null or holds null or non-finite entries are left out.
    """
    packed = rows.filter(whole(vector)).select(F.struct(*[rows[c] for c in rows.columns]).alias("doc"))
    return packed.withColumn("x", scaled(f"doc.{vector}", factor))


def common_width(x: DataFrame):
    """The number of entries that most vectors have, the larger one of equals; 0 without any."""
    # A row per length.
    widths = x.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    top = widths.filter("width > 0").orderBy(F.desc("n"), F.desc("width")).first()
    return top.width if top else 0


def fit(x: DataFrame, components=4) -> Whitening | None:
    """The leading components of the distinct vectors ``x``; None where there is no vector."""
    width = common_width(x)
    if not width:
        return None
    # Equal vectors combine before the shuffle, so frequent ones make no hot key.
    distinct = materialise(x.filter(F.size("x") == width).select("x").distinct(), "distinct")
    n, sums = _sums(distinct, width)
    learnt = Whitening(n, sums, np.zeros(0), np.zeros((0, width)), 0.0)
    square, _ = _products(distinct, width, learnt.centred)
    covariance = square / n
    learnt.trace = float(np.trace(covariance))
    values, vectors = leading_components(covariance, components)
    # A component without any spread cannot be scaled to unit variance.
    spread = values > width * np.finfo(float).eps * learnt.trace
    learnt.values, learnt.vectors = values[spread], vectors[spread]
    k = len(learnt.values)
    if k:
        square, plain = _products(distinct, k, learnt.projected)
        mean = plain / n
        learnt.identity_error = float(np.abs(square / n - np.outer(mean, mean) - np.eye(k)).max())
    return learnt


_OUT = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, vector="embedding", components=4, factor=256) -> DataFrame:
    """Each row's place along the leading components of all rows, scaled to unit variance.

    Returns ``doc`` (the whole row) with component (from 1, by falling eigenvalue e), n (vectors in
    the fit list), deviation, whitened, explained and identity_error; a row for each row and
    component. The fit list is each distinct vector once, so copies add nothing to the components,
    but every row comes out as often as it came in. Rows whose vector is null, empty or holds null
    or non-finite entries are left out, and so are vectors of another length than most vectors
    have, as they share no space with them. Entries whose multiple is beyond a long count as the
    nearest long, and a deviation of more than 38 digits is null. Components without any spread
    (constant vectors, a single vector) do not exist; a table without vectors gives no rows. Ties of
    eigenvalues come in the order of the iteration, the same for all rows.
    """
    prepared = quantised(rows, vector, factor)
    learnt = fit(prepared, components)
    kind = rows.sparkSession.createDataFrame([], _OUT).schema
    if learnt is None or not len(learnt.values):
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in kind]
        return prepared.select("doc", *empty).limit(0)
    # The components: width * components numbers, and a sum per dimension.
    shared = rows.sparkSession.sparkContext.broadcast(learnt)
    fields = [("component", pa.int32()), ("n", pa.int64()), ("deviation", _DECIMAL)]
    fields += [(name, pa.float64()) for name in ("whitened", "explained", "identity_error")]

    @F.arrow_udf(f"array<struct<{_OUT.replace(' ', ':').replace(',:', ', ').replace('decimal(38, 0)', 'decimal(38,0)')}>>")
    def project(lists: pa.Array) -> pa.Array:
        learnt = shared.value
        k = len(learnt.values)
        if not len(lists):
            return pa.array([], pa.list_(pa.struct(fields)))
        white, apart = [], []
        for at in range(0, len(lists), _BLOCK):
            x = matrix(lists.slice(at, _BLOCK), learnt.width)
            white.append(learnt.projected(x))
            apart.append(learnt.deviations(x))
        m = len(lists) * k
        columns = [
            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(lists))),
            pa.array(np.full(m, learnt.n)),
            pa.concat_arrays(apart).take(pa.array(np.repeat(np.arange(len(lists)), k))),
            pa.array(np.concatenate(white).ravel()),
            pa.array(np.tile(learnt.values / learnt.trace, len(lists))),
            pa.array(np.full(m, learnt.identity_error)),
        ]
        offsets = pa.array(np.arange(0, m + 1, k), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, [f for f, _ in fields]))

    usable = prepared.filter(F.size("x") == learnt.width)
    placed = usable.select("doc", F.explode(project("x")).alias("found"))
    return placed.select("doc", "found.*")
