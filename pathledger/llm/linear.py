"""Logistic regression by FTRL-proximal steps over hashed features."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Feature 0 is always on and never shrunk: the intercept.
INTERCEPT = 0
_LEARNERS = -1


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


class Ftrl:
    """Per-coordinate rates alpha / (beta + sqrt(sum of squared gradients)) and L1 sparsity."""

    def __init__(self, dims, alpha=0.1, beta=1.0, l1=1.0, l2=1.0):
        self.z, self.n = np.zeros(dims), np.zeros(dims)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, ids):
        z = self.z[ids]
        l1 = np.where(ids == INTERCEPT, 0.0, self.l1)
        slope = (self.beta + np.sqrt(self.n[ids])) / self.alpha + self.l2
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / slope)

    def step(self, ids, values, label):
        """One example with distinct ``ids``."""
        w = self.weights(ids)
        g = (sigmoid(float(w @ values)) - label) * values
        rate = (np.sqrt(self.n[ids] + g * g) - np.sqrt(self.n[ids])) / self.alpha
        self.z[ids] += g - rate * w
        self.n[ids] += g * g


def fit(rows: DataFrame, dims, shards=4, epochs=3, **settings):
    """(ids, weights) that are not zero, from ``rows`` of ids, label and, unless all are 1, values.

    ``rows`` is a bounded sample of labelled rows. Each shard is trained in one task, in an order
    that depends on the rows alone, and the shards' weights are averaged. No rows give no weights.
    """

    fields = [c for c in ("ids", "values") if c in rows.columns]

    def train(batches):
        model, examples = Ftrl(dims, **settings), []
        for batch in batches:
            for i, label in enumerate(batch.column("label").to_pylist()):
                example = [batch.column(c)[i].values.to_numpy(zero_copy_only=False).copy() for c in fields]
                examples.append((*example, label))
        rng = np.random.default_rng(5)
        for _ in range(epochs):
            for i in rng.permutation(len(examples)):
                ids, *values, label = examples[i]
                model.step(ids, values[0] if values else np.ones(len(ids)), label)
        if examples:
            known = np.flatnonzero(model.n)
            w = model.weights(known)
            found = w != 0
            # The last row counts the learners.
            columns = [pa.array(np.append(known[found], _LEARNERS).astype(np.int32)), pa.array(np.append(w[found], 1.0))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "weight"])

    key = F.xxhash64("ids", "label")
    dealt = rows.withColumn("key", key).withColumn("shard", F.pmod("key", F.lit(shards)))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("key").drop("key", "shard")
    trained = dealt.mapInArrow(train, "id int, weight double")
    # At most dims rows, a fixed number.
    sums = trained.groupBy("id").agg(F.sum("weight").alias("weight")).orderBy("id").toPandas()
    learners = sums.loc[sums["id"] == _LEARNERS, "weight"].sum() or 1.0
    sums = sums[sums["id"] != _LEARNERS]
    return sums["id"].to_numpy(np.int64), sums["weight"].to_numpy(np.float64) / learners


class Weights:
    """Sparse weights as they travel, dense where they are used."""

    def __init__(self, dims, ids, weights):
        self.dims, self.ids, self.weights, self.table = dims, ids, weights, None

    def dense(self):
        if self.table is None:
            self.table = np.zeros(self.dims)
            self.table[self.ids] = self.weights
        return self.table

    def __getstate__(self):
        return self.__dict__ | {"table": None}


def labelled_sample(docs, labels, doc_id, label, max_rows, keep=None) -> DataFrame:
    """``docs`` packed as ``doc`` with ``label`` 0 or 1, for at most ``max_rows`` labelled ids.

    The ids with the smallest hashes are taken. Labels other than 0 and 1, and null ids, do not
    count; of several labels of an id the largest holds. ``keep``: a condition on the id.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    if keep is not None:
        known = known.filter(keep(F.col("id")))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    # At most max_rows rows of 16 bytes.
    joined = packed.join(F.broadcast(chosen), F.col(f"doc.{doc_id}") == F.col("id"))
    return joined.select("doc", "label")
