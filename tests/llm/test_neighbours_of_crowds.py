"""op7's search where vectors crowd, and with very large and small numbers."""

import numpy as np
from pyspark.sql import functions as F

from zoneload.llm import neighbours as N

DDL = "vec_id long, embedding array<double>"


def found(spark, x, each):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], DDL)
    got = {}
    for r in N.search(rows, F.col("id") % each == 0).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    return got


def nearest(x, i, k=5):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u[i]
    s[i] = -9
    return set(np.argsort(-s, kind="stable")[:k].tolist())


def test_recall_outside_a_crowd(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=32) + 0.1 * r.normal(size=(1000, 32)), r.normal(size=(3000, 32))])[r.permutation(4000)]
    got = found(spark, x, 50)
    recall = np.mean([len(nearest(x, i) & set(got[i])) / 5 for i in range(0, 4000, 50)])
    assert all(len(v) == 5 for v in got.values()) and recall >= 0.9


def test_large_and_small_numbers(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 16))
    factors = np.array([1e200, 1e-200, 1.0, 1e300])[np.arange(200) % 4]
    got = found(spark, x * factors[:, None], 20)
    for i in range(0, 200, 20):
        assert set(got[i]) == nearest(x, i) and all(abs(s) <= 1 + 1e-12 for s in got[i].values())
