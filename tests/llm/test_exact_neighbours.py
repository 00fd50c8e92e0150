"""op7's search gives the nearest of all rows, whatever its index retrieves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from zoneload.llm import neighbours as N

DDL = "vec_id long, embedding array<double>"


def nearest(ids, x, q, k=5):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u[ids.index(q)], 12)
    return [i for _, i in sorted((-c, i) for i, c in zip(ids, s.tolist(), strict=True) if i != q)][:k]


def found(spark, rows, each):
    got = {}
    for r in sorted(N.search(spark.createDataFrame(rows, DDL), F.col("id") % each == 0).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


@pytest.mark.parametrize("block", [32 << 20, 40_000])
def test_nothing_beyond_the_radius_is_left_out(spark, monkeypatch, block):
    monkeypatch.setattr(N, "WITHIN", 8)  # the radius holds far fewer than find all
    monkeypatch.setattr(N, "CHECK_BYTES", block)  # 40,000: several blocks of rows and of queries
    r = np.random.default_rng(8)
    x = r.normal(size=(1200, 48))
    x[700:800] = x[700] * 2.0 ** r.integers(0, 3, 100)[:, None]  # ties
    got = found(spark, list(enumerate(x.tolist())), 12)
    assert got == {q: nearest(list(range(1200)), x, q) for q in range(0, 1200, 12)}


def test_vectors_of_another_dimension_are_searched_among_their_like(spark):
    r = np.random.default_rng(9)
    rows = [(i, r.normal(size=8 if i % 3 else 6).tolist()) for i in range(300)] + [(400, [1.0])]
    want = {}
    for like in ([i for i in range(300) if i % 3], [i for i in range(300) if i % 3 == 0]):
        x = np.array([rows[i][1] for i in like])
        want |= {q: nearest(like, x, q) for q in like if q % 20 == 0}
    assert found(spark, rows, 20) == want
