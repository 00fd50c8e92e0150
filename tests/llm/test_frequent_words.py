"""op5's lists where all word pairs are frequent, and where a family has a few members that aren't linked with it."""

import random

import numpy as np

from tests.llm.test_operators import brute_components
from zoneload.llm import minhash

DDL = "doc_id long, text string"


def test_frequent_word_pairs_make_no_long_lists(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LONG", 8)
    listed, outsiders = [], minhash._outsiders
    monkeypatch.setattr(minhash, "_outsiders", lambda hot, *more: listed.append(hot.count()) or outsiders(hot, *more))
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("abcdefghijklmno") for _ in range(r.randrange(3, 40)))) for i in range(700)]
    rows += [(1000 + i, t + r.choice(["", " z"])) for i, t in rows[::10]]
    got = {g.doc_id: (g.n_shingles, g.component_id, g.kept) for g in minhash.near_duplicates(spark.createDataFrame(rows, DDL), 2).collect()}
    assert got == brute_components(rows, 2)
    assert listed[0] < 100


def test_a_family_meets_its_outsiders_once(spark, monkeypatch):
    sent, checkpoint = [], minhash.checkpoint

    def seen(df):
        out = checkpoint(df)
        sent.extend([out.count()] if "outside" in out.columns and "block" not in out.columns else [])
        return out

    monkeypatch.setattr(minhash, "checkpoint", seen)
    r = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(12 if i % 16 == 0 else 3):
            w[r.randrange(200)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {g.doc_id: (g.n_shingles, g.component_id, g.kept) for g in minhash.near_duplicates(spark.createDataFrame(rows, DDL), 2).collect()}
    want = brute_components(rows, 2)
    assert got == want and 1 < sum(k for _, _, k in want.values()) < 20
    assert 0 < sent[0] <= 2 * len(rows)


def test_sets_at_the_threshold_share_a_key():
    r = np.random.default_rng(6)
    for n in (4, 5, 6, 9, 12, 13, 16, 20, 40, 64, 70, 200):
        for _ in range(40):
            less = n // 5
            union = r.integers(0, 1 << 63, n).astype(np.uint64)
            away = r.permutation(n)[:less]
            side = r.random(less) < 0.5
            a, b = (np.sort(np.delete(union, away[s]))[: minhash.SKETCH] for s in (side, ~side))
            keys, of = minhash.run_keys(np.concatenate([a, b]), np.array([len(a), len(b)]))
            assert set(keys[of == 0].tolist()) & set(keys[of == 1].tolist())
    a = r.integers(0, 1 << 63, 400).astype(np.uint64)
    assert 5 < (minhash.band_keys(a[:360]) == minhash.band_keys(a[40:])).sum() < 30  # 46 * 0.8 ** 6 are 12
