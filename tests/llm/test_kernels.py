"""Text kernels, suffix sorting and differencing, without Spark."""

import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zoneload.llm import _text, minhash, packing, scoring, suffix


def block_of(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    return next(_text.blocks(batch, limit=1 << 30))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB\t é1.\n")), min_size=1, max_size=6))
def test_words_match_a_regular_expression(texts):
    block = block_of(texts)
    starts, ends, counts = _text.words(block, _text.NON_SPACE)
    got = [block.data[a:b].tobytes() for a, b in zip(starts, ends)]
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in texts]
    assert got == list(itertools.chain(*want)) and counts.tolist() == [len(w) for w in want]


def test_hashes_depend_on_the_words_alone():
    a, b = block_of(["x abc def", "abc"]), block_of(["abc", "zz zz abc def"])
    ha = _text.word_hashes(a, *_text.words(a, _text.NON_SPACE)[:2])
    hb = _text.word_hashes(b, *_text.words(b, _text.NON_SPACE)[:2])
    assert ha[1] == ha[3] == hb[0] == hb[3] and ha[2] == hb[4] and len({*ha.tolist()}) == 3
    assert _text.window_hashes(ha[1:3], 2)[0] == _text.window_hashes(hb[3:5], 2)[0] != _text.window_hashes(ha[1:3][::-1], 2)[0]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=300))
def test_two_stage_sorting_sorts_suffixes(data):
    order = suffix.two_stage(np.frombuffer(data, np.uint8))
    assert sorted(order.tolist()) == list(range(len(data)))
    if len(data) < 56:
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_two_stage_sorting_of_repeats():
    for data in (b"a" * 400, b"ab" * 200, bytes(random.Random(1).choices(b"ab", k=500)), b"b" * 99 + b"a" * 99):
        order = suffix.two_stage(np.frombuffer(data, np.uint8)).tolist()
        heads = [data[i : i + 56] for i in order]
        assert sorted(order) == list(range(len(data))) and heads == sorted(heads)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(b"abc"), st.integers(1, 70)), min_size=1, max_size=12))
def test_two_stage_sorting_of_runs(runs):
    data = b"".join(bytes([c]) * n for c, n in runs)
    order = suffix.two_stage(np.frombuffer(data, np.uint8)).tolist()
    heads = [data[i : i + 56] for i in order]
    assert sorted(order) == list(range(len(data))) and heads == sorted(heads)


def test_long_uniform_texts_are_sorted_at_once():
    begin = time.process_time()
    data = np.concatenate([np.full(4_000_000, 97, np.uint8), np.full(1_000_000, 98, np.uint8), np.array([97], np.uint8)])
    order = suffix.two_stage(data)
    assert len(order) == len(data) and order[0] == len(data) - 1 and time.process_time() - begin < 60


def dense_model(weights, texts):
    """The model with plain loops: log10 of class, group and subgroup of each token."""
    block = block_of(texts)
    hashes, leaf, counts = scoring.tokens(block)
    context = scoring.contexts(hashes, leaf, counts)
    out = []
    for i in range(len(hashes)):
        total, low = 0.0, sum(scoring.BITS)
        for level, bits in enumerate(scoring.BITS):
            low -= bits
            before, value = int(leaf[i]) >> (low + bits), (int(leaf[i]) >> low) & ((1 << bits) - 1)
            z = weights.bias[level][before].astype(float).copy()
            salt = int(_text.mix(np.array([before + ((level + 1) << 40)], np.uint64))[0])
            for table, f in zip(weights.tables[level], scoring.USED[level], strict=True):
                row = ((int(context[f][i]) ^ salt) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - weights.rows.bit_length() + 1)
                z += table[row]
            total += z[value] - np.log(np.exp(z).sum())
        out.append(total / np.log(10))
    return hashes, leaf, counts, context, out


def test_factored_softmax_equals_plain_loops():
    r = np.random.default_rng(4)
    weights = scoring.Weights(r.random(scoring.LEAVES) + 0.1, 64)
    for a in weights.arrays():
        a += r.normal(size=a.shape).astype(np.float32) / 2
    hashes, leaf, counts, context, want = dense_model(weights, ["The cat sat on the mat", None, "a", "on the mat sat the cat the cat"])
    assert counts.tolist() == [7, 1, 2, 9] and np.allclose(weights.log10(context, leaf), want, atol=1e-4)
    # One step of learning is the gradient of the likelihood, by finite differences, scaled by its own size.
    seen = [np.ones(len(a), np.float32) for a in weights.arrays()]
    after = weights.copy()
    after.learn(context, leaf, seen)
    for number in range(len(weights.arrays())):
        changed = np.argwhere(after.arrays()[number] != weights.arrays()[number])
        row, cell = changed[r.integers(len(changed))]
        width = weights.arrays()[number].shape[1]
        gradient = []
        for j in range(width):
            both = []
            for step in (1e-2, -1e-2):
                moved = weights.copy()
                moved.arrays()[number][row, j] += step
                both.append(-moved.log10(context, leaf).sum() * np.log(10))
            gradient.append((both[0] - both[1]) / 2e-2)
        size = 1 + scoring.SCALE * sum(g * g for g in gradient)
        assert seen[number][row] == pytest.approx(size, rel=1e-2)
        move = weights.arrays()[number][row, cell] - after.arrays()[number][row, cell]
        assert move == pytest.approx(scoring.RATE * gradient[cell] / np.sqrt(size), rel=2e-2, abs=2e-4)


def test_factors_sum_to_one():
    r = np.random.default_rng(9)
    weights = scoring.Weights(np.ones(scoring.LEAVES), 64)
    for a in weights.arrays():
        a += r.normal(size=a.shape).astype(np.float32)
    leaf = np.arange(scoring.LEAVES, dtype=np.uint16)
    context = [np.full(scoring.LEAVES, v, np.uint64) for v in (3, 5, 7)]
    assert (10 ** weights.log10(context, leaf)).sum() == pytest.approx(1, rel=1e-4)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 512), min_size=1, max_size=120))
def test_differencing_fills_windows(lengths):
    parts = packing.windows_of(lengths, 2048)
    assert sorted(i for p in parts for i in p) == list(range(len(lengths)))
    assert max(sum(lengths[i] for i in p) for p in parts) <= 2048


def test_differencing_is_near_equal():
    r = random.Random(3)
    lengths = [r.randint(1, 512) for _ in range(900)]
    sums = [sum(lengths[i] for i in p) for p in packing.windows_of(lengths, 2048)]
    assert max(sums) - min(sums) < 150 and sum(sums) / len(sums) / 2048 > 0.97


def test_estimates_let_true_pairs_pass():
    r = np.random.default_rng(0)
    for n in (3, 20, 60, 500):
        for _ in range(40):
            common = int(np.ceil(0.8 * n))
            union = np.unique(r.integers(0, 1 << 63, 2 * n - common).astype(np.uint64))
            a, b = np.sort(union[r.permutation(len(union))[:]]), union
            a = np.sort(np.concatenate([union[:common], union[common:n]]))
            b = np.sort(np.concatenate([union[:common], union[n:]]))
            if len(a) + len(b) and 100 * common >= 80 * len(union):
                m = np.full((2, minhash.ESTIMATE), 0xFFFFFFFF, np.uint32)
                for i, s in enumerate((a, b)):
                    e = np.unique((s[: minhash.ESTIMATE] >> np.uint64(32)).astype(np.uint32))
                    m[i, : len(e)] = e
                assert minhash.may_link(m[:1], m[1:])[0]
