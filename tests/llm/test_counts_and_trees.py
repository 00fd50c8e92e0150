"""Phrases, repeated windows of words and hash trees against plain Python on small odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from zoneload.llm import collocations, merkle, substring
from zoneload.llm._text import U

LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Columns beside the documents' own, named like working or result columns.
EXTRA = "group string, rank int, n_words int, spans string, words string, tree long, place long, leaf string, pid string, bucket long"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(r, n, words="a b c d e f g h".split()):
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Shared passages, exact copies, nulls in every column, one long text, odd spacing."""
    r = random.Random(3)
    passages = [sentence(r, n, [f"w{i}" for i in range(40)]) for n in (49, 50, 51, 70, 120)]
    texts = [None, "", " \n ", "one", "É, é. É", "a b a b", "x" * 400, "a b\tc\x0bd", *passages]
    for i in range(60):
        texts.append(f"{sentence(r, r.randint(0, 30))} {r.choice(passages)} {sentence(r, r.randint(0, 30))}{r.choice('.,;:!?')}{r.choice(passages)}")
    texts += [passages[3] + "  " + passages[3], passages[4].replace(" ", "\t\n"), " ".join(passages) * 3, sentence(r, 5000), *texts[-3:]]
    out = [(i, t, ("en", "fr", None, "", "é")[i % 5], "s", len(t or "")) for i, t in enumerate(texts)]
    out += [(None, texts[-1], "en", None, None)] * 9 + [(2, texts[-2], "fr", None, 5), (2, texts[-2], "fr", None, 5), (-4, texts[20], "en", "s", 1), (2**53 + 1, texts[21], None, "s", 2**63 - 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = [F.lit(None).cast(kind).alias(name) for name, kind in (c.split(" ") for c in EXTRA.split(", "))]
    return spark.createDataFrame(rows, DOCS).repartition(3).select("*", *extra)


def plain_cut(rows, size):
    first = {}
    split = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t, *_ in rows]
    for i, w in split:
        for k in range(len(w) - size + 1) if i is not None else ():
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    for i, w in split:
        gone = set()
        for k in range(len(w) - size + 1) if i is not None else ():
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        spans, kept = [], [x for k, x in enumerate(w) if k not in gone]
        for k in sorted(gone):
            spans = spans[:-1] + [(spans[-1][0], k + 1)] if spans and spans[-1][1] == k else [*spans, (k, k + 1)]
        yield i, " ".join(kept), len(w), len(gone), spans


@pytest.mark.parametrize("size,group", [(50, 8 << 20), (50, 3000), (3, 20000), (1, 4000)])
def test_windows_of_words(docs, rows, size, group, monkeypatch):
    monkeypatch.setattr(substring, "GROUP_BYTES", group)
    got = [(x.doc_id, x.text, x.n_words, x.n_removed, [tuple(s) for s in x.spans]) for x in substring.trimmed(docs, size).collect()]
    assert sorted(got, key=repr) == sorted(plain_cut(rows, size), key=repr)


def test_windows_of_words_digest_and_empty_table(spark, docs, rows):
    got = Counter(map(tuple, substring.repeats(docs).collect()))
    assert got == Counter((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, kept, n, gone, _ in plain_cut(rows, 50))
    assert substring.repeats(spark.createDataFrame([], DOCS)).count() == 0
    assert set(EXTRA.replace(",", "").split()[::2]) <= set(substring.trimmed(docs).columns)


def test_rolling_hashes_equal_plain_sums():
    symbols = np.random.default_rng(1).integers(0, 2**63, 200, dtype=np.int64).view(U)
    prime = 2**31 - 1
    for size in (1, 2, 7, 50):
        want = [sum((int(x) >> 2) * pow(substring._FACTOR, size - 1 - j, prime) for j, x in enumerate(symbols[i : i + size])) % prime for i in range(200 - size + 1)]
        assert substring.prime_rolling(symbols, size).tolist() == want
        again = substring.rolling(np.concatenate([symbols[60:], symbols]), size)
        assert (again[140 : 140 + 201 - size] == substring.rolling(symbols, size)).all()


def test_equal_wide_hashes_are_told_apart_by_the_narrow_ones():
    class Found:
        starts, first = np.arange(4), np.arange(3)
        wide, narrow, ids = np.array([5, 5, 7], U), np.array([2, 3, 1], U), np.array([9, 9, 9])

    gone = substring._gone(Found, 1, np.array([5, 5, 8], U), np.array([1, 3, 1], U), np.array([0, 4, 0]), np.zeros(3, bool))
    assert gone.tolist() == [False, True, False, False]


def plain_phrases(rows, least, most):
    counts, totals = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lowered = (text or "").encode().translate(LOWER).decode()
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i : i + k])
                    counts[key] = counts.get(key, 0) + 1
    chosen = {key: n for key, n in counts.items() if len(key[1]) > 1 and n >= least}
    inside = {(lang, g[i : i + k]) for (lang, g), n in chosen.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if n >= counts[lang, g[i : i + k]]}
    out = []
    for lang in totals:
        scored = []
        for (of, g), a in chosen.items():
            if of == lang and (lang, g) not in inside:
                cuts = [(1000 * a * totals[lang] // (counts[lang, g[:k]] * counts[lang, g[k:]]), k) for k in range(1, len(g))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(g).encode(), counts[lang, g[:k]], counts[lang, g[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,most,group", [(3, 2000, 16 << 20), (3, 7, 3000), (12, 2000, 5000), (1, 50, 20000)])
def test_phrases(docs, rows, least, most, group, monkeypatch):
    monkeypatch.setattr(collocations, "GROUP_BYTES", group)
    monkeypatch.setattr(collocations, "_RANKED", 40)
    got = sorted(map(tuple, collocations.collocations(docs, least, most).collect()))
    assert got == plain_phrases(rows, least, most) and got


def test_phrases_of_odd_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, None), (2, "a b", "en", None, None)], DOCS)).count() == 0
    hot = spark.createDataFrame([(1, "the cat. " * 120, "en", None, None)] * 3, DOCS)
    assert [tuple(x) for x in collocations.collocations(hot).collect()] == [("en", 1, "the cat", 360, 360, 360, 720, 2000)]


def test_a_stream_cut_anywhere_gives_the_same_parts(spark):
    words = [list(w) for w in ("a", "ab", "aba", "abab", "abb", "ac", "b", "ba", "c")]
    stream = spark.createDataFrame([("en", w, 100 - 10 * len(w)) for w in words] + [("fr", ["a"], 4), ("fr", ["a", "b"], 4)], "lang string, words array<string>, count long")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    for ranges in (1, 3, 11):
        spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
        got = {(x.lang, "".join(x.words)): (x.parts, x.covers) for x in collocations.merged(stream).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        want = {("en", "".join(w)): ([100 - 10 * k for k in range(1, len(w))], False) for w in words if len(w) > 1}
        assert got == want | {("fr", "ab"): ([4], True)}


def test_products_beyond_64_bits(spark):
    big = 10**13
    rows = [("en", [], 10**14), ("en", ["a"], big + 1), ("en", ["b"], big), ("en", ["a", "b"], big - 7)]
    stream = spark.createDataFrame(rows, "lang string, words array<string>, count long")
    collocations_counts = collocations.counts
    try:
        collocations.counts = lambda docs, least: stream
        got = [tuple(x) for x in collocations.collocations(stream).collect()]
    finally:
        collocations.counts = collocations_counts
    assert got == [("en", 1, "a b", big - 7, big + 1, big, 10**14, 1000 * (big - 7) * 10**14 // ((big + 1) * big))]


def plain_trees(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    leaf = lambda i, t, lang, s, n: digest("".join(map(field, (i, s, lang, n, t))))

    def proofs(nodes):
        paths = [[] for _ in nodes]
        at, level = list(range(len(nodes))), list(nodes)
        while len(level) > 1:
            for k, i in enumerate(at):
                paths[k].append((level[i ^ 1] if i ^ 1 < len(level) else None, i % 2 == 0))
            level = [digest("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
            at = [i // 2 for i in at]
        return paths, level[0]

    langs = sorted({x[2] for x in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((x for x in rows if x[2] == lang), key=lambda x: (x[0] is not None, x[0] or 0, leaf(*x)))
        trees.append((own, *proofs([leaf(*x) for x in own])))
    upper, root = proofs([t[2] for t in trees])
    for (own, paths, subroot), over in zip(trees, upper, strict=True):
        for x, path in zip(own, paths, strict=True):
            i, t, lang, s, n = x
            touched = i is not None and zlib.crc32(str(i).encode()) % 7 == 0
            if touched and n == 2**63 - 1:
                n = None
            elif touched and n is not None:
                n += 1
            node = leaf(i, t, lang, s, n)
            for other, right in path + over:
                node = digest(node if other is None else node + other if right else other + node)
            yield i, leaf(*x), subroot, root, digest("".join(o for o, _ in path + over if o)), node, node == root


@pytest.mark.parametrize("height,few", [(1, 200), (2, 200), (10, 200), (1, 1), (1, 2), (2, 9)])
def test_hash_trees(docs, rows, height, few, monkeypatch):
    some = [x for x in rows if x[0] is not None][:few] if few < 200 else rows
    part = docs if few == 200 else docs.sparkSession.createDataFrame(some, DOCS)
    monkeypatch.setattr(merkle, "HEIGHT", height)
    plain_manifest = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda d, p: plain_manifest(d, p, height))
    assert Counter(map(tuple, merkle.audited(part).collect())) == Counter(plain_trees(some))


def test_hash_trees_of_many_languages_and_none(spark):
    rows = [(i, "t", f"l{i % 37}" if i % 5 else None, None, 1) for i in range(120)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS), None, 2)
    kept = got.collect()
    assert len(kept) == 120 and all(x.verified for x in kept) and len({x.root for x in kept}) == 1
    assert Counter((x.doc_id, x.leaf, x.subroot, x.root) for x in kept) == Counter(x[:4] for x in plain_trees(rows))
    assert merkle.audited(spark.createDataFrame([], DOCS)).count() == 0


def test_any_change_breaks_the_proof(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", i) for i in range(40)], DOCS)
    for column in ("text", "source", "n_chars"):
        changed = merkle.leaf({column: F.concat(F.col(column).cast("string"), F.lit("0"))})
        assert not merkle.manifest(docs, changed, 2).where("verified").count()
