"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zoneload.llm import decontaminate, language, licenses, minhash, neighbours, packing, quality, scoring, sharding, suffix
from zoneload.llm.components import components

DOCS = "doc_id long, text string, pid string, rep string, v string, label string"
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def prose(r, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()):
    return " ".join(r.choice(words) + r.choice("abcdefgh") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Near and exact copies, shared passages, nulls, empties, one long text."""
    r = random.Random(5)
    base = prose(r, 120)
    family = []
    for _ in range(45):
        w = base.split()
        for _ in range(r.randint(1, 9)):
            w[r.randrange(len(w))] = r.choice("qrstuvw") * 4
        family.append(" ".join(w))
    passage = prose(r, 30)
    shared = [f"{prose(r, r.randint(20, 60))} {passage} {prose(r, r.randint(20, 60))}" for _ in range(40)]
    odd = [None, None, "", "", "one", "One", "two words", "äöü ß", "a" * 300, "a" * 260, " \n\t ", "x" * 49, "x" * 50, "x" * 50, "é" * 40, "y" + "é" * 40]
    out = [*family, *family[:5], *shared, *odd, prose(r, 4000), *[prose(r, r.randint(1, 80)) for _ in range(40)]]
    r.shuffle(out)
    return list(enumerate(out, 100))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "p", "r", "v", "l") for i, t in texts], DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text, pattern=rb"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").encode().translate(LOWER))


def brute_repeats(texts):
    first, out = {}, {}
    rows = sorted((d, (t or "").encode()) for d, t in texts)
    for d, b in rows:
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    for d, b in rows:
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = [True] * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_suffix_dedup(docs, texts, empty, monkeypatch):
    want = brute_repeats(texts)
    assert any(w[1] for w in want.values())
    for size in (8 << 20, 4000):  # one group, and many
        monkeypatch.setattr(suffix, "GROUP_BYTES", size)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeats(docs).collect()}
        assert got == want
    assert suffix.repeats(empty).collect() == []


def test_suffix_dedup_bounds_the_passages_of_a_hot_key(spark, monkeypatch):
    """A short line among ever other words is the least gram of one passage per document; no bucket gets them all."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    line = "Please recycle this page after use, thanks"
    hot = [f"{word()} {word()} {word()} {word()}\n{line}\n{word()} {word()} {word()} {word()}" for _ in range(600)]
    texts = list(enumerate([*hot, *hot[:5], *[f"{word()}{h[30:-30]}{word()}" for h in hot[:20]]]))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute_repeats(texts)
    assert sum(w[1] > 0 for w in want.values()) >= 25
    for size in (8 << 20, 8000):
        monkeypatch.setattr(suffix, "GROUP_BYTES", size)
        monkeypatch.setattr(suffix, "KEY_BYTES", 5000)
        got = {row.doc_id: (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) for row in suffix.repeats(docs).collect()}
        assert got == want
    dealt = docs.withColumn("g", docs.doc_id % 11)
    passages, heavy = suffix._sent(dealt, "g", 11)
    assert heavy.select("pid").distinct().count() == 11
    sent = sum(len(row.uids) // 8 for row in passages.collect())
    assert 0 < sent < 0.3 * 600 * 31  # windows that one document alone has aren't sent
    monkeypatch.setattr(suffix, "KEY_BYTES", 1 << 20)
    assert suffix._sent(dealt, "g", 11)[1].count() == 0


def test_suffix_trimmed_keeps_columns_and_rows_without_id(spark):
    text = "0123456789" * 6
    rows = [(None, text, "a"), (1, text, "b"), (2, "pre " + text, "c"), (2, text, "d")]
    got = suffix.trimmed(spark.createDataFrame(rows, "doc_id long, text string, pid string"))
    assert sorted((r.doc_id or 0, r.text, r["pid"]) for r in got.collect()) == [(0, text, "a"), (1, text, "b"), (2, "", "d"), (2, "pre ", "c")]


def brute_components(texts, size):
    sets = {}
    for d, t in texts:
        w = words_of(t)
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    label = {d: d for d in sets}
    ids = [d for d in sets if sets[d]]
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(label[a], label[b])
            moved |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {d: (len(sets[d]), label[d], label[d] == d) for d in sets}


@pytest.mark.parametrize(("size", "long", "block"), [(2, 32, 4 << 20), (2, 3, 4 << 20), (5, 3, 4 << 20), (2, 3, 3000), (5, 3, 3000)])
def test_near_duplicates(docs, texts, size, long, block, monkeypatch):
    monkeypatch.setattr(minhash, "LONG", long)  # 3: nearly all lists of the family are long ones
    monkeypatch.setattr(minhash, "BLOCK_BYTES", block)  # 3000: a few sets each
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, size).collect()}
    assert got == brute_components(texts, size)


def test_families_of_unlinked_members(spark, monkeypatch):
    """Members that share a base but mostly aren't linked with each other, of several sizes; some pairs are."""
    monkeypatch.setattr(minhash, "LONG", 3)
    monkeypatch.setattr(minhash, "HUBS", 1)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 20_000)
    r = random.Random(12)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(70):
        w = base[: r.choice((60, 75, 90))]
        for _ in range(9):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((2 * i, " ".join(w)))
        if i % 5 == 0:
            w[3] = f"y{i}"
            rows.append((2 * i + 1, " ".join(w)))
    got = {g.doc_id: (g.n_shingles, g.component_id, g.kept) for g in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    want = brute_components(rows, 2)
    assert got == want and 20 < sum(k for _, _, k in want.values()) < len(rows)


def test_near_duplicates_odd_tables(spark, empty):
    assert minhash.near_duplicates(empty).collect() == []
    rows = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, "a b c"), (4, "A  b c"), (4, "A  b c")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in minhash.near_duplicates(rows, 2).collect())
    assert got == [(0, None, True), (0, None, True), (3, 3, True), (4, 3, False), (4, 3, False)]
    assert sorted(r.doc_id or 0 for r in minhash.distinct_documents(rows, 2).collect()) == [0, 0, 3]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


@pytest.mark.parametrize("limit", [1 << 20, 300])  # in one part, and in several
def test_decontamination(spark, docs, texts, limit):
    bodies = [t for _, t in texts if t and len(t) > 300]
    pattern = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    cut = lambda t, i, n: " ".join(t.split()[i : i + n])
    items = [(1, cut(bodies[0], 5, 14)), (2, cut(bodies[1], 0, 10).upper()), (3, "two WORDS!"), (4, None), (5, ""), (6, cut(bodies[0], 5, 14)), (None, cut(bodies[2], 3, 12)), (7, "absent " * 12)]
    known = []
    for item, t in items:
        w = words_of(t, pattern)
        n = min(10, len(w))
        known += [(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    want = {}
    for d, t in texts:
        w = words_of(t, pattern)
        hit, found = set(), set()
        for item, k in known:
            for i in range(len(w) - len(k) + 1):
                if tuple(w[i : i + len(k)]) == k:
                    hit |= set(range(i, i + len(k)))
                    found.add(item)
        names = sorted(str(i) for i in found if i is not None)
        want[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.decontaminate(docs, benchmark, broadcast_bytes=limit).collect()}
    assert got == want and sum(w[4] for w in want.values()) > 3
    left = decontaminate.remove(docs, benchmark, broadcast_bytes=limit)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(d for d in want if not want[d][4])
    none = decontaminate.decontaminate(docs, benchmark.limit(0), broadcast_bytes=limit).collect()
    assert len(none) == len(texts) and not any(r.contaminated for r in none)


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_decontamination_judges_each_row_by_itself(spark, limit):
    """Repeated ids, no ids, equal texts and clashing columns: the same whatever the benchmark's size."""
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, item, "a", 1), (1, "clean", "b", 2), (None, f"so {item}", "c", 3), (None, "clean", "d", 4), (2, "clean", "e", 5), (2, "clean", "e", 5), (3, None, "f", 6), (4, "x the y", "g", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, contaminated string, __contaminated long")
    items = spark.createDataFrame([(7, item), (7, item), (8, item), (9, "The"), (None, "y")], "item_id long, text string")
    left = decontaminate.remove(docs, items, broadcast_bytes=limit)
    assert left.columns == docs.columns
    assert sorted(r["__contaminated"] for r in left.collect()) == [2, 4, 5, 5, 6]
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in decontaminate.decontaminate(docs, items, broadcast_bytes=limit).collect())
    assert got == [(0, 1, 0, 0), (0, 12, 11, 2), (1, 1, 0, 0), (1, 11, 11, 2), (2, 1, 0, 0), (2, 1, 0, 0), (3, 0, 0, 0), (4, 3, 2, 1)]


def test_long_items_are_cut_into_overlapping_parts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_WORDS", 7)
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "")], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(words[i : i + 10])) for i in range(31)] + [(99, " ".join(words[:9]))], "doc_id long, text string")
    got = {r.doc_id: r.n_hit for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {**{i: 10 for i in range(31)}, 99: 0}


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    """Were all hashes equal, the comparison of the texts alone would decide."""
    import pyarrow as pa

    monkeypatch.setattr(decontaminate, "window_hashes", lambda h, size: np.zeros(max(0, len(h) - size + 1), np.uint64))
    known = decontaminate.Windows([(1, "a b c"), (2, "b c d"), (3, "a b c"), (4, "c")], 3)
    block = next(decontaminate.blocks(pa.RecordBatch.from_arrays([pa.array(["z a b c z", "b c x", "b  C,d"])], ["text"])))
    *_, marked, items = decontaminate.hits(block, known)
    assert marked.tolist() == [False, True, True, True, False, False, True, False, True, True, True]
    assert items == [[0, 2, 3], [3], [1, 3]]


def test_licences(spark, empty):
    mit = licenses.TEMPLATES["MIT/2"]
    rows = [
        (1, f"Some text.\nReleased under the MIT License.\nMore of it"),
        (2, "intro\n\n" + mit.replace(", ", ",\n") + "\n\nend"),
        (3, None),
        (4, ""),
        (5, "this work is LICENSED under the gnu general public license, version 3\n\nLicensed under CC BY 4.0."),
        (6, "the license is here and there, under any version"),
        (7, "word"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].license_id, got[1].dice, got[1].n_units) == ("MIT", 1.0, 4)
    assert got[2].license_id == "MIT" and got[2].dice == 1.0
    assert got[5].licenses == "CC-BY-4.0,GPL-3.0" and got[5].n_matches == 2
    assert all(got[i].n_matches == 0 and got[i].license_id is None for i in (3, 4, 6, 7))
    assert licenses.scan(empty).collect() == []


def test_licences_across_lines_and_within_prose(spark):
    full = {n.split("/")[0]: t for n, t in licenses.full_texts().items()}
    one = " ".join(full["MIT"].split())
    spread = full["BSD-2-Clause"]
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + one),
        (2, " ".join(full["ISC"].split())),
        (3, "Some words before.\n\n" + spread.replace(". ", ".\n\n") + "\n\nand after it"),
        (4, "The parts of this collection are all Released under the MIT License. They were gathered by hand over many long years."),
        (5, full["BSD-3-Clause"]),
        *[(10 + i, f"intro of a few words\n{full[n]}\noutro") for i, n in enumerate(("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "Unlicense"))],
        (20, "a license of the software is granted to the public under terms that no one has read"),
    ]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {1: "MIT", 2: "ISC", 3: "BSD-2-Clause", 4: "MIT", 5: "BSD-3-Clause", 10: "Apache-2.0", 11: "GPL-2.0", 12: "GPL-3.0", 13: "LGPL-3.0", 14: "MPL-2.0", 15: "Unlicense", 20: None}
    assert got == want


def test_licences_by_identifier_heading_and_conditions(spark):
    names = sorted({n.split("/")[0] for n in licenses.TEMPLATES})
    rows = [(i, f"#!/bin/sh\n# SPDX-License-Identifier: {n}\necho some other words") for i, n in enumerate(names)]
    three, two = licenses.TEMPLATES["BSD-3-Clause/2"], licenses.TEMPLATES["BSD-2-Clause/1"]
    rows += [(50, three.replace(" 2. ", "\n\n 2. ").replace(" 3. ", "\n\n 3. ")), (51, two.replace(" 2. ", "\n\n 2. ")), (52, "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n"), (53, "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007")]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict(enumerate(names)), 50: "BSD-3-Clause", 51: "BSD-2-Clause", 52: "GPL-3.0", 53: "LGPL-3.0"}


def test_no_licence_from_a_phrase_or_another_identifier(spark):
    others = ["Zlib", "AGPL-3.0-only", "EPL-2.0", "BSL-1.0", "LGPL-2.1-or-later", "Artistic-2.0", "ISCX"]
    rows = [(i, f"// SPDX-License-Identifier: {n}") for i, n in enumerate(others)]
    rows += [
        (20, "See the SPDX license identifier field in the manual"),
        (21, "Licensed under the Apache License, Version 1.1"),
        (22, "This work is licensed under the GNU Affero General Public License, version 3."),
        (23, "This work is licensed under the GNU Lesser General Public License, version 2.1."),
        (24, licenses.TEMPLATES["MPL-2.0/1"].replace("v. 2.0", "v. 1.1").replace("MPL/2.0", "MPL/1.1")),
        (25, licenses.full_texts()["GPL-3.0/full"].replace("GNU General", "GNU Affero General").replace("GNU GENERAL", "GNU AFFERO GENERAL").replace("29 June 2007", "19 November 2007")),
        (26, licenses.TEMPLATES["GPL-3.0/2"].replace("version 3", "version 4")),
        (30, "SPDX-License-Identifier: MIT OR Zlib"),
        (31, "see Licensed under the Apache License, Version 2.0, and more"),
        (32, licenses.TEMPLATES["GPL-3.0/2"].replace("free software", "a free software")),
    ]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys([*range(len(others)), *range(20, 27)]) | {30: "MIT", 31: "Apache-2.0", 32: "GPL-3.0"}


def test_licence_windows_equal_all_windows():
    """Made-up texts of licence words: the best window from each place of a template's bigrams, among all of admissible size."""
    r = random.Random(8)
    templates = {"A-1.0/1": "a b c d e f g h i j k l", "A-1.0/2": "a b c", "GPL-3.0/1": "x gnu general public license version 3 y z w v u t", "B/spdx": "spdx license identifier b"}
    known, threshold = licenses.Templates(templates), licenses.THRESHOLD
    vocabulary = " ".join(templates.values()).split()
    pairs = lambda ws: [" ".join(p) for p in zip(ws, ws[1:])]
    found = 0
    for _ in range(400):
        ws = []
        while len(ws) < r.randint(4, 40):
            source = r.choice(list(templates.values())).split()
            a = r.randrange(len(source))
            ws += source[a : a + r.randint(1, 12)] if r.random() < 0.8 else [r.choice(vocabulary)]
        own = pairs(ws)
        hashes = np.array([licenses._bigrams(p)[0] for p in own])
        got = licenses.windows(hashes, np.ones(len(own), bool), np.flatnonzero(known.has(hashes)), known, threshold)
        want = []
        for name in sorted(templates):
            theirs, needed = set(pairs(templates[name].split())), set(licenses.needed_bigrams(name, templates[name]))
            for a in (i for i, p in enumerate(own) if p in theirs):
                sizes = range(a + 1, min(len(own), a + int((2 - threshold) * len(theirs) / threshold + 1e-9)) + 1)
                dice = [(2 * len(theirs & set(own[a:b])) / (len(theirs) + len(set(own[a:b]))), -b) for b in sizes if needed <= set(own[a:b])]
                if dice and max(dice)[0] >= threshold:
                    want.append((name, max(dice)[0], a, -max(dice)[1], len(theirs)))
        assert sorted(got) == sorted(want)
        found += len(got)
    assert found > 100


def test_licences_take_odd_rows(spark):
    rows = [(1, "Released under the MIT License.", "x"), (1, "Released under the MIT License.", "x"), (None, "Released under the MIT License.", "y"), (None, None, "z")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license_id string")).collect()
    assert sorted((str(g.doc_id), g.license_id or "") for g in got) == [("1", "MIT"), ("1", "MIT"), ("None", ""), ("None", "MIT")]


def test_neighbours_recall_and_cases(spark, monkeypatch):
    r = np.random.default_rng(2)
    monkeypatch.setattr(neighbours, "LIST_ROWS", 100)  # several leading bits, and long lists in parts
    x = r.normal(size=(1500, 16)).astype(np.float32)
    x[200:260] = x[200]
    x[700:1000] = x[700] + r.normal(size=(300, 16)) * 1e-4
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2050, [0.0] * 16), (2100, [1.0] * 15 + [None]), (2150, [float("nan")] * 16), (2200, [1.0] * 3), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = neighbours.search(table, F.col("id") % 50 == 0).collect()
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    hits = 0
    for q in range(0, 1500, 50):
        s = y @ y[q]
        s[q] = -9
        want = sorted(range(1500), key=lambda i: (-round(s[i], 12), i))[:5]
        mine = [(g.rank, g.vec_id, g.score) for g in sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)]
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(s[i] - c) < 1e-12 for _, i, c in mine)
        hits += len({m[1] for m in mine} & set(want))
        if q == 200:
            assert [m[1] for m in mine] == [201, 202, 203, 204, 205]
    assert hits >= 0.9 * 5 * 30 and {g.query_id for g in got} == set(range(0, 1500, 50))
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (51, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((g.query_id, g.rank, g.vec_id) for g in neighbours.search(few, F.col("id") % 50 == 0).collect()) == [(0, 1, 51), (0, 2, 50), (50, 1, 51), (50, 2, 0)]
    assert neighbours.search(few.limit(0), F.col("id") % 50 == 0).collect() == []


def test_probing_retrieves_every_code_within_its_guarantee():
    """Multi-index probing against all codes: nothing within the pigeonhole's distance is missed, and it prunes."""
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 32))
    coder = neighbours.Coder(x, 5, len(x))
    codes = coder.codes(x)
    values = coder.values(codes)[:, : coder.used]
    text = ["".join(f"{w:064b}" for w in row) for row in codes[:5].tolist()]
    assert [[int(t[j * coder.width : (j + 1) * coder.width], 2) for j in range(coder.used)] for t in text] == values[:5].tolist()
    visited = []
    for q in range(50):
        found = (neighbours.bits_of(values ^ values[q]) <= coder.reach).any(1)
        away = neighbours.bits_of(codes ^ codes[q]).sum(1)
        assert found[away <= coder.used * (coder.reach + 1) - 1].all()
        visited.append(found.mean())
    assert np.mean(visited) < 0.7 and abs(np.mean(visited) - coder.share) < 0.1
    assert sorted(neighbours.masks(6, 2).tolist()) == [v for v in range(64) if bin(v).count("1") <= 2]


def test_neighbours_take_odd_tables(spark):
    rows = [(50, [1.0, 0.0], 9), (50, [1.0, 0.0], 9), (100, [1.0, 0.0], 9), (3, [1.0, 0.0], 9), (4, [2.0, 0.0], 9), (5, [-1.0, 0.0], 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long")
    got = sorted((g.query_id, g["rank"], g.vec_id, round(g.score, 9)) for g in neighbours.search(table.drop("id"), F.col("id") % 50 == 0).collect())
    assert got == [(50, 1, 3, 1.0), (50, 2, 4, 1.0), (50, 3, 100, 1.0), (50, 4, 5, -1.0), (100, 1, 3, 1.0), (100, 2, 4, 1.0), (100, 3, 50, 1.0), (100, 4, 5, -1.0)]
    one = spark.createDataFrame([(0, [1.0]), (None, [2.0])], "vec_id long, embedding array<double>")
    assert neighbours.search(one, F.col("id") % 50 == 0).collect() == []


def test_sharding(docs, texts, empty):
    got = sharding.shard(docs, shards=7).collect()
    assert sorted(r.doc_id for r in got) == [d for d, _ in texts]
    text = dict(texts)
    for r in got:
        t = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 16, zlib.crc32(t), "rows", None)
    counts = Counter(r.shard for r in got)
    assert set(counts) <= set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    groups = {}
    for r in got:
        if text[r.doc_id] is not None:
            groups.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(g) == 1 for g in groups.values())
    size = Counter(t for t in text.values() if t is not None)
    assert all(r.linked == r.linked_here == (size[text[r.doc_id]] - 1 if text[r.doc_id] is not None else 0) for r in got)
    assert sharding.shard(empty).collect() == []


def test_propagation_equals_plain_rounds(spark):
    """Rounds of requests and admissions in plain Python; no shard ever takes more than its capacity."""
    r = random.Random(11)
    state = {}
    for g in range(60):
        for label in r.sample(range(5), r.randint(1, 5)):
            state[bytes([g]), label] = r.randint(1, 9) if g else 60
    capacity = sum(state.values()) // 5
    rows = spark.createDataFrame([(g, s, n) for (g, s), n in state.items()], "g binary, label int, n long").repartition(3)
    got = {(bytes(x.g), x.label): x.n for x in sharding.propagate(rows, capacity, 4, 5).collect()}
    for _ in range(4):
        load = {s: sum(n for (_, x), n in state.items() if x == s) for s in range(5)}
        room = {s: capacity - load[s] for s in range(5) if capacity > load[s]}
        asked = []
        for (g, label), n in state.items():
            best = max(((m, -s) for (h, s), m in state.items() if h == g and s in room), default=None)
            if best and (best[0] > n or best[0] == n and -best[1] < label):
                asked.append((n - best[0], g, label, -best[1], n))
        for _, g, label, to, n in sorted(asked):
            moved = min(n, room[to])
            room[to] -= moved
            state[g, label] -= moved
            state[g, to] = state.get((g, to), 0) + moved
        state = {k: n for k, n in state.items() if n}
        after = {s: sum(n for (_, x), n in state.items() if x == s) for s in range(5)}
        assert all(after[s] <= max(capacity, load[s]) for s in range(5))
    assert got == state


def test_sharding_takes_odd_rows(spark):
    rows = [(1, "a", 5), (1, "a", 5), (None, "a", 5), (None, None, 5), (2, "", 5), (3, "", 5)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, shard int"), shards=4).collect()
    assert sorted(str(g.doc_id) for g in got) == ["1", "1", "2", "3", "None", "None"] and sorted(Counter(g.shard for g in got).values()) == [1, 1, 2, 2]
    assert sorted(g.linked for g in got) == [0, 1, 1, 2, 2, 2]


def test_sharding_cuts_only_groups_that_do_not_fit(spark):
    rows = spark.createDataFrame([(i, "same" if i < 60 else f"t{i // 2}" if i < 100 else f"s{i}") for i in range(200)], "doc_id long, text string")
    got = sharding.shard(rows, shards=4).collect()
    assert Counter(r.shard for r in got) == {s: 50 for s in range(4)}
    by_text = {}
    for r in (r for r in got if r.doc_id < 100):
        by_text.setdefault("same" if r.doc_id < 60 else r.doc_id // 2, set()).add(r.shard)
    assert sum(len(s) > 1 for k, s in by_text.items() if k != "same") <= 2
    text = {r.doc_id: "same" if r.doc_id < 60 else f"t{r.doc_id // 2}" if r.doc_id < 100 else f"s{r.doc_id}" for r in got}
    here = Counter((text[r.doc_id], r.shard) for r in got)
    assert all(r.linked_here == here[text[r.doc_id], r.shard] - 1 for r in got)
    assert 2 * 50 * 10 <= sum(r.linked - r.linked_here for r in got if text[r.doc_id] == "same") <= 2 * 40 * 20


def test_packing_round_trip(docs, texts, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_paths()[0])
    got = packing.pack(docs).collect()
    pieces, windows = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    for d, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : at], "<u4").tobytes())
        assert at == len(ids)
    for rows in windows.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and {r.sequence_tokens for r in rows} == {at}
    assert packing.pack(empty).collect() == []


def test_texts_beyond_a_block(spark):
    """Texts of more than a block's bytes, uniform ones too, beside short ones: each operator takes them whole."""
    r = random.Random(1)
    long = prose(r, 200_000)
    assert len(long) > 1 << 20
    rows = [(1, long, "en"), (2, "short words " * 3, "de"), (3, "z" * 3_000_000, "fr"), (4, long + " end of it", "en"), (5, "q" + "z" * 3_000_000, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {g.doc_id: g for g in suffix.repeats(docs).collect()}
    assert [got[i].n_removed for i in (1, 2, 3, 4, 5)] == [0, 0, 0, len(long), 3_000_000] and got[4].kept_sha256 == hashlib.sha256(b" end of it").hexdigest()
    assert {g.doc_id: g.component_id for g in minhash.near_duplicates(docs, 2).collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5}
    item = " ".join(long.split()[150_000:150_011])
    found = decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {g.doc_id: (g.n_words, g.n_hit) for g in found} == {1: (200_000, 11), 2: (6, 0), 3: (1, 0), 4: (200_003, 11), 5: (1, 0)}
    assert {g.doc_id: g.n_tokens for g in scoring.score(docs).collect()} == {1: 200_001, 2: 7, 3: 2, 4: 200_004, 5: 2}
    assert {g.doc_id: g.n_units for g in licenses.scan(docs).collect()} == {i: 1 for i in range(1, 6)}
    assert sum(g.length for g in packing.pack(docs.where("doc_id < 3")).collect()) > 200_000
    assert quality.classify(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")).count() == 5
    assert language.identify(docs).count() == 5


def test_packing_keeps_large_ids_beside_null_ones(spark):
    ids = [9007199254740993, 9007199254740995, None, None, -5]
    docs = spark.createDataFrame([(i, "some words here") for i in ids], "doc_id long, text string").coalesce(1)
    assert sorted(packing.pack(docs).collect(), key=str) and sorted(str(r.doc_id) for r in packing.pack(docs).collect()) == sorted(map(str, ids))


SCRIPTS = "aZ09 _-.,'\"\n\t\r\u00a0\u3000\u200d éßŁźñ çŒ Жщя Ωλ שלום عرب हिन्दी ไทย 한국어 日本語 カナ \U0001f600\U0001f468\u0301 ½² ©™ <|endoftext|>"


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=400), st.text(alphabet=SCRIPTS, max_size=400), st.builds(lambda t, n: t * n, st.text(max_size=6), st.integers(0, 800))))
def test_both_tokenizers_agree_on_any_text(text):
    fast, slow = packing.encoder(*packing.default_paths()), packing.encoder(packing.default_paths()[0], None)
    text = text.encode("utf-8", "ignore").decode()
    assert fast(text).tolist() == slow(text).tolist()


@pytest.mark.parametrize("unit", ["word ", "x", " ", "日本", "a1 b2, c3!\n", "\n \t"])
@pytest.mark.parametrize("size", [packing.LONG_TEXT - 1, packing.LONG_TEXT, packing.LONG_TEXT + 1])
def test_both_tokenizers_agree_around_the_limit(unit, size):
    fast, slow = packing.encoder(*packing.default_paths()), packing.encoder(packing.default_paths()[0], None)
    text = (unit * size)[:size]
    assert fast(text).tolist() == slow(text).tolist()


def test_both_tokenizers_agree():
    fast, slow = packing.encoder(*packing.default_paths()), packing.encoder(packing.default_paths()[0], None)
    for t in ["", "a  b\n\n c\t", "it's 123 äöü ß x <|endoftext|> y", "日本語 \U0001f600!!", "\r\n \x00 x" + " " * 50 + "z", "word" * 200]:
        assert fast(t).tolist() == slow(t).tolist()


def test_quality(spark, empty):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(700):
        bad = i % 4 == 0
        t = " ".join(w.upper() + "!!" if bad else w for w in prose(r, r.randint(5, 150)).split())
        rows.append((i, t))
        labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(rows + [(9000, None), (9001, ""), (None, "x")], "doc_id long, text string")
    marks = spark.createDataFrame(labels + labels[:9] + [(9100, 1), (3, None)], "doc_id long, quality int")
    got = {g.doc_id: g for g in quality.classify(docs, marks).collect()}
    assert len(got) == 703 and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in got.values())
    assert all(g.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, g in got.items() if i is not None) and got[None].held_out is False
    held = [i for i in range(700) if got[i].held_out]
    assert sum(got[i].predicted == (i % 4 != 0) for i in held) >= 0.97 * len(held)
    assert quality.classify(empty, marks).collect() == []
    assert {g.score for g in quality.classify(docs, marks.limit(0)).collect()} == {0.5}


def test_long_labelled_texts_are_learned_from(spark):
    """Labelled texts of many passages are learned from whole; beyond the sample's bytes some are left out."""
    r = random.Random(3)
    rows = [(i, " ".join((w.upper() if i % 2 else w) for w in prose(r, 64 * 12).split()), "de" if i % 2 else "fi") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.classify(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int"), sample_bytes=150_000).collect()
    assert all(g.predicted == g.doc_id % 2 for g in got)
    none = quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int"), F.lit(True), sample_bytes=4000)
    assert not none.trained


def test_attention_model_equals_plain_loops():
    """The forward pass and the gradient of the model against one passage at a time and finite differences."""
    r = np.random.default_rng(1)
    m = quality.Model()
    m.mean, m.scale = r.normal(size=quality.FEATURES).astype(np.float32), r.uniform(0.5, 2, quality.FEATURES).astype(np.float32)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    m.p["bo"][0], m.p["be"][:] = 0.3, r.normal(size=quality.HIDDEN)
    x, sizes = r.normal(size=(9, quality.FEATURES)), [3, 1, 5]
    first, y = np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    want, at = [], 0
    for n in sizes:
        h = [np.tanh((p - m.mean) * m.scale @ m.p["we"] + m.p["be"]) for p in x[at : at + n]]
        e = [float((np.tanh(q @ m.p["v"]) * sigmoid(q @ m.p["u"])) @ m.p["w"]) for q in h]
        a = np.exp(e) / np.exp(e).sum()
        want.append(float(sum(w * q for w, q in zip(a, h)) @ m.p["wo"] + m.p["bo"][0]))
        at += n
    assert np.allclose(m.forward(x, first)[-1], want)
    m.trained = True
    assert np.allclose(m.score(x, np.array(sizes)), sigmoid(np.array(want)))
    loss = lambda: float(np.mean(np.logaddexp(0, m.forward(x, first)[-1]) - y * m.forward(x, first)[-1]))
    for name, g in m.gradient(x, first, y).items():
        flat, i = m.p[name].reshape(-1), int(r.integers(m.p[name].size))
        old, step = flat[i], 1e-5
        flat[i] = old + step
        up = loss()
        flat[i] = old - step
        assert abs((up - loss()) / (2 * step) - g.reshape(-1)[i]) < 1e-6
        flat[i] = old


def test_language_votes_equal_plain_loops():
    r = np.random.default_rng(6)
    names = ["de", "en", "fi", "hu", "xx"]
    x = r.random((200, language.WIDTH)).astype(np.float32)
    spoken = [names[i % 5] for i in range(200)]
    for i, n in enumerate(spoken):
        x[i, names.index(n) * 7] += 3
    m = language.Machines(x, spoken)
    got, score = m.predict(x[:20])
    for i in range(20):
        v = np.append(x[i], 1)
        margins = {f: float(v @ m.by_family[:, j]) for j, f in enumerate(m.families)}
        f = max(margins, key=margins.get)
        own = [n for n in names if language.family(n) == f]
        votes = {n: 0.0 for n in own}
        for (a, b), w in m.pairs.items():
            if a in votes:
                p = 1 / (1 + np.exp(-8 * float(v @ w)))
                votes[a] += p + len(own) * (p >= 0.5)
                votes[b] += 1 - p + len(own) * (p < 0.5)
        assert got[i] == max(sorted(votes), key=votes.get) and 0 <= score[i] <= 1


def test_classifiers_take_odd_rows(spark):
    """Repeated ids, rows without id, equal rows and clashing columns change nothing for the others."""
    rows = [(1, "good words here", "de", 0.1), (1, "good words here", "de", 0.1), (None, "x y", None, 0.2), (None, None, "fi", 0.3), (2, "", "fi", 0.4), (9, "MORE", "fi", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3)
    marks = spark.createDataFrame([(1, 1), (9, 0), (9, 0), (None, 1)], "doc_id long, quality int")
    assert sorted(str(g.doc_id) for g in quality.classify(docs, marks).collect()) == ["1", "1", "2", "9", "None", "None"]
    assert sorted(str(g.doc_id) for g in language.identify(docs).collect()) == ["1", "1", "2", "9", "None", "None"]
    model = quality.train(docs, marks, F.lit(True))
    kept = quality.accepted(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == 6


def test_language(spark, empty):
    r = random.Random(4)
    syllables = {"de": "sch ung ein lich keit auf", "en": "the ing tion and wh ou", "fr": "eau eux oi ment ç è", "es": "ción ado ñ mente os ll", "fi": "kk ää yy sta lla nen"}
    rows = []
    for i in range(600):
        lang = sorted(syllables)[i % 5]
        rows.append((i, " ".join("".join(r.choices(syllables[lang].split(), k=3)) for _ in range(r.randint(3, 60))), lang))
    docs = spark.createDataFrame(rows + [(900, None, "de"), (901, "", "en"), (902, "12 + 3 = …", None), (903, "日本", None)], "doc_id long, text string, lang string")
    got = {g.doc_id: g for g in language.identify(docs).collect()}
    held = [x for x in rows if got[x[0]].held_out]
    assert len(held) > 80 and sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.97 * len(held)
    assert all(0 <= g.score <= 1 for g in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred in syllables
    assert language.identify(empty.withColumn("lang", F.lit("de"))).collect() == []
    assert {g.lang_pred for g in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_scoring(spark, docs, texts, empty):
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in texts}
    words = {d: [*words_of(t), None] for d, t in texts}
    count = Counter(w for d in words if not held[d] for w in words[d])
    total, distinct = sum(count.values()), len(count)
    got = {r.doc_id: r for r in scoring.score(docs).collect()}
    assert set(got) == set(words)
    for d, w in words.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w), sum(count[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(np.log10((count[x] + 1) / (total + distinct + 1)) for x in w), rel=1e-9)
        assert r.score < 0
    assert scoring.score(empty).collect() == []
    assert all(r.n_known == 0 for r in scoring.score(docs, F.lit(True)).collect())


def test_scoring_beats_counts_alone(spark):
    r = random.Random(8)
    kinds = [[a + b for a in "bdg" for b in ("ao", "ue", "ii")], [a + b for a in "kpt" for b in ("xn", "yr", "zs")]]
    rows = [(i, " ".join(r.choices(kinds[i % 2], k=200))) for i in range(400)]
    got = scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert len(got) > 30 and sum(g.score for g in got) > 0.9 * sum(g.base_score for g in got)


def test_scoring_tells_words_of_a_class_apart(spark):
    """Words of the same last bytes, so of one class: only what goes before tells which of them follows."""
    r = random.Random(2)
    names = [f"{a}{b}ing" for a in "bdfgklmnprst" for b in "aeiou"]
    after = {n: r.sample(names, 2) for n in names}
    rows = []
    for i in range(500):
        w = [r.choice(names)]
        while len(w) < 60:
            w.append(r.choice(after[w[-1]]))
        rows.append((i, " ".join(w)))
    got = scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    tokens = sum(g.n_tokens for g in got)
    assert (sum(g.score for g in got) - sum(g.base_score for g in got)) / tokens > 0.7  # log10: 60 words to 2 are 1.5


def test_scoring_takes_odd_rows(spark):
    rows = [(1, "a b c", 0.1), (1, "a b c", 0.2), (None, "a b", 0.3), (None, None, 0.4), (2, "", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = sorted((str(g.doc_id), g.n_tokens, g.train_tokens) for g in scoring.score(docs).collect())
    train = sum(n for i, n in (("1", 4), ("1", 4), ("None", 3), ("None", 1), ("2", 1)) if i == "None" or zlib.crc32(i.encode()) % 7 != 2)
    assert got == [("1", 4, train), ("1", 4, train), ("2", 1, train), ("None", 1, train), ("None", 3, train)]


def test_columns_of_any_name_go_along(spark):
    names = ["gone", "_gone", "__gone", "group", "__zoneload_group", "kept", "component", "text2"]
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(i, text + f" x{i}", *[f"{n}{i}" for n in names]) for i in range(3)], ["doc_id", "text", *names])
    kept = minhash.distinct_documents(docs).collect()
    assert [(r.doc_id, *[r[n] for n in names]) for r in kept] == [(0, *[f"{n}0" for n in names])]
    cut = sorted(suffix.trimmed(docs).collect())
    assert [tuple(r[n] for n in names) for r in cut] == [tuple(f"{n}{i}" for n in names) for i in range(3)]
    assert cut[0].text == text + " x0" and len(cut[1].text) < 10


def test_rows_without_id_are_spread_over_groups(spark, monkeypatch):
    """All ids null: no group holds more than its share, and results are those of each row alone."""
    from zoneload.llm._exchange import dealt

    rows = [(None, f"some words of row {i % 7}. " * 8) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    groups, name, n = dealt(docs, 4000)
    sizes = [r["count"] for r in groups.groupBy(name).count().collect()]
    assert n > 15 and len(sizes) == n and max(sizes) < 4 * len(rows) / n
    for module in (suffix, scoring):
        monkeypatch.setattr(module, "GROUP_BYTES", 4000)
    cut = suffix.repeats(docs).collect()
    assert len(cut) == 400 and not any(r.n_removed for r in cut)
    scored = scoring.score(docs).collect()
    words = Counter(w for _, t in rows for w in [*t.split(), None])
    base = lambda t: sum(math.log10((words[w] + 1) / (sum(words.values()) + len(words) + 1)) for w in [*t.split(), None])
    assert sorted(round(r.base_score, 6) for r in scored) == sorted(round(base(t), 6) for _, t in rows) and {(r.n_tokens, r.n_known) for r in scored} == {(41, 41)}
    packed = packing.pack(docs, capacity=64, piece=16).collect()
    by_window = Counter()
    for r in packed:
        by_window[r.sequence_id] += r.length
    assert max(by_window.values()) <= 64 and sum(by_window.values()) == sum(r.length for r in packed)


def test_averages_in_levels_equal_one_average(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(scoring, "FAN_IN", 3)
    ddl = "part int, salt int, mass binary, change binary"
    r = np.random.default_rng(4)
    rows = [(part, salt, r.random(4).astype(np.float32), r.random(4).astype(np.float32)) for part in range(2) for salt in range(20) if salt != 7]

    def average(group):
        mass = np.stack([np.frombuffer(x.as_buffer(), np.float32) for x in group["mass"].combine_chunks()])
        change = np.stack([np.frombuffer(x.as_buffer(), np.float32) for x in group["change"].combine_chunks()])
        assert len(mass) <= 3
        mean = (mass * change).sum(0) / mass.sum(0)
        return pa.table({"part": group["part"][:1], "salt": group["salt"][:1], "mass": [mass.sum(0).tobytes()], "change": [mean.astype(np.float32).tobytes()]})

    table = spark.createDataFrame([(p, s, bytearray(m.tobytes()), bytearray(c.tobytes())) for p, s, m, c in rows], ddl)
    got = {x.part: np.frombuffer(bytes(x.change), np.float32) for x in scoring.averaged(table, 20, average, ddl).collect()}
    for part in range(2):
        own = [x for x in rows if x[0] == part]
        want = sum(m * c for _, _, m, c in own) / sum(m for _, _, m, _ in own)
        assert np.allclose(got[part], want, atol=1e-5)
