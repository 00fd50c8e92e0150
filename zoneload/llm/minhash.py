"""Near duplicates by bottom-k sketches from one hash function.

A document's set is its distinct shingles of ``size`` words, as 64-bit hashes; its sketch, the ``SKETCH`` smallest.
Documents with equal sets form a class and are compared once. ``RUN`` neighbouring values of a sketch make one key, and
keys of two classes or more make inverted lists; a list generates overlaps, the union's sketch estimates the Jaccard
coefficient of a pair and drops what is far below the threshold, and the full sets of the rest decide.

Why runs. Of two sets at the threshold (0.8), the union has four values in five in common: among its first 66, no four in
sequence are with a probability below 1e-6, and four in sequence are neighbours in both sketches. Where a sketch is the
whole set, d values that one side lacks leave at least 4 d common ones, so there always is such a run, but in sets of up to
15 values (three, for certain) and 5 (two), which are listed by shorter runs as well. A word pair that a tenth of all
documents have makes a list of as many; a run of four, one of those that have all four next to each other. So with a
vocabulary that doesn't grow, lists grow with what is alike, hardly with the documents.

Classes in lists beyond ``LONG`` are crowded: families of near copies, but also short texts of frequent words. Any pair of
them that shares a long list meets again by ``BANDS`` keys, each of ``ROWS`` minima of independent hashes of the full
sets: at the threshold none agrees with a probability below 1e-6, at a similarity of 0.2 one in 46 x 0.2 ^ 6. Of these
lists the short ones generate overlaps as above. In long ones, all are first verified against one member, and then only
those outside the list's largest component are compared with the others of a like size, once for all lists of that
component, in blocks of bounded size that return a spanning forest and no pairs. That last step is what costs most for a
large family whose members are alike but not linked: its work and what it sends grow with the square of those outside,
its output doesn't.

Links between classes are joined to components by iterated joins. Nothing is capped: lists of any length are
handled one way or the other.

Cases: a text without words, or null, has an empty set and is linked with nothing; with fewer words than ``size`` the
whole sequence is the one shingle; equal texts are one class; a row without id is linked with nothing, its
component is null and it is kept; rows of the same id count as one document in components; an empty table gives no
row; other columns are left out of the comparison.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import NON_SPACE, Block, blocks, column, mix, output, window_hashes, within, word_hashes, words
from ._util import checkpoint, fresh
from .components import components

SIZE, THRESHOLD = 5, 80
SKETCH, RUN, LONG, HUBS = 66, 4, 32, 1
#: Up to how many shingles a set has shorter runs as keys, too.
SHORT_RUNS = {3: 15, 2: 5}
BANDS, ROWS = 46, 6
#: Values of the sketch used for estimation, and how many of them a pair must share to be verified.
ESTIMATE, ESTIMATE_SHARED = 32, 13
#: Bytes of full sets that a block of a long list holds about.
BLOCK_BYTES = 4 << 20
#: Its rows at most, about: sets of a few shingles are many to a byte.
BLOCK_ROWS = 2048
#: Rows of a long list are spread over so many tasks where they meet something that the list has once.
SALTS = 16
#: Candidates' ids are broadcast up to this many, joined in a shuffle beyond.
BROADCAST_IDS = 1 << 20


def shingle_sets(block: Block, size: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    starts, ends, counts = words(block, NON_SPACE)
    hashes = word_hashes(block, starts, ends)
    found = window_hashes(hashes, size)
    out, first = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(found[first : first + n - size + 1]))
        else:
            out.append(window_hashes(hashes[first : first + n], n) if n else np.zeros(0, np.uint64))
        first += n
    return out


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, d1 and d2 (a digest of the set), sketch (ascending as unsigned numbers)."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                sets = shingle_sets(block, size)
                d1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                d2 = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(7))) if len(s) else 0 for s in sets], np.uint64)
                bounds = np.concatenate([[0], np.cumsum([min(len(s), SKETCH) for s in sets])]).astype(np.int32)
                flat = np.concatenate([s[:SKETCH] for s in sets]).view(np.int64)
                sketch = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))
                yield output(arrow, doc_id=column(block.batch, "doc_id"), n=[len(s) for s in sets], d1=d1.view(np.int64), d2=d2.view(np.int64), sketch=sketch)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sketch array<long>")


_KEYS = pa.schema([("v", pa.int64()), ("rep", pa.int64()), ("n", pa.int64())])
_KEYS_DDL = "v long, rep long, n long"


def run_keys(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sketches that lie in ``values`` one after the other, and the row that each is of."""
    row, keys, of = np.repeat(np.arange(len(counts)), counts), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for run in (RUN, *SHORT_RUNS):
        at = np.flatnonzero(within(counts, run) & (counts[row] <= SHORT_RUNS.get(run, SKETCH)))
        keys.append(window_hashes(values, run)[at])
        of.append(row[at])
    return np.concatenate(keys), np.concatenate(of)


def band_keys(values: np.ndarray) -> np.ndarray:
    """A set's keys by minima of independent hashes."""
    seeds, step = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)), max(1, (1 << 18) // len(values))
    minima = np.concatenate([mix(values ^ seeds[i : i + step, None]).min(1) for i in range(0, len(seeds), step)])
    return window_hashes(minima, ROWS)[::ROWS] + np.arange(BANDS, dtype=np.uint64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketch, rep, n = (column(batch, c) for c in ("sketch", "rep", "n"))
        v, of = run_keys(np.asarray(sketch.flatten()).view(np.uint64), np.asarray(sketch.value_lengths()).astype(np.int64))
        yield output(_KEYS, v=v.view(np.int64), rep=np.asarray(rep)[of], n=np.asarray(n)[of])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(w.as_buffer(), np.uint64) for w in column(batch, "words")]
        v = np.concatenate([np.zeros(0, np.uint64), *[band_keys(s) for s in sets]])
        yield output(_KEYS, v=v.view(np.int64), rep=np.repeat(np.asarray(column(batch, "rep")), BANDS), n=np.repeat([len(s) for s in sets], BANDS).astype(np.int64))


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("rep", pa.int64()), ("est", pa.binary())])
    for batch in batches:
        sketch = column(batch, "sketch")
        flat, length = np.asarray(sketch.flatten()).view(np.uint64), np.asarray(sketch.value_lengths()).astype(np.int64)
        begin = np.cumsum(length) - length
        est = [np.unique((flat[b : b + min(m, ESTIMATE)] >> np.uint64(32)).astype("<u4")).tobytes() for b, m in zip(begin.tolist(), length.tolist(), strict=True)]
        yield output(schema, rep=column(batch, "rep"), est=est)


def _lists(keys: DataFrame) -> DataFrame:
    """v, rep, n and m: the keys that several classes have, with their number."""
    return checkpoint(keys.join(keys.groupBy("v").agg(F.count("*").alias("m")).where("m > 1"), "v"))


def may_link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of estimation sketches (rows of ESTIMATE values, padded with the largest number): worth verifying."""
    both = np.sort(np.concatenate([a, b], 1), axis=1)
    pad = np.uint32(0xFFFFFFFF)
    again = both[:, 1:] == both[:, :-1]
    again &= both[:, 1:] != pad
    number = 1 + np.cumsum(np.concatenate([np.zeros((len(both), 1), bool), ~again], 1), axis=1)[:, 1:]
    shared = (again & (number <= ESTIMATE)).sum(1)
    distinct = (both != pad).sum(1) - again.sum(1)
    return np.where(distinct >= ESTIMATE, shared >= ESTIMATE_SHARED, shared * 100 >= (THRESHOLD - 10) * distinct)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs from rows sorted by v: lists of at most LONG rows, which may go on in the next batch."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(v: np.ndarray, rep: np.ndarray, n: np.ndarray, est: list) -> pa.RecordBatch:
        matrix = np.full((len(v), ESTIMATE), 0xFFFFFFFF, np.uint32)
        for i, e in enumerate(est):
            matrix[i, : len(e) // 4] = np.frombuffer(e, "<u4")
        found = []
        for step in range(1, len(v)):
            i = np.flatnonzero(v[:-step] == v[step:])
            if not len(i):
                break
            j = i + step
            low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            fit = (100 * low >= THRESHOLD * high) & (rep[i] != rep[j])
            i, j = i[fit], j[fit]
            for part in range(0, len(i), 50_000):
                p, q = i[part : part + 50_000], j[part : part + 50_000]
                ok = may_link(matrix[p], matrix[q])
                found.append(np.stack([np.minimum(rep[p[ok]], rep[q[ok]]), np.maximum(rep[p[ok]], rep[q[ok]])], 1))
        both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return output(schema, a=both[:, 0], b=both[:, 1])

    rest: tuple | None = None
    for batch in batches:
        v, rep, n = (np.asarray(column(batch, c)) for c in ("v", "rep", "n"))
        est = column(batch, "est").to_pylist()
        if rest is not None:
            v, rep, n, est = np.concatenate([rest[0], v]), np.concatenate([rest[1], rep]), np.concatenate([rest[2], n]), rest[3] + est
        if not len(v):
            continue
        cut = int(np.searchsorted(v, v[-1]))
        yield pairs(v[:cut], rep[:cut], n[:cut], est[:cut])
        rest = v[cut:], rep[cut:], n[cut:], est[cut:]
    if rest is not None:
        yield pairs(*rest)


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """rep, words: the full sets of the documents in ``ids`` (rep)."""
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    chosen = texts.join(F.broadcast(ids) if few else ids, "rep", "left_semi")
    arrow = pa.schema([("rep", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                yield output(arrow, rep=column(block.batch, "rep"), words=[s.tobytes() for s in shingle_sets(block, size)])

    return checkpoint(chosen.mapInArrow(run, "rep long, words binary"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("words").alias("wa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("words").alias("wb")), "b")
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for wa, wb in zip(column(batch, "wa"), column(batch, "wb"), strict=True):
                x, y = np.frombuffer(wa.as_buffer(), np.uint64), np.frombuffer(wb.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= THRESHOLD * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield output(arrow, a=column(batch, "a").filter(mask), b=column(batch, "b").filter(mask))

    return both.select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long")


def _forest(group: pd.DataFrame) -> pd.DataFrame:
    """Between two blocks of a long list (or within one), links of outsiders with others: as many as join what they join."""
    group = group.drop_duplicates("rep").sort_values("rep").reset_index(drop=True)
    reps, comps = group["rep"].to_numpy(), group["component"].to_numpy()
    side, outside = group["side"].to_numpy(), group["outside"].to_numpy()
    sets = [np.frombuffer(w, np.uint64) for w in group["words"]]
    sizes = np.array([len(s) for s in sets])
    _, code, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[code] > 1
    number = np.cumsum(counts > 1) - 1
    if (side == 0).all():  # one block: its outsiders with all of it
        meets = [(np.flatnonzero(outside), np.arange(len(sets)))]
    else:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        meets = [(left[outside[left]], right), (left[~outside[left]], right[outside[right]])]
    meets = [(x, y, np.zeros((len(x), len(y)), np.float32)) for x, y in meets if len(x) and len(y)]
    width = 4096
    for start in range(0, int((counts > 1).sum()) if meets else 0, width):
        part = shared & (number[code] >= start) & (number[code] < start + width)
        matrix = np.zeros((len(sets), width), np.float32)
        matrix[row[part], number[code[part]] - start] = 1
        for x, y, common in meets:
            common += matrix[x] @ matrix[y].T
    parent = {c: c for c in comps.tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []
    for x, y, common in meets:
        union = sizes[x][:, None] + sizes[y][None, :] - common
        for i, j in zip(*np.nonzero((100 * common >= THRESHOLD * union) & (comps[x][:, None] != comps[y][None, :])), strict=True):
            a, b = root(comps[x[i]].item()), root(comps[y[j]].item())
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((reps[x[i]], reps[y[j]]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _per_list(rows: DataFrame, lists: DataFrame, *more: str) -> DataFrame:
    """``rows`` (v, rep) with what ``lists`` has for their v: a join that spreads each list's rows over SALTS tasks."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    spread = lists.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, ["v", *more, "__salt"]).drop("__salt")


def _outsiders(hot: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across components within the long lists that verified hubs left apart.

    Lists of which one component has the most part are put together by it, as a family meets in many lists; others stay
    alone. Sets of a pair at the threshold differ in size by a fifth at most, so each is cut into bands of size in which
    only neighbouring ones meet, and bands into blocks of a bounded number of bytes and rows, outsiders apart from the rest:
    each unordered pair of blocks with outsiders on either side is one group, so a few outsiders get the rest sent once.
    """
    lists = checkpoint(hot.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("v", "rep", "n", F.coalesce("component", "rep").alias("component")))
    parts = lists.groupBy("v", "component").agg(F.count("*").alias("m"))
    most = parts.groupBy("v").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    family = F.when(F.col("top.m") * 2 > F.col("all"), F.xxhash64("top.component")).otherwise(F.col("v"))
    marked = _per_list(lists, most.select("v", F.col("top.component").alias("largest"), family.alias("family"))).withColumn("outside", F.col("component") != F.col("largest"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / THRESHOLD)).cast("int").alias("band")
    banded = checkpoint(marked.select(F.col("family").alias("v"), "rep", "n", "component", "outside", band).distinct())
    weight = banded.groupBy("v", "band", "outside").agg(F.ceil(F.greatest(F.sum("n") * 8 / BLOCK_BYTES, F.count("*") / BLOCK_ROWS)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int") * 2 + F.col("outside").cast("int")
    members = checkpoint(_per_list(banded, weight, "band", "outside").withColumn("block", block).drop("blocks"))
    blocks = members.groupBy("v", "band", "block").agg(F.bool_or("outside").alias("some"))
    other = blocks.select("v", F.col("band").alias("band2"), F.col("block").alias("block2"), F.col("some").alias("some2"))
    near = blocks.withColumn("band2", F.explode(F.array(F.col("band"), F.col("band") + 1))).join(other, ["v", "band2"])
    meet = checkpoint(near.where((F.col("some") | F.col("some2")) & ((F.col("band") < F.col("band2")) | (F.col("block") <= F.col("block2")))).select("v", "band", "block", "band2", "block2"))
    key = ["v", "band", "block", "band2", "block2"]
    first = members.join(meet, ["v", "band", "block"]).select(*key, "rep", "component", "outside", F.lit(0).alias("side"))
    later = meet.where("band <> band2 OR block <> block2")
    renamed = members.withColumnsRenamed({"band": "band2", "block": "block2"})
    second = renamed.join(later, ["v", "band2", "block2"]).select(*key, "rep", "component", "outside", F.lit(1).alias("side"))
    return first.unionByName(second).join(sets, "rep").groupBy(*key).applyInPandas(_forest, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest id reachable) and whether it is that one."""
    marked = checkpoint(signatures(docs, size))
    known = marked.where("n > 0 AND doc_id IS NOT NULL")
    classes = checkpoint(known.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")))
    listed = _lists(classes.select("rep", "n", "sketch").mapInArrow(_runs, _KEYS_DDL))
    crowded = checkpoint(listed.where(F.col("m") > LONG).select("rep").distinct())
    crowd = _sets(docs, crowded, size)
    again = _lists(crowd.mapInArrow(_bands, _KEYS_DDL))
    few = listed.unionByName(again).where(F.col("m") <= LONG).drop("m")
    estimates = classes.select("rep", "sketch").mapInArrow(_estimates, "rep long, est binary")
    pairs = few.join(estimates, "rep").repartition("v").sortWithinPartitions("v").mapInArrow(_overlaps, "a long, b long")
    hot = again.where(F.col("m") > LONG).drop("m")
    hubs = hot.groupBy("v").agg(*[F.min(F.struct(F.xxhash64("rep", F.lit(i)), "rep"))["rep"].alias(f"h{i}") for i in range(HUBS)])
    spokes = _per_list(hot.select("v", "rep"), hubs).select("rep", F.explode(F.array(*[F.col(f"h{i}") for i in range(HUBS)])).alias("hub")).where("rep <> hub")
    candidates = checkpoint(pairs.unionByName(spokes.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))).distinct())
    ids = checkpoint(candidates.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(crowded, "rep", "left_anti"))
    sets = crowd.unionByName(_sets(docs, ids, size))
    links = checkpoint(_verified(candidates, sets))
    found = components(links)
    across = checkpoint(_outsiders(hot, found, sets))
    if not across.isEmpty():
        found = components(links.unionByName(across))
    of_class = classes.select("d1", "d2", "n", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component_id"))
    joined = marked.select("doc_id", "d1", "d2", "n").join(of_class, ["d1", "d2", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def distinct_documents(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One document of each group of near duplicates, with all columns."""
    name = fresh("gone", docs)
    gone = near_duplicates(docs, size).where(~F.col("kept")).select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
