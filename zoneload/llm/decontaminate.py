"""Benchmark decontamination: which words of the documents lie in a window of words of a test item.

Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. Every item gives its
windows of ``window`` consecutive words; a shorter item is one window. The windows' hashes are broadcast, and every
hit is verified byte by byte. What is broadcast at once is bounded: a benchmark beyond ``broadcast_bytes`` is first
reduced to the items that share a window's hash with some document (a join of distinct hashes, so that no frequent
window is a hot key), and the rest goes over the documents in parts, each row carrying what it has found so far. Rows
are judged each by itself whatever the benchmark's size; no row needs an id.

Cases: a null text or item has no words; equal items, and equal windows of different items, all count; an item
without id hits words but isn't listed; repeated documents, and those without id, are judged each by itself; empty
tables give no hits. ``decontaminate`` leaves other columns out; ``remove`` keeps all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import ALNUM, Block, blocks, column, output, window_hashes, within, word_hashes, words
from ._util import checkpoint, fresh, groups_for

WINDOW = 10
#: Bytes of benchmark text that are broadcast at once.
BROADCAST_BYTES = 32 << 20
#: Longer items are cut into parts of so many words that overlap by a window less a word.
PART_WORDS = 100_000
#: Pairs or bytes that are compared at once.
STEP = 1 << 20


def joined_words(block: Block, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block's words with one space after each, and where each begins (and the last one's end)."""
    size = ends - starts + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    out = block.data[np.minimum(spread(starts, size), max(0, len(block.data) - 1))] if len(starts) else np.zeros(0, np.uint8)
    out[begin[1:] - 1] = 32
    return out, begin


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] numbers each, one after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def equal_spans(a: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> np.ndarray:
    """Whether a[a_from:a_to] equals b[b_from:b_to], pair by pair."""
    size = a_to - a_from
    same = size == b_to - b_from
    at = np.flatnonzero(same)
    step = max(1, STEP // max(1, int(size.max(initial=1))))
    for i in range(0, len(at), step):
        some = at[i : i + step]
        n = size[some]
        differs = a[spread(a_from[some], n)] != b[spread(b_from[some], n)]
        same[some] = np.add.reduceat(differs, np.cumsum(n) - n) == 0
    return same


class Windows:
    """A benchmark's windows: by size, the distinct ones ascending by hash, each with its place and its items."""

    def __init__(self, items: list[tuple[int | None, str]], window: int):
        self.items = [i for i, _ in items]
        batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in items], pa.large_string())], ["text"])
        texts, begins, found, row, number = [], [], [], 0, 0
        for block in blocks(batch):
            starts, ends, counts = words(block, ALNUM)
            hashes = word_hashes(block, starts, ends)
            text, begin = joined_words(block, starts, ends)
            begins.append(begin[:-1] + sum(map(len, texts)))
            texts.append(text)
            size = np.repeat(np.minimum(counts, window), counts)
            for n in np.unique(size).tolist():
                h = window_hashes(hashes, n)
                at = np.flatnonzero((size[: len(h)] == n) & within(counts, n)[: len(h)])
                found.append((n, h[at], number + at, row + np.repeat(np.arange(block.rows), counts)[at]))
            row, number = row + block.rows, number + len(starts)
        self.text = np.concatenate([np.zeros(0, np.uint8), *texts])
        self.begin = np.append(np.concatenate([np.zeros(0, np.int64), *begins]), len(self.text))
        self.sizes: dict[int, tuple[np.ndarray, ...]] = {}
        for n in sorted({f[0] for f in found}):
            self.sizes[n] = self._grouped(n, *(np.concatenate([f[i] for f in found if f[0] == n]) for i in (1, 2, 3)))

    def _grouped(self, size: int, h: np.ndarray, word: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hash and first word of each distinct window, and its items: a range of the last array, from where to where."""
        order = np.lexsort((item, h))
        h, word, item = h[order], word[order], item[order]
        variant = np.zeros(len(h), np.int64)  # tells texts of one hash apart
        new = np.concatenate([[True], h[1:] != h[:-1]])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        odd = np.flatnonzero(~self._same(size, word, word[lead]))
        for i in odd.tolist():
            among = [j for j in range(int(lead[i]), i) if self._same(size, word[i : i + 1], word[j : j + 1])[0]]
            variant[i] = variant[among[0]] if among else i - lead[i]
        if len(odd):
            order = np.lexsort((item, variant, h))
            h, word, item, variant = h[order], word[order], item[order], variant[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (variant[1:] != variant[:-1])]))
        return h[first], word[first], first, np.append(first[1:], len(h)), item

    def _same(self, size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return equal_spans(self.text, self.begin[a], self.begin[a + size], self.text, self.begin[b], self.begin[b + size])


def hits(block: Block, known: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
    """Words' starts, ends, counts by row, the marks of those inside a window's occurrence, and numbers of items by row."""
    starts, ends, counts = words(block, ALNUM)
    hashes = word_hashes(block, starts, ends)
    row = np.repeat(np.arange(block.rows), counts)
    edges = np.zeros(len(starts) + 1, np.int64)
    owners = [np.zeros((0, 2), np.int64)]
    text = begin = None
    for size, (listed, first_word, first, last, item) in known.sizes.items():
        found = window_hashes(hashes, size)
        low, high = np.searchsorted(listed, found), np.searchsorted(listed, found, "right")
        at = np.flatnonzero((low < high) & within(counts, size)[: len(found)])
        if not len(at):
            continue
        if text is None:
            text, begin = joined_words(block, starts, ends)
        for part in range(0, len(at), STEP // 16):
            some = at[part : part + STEP // 16]
            n = high[some] - low[some]
            i, group = np.repeat(some, n), spread(low[some], n)
            fine = equal_spans(text, begin[i], begin[i + size], known.text, known.begin[first_word[group]], known.begin[first_word[group] + size])
            i, group = i[fine], group[fine]
            np.add.at(edges, i, 1)
            np.add.at(edges, i + size, -1)
            pairs = np.unique(np.stack([row[i], group], 1), axis=0)
            n = (last - first)[pairs[:, 1]]
            owners.append(np.unique(np.stack([np.repeat(pairs[:, 0], n), item[spread(first[pairs[:, 1]], n)]], 1), axis=0))
    items: list[list[int]] = [[] for _ in range(block.rows)]
    for r, i in np.unique(np.concatenate(owners), axis=0).tolist():
        items[r].append(i)
    return starts, ends, counts, np.cumsum(edges)[:-1] > 0, items


def parts(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, text: the items' words, a space between; long ones in overlapping parts that have the same windows."""
    arrow = pa.schema([("item_id", pa.int64()), ("text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                starts, ends, counts = words(block, ALNUM)
                text, begin = joined_words(block, starts, ends)
                ids, done, rows = column(block.batch, "item_id").to_pylist(), 0, []
                for i, n in zip(ids, counts.tolist(), strict=True):
                    for a in range(0, max(1, n - window + 1), PART_WORDS) if n else ():
                        b = min(n, a + PART_WORDS + window - 1)
                        rows.append((i, text[begin[done + a] : begin[done + b] - 1].tobytes().decode()))
                    done += n
                yield output(arrow, item_id=[r[0] for r in rows], text=[r[1] for r in rows])

    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "item_id long, text string").distinct()


def _window_keys(rows: DataFrame, name: str, sizes: list[int], window: int, of_item: bool) -> DataFrame:
    """The distinct hashes of windows of the given sizes, with the column ``name``; of an item, those of its own size."""
    arrow = pa.schema([(name, pa.string()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                starts, ends, counts = words(block, ALNUM)
                hashes = word_hashes(block, starts, ends)
                row = np.repeat(np.arange(block.rows), counts)
                for size in sizes:
                    found = window_hashes(hashes, size)
                    fits = within(counts, size)[: len(found)]
                    if of_item:
                        fits = fits & (np.minimum(np.repeat(counts, counts), window)[: len(found)] == size)
                    at = np.flatnonzero(fits)
                    pairs = np.unique(np.stack([row[at] if of_item else np.zeros(len(at), np.int64), found[at].view(np.int64)], 1), axis=0)
                    label = column(block.batch, name).take(pa.array(pairs[:, 0])) if of_item else pa.nulls(len(pairs), pa.string())
                    yield output(arrow, **{name: label, "key": pairs[:, 1]})

    return rows.mapInArrow(run, f"{name} string, key long")


def _sizes(items: DataFrame, window: int) -> list[int]:
    """The window sizes that occur: at most ``window`` values."""
    count = F.least(F.size(F.split("text", " ")), F.lit(window)).alias("n")
    return sorted(r["n"] for r in items.select(count).distinct().collect())


def _occurring(items: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """Those parts of items of which some window's hash is also one of a document."""
    named = items.withColumn("part", F.sha2(F.concat_ws(" ", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), "text"), 256))
    sizes = _sizes(items, window)
    of_docs = _window_keys(docs.select("text").withColumn("none", F.lit(None).cast("string")), "none", sizes, window, False).select("key").distinct()
    of_items = _window_keys(named.select("part", "text"), "part", sizes, window, True)
    return named.join(of_items.join(of_docs, "key", "left_semi").select("part").distinct(), "part", "left_semi").select("item_id", "text")


def _chunks(benchmark: DataFrame, docs: DataFrame, window: int, broadcast_bytes: int) -> list[DataFrame]:
    """The benchmark in tables that may be broadcast one at a time."""
    items = checkpoint(parts(benchmark, window))
    size = lambda: items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if size() <= broadcast_bytes:
        return [items]
    items = checkpoint(_occurring(items, docs, window))
    n = groups_for(2 * size(), max(1, broadcast_bytes))  # hashing deals unevenly: half full on average
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


VERDICT = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())]
_TYPES = {pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.bool_(): T.BooleanType()}


def _scan(docs: DataFrame, chunk: DataFrame, window: int, state: str, marks_out: bool, names: dict[str, str]) -> DataFrame:
    """One pass. ``state``: the column of what was found before, if there is one; ``names``: the verdict's columns."""
    shared = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in chunk.collect()])
    kept = [f for f in docs.schema.fields if f.name != state]
    fields = [T.StructField(state, T.StructType().add("marks", "binary").add("items", T.ArrayType(T.StringType())))] if marks_out else [T.StructField(n, _TYPES[t]) for (v, t) in VERDICT for n in [names[v]]]
    inner = pa.struct([("marks", pa.binary()), ("items", pa.list_(pa.string()))])
    cache: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cache:
            cache[0] = Windows(shared.value, window)
        for batch in batches:
            for block in blocks(batch):
                _, _, counts, marked, found = hits(block, cache[0])
                items = [{str(cache[0].items[i]) for i in some if cache[0].items[i] is not None} for some in found]
                cut = np.cumsum(counts)
                if state in block.batch.schema.names:
                    before = column(block.batch, state).to_pylist()
                    items = [own | set(b["items"]) for own, b in zip(items, before, strict=True)]
                    marked = marked | np.concatenate([np.unpackbits(np.frombuffer(b["marks"], np.uint8), count=n) for b, n in zip(before, counts.tolist(), strict=True)]).astype(bool)
                if marks_out:
                    rows = [{"marks": np.packbits(m).tobytes(), "items": sorted(i)} for m, i in zip(np.split(marked, cut[:-1]), items, strict=True)]
                    new = [pa.array(rows, inner)]
                else:
                    total = np.concatenate([[0], np.cumsum(marked)])
                    n_hit = total[cut] - total[cut - counts]
                    listed = [sorted(i) for i in items]
                    values = [counts, n_hit, [len(i) for i in listed], [hashlib.sha256(",".join(i).encode()).hexdigest() for i in listed], n_hit > 0]
                    new = [pa.array(v, t) for v, (_, t) in zip(values, VERDICT, strict=True)]
                columns = [column(block.batch, f.name) for f in kept] + new
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in [*kept, *fields]])

    return docs.mapInArrow(run, T.StructType([*kept, *fields]))


def judged(docs: DataFrame, benchmark: DataFrame, window: int, broadcast_bytes: int, names: dict[str, str]) -> DataFrame:
    """The documents with all their columns and the verdict's, under ``names``."""
    state = fresh("__found", docs)
    chunks = _chunks(benchmark, docs, window, broadcast_bytes)
    for i, chunk in enumerate(chunks):
        last = i == len(chunks) - 1
        docs = _scan(docs, chunk, window, state, not last, names)
        docs = docs if last else checkpoint(docs)
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: words, words hit, items with occurring windows, and the digest of those items' ids."""
    names = {v: v for v, _ in VERDICT}
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return judged(rows, benchmark, window, broadcast_bytes, names).drop("text")


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents without a hit, with all their columns."""
    names = {v: fresh(f"__{v}", docs) for v, _ in VERDICT}
    kept: Column = ~F.col(names["contaminated"])
    return judged(docs, benchmark, window, broadcast_bytes, names).where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])
