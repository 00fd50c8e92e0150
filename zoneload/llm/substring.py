"""Removal of windows of words that an earlier document has too, by rolling hashes.

A word goes if a window of ``window`` consecutive words that covers it also starts in a document with a smaller id.
Windows are judged on the input and never reach over two documents; words are runs of other than white space, unchanged.

Every window has two Rabin-Karp hashes of its words' hashes: one modulo 2^64, from prefix sums, and one modulo the prime
2^31 - 1, by doubling.
 1. Documents are dealt by row to groups of bounded size; each sends its distinct window hashes (four bytes each) to
    buckets, which count them over all groups and answer with a bit per hash: seen twice or more.
 2. Of the windows that stand this test, each group sends both hashes, with the least id of its documents that have the
    window; the bucket answers with a bit: some group has a smaller id.
 3. A window is repeated if the bit says so or its own group has a smaller id; repeated windows that touch or overlap
    merge into maximal intervals of words, which are cut out.
A window that a third of all rows share is sent once per group, not once per row.

Windows are told apart by 95 bits: with n distinct windows in the corpus, some pair is mistaken with a probability of
n * n / 2^96, below 1 % even for the 1.6e13 words of 100 TB.

Cases: a null text has no words; texts with fewer words than the window stay; a row without id stays whole and removes
nothing elsewhere; rows with the same id don't remove each other's words; an empty table gives no row. Columns of the
input named like a result's column give way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._exchange import ANSWERED, ASKED, among, answer, answered, asked_keys, bucket_of, compressed, counted, dealt, expanded, parts, question
from ._text import NON_SPACE, U, Block, blocks, column, mix, powers, within, word_hashes, words

WINDOW = 50
GROUP_BYTES = 8 << 20
_PRIME = (1 << 31) - 1
_FACTOR = 0x5DEECE66
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])))])
_SENT = pa.schema([("bucket", pa.int64()), ("pid", pa.int64()), ("wide", pa.binary()), ("narrow", pa.binary()), ("ids", pa.binary())])


def _reduced(x: np.ndarray) -> np.ndarray:
    """Modulo 2^31 - 1, for values below 2^62 (the prime itself stands for 0 at times; twice makes it one form)."""
    for _ in range(2):
        x = (x & U(_PRIME)) + (x >> U(31))
    return np.where(x == U(_PRIME), U(0), x)


def prime_rolling(symbols: np.ndarray, size: int) -> np.ndarray:
    """The hash modulo 2^31 - 1 of each ``size`` consecutive symbols: joined from those of powers of two."""

    def joined(left: np.ndarray, right: np.ndarray, left_size: int, right_size: int) -> np.ndarray:
        shifted = right[left_size:]
        return _reduced(left[: len(shifted)] * U(pow(_FACTOR, right_size, _PRIME)) + shifted)

    power, reach, out, done = _reduced(symbols >> U(2)), 1, None, 0
    while True:
        if size & reach:
            out, done = (power, reach) if out is None else (joined(power, out, reach, done), done + reach)
        if 2 * reach > size:
            return out
        power, reach = joined(power, power, reach, reach), 2 * reach


def rolling(symbols: np.ndarray, size: int) -> np.ndarray:
    """The hash modulo 2^64 of each ``size`` consecutive symbols, from prefix sums; mixed."""
    p, inverse = powers(len(symbols) + 1)
    prefix = np.zeros(len(symbols) + 1, U)
    np.cumsum(symbols * p[:-1], out=prefix[1:])
    n = len(symbols) - size + 1
    return mix((prefix[size:] - prefix[:n]) * inverse[:n])


class _Windows:
    """A block's words and its windows in documents with an id: first word, hashes, id."""

    def __init__(self, block: Block, size: int, narrow: bool = True):
        self.starts, self.ends, self.counts = words(block, NON_SPACE, lower=False)
        rows = np.repeat(np.arange(block.rows), self.counts)
        ids = column(block.batch, "doc_id")
        n = max(0, len(self.starts) - size + 1)
        fine = within(self.counts, size)[:n] & np.asarray(ids.is_valid())[rows[:n]]
        self.first = np.flatnonzero(fine)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)[rows[self.first]]
        if len(self.first):
            symbols = word_hashes(block, self.starts, self.ends)
            self.wide = rolling(symbols, size)[self.first]
            self.narrow = prime_rolling(symbols, size)[self.first] if narrow else None
        else:
            self.wide = self.narrow = np.zeros(0, U)


def _keys(group: pa.Table, size: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.concatenate([np.zeros(0, U), *[_Windows(b, size, narrow=False).wide for b in blocks(group)]])
    return np.unique(asked_keys(hashes, n_buckets), return_counts=True)


def _ask(name: str, size: int, n_buckets: int):
    return lambda group: question(column(group, name)[0].as_py(), *_keys(group, size, n_buckets))


def _candidates(group: pa.Table, answers: pa.Table, size: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct windows that were seen twice or more, ascending, with the least id in this group."""
    keys, _ = _keys(group, size, n_buckets)
    seen = keys[answered(answers, 1, (keys >> U(32)).astype(np.int64))]
    found: list[tuple] = [(np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64))]
    for block in blocks(group) if len(seen) else ():
        w = _Windows(block, size)
        at = among(asked_keys(w.wide, n_buckets), seen)
        found.append((w.wide[at], w.narrow[at], w.ids[at]))
    wide, narrow, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((ids, narrow, wide))
    wide, narrow, ids = wide[order], narrow[order], ids[order]
    new = np.ones(len(wide), bool)
    new[1:] = (wide[1:] != wide[:-1]) | (narrow[1:] != narrow[:-1])
    return wide[new], narrow[new], ids[new]


def _send(name: str, size: int, n_buckets: int):
    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows or not answers.num_rows:
            return _SENT.empty_table()
        wide, narrow, ids = _candidates(group, answers, size, n_buckets)
        pid = column(group, name)[0].as_py()
        rows = [(b, pid, wide[i:j].tobytes(), narrow[i:j].astype("<u4").tobytes(), compressed(ids[i:j].tobytes())) for b, i, j in parts(bucket_of(wide, n_buckets))]
        return pa.table([list(c) for c in zip(*rows, strict=True)], schema=_SENT) if rows else _SENT.empty_table()

    return run


def _earlier(group: pa.Table) -> pa.Table:
    """A bucket's answers: some group has the window in a document with a smaller id than the asking group's least."""
    wide = [np.frombuffer(x.as_buffer(), U) for x in column(group, "wide")]
    narrow = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in column(group, "narrow")])
    ids = np.concatenate([expanded(x, "<i8") for x in column(group, "ids")])
    every = np.concatenate(wide)
    order = np.lexsort((ids, narrow, every))
    new = np.ones(len(order), bool)
    new[1:] = (every[order][1:] != every[order][:-1]) | (narrow[order][1:] != narrow[order][:-1])
    least = np.empty(len(order), np.int64)
    least[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return answer(column(group, "pid").to_pylist(), [len(w) for w in wide], least < ids, 2, column(group, "bucket")[0].as_py())


def _gone(w: _Windows, size: int, wide: np.ndarray, narrow: np.ndarray, least: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Marks of a block's words that a repeated window covers. Equal wide hashes with different narrow ones stand side by side."""
    change = np.zeros(len(w.starts) + 1, np.int64)
    if len(wide) and len(w.first):
        at, hit = np.searchsorted(wide, w.wide), np.zeros(len(w.first), bool)
        new = np.flatnonzero(np.concatenate([[True], wide[1:] != wide[:-1], [True]]))
        for step in range(int(np.diff(new).max())):
            i = np.minimum(at + step, len(wide) - 1)
            hit |= (wide[i] == w.wide) & (narrow[i] == w.narrow) & (earlier[i] | (least[i] < w.ids))
        np.add.at(change, w.first[hit], 1)
        np.add.at(change, w.first[hit] + size, -1)
    return np.cumsum(change)[:-1] > 0


def _kept(block: Block, w: _Windows, gone: np.ndarray) -> pa.Array:
    """Each row's kept words, joined by one space."""
    keep = ~gone
    size = (w.ends - w.starts)[keep] + 1
    total = int(size.sum())
    place = np.cumsum(size) - size
    body = np.full(total, 32, np.uint8)
    inner = np.ones(total, bool)
    inner[place + size - 1] = False
    body[inner] = block.data[np.repeat(w.starts[keep] - (place - np.arange(len(size))), size - 1) + np.arange(total - len(size))]
    upto = np.concatenate([[0], np.cumsum(size)])
    of_row = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(w.counts)])]
    begin, end = upto[of_row[:-1]], upto[of_row[1:]]
    return pa.array([body[a : max(a, b - 1)].tobytes().decode("utf-8", "replace") for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.string())


def _cut(name: str, size: int, n_buckets: int, fields: list[T.StructField]):
    schema = to_arrow_schema(T.StructType(fields))

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return schema.empty_table()
        wide, narrow, least = _candidates(group, answers, size, n_buckets)
        earlier = answered(answers, 2, bucket_of(wide, n_buckets))
        made: list[pa.RecordBatch] = []
        for block in blocks(group):
            w = _Windows(block, size)
            gone = _gone(w, size, wide, narrow, least, earlier)
            bounds = np.concatenate([[0], np.cumsum(w.counts)])
            total = np.concatenate([[0], np.cumsum(gone)])
            edge = np.zeros(len(gone) + 1, bool)
            edge[bounds] = True
            padded = np.concatenate([[False], gone, [False]])
            first = np.flatnonzero(padded[1:-1] & (~padded[:-2] | edge[:-1]))
            end = np.flatnonzero(padded[1:-1] & (~padded[2:] | edge[1:])) + 1
            row = np.searchsorted(bounds, first, "right") - 1
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(block.rows + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(first - bounds[row]), pa.array(end - bounds[row])], ["first", "end"]))
            values = {f.name: column(block.batch, f.name) for f in fields if f.name not in ("text", *_FOUND.names)}
            values |= {"text": _kept(block, w, gone), "n_words": pa.array(w.counts, pa.int64()), "n_removed": pa.array(total[bounds[1:]] - total[bounds[:-1]]), "spans": spans}
            made.append(pa.RecordBatch.from_arrays([values[f.name].cast(f.type) for f in schema], schema=schema))
        return pa.Table.from_batches(made, schema)

    return run


def trimmed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with all columns (``doc_id`` as long). ``text``: the kept words, joined by one space; ``n_words``,
    ``n_removed``: words before, and removed; ``spans``: maximal removed intervals of word numbers, ends exclusive."""
    rows = docs.drop(*_FOUND.names).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    groups, name, n_groups = dealt(rows, GROUP_BYTES)
    n = 4 * n_groups
    seen = groups.groupBy(name).applyInArrow(_ask(name, window, n), ASKED).groupBy("bucket").applyInArrow(counted(1, lambda total, _: total > 1), ANSWERED)
    sent = groups.groupBy(name).cogroup(seen.groupBy("pid")).applyInArrow(_send(name, window, n), "bucket long, pid long, wide binary, narrow binary, ids binary")
    answers = seen.unionByName(sent.groupBy("bucket").applyInArrow(_earlier, ANSWERED))
    fields = [*rows.schema.fields, *_FOUND.fields]
    return groups.groupBy(name).cogroup(answers.groupBy("pid")).applyInArrow(_cut(name, window, n, fields), T.StructType(fields))


def repeats(docs: DataFrame) -> DataFrame:
    """Per document: words, removed words and the digest of what is left."""
    cut = trimmed(docs.select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
