"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class in the context, times that of its group within the class, times that of
its subgroup within the group, times that of the word within the subgroup. The class (16, by a hash of a word's last
bytes; the end has its own) and the two further factors (16 values each, by a hash of the word) are softmaxes over a
trained bias and weights of hashed features: the word before, the word before last (a skip), and the classes of the
four words before. The class takes all three, the group the first and last, the subgroup the first two. In the further
factors features are hashed together with the class and group so far, so contexts weigh words within their class. The
4096 subgroups hold a few words each; there, a word has
its count, plus one, over all training documents.

Counts: documents are dealt to groups of bounded size; each sends its distinct tokens once to the tokens'
buckets and gets their totals back, so neither a frequent word nor the vocabulary is gathered anywhere.
Weights: in each round the training documents of one part of the corpus are read; every task takes gradient
steps on its own documents from the shared weights. The changes are averaged in two levels, each row of a table by
how much of its gradient a task has seen, so that what few tasks have met isn't averaged away. All training documents
are read once. Rows per table grow with the bytes of text, from 2^13 to 2^15, so the weights that are broadcast are
bounded by 15 MB. Documents are scored in blocks of arrays, whole texts each.

Cases: a null text is empty and has the end alone; a row without id is learned from and not held out; repeated
rows are learned from and scored each by itself; with no training document every count is 0 and the values of
each factor are equally likely; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._exchange import dealt
from ._text import NON_SPACE, U, Block, blocks, column, mix, output, word_hashes, words
from ._util import checkpoint, crc_mod, groups_for, text_bytes

#: Bits of the factors: class, group, subgroup.
BITS = (4, 4, 4)
#: Features by factor: 0 the word before, 1 the word before last, 2 the classes before.
USED = ((0, 1, 2), (0, 2), (0, 1))
CLASSES, LEAVES, ROUNDS = 1 << BITS[0], 1 << sum(BITS), 2
STEP_TOKENS, LEAST_STEP, RATE, SCALE, PRIOR = 16_384, 1024, 0.4, 0.3, 0.1
#: Rows of a table: one for so many bytes of text, within bounds.
ROW_BYTES, LEAST_ROWS, MOST_ROWS = 1 << 16, 1 << 13, 1 << 15
GROUP_BYTES, TASK_BYTES = 8 << 20, 32 << 20
#: Rows of a table that are averaged together, and how many tasks' changes at a time.
SLICE, FAN_IN = 1 << 12, 16
END = mix(np.array([0x5EED], U))[0]
_ODD = U(0x9E3779B97F4A7C15)


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and leaf (class, group, subgroup) of each token, the end of a row after its words; and tokens by row."""
    starts, ends, counts = words(block, NON_SPACE)
    hashes = word_hashes(block, starts, ends)
    last = block.data[ends - 1].astype(np.uint32)
    second = np.where(ends - starts > 1, block.data[np.maximum(ends - 2, 0)], 0).astype(np.uint32)
    kind = ((last * np.uint32(2654435761) ^ (second + np.uint32(1)) * np.uint32(2246822519)) >> np.uint32(7)) % np.uint32(CLASSES - 1)
    at = np.cumsum(counts)
    hashes, kind = np.insert(hashes, at, END), np.insert(kind.astype(np.uint16), at, CLASSES - 1)
    low = sum(BITS[1:])
    return hashes, (kind << np.uint16(low)) | (hashes >> U(64 - low)).astype(np.uint16), counts + 1


def contexts(hashes: np.ndarray, leaf: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Each token's features: hashes of the word before, the one before last, and the four classes before."""
    total = len(hashes)
    number = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    one, two = np.zeros(total, U), np.zeros(total, U)
    one[1:], two[2:] = hashes[:-1], hashes[:-2]
    one[number < 1] = 0
    two[number < 2] = 0
    kind = (leaf >> np.uint16(sum(BITS[1:]))).astype(np.uint32) + np.uint32(1)
    kinds = np.zeros(total, np.uint32)
    for back in range(1, 5):
        before = np.zeros(total, np.uint32)
        before[back:] = kind[:-back] if total > back else before[back:]
        before[number < back] = 0
        kinds = (kinds << np.uint32(6)) | before
    return [mix(x) for x in (one + U(1), two + U(9), kinds.astype(U) + U(1 << 40))]


def factor(leaf: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """What was decided before a level, and the value there."""
    low = sum(BITS[level + 1 :])
    return leaf >> np.uint16(low + BITS[level]), (leaf >> np.uint16(low)) & np.uint16((1 << BITS[level]) - 1)


class Weights:
    """Biases (by level: what was decided before, value) and tables (by level and feature: row, value)."""

    def __init__(self, mass: np.ndarray, rows: int):
        self.rows = rows
        self.bias, self.tables = [], []
        for level, bits in enumerate(BITS):
            m = mass.reshape(1 << sum(BITS[: level + 1]), -1).sum(1).reshape(-1, 1 << bits)
            self.bias.append(np.log(m / m.sum(1, keepdims=True)).astype(np.float32))
            self.tables.append([np.zeros((rows, 1 << bits), np.float32) for _ in USED[level]])

    def copy(self) -> Weights:
        out = object.__new__(Weights)
        out.rows, out.bias, out.tables = self.rows, [b.copy() for b in self.bias], [[t.copy() for t in level] for level in self.tables]
        return out

    def arrays(self) -> list[np.ndarray]:
        return [*self.bias, *[t for level in self.tables for t in level]]

    def places(self, context: list[np.ndarray], before: np.ndarray, level: int) -> list[np.ndarray]:
        """The row of each feature in its table, hashed with what was decided before."""
        shift = U(64 - (self.rows.bit_length() - 1))
        salt = mix(np.arange(1 << sum(BITS[:level]), dtype=U) + U((level + 1) << 40))[before]
        return [((context[f] ^ salt) * _ODD >> shift).astype(np.uint16) for f in USED[level]]

    def log_odds(self, level: int, before: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
        z = self.bias[level][before]
        for table, p in zip(self.tables[level], places, strict=True):
            z += table[p]
        return z

    def log10(self, context: list[np.ndarray], leaf: np.ndarray) -> np.ndarray:
        """Of the token's class, group and subgroup together."""
        out = np.zeros(len(leaf))
        for level in range(len(BITS)):
            before, value = factor(leaf, level)
            places = self.places(context, before, level)
            for i in range(0, len(leaf), STEP_TOKENS):
                part = slice(i, i + STEP_TOKENS)
                z = self.log_odds(level, before[part], [p[part] for p in places])
                own = z[np.arange(len(z)), value[part]].astype(np.float64)
                out[part] += own - np.log(np.exp(z, out=z).sum(1, dtype=np.float64))
        return out / np.log(10)

    def learn(self, context: list[np.ndarray], leaf: np.ndarray, seen: list[np.ndarray]) -> None:
        """Gradient steps over the tokens in turn, a dozen at least where there are enough; ``seen`` sums each row's
        squared gradients, which scale its steps."""
        step = min(STEP_TOKENS, max(LEAST_STEP, len(leaf) // 12))
        for level in range(len(BITS)):
            before, value = factor(leaf, level)
            places = self.places(context, before, level)
            first = len(BITS) + sum(map(len, USED[:level]))
            for i in range(0, len(leaf), step):
                part = slice(i, i + step)
                at = [p[part] for p in places]
                p = self.log_odds(level, before[part], at)
                np.exp(p, out=p)
                p *= 1 / p.sum(1, keepdims=True)
                p[np.arange(len(p)), value[part]] -= 1
                _step(self.bias[level], seen[level], before[part], p)
                for table, sums, rows in zip(self.tables[level], seen[first : first + len(USED[level])], at, strict=True):
                    _step(table, sums, rows, p)


def _step(table: np.ndarray, sums: np.ndarray, rows: np.ndarray, p: np.ndarray) -> None:
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    gradient = np.add.reduceat(p[order], first)
    at = ordered[first]
    total = sums[at] + SCALE * np.einsum("ij,ij->i", gradient, gradient)
    sums[at] = total
    gradient *= (RATE / np.sqrt(total))[:, None]
    table[at] -= gradient


def _distinct(n_buckets: int):
    schema = pa.schema([("bucket", pa.int64()), ("pid", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("leaves", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        keys, counts, leaves = vocabulary(group)
        pid = column(group, "pid")[0].as_py()
        rows = [(b, pid, keys[i:j].tobytes(), counts[i:j].tobytes(), leaves[i:j].tobytes()) for b, i, j in _split(keys, n_buckets)]
        return pa.table([list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5, schema=schema)

    return run


def vocabulary(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A group's distinct tokens, ascending, with their counts in training rows and their leaves."""
    parts = []
    for block in blocks(group):
        hashes, leaf, counts = tokens(block)
        train = np.repeat(column(block.batch, "train").to_numpy(zero_copy_only=False), counts)
        key, first, code = np.unique(hashes, return_index=True, return_inverse=True)
        parts.append((key, np.bincount(code[train], minlength=len(key)), leaf[first]))
    if not parts:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.uint16)
    key, number, leaf = (np.concatenate(p) for p in zip(*parts, strict=True))
    unique, first, code = np.unique(key, return_index=True, return_inverse=True)
    return unique, np.bincount(code, weights=number, minlength=len(unique)).astype(np.int64), leaf[first]


def _split(ascending: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    bucket = ((ascending >> U(32)) * U(n) >> U(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return list(zip(bucket[first].tolist(), first.tolist(), np.append(first[1:], len(bucket)).tolist(), strict=True))


_TOTALS = pa.schema([("pid", pa.int64()), ("bucket", pa.int64()), ("width", pa.int32()), ("totals", pa.binary()), ("leaf", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())), ("v", pa.list_(pa.int64()))])


def _totals(group: pa.Table) -> pa.Table:
    """A bucket's totals for each group, in the order of its tokens; and one row of sums by leaf (pid null)."""
    pids, bucket = column(group, "pid").to_pylist(), column(group, "bucket")[0].as_py()
    read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in column(group, name)]
    keys = read("keys", U)
    _, first, code = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.bincount(code, weights=np.concatenate(read("counts", np.int64))).astype(np.int64)
    leaf = np.concatenate(read("leaves", np.uint16))[first]
    width = 2 if total.max() < 1 << 16 else 4 if total.max() < 1 << 32 else 8
    rows = [(pid, bucket, width, part.astype(f"<u{width}").tobytes(), None, None, None) for pid, part in zip(pids, np.split(total[code], np.cumsum([len(k) for k in keys])[:-1]), strict=True)]
    known = total > 0
    n, v = np.bincount(leaf, weights=total, minlength=LEAVES).astype(np.int64), np.bincount(leaf[known], minlength=LEAVES)
    some = np.flatnonzero(v)
    rows.append((None, bucket, width, b"", some.tolist(), n[some].tolist(), v[some].tolist()))
    return pa.table([list(c) for c in zip(*rows, strict=True)], schema=_TOTALS)


def _slices(arrays: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Array, first row and end of the parts that are averaged together."""
    return [(i, a, min(a + SLICE, len(x))) for i, x in enumerate(arrays) for a in range(0, len(x), SLICE)]


def averaged(changes: DataFrame, tasks: int, average: Callable[[pa.Table], pa.Table], ddl: str) -> DataFrame:
    """One row per part from one per part and task (``salt``, from 0): ``FAN_IN`` of them at a time, in as many levels as
    that takes, so that what one task gathers is bounded whatever the number of tasks."""
    while tasks > 1:
        changes = changes.withColumn("salt", F.floor(F.col("salt") / FAN_IN).cast("int")).groupBy("part", "salt").applyInArrow(average, ddl)
        tasks = math.ceil(tasks / FAN_IN)
    return changes


def _trained(docs: DataFrame, weights: Weights, turn: int, tasks: int) -> Weights:
    """One round over the training documents of part ``turn``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    arrow = pa.schema([("part", pa.int32()), ("salt", pa.int32()), ("mass", pa.binary()), ("change", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for block in blocks(batch):
                if own is None:
                    own = shared.value.copy()
                    seen = [np.ones(len(a), np.float32) for a in own.arrays()]
                hashes, leaf, counts = tokens(block)
                own.learn(contexts(hashes, leaf, counts), leaf, seen)
        if own is not None:
            salt = TaskContext.get().partitionId()
            now, old = own.arrays(), shared.value.arrays()
            for number, (i, a, b) in enumerate(_slices(now)):
                change = (now[i][a:b] - old[i][a:b]).astype(np.float16)
                yield output(arrow, part=[number], salt=[salt], mass=[(seen[i][a:b] - 1).tobytes()], change=[change.tobytes()])

    def average(group: pa.Table) -> pa.Table:
        mass = total = None
        for m, change in zip(column(group, "mass"), column(group, "change"), strict=True):
            m = np.frombuffer(m.as_buffer(), np.float32)
            own = np.frombuffer(change.as_buffer(), np.float16).reshape(len(m), -1) * m[:, None]
            mass, total = (m.copy(), own) if total is None else (mass + m, total + own)
        mean = (total / np.maximum(mass, np.float32(1e-12))[:, None]).astype(np.float16)
        first = {name: [column(group, name)[0].as_py()] for name in ("part", "salt")}
        return pa.table({**first, "mass": [mass.tobytes()], "change": [mean.tobytes()]}, schema=arrow)

    ddl = "part int, salt int, mass binary, change binary"
    mine = docs.where(F.col("train") & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == turn)).select("text").coalesce(tasks)
    levels = averaged(mine.mapInArrow(run, ddl), tasks, average, ddl)
    out = weights.copy()
    arrays = out.arrays()
    slices = _slices(arrays)
    for r in levels.select("part", "change").collect():
        i, a, b = slices[r["part"]]
        arrays[i][a:b] += np.frombuffer(r["change"], np.float16).reshape(b - a, -1).astype(np.float32)
    return out


def score(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score (counts alone) and score, both log10."""
    held = F.coalesce(crc_mod("doc_id", 7) == 2 if held_out is None else held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("train", ~held)
    size = text_bytes(rows)
    groups, name, n_groups = dealt(rows, GROUP_BYTES)
    groups = groups.withColumnRenamed(name, "pid")
    n_buckets = max(1, n_groups // 2)
    distinct = groups.groupBy("pid").applyInArrow(_distinct(n_buckets), "bucket long, pid long, keys binary, counts binary, leaves binary")
    totals = checkpoint(distinct.groupBy("bucket").applyInArrow(_totals, "pid long, bucket long, width int, totals binary, leaf array<int>, n array<long>, v array<long>"))
    sums = totals.where("pid IS NULL").select(F.inline(F.arrays_zip("leaf", "n", "v"))).groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    n, v = np.zeros(LEAVES), np.zeros(LEAVES)
    for r in sums.collect():  # as many as there are leaves
        n[r["leaf"]], v[r["leaf"]] = r["n"], r["v"]
    wanted = min(MOST_ROWS, max(LEAST_ROWS, size // ROW_BYTES))
    weights = Weights(n + PRIOR, 1 << (int(wanted).bit_length() - 1))
    for turn in range(ROUNDS if n.sum() else 0):
        weights = _trained(rows, weights, turn, groups_for(size, TASK_BYTES))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    all_tokens, base = int(n.sum()), np.log10(n.sum() + v.sum() + 1)
    own = np.log10(n + v + 1)
    arrow = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(group: pa.Table, found: pa.Table) -> pa.Table:
        if not len(group):
            return arrow.empty_table()
        read = [(block, *tokens(block)) for block in blocks(group)]
        keys = np.unique(np.concatenate([np.unique(r[1]) for r in read]))
        order = np.argsort(column(found, "bucket").to_numpy(), kind="stable")
        width, total = column(found, "width").to_pylist(), column(found, "totals")
        count = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(total[i].as_buffer(), f"<u{width[i]}").astype(np.int64) for i in order.tolist()]])
        out = []
        for block, hashes, leaf, counts in read:
            c = count[np.searchsorted(keys, hashes)]
            log_count = np.log10(c + 1)
            model = shared.value.log10(contexts(hashes, leaf, counts), leaf) + log_count - own[leaf]
            first = np.cumsum(counts) - counts
            held = pa.array(~column(block.batch, "train").to_numpy(zero_copy_only=False))
            out.append(output(arrow, doc_id=column(block.batch, "doc_id"), held_out=held, n_tokens=counts, n_known=np.add.reduceat((c > 0).astype(np.int64), first), train_tokens=[all_tokens] * len(counts), base_score=np.add.reduceat(log_count - base, first), score=np.add.reduceat(model, first)))
        return pa.Table.from_batches(out, arrow)

    return groups.groupBy("pid").cogroup(totals.where("pid IS NOT NULL").groupBy("pid")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
