"""Nearest neighbours by cosine with multi-index hashing.

Rotations of the centred vectors' principal axes are learned (iterative quantisation) on a bounded sample; the signs
of the rotated coordinates, ``TURNS`` rotations one after the other, are a vector's code. The code is split into
substrings of about log2(rows) bits. Every row is indexed once for each substring, under its value there; the index
holds codes, not vectors, and is shuffled by substring and the leading bits of the value. A query probes, for each
substring, all values within ``reach`` bits of its own: by the pigeonhole principle every code within a Hamming
distance of substrings * (reach + 1) - 1 is retrieved, and farther ones with the probability measured on the sample.
Of the retrieved rows those within ``radius`` (whole code) are reranked by the exact cosine of the original vectors in
double precision. Reach and number of substrings are those of the least work that find ``TARGET`` of the sample's
neighbours; the radius is that within which ``WITHIN`` of all rows lie on average, by the sample's distances, so that
it shrinks as rows grow and each query reranks about as many.

An exact check follows, so that neither reach nor radius leaves anything out: blocks of all rows meet blocks of queries,
and what has a cosine of at least the worst that a query has found (any, where it has found fewer than k) is scored as the
others are. So the result is that of all pairs; the index tells the check what few pairs to score and hand on. Its products
of blocks grow with rows times queries, what it sends with rows times blocks of queries and queries times blocks of rows.

Equal vectors are indexed once, with the k + 1 smallest ids: others can't be among the k nearest, as ties go to the
smaller id. Lists of many rows are split, and queries sent to each part.

Cases: vectors null, empty, zero, or with null or non-finite components take no part; rows without id neither; vectors of
several dimensions are searched apart, each among its like; repeated rows of an id count once per distinct vector; with fewer candidates than k, all are returned; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import column, output
from ._util import checkpoint

SAMPLE, SAMPLE_QUERIES, SAMPLE_OTHERS, ROUNDS = 20_000, 400, 2_000, 25
TURNS, TARGET, WITHIN = 8, 0.965, 384
#: Rows of a list that one task's group holds about; lists beyond four times as many are split.
LIST_ROWS = 16_384
PAIRS = 1 << 19
#: Bytes of vectors in a block of the exact check; cosines there that a matrix product and a sum may differ by.
CHECK_BYTES, CHECK_ERROR = 32 << 20, 1e-9


def bits_of(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square of a number overflows or vanishes; cosines stay the same to the bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


class Coder:
    """Mean, rotations and how to probe, from a sample of vectors (rows) out of ``total``."""

    def __init__(self, x: np.ndarray, k: int, total: int):
        r = np.random.default_rng(3)
        x = scaled(x)
        u = x / np.linalg.norm(x, axis=1)[:, None]
        self.mean = u.mean(0)
        y = u - self.mean
        _, axes = np.linalg.eigh(y.T @ y)
        y = y @ axes
        self.rotations = [axes @ self._turned(y, r) for _ in range(TURNS)]
        self.bits = TURNS * x.shape[1]
        self.width = max(1, min(self.bits, 20, max(12, math.ceil(math.log2(max(2, total))))))
        self.most = self.bits // self.width
        self._probing(u, self.codes(x), k, total, r)
        #: Leading bits of a value by which lists are dealt to groups.
        self.lead = max(0, min(self.width, math.ceil(math.log2(max(1, total / LIST_ROWS)))))

    @staticmethod
    def _turned(y: np.ndarray, r: np.random.Generator) -> np.ndarray:
        turn = np.linalg.qr(r.normal(size=(y.shape[1], y.shape[1])))[0]
        for _ in range(ROUNDS):
            left, _, right = np.linalg.svd(np.where(y @ turn > 0, 1.0, -1.0).T @ y)
            turn = (left @ right).T
        return turn

    def _probing(self, u: np.ndarray, codes: np.ndarray, k: int, total: int, r: np.random.Generator) -> None:
        """Choose reach, substrings and radius by the sample's queries, their neighbours and some other rows."""
        asked = r.permutation(len(u))[:SAMPLE_QUERIES]
        others = r.permutation(len(u))[:SAMPLE_OTHERS]
        near, far, away = [], [], np.zeros(self.bits + 1)
        values = self.values(codes)
        for i in asked:
            s = u @ u[i]
            s[i] = -9
            top = np.argsort(-s)[: min(k, len(u) - 1)]
            near.append(bits_of(values[top] ^ values[i]))
            far.append(bits_of(values[others] ^ values[i]))
            away += np.bincount(bits_of(codes ^ codes[i]).sum(1), minlength=self.bits + 1)
        near, far = (np.minimum.accumulate(np.concatenate(d), axis=1) for d in (near, far))
        self.reach, self.used, self.share, least = self.width, 1, 1.0, math.inf
        for reach in range(self.width if len(near) else 0):
            enough = np.flatnonzero((near <= reach).mean(0) >= TARGET)
            if not len(enough):
                continue
            used = int(enough[0]) + 1
            share = float((far[:, used - 1] <= reach).mean())
            work = share * total + used * sum(math.comb(self.width, d) for d in range(reach + 1))
            if work < least:
                self.reach, self.used, self.share, least = reach, used, share, work
        away[0] -= len(asked)  # each query is at no distance from itself
        upto = np.cumsum(away) * total / max(1.0, away.sum())
        self.radius = int(np.searchsorted(upto, WITHIN))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of 64-bit words; bits beyond the code's length are zero."""
        x = scaled(x)
        u = x / np.linalg.norm(x, axis=1)[:, None] - self.mean
        bits = np.concatenate([u @ turn > 0 for turn in self.rotations], axis=1)
        packed = np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1)
        return np.ascontiguousarray(packed).view(">u8").astype(np.uint64)

    def values(self, codes: np.ndarray) -> np.ndarray:
        """The substrings' values, a column each."""
        bits = np.unpackbits(codes.astype(">u8").view(np.uint8).reshape(len(codes), -1), axis=1)[:, : self.most * self.width]
        return bits.reshape(len(codes), self.most, self.width) @ (1 << np.arange(self.width)[::-1]).astype(np.uint32)


def masks(width: int, reach: int) -> np.ndarray:
    """All values of at most ``reach`` bits."""
    every = np.arange(1 << width, dtype=np.uint32)
    return every[bits_of(every) <= reach]


_ROWS = pa.schema([("j", pa.int32()), ("lead", pa.int32()), ("rows", pa.int64()), ("e", pa.binary()), ("value", pa.binary()), ("code", pa.binary())])
_DDL = "j int, lead int, rows long, e binary, value binary, code binary"


def matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def _dealt(entries: DataFrame, shared, used: int, reach: int, asked: bool) -> DataFrame:
    """Of entries (e, vec), by substring and leading bits, arrays of numbers, values and codes; queries go to the
    leading bits within ``reach`` of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        low = coder.width - coder.lead
        for batch in batches:
            if not len(batch):
                continue
            codes = coder.codes(matrix(column(batch, "vec")))
            values, e = coder.values(codes), column(batch, "e").to_numpy()
            rows = []
            for j in range(used):
                v = values[:, j]
                at = np.arange(len(v))
                lead = v >> np.uint32(low)
                if asked:
                    near = masks(coder.lead, min(reach, coder.lead))
                    at, lead = np.repeat(at, len(near)), (lead[:, None] ^ near).ravel()
                order = np.argsort(lead, kind="stable")
                at, lead = at[order], lead[order]
                first = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]]))
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(lead)], strict=True):
                    some = at[a:b]
                    rows.append((j, int(lead[a]), b - a, e[some].tobytes(), v[some].tobytes(), codes[some].tobytes()))
            yield output(_ROWS, **dict(zip(_ROWS.names, map(list, zip(*rows, strict=True)), strict=True)))

    return entries.select("e", "vec").mapInArrow(run, _DDL)


def _parted(index: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the part of a list: long lists are split, their queries go to every part."""
    sizes = index.groupBy("j", "lead").agg(F.sum("rows").alias("n")).select("j", "lead", F.ceil(F.col("n") / (4 * LIST_ROWS)).cast("int").alias("parts"))
    parts = checkpoint(sizes.where("parts > 1"))
    whole = F.coalesce("parts", F.lit(1))
    left = index.join(parts, ["j", "lead"], "left").withColumn("part", F.pmod(F.xxhash64("e"), whole).cast("int")).drop("parts")
    right = queries.join(parts, ["j", "lead"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), whole - 1))).drop("parts")
    return left, right


def _candidates(entries: DataFrame, asked: DataFrame, shared, used: int, reach: int, radius: int) -> DataFrame:
    """q, e: retrieved rows of each query (numbers of entries) within the radius."""
    index, queries = _parted(_dealt(entries, shared, used, reach, False), _dealt(asked, shared, used, reach, True))
    arrow = pa.schema([("q", pa.int64()), ("e", pa.int64())])

    def read(table: pa.Table, name: str, kind) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *[np.frombuffer(x.as_buffer(), kind) for x in column(table, name)]])

    def find(rows: pa.Table, some: pa.Table) -> pa.Table:
        if not len(rows) or not len(some):
            return arrow.empty_table()
        coder = shared.value
        words, low = -(-coder.bits // 64), coder.width - coder.lead
        lead, tail = column(some, "lead")[0].as_py(), np.uint32((1 << low) - 1)
        value, e, code = read(rows, "value", np.uint32) & tail, read(rows, "e", np.int64), read(rows, "code", np.uint64).reshape(-1, words)
        order = np.argsort(value, kind="stable")
        value, e, code = value[order], e[order], code[order]
        bounds = np.searchsorted(value, np.arange((1 << low) + 1))
        qv, q, qcode = read(some, "value", np.uint32), read(some, "e", np.int64), read(some, "code", np.uint64).reshape(-1, words)
        left = reach - bits_of((qv >> np.uint32(low)) ^ np.uint32(lead)).astype(np.int64)
        out = [np.zeros((0, 2), np.int64)]
        for rest in np.unique(left[left >= 0]).tolist():
            mine, probes = np.flatnonzero(left == rest), masks(low, rest)
            step = max(1, PAIRS // len(probes))
            for a in range(0, len(mine), step):
                at = mine[a : a + step]
                lists = (qv[at] & tail)[:, None] ^ probes
                first, size = bounds[lists], bounds[lists + 1] - bounds[lists]
                total = np.cumsum(size.sum(1))
                b = 0
                while b < len(at):  # as many queries at once as give some pairs
                    c = max(b + 1, int(np.searchsorted(total, (total[b - 1] if b else 0) + PAIRS, "right")))
                    n, start = size[b:c].ravel(), first[b:c].ravel()
                    row = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    who = np.repeat(at[b:c], size[b:c].sum(1))
                    fine = bits_of(code[row] ^ qcode[who]).sum(1) <= radius
                    out.append(np.stack([q[who[fine]], e[row[fine]]], 1))
                    b = c
        pairs = np.concatenate(out)
        return pa.table([pairs[:, 0], pairs[:, 1]], schema=arrow)

    key = ["j", "lead", "part"]
    return index.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(find, "q long, e long").distinct()


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of scaled rows, one by one."""
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


_SCORED = pa.schema([("q", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
_SCORED_DDL = "q long, ids array<long>, score double"


def _scored(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """q, ids, score: exact cosines of the pairs (q, e)."""
    both = pairs.join(entries.select("e", "vec", "ids"), "e").join(entries.select(F.col("e").alias("q"), F.col("vec").alias("qvec")), "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = scaled(matrix(column(batch, "vec"))), scaled(matrix(column(batch, "qvec")))
            yield output(_SCORED, q=column(batch, "q"), ids=column(batch, "ids"), score=cosines(x, y))

    return both.select("q", "ids", "vec", "qvec").mapInArrow(run, _SCORED_DDL)


def _best(scored: DataFrame, k: int) -> DataFrame:
    """q, id, score: the k nearest ids of each query entry, ties to the smaller id."""
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    flat = scored.select("q", "score", F.explode("ids").alias("id")).groupBy("q", "id").agg(F.max("score").alias("score"))
    return flat.withColumn("__n", best).where(F.col("__n") <= k).select("q", "id", "score")


def nearest_of_block(x: np.ndarray, first: np.ndarray, y: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For scaled rows x (``first``: their smallest ids) and queries y, the pairs (row of y, row of x, cosine) of at least the
    queries' ``least``: each query's k nearest, ties to the smaller id."""
    u, w = (z / np.linalg.norm(z, axis=1)[:, None] for z in (x, y))
    step, out = max(1, (CHECK_BYTES >> 3) // max(1, len(x))), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for a in range(0, len(y), step):
        s = w[a : a + step] @ u.T
        floor = least[a : a + step] - CHECK_ERROR
        many = np.flatnonzero((s >= floor[:, None]).sum(1) > 4 * k)
        if len(many):  # no more of them can be among the k nearest than are as near as the block's k-th
            floor[many] = np.maximum(floor[many], np.partition(s[many], -k, axis=1)[:, -k] - CHECK_ERROR)
        i, j = np.nonzero(s >= floor[:, None])
        parts = range(0, len(i), 1 << 15)
        score = np.concatenate([np.zeros(0), *[cosines(x[j[p : p + (1 << 15)]], y[a + i[p : p + (1 << 15)]]) for p in parts]])
        order = np.lexsort((first[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((a + i[keep], j[keep], score[keep]))
    i, j, score = (np.concatenate(o) for o in zip(*out, strict=True))
    return i, j, score


def _checked(entries: DataFrame, asked: DataFrame, got: DataFrame, k: int, total: int, queries: int, size: int) -> DataFrame:
    """q, ids, score: whatever entry is as near as the k-th that a query has ``got`` (q, id, score), of its block's k nearest."""
    of_query = got.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    cores = entries.sparkSession.sparkContext.defaultParallelism
    rows, some = 8 * size * total, 8 * size * queries
    dealt = max(math.ceil(rows / CHECK_BYTES), min(cores, math.ceil(rows / (1 << 20))))
    parts = math.ceil(some / CHECK_BYTES)
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = entries.select("e", F.col("vec").alias("vec"), F.col("ids").alias("ids"), number("e", dealt).alias("b")).withColumn("p", every(parts))
    right = asked.join(of_query, "q", "left").withColumn("p", number("q", parts)).withColumn("b", every(dealt))

    def check(block: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(block) or not len(wanted):
            return _SCORED.empty_table()
        ids, q = column(block, "ids"), column(wanted, "q").to_numpy()
        least = column(wanted, "least").fill_null(-2.0).to_numpy()
        first = ids.flatten().to_numpy()[np.asarray(ids.offsets)[:-1] - ids.offsets[0].as_py()]
        i, j, score = nearest_of_block(scaled(matrix(column(block, "vec"))), first, scaled(matrix(column(wanted, "qvec"))), least, k)
        return pa.table([q[i], ids.take(pa.array(j)), score], schema=_SCORED)

    # Few groups of much work: a partition for each, which adaptive execution doesn't join again.
    left, right = (side.repartition(2 * dealt * parts, "p", "b") for side in (left, right))
    return left.groupBy("p", "b").cogroup(right.groupBy("p", "b")).applyInArrow(check, _SCORED_DDL)


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, vec (doubles) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("vec")).where(
        F.col("id").isNotNull()
        & F.col("vec").isNotNull()
        & F.forall("vec", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
        & F.exists("vec", lambda c: c != 0)
    )
    return rows


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest of each query. ``is_query`` is on ``id``."""
    rows = usable(vectors, id_column, vector)
    near = vectors.sparkSession.createDataFrame([], "id long, vec_id long, score double")
    for sizes in rows.groupBy(F.size("vec").alias("size")).count().where("count > 1").orderBy("size").collect():
        near = near.unionByName(_search(rows.where(F.size("vec") == sizes["size"]), is_query, k, sample, sizes["size"]))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id"))
    near = near.where("id <> vec_id").withColumn("rank", rank).where(F.col("rank") <= k)
    return near.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(rows: DataFrame, is_query: Column, k: int, sample: int, size: int) -> DataFrame:
    """id, vec_id, score: of rows (id, vec) of one dimension, the k + 1 nearest of each query, itself among them."""
    # Equal vectors: one entry with its k + 1 smallest ids.
    smallest = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    kept = rows.distinct().withColumn("__k", smallest).where(F.col("__k") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = checkpoint(kept.withColumn("e", F.monotonically_increasing_id()))  # fixed by the checkpoint
    total = entries.count()
    training = entries.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(sample).toArrow()
    coder = Coder(matrix(column(training, "vec")), k, total)
    shared = rows.sparkSession.sparkContext.broadcast(coder)
    queries = checkpoint(rows.where(is_query).distinct().join(entries.select("vec", "e"), "vec").select("id", F.col("e").alias("q")))
    asked = checkpoint(entries.join(queries.select(F.col("q").alias("e")).distinct(), "e", "left_semi").select("e", "vec"))
    number = asked.count()
    if not number:
        return queries.selectExpr("id", "id AS vec_id", "0D AS score")
    pairs = _candidates(entries, asked, shared, coder.used, coder.reach, coder.radius)
    got = checkpoint(_best(_scored(pairs, entries), k + 1))
    missed = _checked(entries, asked.toDF("q", "qvec"), got, k + 1, total, number, size)
    found = _best(got.select("q", F.array("id").alias("ids"), "score").unionByName(missed), k + 1)
    return queries.join(found.withColumnRenamed("id", "vec_id"), "q").select("id", "vec_id", "score")
