"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words (an empty text: one empty passage). Each passage is
described by shares of its bytes and byte pairs, hashed, and by its length; a trained layer encodes it, gated
attention (a tanh and a sigmoid branch) weighs the passages of the document, and a logistic unit scores the
weighted sum. All parameters are learned together from document labels, with no labels of passages.

Training takes a bounded sample of labelled documents, each with all its passages: the ``SAMPLE`` smallest by a hash of
their text and id, as many of them as have ``SAMPLE_BYTES`` bytes of text together (one that has more alone is passed
over). Both bounds hold the driver's share constant. Scoring reads every passage of every whole text.

Cases: a null text is an empty one and gets a score; a document with several labels counts once for each
distinct one; null labels are left out; with no usable label, or one class only, the score is the share of label 1
(0.5 without labels); repeated rows are scored each by itself; a row without id is scored, not held out and not
learned from; other columns, whatever their names, are kept out of the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import NON_SPACE, Block, blocks, column, output, words
from ._util import crc_mod, fresh

PASSAGE_WORDS = 64
#: Labelled documents to learn from at most, and the bytes of all their texts.
SAMPLE, SAMPLE_BYTES = 4000, 32 << 20
PAIRS, HIDDEN, GATE, EPOCHS, BATCH, RATE = 128, 24, 12, 24, 64, 0.01
FEATURES = 128 + 1 + PAIRS + 1

#: Bytes by feature: each ASCII character has its own, all others share one.
_BYTE_FEATURE = np.minimum(np.arange(256), 128).astype(np.int64)


def passages(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Features of the block's passages (a row each) and the number of passages by text."""
    starts, _, counts = words(block, NON_SPACE, lower=False)
    per_row = np.maximum(1, -(-counts // PASSAGE_WORDS))
    total = int(per_row.sum())
    # A passage begins at its first word; the first one of a text, at the text's start.
    first_word = np.cumsum(counts) - counts
    row = np.repeat(np.arange(block.rows), per_row)
    number = np.arange(total) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    bounds = block.offsets[row].copy()
    later = number > 0
    bounds[later] = starts[first_word[row[later]] + number[later] * PASSAGE_WORDS]
    size = np.diff(np.append(bounds, block.offsets[-1]))
    at = np.repeat(np.arange(total), size)
    data = block.data.astype(np.int64)
    byte_counts = np.bincount(at * 129 + _BYTE_FEATURE[data], minlength=total * 129).reshape(total, 129)
    pair = (data[:-1] * 31 + data[1:] * 17 + (data[:-1] * data[1:] >> 3)) % PAIRS if len(data) else data
    whole = at[:-1] == at[1:] if len(data) else np.zeros(0, bool)
    pair_counts = np.bincount(at[:-1][whole] * PAIRS + pair[whole], minlength=total * PAIRS).reshape(total, PAIRS)
    length = np.maximum(size, 1)[:, None]
    x = np.concatenate([np.sqrt(byte_counts / length), np.sqrt(pair_counts / length), np.log1p(size)[:, None] / 8], 1)
    return x.astype(np.float32), per_row


class Model:
    """The parameters: encoder (we, be), attention branches (v, u, w) and the scoring unit (wo, bo)."""

    NAMES = ("we", "be", "v", "u", "w", "wo", "bo")

    def __init__(self, prior: float = 0.5):
        r = np.random.default_rng(7)
        self.prior, self.trained = prior, False
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        shape = {"we": (FEATURES, HIDDEN), "be": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "w": (GATE,), "wo": (HIDDEN,), "bo": (1,)}
        self.p = {k: (r.normal(0, 1 / np.sqrt(s[0]), s) if k not in ("be", "bo") else np.zeros(s)).astype(np.float32) for k, s in shape.items()}

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        """``first``: each bag's first passage."""
        p = self.p
        h = np.tanh(((x - self.mean) * self.scale) @ p["we"] + p["be"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["w"]
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return h, t, g, a, z, bag, z @ p["wo"] + p["bo"][0]

    def score(self, x: np.ndarray, per_row: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(per_row), self.prior)
        logits = self.forward(x, np.cumsum(per_row) - per_row)[-1].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h, t, g, a, z, bag, logit = self.forward(x, first)
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
        dz = d[:, None] * p["wo"]
        dh = a[:, None] * dz[bag]
        da = (h * dz[bag]).sum(1)
        de = a * (da - np.add.reduceat(a * da, first)[bag])
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh += dt @ p["v"].T + dg @ p["u"].T
        dh *= 1 - h * h
        xs = (x - self.mean) * self.scale
        return {"we": xs.T @ dh, "be": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "w": (t * g).T @ de, "wo": z.T @ d, "bo": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, per_row: np.ndarray, y: np.ndarray) -> Model:
        """Adam over bags in a fixed order by epoch."""
        self.prior = float(y.mean()) if len(y) else self.prior
        if len(y) == 0 or y.min() == y.max():
            return self
        self.trained = True
        self.mean = x.mean(0)
        self.scale = (1 / (x.std(0) + 0.01)).astype(np.float32)
        start = np.cumsum(per_row) - per_row
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        r, step = np.random.default_rng(11), 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(y))
            for i in range(0, len(y), BATCH):
                bags = order[i : i + BATCH]
                sizes = per_row[bags]
                first = np.cumsum(sizes) - sizes
                rows = np.repeat(start[bags] - first, sizes) + np.arange(sizes.sum())
                step += 1
                for k, dk in self.gradient(x[rows], first, y[bags]).items():
                    dk = dk + 1e-4 * self.p[k]
                    m[k][0] = 0.9 * m[k][0] + 0.1 * dk
                    m[k][1] = 0.999 * m[k][1] + 0.001 * dk * dk
                    rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    self.p[k] = (self.p[k] - rate * m[k][0] / (np.sqrt(m[k][1]) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit a model on the sample. ``usable``: which labels' documents (by doc_id) may be learned from."""
    marked = labels.where(usable & F.col(label).isin(0, 1)).select(F.col("doc_id").alias("__id"), F.col(label).alias("__y")).distinct()
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Ids and labels first; the texts of the chosen ones follow, so that no text is sorted or shuffled.
    hashed = texts.select("doc_id", F.xxhash64("doc_id", "text").alias("__h"), F.octet_length("text").alias("__n")).where(usable & (F.octet_length("text") <= sample_bytes))
    first = hashed.join(marked, F.col("doc_id") == F.col("__id")).orderBy("__h", "doc_id", "__y").limit(sample).select("__h", "__id", "__y", "__n")
    # Of these few rows, without their texts, as many as the bytes allow.
    upto = F.sum("__n").over(Window.orderBy("__h", "__id", "__y").rowsBetween(Window.unboundedPreceding, 0))
    chosen = first.withColumn("__n", upto).where(F.col("__n") <= sample_bytes).drop("__n")
    # The hash, too, so that of several texts of one id the chosen ones alone follow.
    same = (F.col("doc_id") == F.col("__id")) & (F.xxhash64("doc_id", "text") == F.col("__h"))
    rows = texts.join(F.broadcast(chosen.distinct()), same).select("doc_id", "__h", "__y", "text").distinct()
    arrow = pa.schema([("h", pa.int64()), ("y", pa.int32()), ("n", pa.int64()), ("x", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                x, per_row = passages(block)
                parts = np.split(x.astype(np.float16), np.cumsum(per_row)[:-1])
                yield output(arrow, h=column(block.batch, "__h"), y=column(block.batch, "__y"), n=[len(p) for p in parts], x=[p.tobytes() for p in parts])

    got = rows.mapInArrow(encode, "h long, y int, n long, x binary").toPandas().sort_values(["h", "y", "n", "x"], kind="stable")
    x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(-1, FEATURES).astype(np.float32)
    return Model().fit(x, got["n"].to_numpy(), got["y"].to_numpy(np.float32))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The documents with all their columns and their score, from 0 to 1, under a name that they don't have."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents have a column {name}")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                scores = pa.array(shared.value.score(*passages(block)), pa.float64())
                yield pa.RecordBatch.from_arrays([*block.batch.columns, scores], [*block.batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents of that score or more, with all their columns."""
    name = fresh("__score", docs)
    return score(docs, model, name).where(F.col(name) >= least).drop(name)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, **sample: int) -> DataFrame:
    """Per document: whether its label was held out (crc32 of its id modulo 3 is 1), score and predicted label."""
    held = crc_mod("doc_id", 3) == 1 if held_out is None else held_out
    model = train(docs, labels, F.coalesce(~held, F.lit(False)), **sample)
    scored = score(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
