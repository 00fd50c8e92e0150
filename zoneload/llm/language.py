"""Language identification in two steps: the language family, then one-versus-one machines within it.

A text is described by its hashed letters, letter pairs and letter triples (bytes of lower-cased text; other
characters count as one space), as square roots of shares. One linear support vector machine for each family
against the rest picks the family; within it, one for each pair of languages votes, and the votes decide,
margins breaking ties. Families come from a fixed table by language code; codes that it lacks form a family of
their own.

Training takes a bounded sample: for each language, at most ``SAMPLE`` texts of any length, chosen by a hash of text
and id; tasks send a fixed number of features for each. Prediction reads every whole text.

Cases: a null text, or one without any letter, is ``und`` with score 0; null languages aren't learned; with a single
learned language it is predicted with score 1, with none all is ``und``; repeated rows are judged each by itself; a
row without id isn't held out, but isn't learned from either; other columns are no input.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import LOWER, Block, blocks, column, output, text_array
from ._util import crc_mod

SAMPLE = 700
#: Texts described at once: bounds the dense rows.
ROWS = 1024
WIDTH, EPOCHS, PENALTY = 2048, 30, 1e-4

#: Language codes by family.
FAMILIES = {
    "baltic": ["lt", "lv"],
    "germanic": ["af", "da", "de", "en", "is", "nl", "no", "sv"],
    "indic": ["bn", "hi", "mr", "ne", "ur"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "semitic": ["ar", "he", "mt"],
    "sinitic": ["zh"],
    "slavic": ["bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "turkic": ["az", "kk", "tr", "uz"],
    "uralic": ["et", "fi", "hu"],
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

_LETTER = LOWER.copy()
_LETTER[~((np.arange(256) >= 128) | (LOWER >= 97) & (LOWER <= 122))] = 32


def family(language: str) -> str:
    return _FAMILY.get(language.split("-")[0].lower(), "other")


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Features by text, and whether it has a byte of a letter (any non-ASCII byte counts here)."""
    row = np.repeat(np.arange(block.rows), np.diff(block.offsets))
    data = _LETTER[block.data].astype(np.uint32)
    letter = data != 32
    base = row * WIDTH
    total = np.zeros(block.rows * WIDTH, np.int64)
    h = data.copy()
    for size in (1, 2, 3):
        if size > 1:
            if len(h) < 2:
                break
            h = h[:-1] * np.uint32(0x9E3779B1) + data[size - 1 :]
        k = (h * np.uint32(0x85EBCA6B)) ^ (h >> np.uint32(13))
        k = (k >> np.uint32(16)).astype(np.int64) % WIDTH
        same = (row[: len(h)] == row[size - 1 :]) & letter[: len(h)]
        total += np.bincount((base[: len(h)] + k)[same], minlength=block.rows * WIDTH)
    x = np.sqrt(total.reshape(block.rows, WIDTH))
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    has = np.bincount(row[letter], minlength=block.rows) > 0
    return x.astype(np.float32), has


def machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A linear support vector machine for y of -1 and 1, by averaged stochastic subgradients; classes weigh alike."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    r, w, average, step = np.random.default_rng(5), np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for epoch in range(EPOCHS):
        for part in np.array_split(r.permutation(len(y)), max(1, len(y) // 32)):
            step += 1
            wrong = part[y[part] * (x[part] @ w) < 1]
            w *= 1 - PENALTY
            w += 2.0 / (1 + 0.05 * step) ** 0.5 * (weight[wrong] * y[wrong]) @ x[wrong] / max(1, len(part))
            if epoch >= EPOCHS // 2:
                average += w
    return average / max(1, np.linalg.norm(average))


class Machines:
    def __init__(self, x: np.ndarray, languages: list[str]):
        self.languages = sorted(set(languages))
        of = np.array(languages, object)
        fam = np.array([family(c) for c in languages], object)
        self.families = sorted(set(fam))
        self.scale = 1.0
        self.by_family = np.stack([machine(x, np.where(fam == f, 1.0, -1.0)) for f in self.families], 1) if len(self.families) > 1 else None
        self.pairs = {}
        for f in self.families:
            for a, b in itertools.combinations([c for c in self.languages if family(c) == f], 2):
                among = (of == a) | (of == b)
                self.pairs[a, b] = machine(x[among], np.where(of[among] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
        n = len(x)
        logistic = lambda m: 1 / (1 + np.exp(-np.clip(8 * m, -30, 30)))
        chosen, score = np.zeros(n, int), np.ones(n)
        if self.by_family is not None:
            margins = x @ self.by_family
            chosen = margins.argmax(1)
            score = logistic(margins.max(1))
        language = np.empty(n, object)
        for i, f in enumerate(self.families):
            rows = np.flatnonzero(chosen == i)
            own = [c for c in self.languages if family(c) == f]
            votes = np.zeros((len(rows), len(own)))
            for a, b in itertools.combinations(range(len(own)), 2):
                share = logistic(x[rows] @ self.pairs[own[a], own[b]])
                votes[:, a] += share + (share >= 0.5) * len(own)
                votes[:, b] += 1 - share + (share < 0.5) * len(own)
            best = votes.argmax(1)
            language[rows] = np.array(own, object)[best]
            if len(own) > 1:
                score[rows] *= (votes[np.arange(len(rows)), best] % len(own)) / (len(own) - 1)
        return language, score


def train(docs: DataFrame, usable: Column, sample: int = SAMPLE) -> Machines | None:
    """Machines from the sample; None if no row may be learned from."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        usable & F.col("lang").isNotNull() & (F.octet_length("text") > 0)
    )
    # About half as many again as wanted pass a threshold on the hash, by language; the smallest are taken of them.
    total = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not total:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in total.items() for x in (lang, min(1.0, (1.5 * sample + 50) / n))])
    drawn = F.pmod(F.col("h"), F.lit(1 << 40)) / float(1 << 40)
    chosen = rows.withColumn("h", F.xxhash64("doc_id", "text")).where(drawn < share[F.col("lang")])
    arrow = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("x", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, rows=ROWS):
                x, _ = features(block)
                yield output(arrow, h=column(block.batch, "h"), lang=column(block.batch, "lang"), x=[v.tobytes() for v in x.astype(np.float16)])

    got = chosen.mapInArrow(encode, "h long, lang string, x binary").toPandas().sort_values(["lang", "h", "x"], kind="stable")
    # Equal rows share a hash: no more of a language than asked for.
    got = got[got.groupby("lang").cumcount() < sample]
    return Machines(np.frombuffer(b"".join(got["x"]), np.float16).reshape(-1, WIDTH).astype(np.float32), got["lang"].tolist())


def identify(docs: DataFrame, held_out: Column | None = None, **sample: int) -> DataFrame:
    """Per document: whether it was held out (crc32 of its id modulo 4 is 2), predicted language and score."""
    held = crc_mod("doc_id", 4) == 2 if held_out is None else held_out
    machines = docs.sparkSession.sparkContext.broadcast(train(docs, F.coalesce(~held, F.lit(False)), **sample))
    arrow = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, rows=ROWS):
                x, has = features(block)
                known = machines.value
                language, score = known.predict(x) if known else (np.full(len(x), "und", object), np.zeros(len(x)))
                # Non-ASCII bytes needn't be letters; texts without an ASCII letter are looked at closely.
                ascii_letter = np.add.reduceat(np.append((LOWER[block.data] >= 97) & (LOWER[block.data] <= 122), False).astype(np.int64), block.offsets[:-1]) > 0
                empty = np.diff(block.offsets) == 0
                texts = text_array(column(block.batch, "text"))
                for i in np.flatnonzero(~ascii_letter | empty).tolist():
                    has[i] = has[i] and any(c.isalpha() for c in texts[i].as_py())
                language[~has] = "und"
                yield output(arrow, doc_id=column(block.batch, "doc_id"), lang_pred=language.tolist(), score=np.where(has, score, 0.0))

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
