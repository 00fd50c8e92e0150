"""Phrases whose words occur together more often than by chance, from sorted count streams.

A phrase's score is floor(1000 * a * n / (l * r)) at its worst cut: a, l and r are the counts of the phrase and of its
two parts, n all words of its language. Phrases that lie inside a longer one with the same count are left out.

 1. Counting. Documents are dealt by row to groups of bounded size. In three rounds (words; pairs of frequent words;
    phrases of three to five words whose pairs are all frequent) groups send the distinct hashes of their phrases, four
    bytes each, with counts, and buckets answer with a bit: the sum reaches ``least``. The bits only leave out what can't
    reach it. Groups then send what stands as text, each distinct phrase once, packed by bucket, and the buckets sum the counts of equal texts.
 2. The phrases with their counts are a stream in prefix order (by language, then word by word): every phrase comes after
    its own beginnings and before its extensions. One pass that remembers the counts of the current phrase's beginnings
    merges them all: left counts of every cut, and whether the phrase is an extension as frequent as its beginning.
 3. The same pass over the stream in suffix order (words from the last to the first) gives right counts and extensions
    to the left. Nothing is looked up by hash. Streams are sorted by range, so that a frequent first word is no hot key:
    where a range begins in the midst of extensions, the counts of its first phrase's beginnings (four at most) are sent along.
 4. Both results are merged phrase by phrase, the phrases inside longer ones dropped, and each language's first ``most``
    ranked, in parts first.

Cases: a null text has no words; a null language is ``und``; languages without any phrase give no row; an empty table
gives none; counts and scores are exact (products are decimals of 38 digits).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._exchange import ANSWERED, ASKED, among, answered, asked_keys, bucket_of, compressed, counted, dealt, expanded, parts, question
from ._text import U, Block, blocks, column, mix, window_hashes, within, word_hashes, words
from ._util import checkpoint

LEAST, LONGEST, MOST = 100, 5, 2000
GROUP_BYTES = 8 << 20
#: Ends a piece: .,;:!? and line ends.
BREAK = np.zeros(256, bool)
BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True
#: Words are of all other bytes but blank and tab.
WORD = ~BREAK
WORD[[9, 32]] = False
#: Rows of a ranking's first step.
_RANKED = 1 << 16
_TOLD = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("texts", pa.binary()), ("counts", pa.binary())])
_COUNTS = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("count", pa.int64())])


def _edges(block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's length and of its first and last eight bytes: tells apart words that share their other hash."""
    size = ends - starts
    padded = np.concatenate([block.data, np.zeros(8, np.uint8)]).astype(U)
    first, last = np.zeros(len(starts), U), np.zeros(len(starts), U)
    for i in range(8):
        first |= np.where(i < size, padded[starts + i], U(0)) << U(8 * i)
        last |= np.where(i < size, padded[np.maximum(ends - 1 - i, 0)], U(0)) << U(8 * i)
    return mix(mix(first) + last) + size.astype(U)


class _Words:
    """A block's words with hashes that depend on the language, and how many words their pieces have from each on."""

    def __init__(self, block: Block):
        self.block = block
        self.starts, self.ends, counts = words(block, WORD)
        langs = column(block.batch, "lang").fill_null("und").dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy()[np.repeat(np.arange(block.rows), counts)]
        own = mix(np.array([_folded(lang) for lang in self.langs], U))
        self.hashes = mix(word_hashes(block, self.starts, self.ends) ^ own[self.lang]) if len(self.starts) else np.zeros(0, U)
        breaks = np.concatenate([[0], np.cumsum(BREAK[block.data])])
        new = np.ones(len(self.starts), bool)
        if len(new):
            new[1:] = breaks[self.starts[1:]] != breaks[self.starts[:-1]]
            new[np.cumsum(counts)[:-1][np.cumsum(counts)[:-1] < len(new)]] = True
        self.pieces = np.bincount(np.cumsum(new) - 1) if len(new) else np.zeros(0, np.int64)

    def phrases(self, size: int, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of the phrases of ``size`` words; ``joined`` marks the words (or pairs, by their
        first word) that are frequent."""
        n = len(self.starts) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        fine = within(self.pieces, size)[:n].copy()
        for i in range(size if size < 3 else size - 1):
            fine &= joined[i : i + n]
        at = np.flatnonzero(fine)
        return at, window_hashes(self.hashes, size)[at] if len(at) else np.zeros(0, U)


def _folded(lang: str) -> int:
    value = 0
    for b in lang.encode():
        value = (value * 0x100000001B3 + b + 1) & 0xFFFFFFFFFFFFFFFF
    return value


class _Group:
    """A group's questions, each found again from the texts and the answers to those before."""

    def __init__(self, group: pa.Table, answers: pa.Table | None, n_buckets: int):
        self.parts = [_Words(b) for b in blocks(group)]
        self.n, self.answers, self.known = n_buckets, answers, {}

    def asked(self, stage: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """By block: first words and hashes of the phrases of each of the stage's sizes."""
        if stage == 1:
            return [[(np.arange(len(w.starts)), w.hashes)] for w in self.parts]
        frequent = self.marked(stage - 1)
        sizes = (2,) if stage == 2 else range(3, LONGEST + 1)
        return [[w.phrases(size, f[0]) for size in sizes] for w, f in zip(self.parts, frequent, strict=True)]

    def keys(self, asked: list[list[tuple[np.ndarray, np.ndarray]]]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(asked_keys(np.concatenate([np.zeros(0, U), *[h for block in asked for _, h in block]]), self.n), return_counts=True)

    def marked(self, stage: int) -> list[list[np.ndarray]]:
        """By block and size: marks of the first words of the phrases that the answers let through."""
        if stage in self.known:
            return self.known[stage]
        asked = self.asked(stage)
        keys, _ = self.keys(asked)
        yes = keys[answered(self.answers, stage, (keys >> U(32)).astype(np.int64))]
        out = []
        for w, block in zip(self.parts, asked, strict=True):
            out.append([np.zeros(len(w.starts), bool) for _ in block])
            for marks, (at, hashes) in zip(out[-1], block, strict=True):
                marks[at[among(asked_keys(hashes, self.n), yes)]] = True
        self.known[stage] = out
        return out


def _ask(name: str, stage: int, n_buckets: int):
    def run(group: pa.Table, answers: pa.Table | None) -> pa.Table:
        own = _Group(group, answers, n_buckets)
        return question(column(group, name)[0].as_py() if group.num_rows else 0, *own.keys(own.asked(stage)), answers)

    return run if stage > 1 else lambda group: run(group, None)


def _texts(w: _Words, first: np.ndarray, size: int) -> pa.Array:
    """The phrases of ``size`` words from these first words on, joined by blanks, each ended by a line end."""
    at = (first[:, None] + np.arange(size)).ravel()
    length = (w.ends - w.starts)[at] + 1
    place = np.cumsum(length) - length
    total = int(length.sum())
    body = np.full(total, 32, np.uint8)
    last = place + length - 1
    inner = np.ones(total, bool)
    inner[last] = False
    body[last[size - 1 :: size]] = 10
    body[inner] = w.block.data[np.repeat(w.starts[at] - (place - np.arange(len(at))), length - 1) + np.arange(total - len(at))]
    offsets = np.append(place[::size], total).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def _summed(lang: pa.Array, text: pa.Array, bucket: np.ndarray, count: np.ndarray) -> pa.Table:
    """Counts of equal texts of a language, by language and bucket."""
    rows = pa.table({"lang": lang, "text": text, "bucket": bucket, "count": count})
    return rows.group_by(["lang", "bucket", "text"]).aggregate([("count", "sum")]).sort_by([("lang", "ascending"), ("bucket", "ascending")])


def _tell(n_buckets: int):
    """A group's words by language, and its distinct phrases that stand, as text with their counts, packed by bucket."""

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return _TOLD.empty_table()
        own = _Group(group, answers, n_buckets)
        marks = [[m for stage in block for m in stage] for block in zip(*(own.marked(stage) for stage in (1, 2, 3)), strict=True)]
        found: list[tuple] = []
        for w, by_size in zip(own.parts, marks, strict=True):
            used = np.unique(w.lang)
            names = pa.array(w.langs, pa.string())
            whole = np.bincount(w.lang, minlength=len(w.langs))[used]
            found.append((names.take(pa.array(used)), pa.array([b"\n"] * len(used), pa.large_binary()), np.array([_folded(w.langs[i]) % n_buckets for i in used.tolist()], np.int64), whole.astype(np.int64)))
            edges = _edges(w.block, w.starts, w.ends) if any(m.any() for m in by_size) else w.hashes
            for size, marked in enumerate(by_size, 1):
                at = np.flatnonzero(marked)
                if not len(at):
                    continue
                first, second = (window_hashes(h, size)[at] for h in (w.hashes, edges))
                order = np.lexsort((second, first))
                a, b = first[order], second[order]
                new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                lead = at[order[new]]
                found.append((names.take(pa.array(w.lang[lead])), _texts(w, lead, size), bucket_of(a[new], n_buckets), np.diff(np.append(new, len(at))).astype(np.int64)))
        lang, text, bucket, count = zip(*found, strict=True)
        all_of = _summed(pa.concat_arrays(lang), pa.concat_arrays(text), np.concatenate(bucket), np.concatenate(count)).combine_chunks()
        rows, counts_ = [], all_of["count_sum"].to_numpy()
        langs, buckets, text = column(all_of, "lang").dictionary_encode(), all_of["bucket"].to_numpy(), column(all_of, "text")
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        body = text.buffers()[2]
        names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        for _, i, j in parts(code.astype(np.int64) * n_buckets + buckets):
            rows.append((names[code[i]], int(buckets[i]), compressed(body[int(offsets[i]) : int(offsets[j])].to_pybytes()), compressed(counts_[i:j].astype("<u4").tobytes())))
        return pa.table([list(c) for c in zip(*rows, strict=True)], schema=_TOLD) if rows else _TOLD.empty_table()

    return run


def _totals(least: int):
    def run(told: pa.Table) -> pa.Table:
        """A bucket's phrases of one language that reach ``least``, and the language's words (no phrase at all)."""
        lang, texts, counts_ = column(told, "lang")[0].as_py(), [], []
        for text, count in zip(column(told, "texts"), column(told, "counts"), strict=True):
            body = expanded(text, np.uint8)
            ends = np.flatnonzero(body == 10) + 1
            # Without their line ends.
            offsets = np.concatenate([[0], ends - np.arange(1, len(ends) + 1)]).astype(np.int64)
            texts.append(pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body[body != 10]))))
            counts_.append(expanded(count, "<u4").astype(np.int64))
        summed = pa.table({"text": pa.concat_arrays(texts), "count": np.concatenate(counts_)}).group_by("text").aggregate([("count", "sum")])
        kept = summed.filter(pc.or_(pc.greater_equal(summed["count_sum"], least), pc.equal(summed["text"], "")))
        text = column(kept, "text")
        words_ = pc.if_else(pc.equal(text, ""), pa.scalar([], pa.list_(pa.large_string())), pc.split_pattern(text, " "))
        return pa.table([pa.array([lang] * len(text), pa.string()), words_.cast(pa.list_(pa.string())), column(kept, "count_sum")], schema=_COUNTS)

    return run


def counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, words, count: every phrase of one to ``LONGEST`` words that occurs ``least`` times, and all words of a
    language under the empty list."""
    rows = docs.select(F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    groups, name, n_groups = dealt(rows, GROUP_BYTES)
    n = 4 * n_groups
    often = lambda stage: counted(stage, lambda total, _: total >= least)
    answers = groups.groupBy(name).applyInArrow(_ask(name, 1, n), ASKED).groupBy("bucket").applyInArrow(often(1), ANSWERED)
    for stage in (2, 3):
        asked = groups.groupBy(name).cogroup(answers.groupBy("pid")).applyInArrow(_ask(name, stage, n), ASKED)
        answers = asked.groupBy("bucket").applyInArrow(often(stage), ANSWERED)
    told = groups.groupBy(name).cogroup(answers.groupBy("pid")).applyInArrow(_tell(n), "lang string, bucket long, texts binary, counts binary")
    return told.groupBy("lang", "bucket").applyInArrow(_totals(least), "lang string, words array<string>, count long")


def _merged(seeds: dict[int, list[int]]):
    """The lockstep pass over one range of a stream; ``seeds``: the counts of its first phrase's proper beginnings."""
    schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("count", pa.int64()), ("parts", pa.list_(pa.int64())), ("covers", pa.bool_())])

    def run(batches):
        before, path = None, list(seeds.get(TaskContext.get().partitionId(), []))
        for batch in batches:
            out: list[tuple] = []
            for lang, words_, count in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if before is not None:
                    same = 0
                    if lang == before[0]:
                        same = next((i for i, (x, y) in enumerate(zip(words_, before[1], strict=False)) if x != y), min(len(words_), len(before[1])))
                    path = path[:same]
                if len(path) != len(words_) - 1:
                    raise ValueError(f"the stream lacks a beginning of {words_} in {lang}")
                if path:
                    out.append((lang, words_, count, list(path), path[-1] == count))
                path.append(count)
                before = lang, words_
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * 5, schema, strict=True)], schema=schema)

    return run


def merged(stream: DataFrame) -> DataFrame:
    """lang, words, count, parts, covers of the phrases of two words or more in a stream (lang, words, count) that holds
    all beginnings of its phrases: ``parts`` are the counts of the proper beginnings, shortest first; ``covers``: the
    longest of them is as frequent as the phrase itself."""
    spark = stream.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = checkpoint(stream.select("lang", "words", "count").repartitionByRange(ranges, "lang", "words").sortWithinPartitions("lang", "words"))
    heads = ordered.select(F.spark_partition_id().alias("range"), "lang", "words").groupBy("range").agg(F.min(F.struct("lang", "words")).alias("head")).select("range", "head.*")
    begins = heads.select("range", "lang", F.explode(F.sequence(F.lit(1), F.lit(LONGEST - 1))).alias("k"), "words").where(F.col("k") < F.size("words")).withColumn("words", F.slice("words", 1, F.col("k")))
    # At most LONGEST - 1 rows per range.
    seeds: dict[int, list[int]] = {}
    for row in sorted(ordered.join(F.broadcast(begins), ["lang", "words"]).select("range", "k", "count").collect()):
        seeds.setdefault(row["range"], []).append(row["count"])
    return ordered.mapInArrow(_merged(seeds), "lang string, words array<string>, count long, parts array<long>, covers boolean")


def _ranked(scored: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each language: of its parts first, so that no task sorts a whole language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    n = scored.count()
    parts = max(1, math.ceil(n / _RANKED))
    some = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    while parts > 1 and parts * most > 4 * _RANKED:
        parts = math.ceil(parts / 16)
        some = some.withColumn("part", F.pmod("part", F.lit(parts))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``most`` phrases of two to ``LONGEST`` words."""
    stream = checkpoint(counts(docs, least))
    phrases = stream.where(F.size("words") > 0)
    total = stream.where(F.size("words") == 0).select("lang", F.col("count").alias("n"))
    left = merged(phrases)
    right = merged(phrases.withColumn("words", F.reverse("words"))).withColumn("words", F.reverse("words")).withColumnRenamed("parts", "ends").withColumnRenamed("covers", "covers_end")
    both = checkpoint(left.join(right.drop("count").hint("merge"), ["lang", "words"]))
    inside = both.where("covers").select("lang", F.slice("words", 1, F.size("words") - 1).alias("words")).unionByName(both.where("covers_end").select("lang", F.slice("words", 2, F.size("words") - 1).alias("words"))).distinct()
    stands = both.join(inside.hint("merge"), ["lang", "words"], "left_anti").join(total, "lang")
    # Products of two counts of 19 digits at most; each phrase has four cuts at most.
    worst = F.expr("""array_min(transform(parts, (l, i) -> struct(
        (1000BD * cast(count AS decimal(19, 0)) * cast(n AS decimal(19, 0))) div (cast(l AS decimal(19, 0)) * cast(ends[size(ends) - 1 - i] AS decimal(19, 0))) AS score,
        i AS k, l AS l, ends[size(ends) - 1 - i] AS r)))""")
    scored = checkpoint(stands.select("lang", F.array_join("words", " ").alias("phrase"), F.col("count").alias("a"), "n", worst.alias("worst")).select("lang", "phrase", "a", "n", "worst.l", "worst.r", "worst.score"))
    return _ranked(scored, most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
