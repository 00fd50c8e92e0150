"""A manifest of hash trees: one tree per language over its documents, one over the languages' roots, a proof per document.

A leaf is the digest of a document's fields; digests are lower-case hex of SHA-256. In a tree, leaves ascend by id; while
several nodes remain, every two neighbours become the digest of their concatenation, and a last one alone its own digest's.
A proof is the neighbours met on the way to the root, lowest first.

 1. Leaves are digests by Spark's own functions on the scan, so texts are never shuffled. They are sorted by range (language,
    id, digest); numbers of trees and leaves follow from the counts of the ranges before, one row per range.
 2. Going up: superblocks of 2^``HEIGHT`` neighbours become one node each, the nodes again, until one is left per tree.
 3. Going down: the nodes of a superblock are cogrouped with what lies outside it, a row with the neighbours from its
    root upwards, and get the neighbours inside it put in front. So each superblock of leaves needs one outer row.
 4. Leaves and that row are cogrouped by superblock: the local reduction, the proofs and the folding of each presented
    leaf up to the root happen together, in at most 2^``HEIGHT`` rows whatever the size of a language.

Cases: a null field counts as ``-``, a null id comes first, rows of equal id stand in the order of their leaves, equal rows
are leaves of their own; languages order by their bytes, null first; an empty table gives no row. A null presented leaf
stands for the leaf itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import checkpoint

HEIGHT = 10
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_PLACED = "tree long, place long, doc_id string, leaf string, presented string"
_NODES = "tree long, place long, inner string, lone string"
_OUTER = "tree long, place long, whole boolean, beside array<string>, right array<boolean>, subroot string, root string"
_PROVED = "doc_id string, leaf string, subroot string, root string, proof array<string>, folded_root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(changed: dict[str, Column] | None = None) -> Column:
    """A document's leaf; ``changed`` fields in place of the columns of that name."""
    return F.sha2(F.concat(*[field((changed or {}).get(c, F.col(c))) for c in FIELDS]), 256)


def levels(nodes: list[str], height: int | None = None) -> list[list[str]]:
    """All levels of a tree, leaves first; up to ``height`` levels above them, or until one node is left."""
    out = [nodes]
    while len(out[-1]) > 1 if height is None else len(out) <= height:
        last = out[-1]
        out.append([digest("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return out


def _path(tree: list[list[str]], place: int) -> tuple[list[str | None], list[bool]]:
    """The neighbours on a node's way up (None where it is alone) and whether they stand to its right."""
    beside: list[str | None] = []
    right = []
    for level in tree[:-1]:
        other = place ^ 1
        beside.append(level[other] if other < len(level) else None)
        right.append(other > place)
        place >>= 1
    return beside, right


def _folded(node: str, beside: list[str | None], right: list[bool]) -> str:
    for other, after in zip(beside, right, strict=True):
        node = digest(node if other is None else node + other if after else other + node)
    return node


def _placed(seeds: dict[int, tuple[int, int]]):
    """Numbers a range's rows, which ascend: (tree, place) of its first row in ``seeds``."""
    schema = pa.schema([("tree", pa.int64()), ("place", pa.int64()), ("doc_id", pa.string()), ("leaf", pa.string()), ("presented", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, place = seeds.get(TaskContext.get().partitionId(), (0, 0))
        before, begun = None, False
        for batch in batches:
            trees, places = [], []
            for lang in batch.column("lang").to_pylist():
                if begun and lang != before:
                    tree, place = tree + 1, 0
                before, begun = lang, True
                trees.append(tree)
                places.append(place)
                place += 1
            yield pa.RecordBatch.from_arrays([pa.array(trees, pa.int64()), pa.array(places, pa.int64()), *[batch.column(c) for c in ("doc_id", "leaf", "presented")]], schema=schema)

    return run


def placed(leaves: DataFrame) -> DataFrame:
    """Tree and place of each leaf (lang, id, leaf, presented), by ranges that begin where those before them end."""
    spark = leaves.sparkSession
    # Rows equal in all columns may be many: a number of their own spreads them over ranges.
    order = ["lang", "id", "leaf", "presented", "row"]
    ordered = checkpoint(leaves.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order))
    runs = ordered.groupBy(F.spark_partition_id().alias("range"), "lang").count()
    first, last = F.min(F.struct("lang", "count")), F.max(F.struct("lang", "count"))
    # One row per range.
    ranges = sorted(runs.groupBy("range").agg(first.alias("first"), last.alias("last"), F.count("*").alias("langs")).collect())
    seeds: dict[int, tuple[int, int]] = {}
    tree, place, before = -1, 0, None
    for row in ranges:
        goes_on = before is not None and before[0] == row["first"]["lang"]
        seeds[row["range"]] = (tree, place) if goes_on else (tree + 1, 0)
        tree = seeds[row["range"]][0] + row["langs"] - 1
        place = row["last"]["count"] + (seeds[row["range"]][1] if row["langs"] == 1 else 0)
        before = (row["last"]["lang"],)
    return ordered.select("lang", F.col("id").cast("string").alias("doc_id"), "leaf", "presented").mapInArrow(_placed(seeds), _PLACED)


def _reduced(height: int):
    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        """A superblock's node: ``inner`` as one of several in its tree, ``lone`` as the tree's root."""
        nodes = nodes.sort_values("place")
        tree, block, own = int(nodes["tree"].iloc[0]), int(nodes["place"].iloc[0]) >> height, list(nodes["inner"])
        # The only node of its tree is its root already.
        lone = nodes["lone"].iloc[0] if len(own) == 1 and block == 0 else levels(own)[-1][0]
        return pd.DataFrame([(tree, block, levels(own, height)[-1][0], lone)], columns=["tree", "place", "inner", "lone"])

    return run


def _block(height: int) -> Column:
    return F.shiftright("place", height).alias("block")


def raised(nodes: DataFrame, height: int) -> list[DataFrame]:
    """From a level's nodes (tree, place, inner, lone) up to one node per tree; the last table has the roots."""
    out = [nodes]
    while out[-1].agg(F.max("place")).first()[0]:
        out.append(checkpoint(out[-1].groupBy("tree", _block(height)).applyInPandas(_reduced(height), _NODES)))
    return out


def _columns(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def _lowered(height: int):
    def run(key: tuple, nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        """Outer rows of a superblock's nodes, from its own."""
        nodes, above, rows = nodes.sort_values("place"), outer.iloc[0], []
        single = len(nodes) == 1 and above["whole"]
        tree = levels(list(nodes["inner"]), None if above["whole"] else height)
        for i, place in enumerate(nodes["place"]):
            beside, right = ([], []) if single else _path(tree, i)
            rows.append((key[0], place, single, beside + list(above["beside"]), right + list(above["right"]), above["subroot"], above["root"]))
        return pd.DataFrame(rows, columns=_columns(_OUTER))

    return run


def lowered(tables: list[DataFrame], outer: DataFrame, height: int) -> DataFrame:
    """From the outer rows of the roots down to those of the first of ``tables`` (of ``raised``)."""
    for nodes in reversed(tables[:-1]):
        outer = nodes.groupBy("tree", _block(height)).cogroup(outer.groupBy("tree", F.col("place").alias("block"))).applyInPandas(_lowered(height), _OUTER)
    return outer


def _proved(height: int):
    def run(key: tuple, leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        """A superblock's leaves with their proofs, and each presented leaf folded up to the root."""
        leaves, above, rows = leaves.sort_values("place"), outer.iloc[0], []
        tree = levels(list(leaves["leaf"]), None if above["whole"] else height)
        for i, (doc_id, own, presented) in enumerate(zip(leaves["doc_id"], leaves["leaf"], leaves["presented"], strict=True)):
            beside, right = _path(tree, i)
            beside, right = beside + list(above["beside"]), right + list(above["right"])
            rows.append((doc_id, own, above["subroot"], above["root"], [x for x in beside if x is not None], _folded(own if pd.isna(presented) else presented, beside, right)))
        return pd.DataFrame(rows, columns=_columns(_PROVED))

    return run


def manifest(docs: DataFrame, presented: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, folded_root, verified: each document's leaf, its language's root, the root, the
    neighbours from leaf to root, and what the presented leaf (by default the own one) folds to with them."""
    kind = docs.schema["doc_id"].dataType
    own = docs.select(F.col("doc_id").alias("id"), F.col("lang").cast("string"), leaf().alias("leaf"), (F.lit(None).cast("string") if presented is None else presented).alias("presented"))
    leaves = checkpoint(placed(checkpoint(own)))
    up = raised(leaves.select("tree", "place", F.col("leaf").alias("inner"), F.col("leaf").alias("lone")), height)
    # The roots are the leaves of a tree of their own, in the order of the languages.
    top = raised(up[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("lone").alias("inner"), "lone"), height)
    nothing = F.array().cast("array<string>").alias("beside"), F.array().cast("array<boolean>").alias("right")
    summit = top[-1].select("tree", "place", F.lit(True).alias("whole"), *nothing, F.lit(None).cast("string").alias("subroot"), F.col("lone").alias("root"))
    above = lowered(top, summit, height).select(F.col("place").alias("tree"), "beside", "right", "root").join(up[-1].select("tree", F.col("lone").alias("subroot")), "tree")
    above = above.select("tree", F.lit(0).cast("long").alias("place"), F.lit(True).alias("whole"), "beside", "right", "subroot", "root")
    outer = lowered(up[1:], above, height)
    proved = leaves.groupBy("tree", _block(height)).cogroup(outer.groupBy("tree", F.col("place").alias("block"))).applyInPandas(_proved(height), _PROVED)
    return proved.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("verified", F.col("folded_root") == F.col("root"))


def audited(docs: DataFrame, every: int = 7) -> DataFrame:
    """The manifest, with proofs as digests, where documents whose id's checksum ``every`` divides present themselves with
    one character more than they have."""
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    changed = F.when(touched, leaf({"n_chars": F.try_add("n_chars", F.lit(1))}))
    return manifest(docs, changed).withColumn("proof_sha256", F.sha2(F.array_join("proof", ""), 256)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
