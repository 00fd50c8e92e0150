"""Sharding by balanced label propagation: linked documents move to the shard where most of their neighbours are.

Documents with equal texts (by SHA-256) are linked. Each starts in the shard that a hash of its id gives. In each
round the links are joined with the labels: a group's documents ask for the shard with room that most of the group's
documents have. Requests are ranked by gain, and as many documents are admitted as a shard has room, so no shard ever
takes more than its capacity. Documents of one group in one shard are alike, so the state is their count by group and
shard: at most as many rows per group as there are shards, however large the group. Documents without links are then
dealt so that the shards' row counts differ by one at most (law ``rows``); a group is only cut where it doesn't fit.
``linked`` and ``linked_here`` tell the links of each document and those that aren't cut.

Ranks and running sums come from a range partitioning and the partitions' sums, so no shard is gathered in one task.

Cases: a null text has no bytes, crc32 0 and no links, an empty text is linked to the other empty ones; repeated
rows, and rows without id, are placed each by itself; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import checkpoint

SHARDS, ROUNDS, ROW_BYTES = 40, 8, 16
#: Rows of a group are spread over so many tasks where they meet what the group has once.
SALTS = 16


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str, amount: str | None = None) -> DataFrame:
    """``rows`` with what comes before each within ``keys``, by ``order``: the number of rows, or their sum of ``amount``.
    Checkpointed, with the columns pid and ``name``."""
    dealt = checkpoint(rows.repartitionByRange(*keys, *order).withColumn("pid", F.spark_partition_id()))
    size = F.lit(1).cast("long") if amount is None else F.col(amount)
    sums = dealt.groupBy("pid", *keys).agg(F.sum(size).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("pid", *keys, F.coalesce(before, F.lit(0)).alias("__before"))
    own = Window.partitionBy("pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(size).over(own), F.lit(0))
    return dealt.withColumn("__at", local).join(offsets, ["pid", *keys]).withColumn(name, F.col("__before") + F.col("__at")).drop("__before", "__at")


def propagate(state: DataFrame, capacity: int, rounds: int, shards: int) -> DataFrame:
    """state: g, label, n. Rounds of requests and admissions, until nothing moves."""
    state = checkpoint(state)
    for _ in range(rounds):
        load = {r["label"]: r["n"] for r in state.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        room = {s: capacity - load.get(s, 0) for s in range(shards) if capacity > load.get(s, 0)}
        if not room:
            return state
        # Each group's best shard with room; documents never leave a shard for one with fewer of their group.
        goals = state.where(F.col("label").isin(list(room))).groupBy("g").agg(F.max(F.struct("n", (-F.col("label")).alias("minus"))).alias("goal"))
        asked = state.join(goals, "g").select("g", "label", "n", (-F.col("goal.minus")).alias("to"), (F.col("n") - F.col("goal.n")).alias("loss"))
        asked = asked.where((F.col("loss") < 0) | (F.col("loss") == 0) & (F.col("to") < F.col("label")))
        queue = ranked(asked, ["to"], ["loss", "g", "label"], "before", "n")
        left = F.create_map(*[F.lit(x) for s, n in room.items() for x in (s, n)])[F.col("to")] - F.col("before")
        moves = checkpoint(queue.withColumn("moved", F.least("n", left)).where("moved > 0").select("g", "label", "to", "moved"))
        if moves.isEmpty():
            return state
        gone = moves.select("g", "label", (-F.col("moved")).alias("n"))
        come = moves.select("g", F.col("to").alias("label"), F.col("moved").alias("n"))
        state = checkpoint(state.unionByName(gone).unionByName(come).groupBy("g", "label").agg(F.sum("n").alias("n")).where("n > 0"))
    return state


def _interval(at: Column, table: list[tuple[int, int, int, int]]) -> Column:
    """Of (first, end, shard, slot of the first), the struct whose interval holds ``at``: one row per shard at most."""
    entries = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("end"), F.lit(s).alias("shard"), F.lit(o).alias("slot")) for a, b, s, o in table])
    return F.get(F.filter(entries, lambda e: (e["first"] <= at) & (at < e["end"])), F.lit(0))


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law); linked: other documents of the same
    text, linked_here: those in the same shard (the other links are cut)."""
    text = F.col("text").cast("string")
    base = checkpoint(
        docs.select(F.col("doc_id").cast("long"), text.alias("text")).select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("g"),
            F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("label"),
        )
    )
    total = base.count()
    target = [total // shards + (s < total % shards) for s in range(shards)]
    state = base.where("g IS NOT NULL").groupBy("g", "label").agg(F.count("*").alias("n"))
    sizes = state.groupBy("g").agg(F.sum("n").alias("m")).where("m > 1").select("g")
    settled = propagate(state.join(sizes, "g", "left_semi"), total // shards, rounds, shards)
    shares = settled.groupBy("g").agg(F.sort_array(F.collect_list(F.struct(F.col("n").alias("n"), "label")), asc=False).alias("parts"))
    placed = _per_group(base, shares)
    several = F.coalesce(F.size("parts") > 1, F.lit(False))
    one = placed.where(~several).withColumn("shard", F.coalesce(F.col("parts")[0]["label"], F.col("label"))).withColumn("single", F.col("parts").isNull())
    split = ranked(placed.where(several), ["g"], ["doc_id"], "at")
    upto = F.aggregate(
        "parts",
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("label")),
        lambda done, part: F.struct((done["sum"] + part["n"]).alias("sum"), F.when(done["label"] >= 0, done["label"]).when(F.col("at") < done["sum"] + part["n"], part["label"]).otherwise(-1).alias("label")),
    )
    cut = split.withColumn("shard", upto["label"]).withColumn("single", F.lit(False))
    names = ["doc_id", "size", "text_crc32", "g", "shard", "single"]
    # Linked documents come first in their shard; what is beyond a shard's target goes where rows lack.
    numbered = checkpoint(ranked(one.select(*names).unionByName(cut.select(*names)), ["shard"], ["single", "g", "doc_id"], "rank"))
    count = {r["shard"]: r["n"] for r in numbered.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    extra_first, lacking, begin, fill = {}, [], 0, 0
    for s in range(shards):
        have = count.get(s, 0)
        extra_first[s] = begin
        begin += max(0, have - target[s])
        if have < target[s]:
            lacking.append((fill, fill + target[s] - have, s, have))
            fill += target[s] - have
    limit = F.array(*[F.lit(t) for t in target])[F.col("own")]
    start = F.array(*[F.lit(extra_first[s]) for s in range(shards)])[F.col("own")]
    at = start + F.col("rank") - limit
    new = _interval(at, lacking) if lacking else F.lit(None)
    beyond = F.col("rank") >= limit
    to_shard = F.when(beyond, new["shard"]).otherwise(F.col("own")) if lacking else F.col("own")
    to_slot = F.when(beyond, new["slot"] + at - new["first"]).otherwise(F.col("rank")) if lacking else F.col("rank")
    # Another name: a new column called shard would be taken for the old one within the filter.
    done = numbered.withColumnRenamed("shard", "own").withColumns({"__to": to_shard.cast("int"), "__slot": to_slot.cast("long")})
    together = done.where("NOT single").groupBy("g", "__to").agg(F.count("*").alias("n")).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("__to", "n"))).alias("here"), F.sum("n").alias("all"))
    return _per_group(done, together).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("__to").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.coalesce(F.col("all") - 1, F.lit(0)).alias("linked"), F.coalesce(F.col("here")[F.col("__to")] - 1, F.lit(0)).alias("linked_here"),
    )


def _per_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with what ``groups`` has for their g, if anything: a join that spreads a group's rows over SALTS tasks."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    spread = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, ["g", "__salt"], "left").drop("__salt")
