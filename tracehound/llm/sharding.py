"""Operator 8, sharding: balanced label propagation over groups of equal texts.

Documents with equal texts are linked. Every document starts in a shard given by a hash of
its id; then, in rounds, linked documents move towards the shard that holds most of their
neighbours, under capacity quotas, so that few links are cut; at the end sizes are made
exactly even (law ``rows``: counts at most one apart).

The state of a round is one row per block (group, home), a block being the documents of a
group whose ids hash to the same of ``HOMES`` homes; even a group with a third of all rows
is at most ``HOMES`` rows, and it can be split over shards. A round joins the blocks with
their group's mass per shard (pre-aggregated); only shard-by-shard sums (shards^2 numbers)
reach the driver. A round moves a block from i to j when the group has more documents in j
and j has room; when more want to enter j than fit, a hash of the group and round picks
the share that fits. Each round is written to the shared folder.

The final evening sorts (shard, linked first, group) by range over all tasks and numbers rows
with per-task offsets; rows past a shard's quota, unlinked ones first, fill the gaps of the
other shards. The row number is the slot.

Defined results: null texts and texts that occur once are linked with nothing (crc32 of a
null text is 0, its size 1); equal empty texts are a group; every repeated row gets its own
slot; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import long_ids, with_column_names, written

SHARDS = 8
HOMES = 128
ROUNDS = 8


def _by_shard(column, values: list[int]):
    out = F.lit(None).cast("long")
    for s, v in enumerate(values):
        out = F.when(column == s, F.lit(v)).otherwise(out)
    return out.cast("long")


def propagate(blocks: DataFrame, capacity: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``blocks``: ``grp, home, n, shard``. Returns the same rows with their final shard."""
    for t in range(rounds):
        load = [0] * shards
        for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # one row per shard
            load[r.shard] = r.n
        room = [max(0, capacity - x) for x in load]
        mass = blocks.groupBy("grp", "shard").agg(F.sum("n").alias("m"))
        rank = F.struct("m", F.xxhash64("grp", "shard").alias("tie"))  # ties go to different shards
        best = (mass.where(_by_shard(F.col("shard"), room) > 0).groupBy("grp")
                .agg(F.max_by("shard", rank).alias("to"), F.max(rank).alias("to_rank"), F.sum("m").alias("g")))
        own = mass.select("grp", "shard", rank.alias("own_rank"))
        wish = (blocks.join(best, "grp", "left").join(own, ["grp", "shard"], "left")
                .withColumn("moves", F.coalesce((F.col("to") != F.col("shard")) & (F.col("to_rank") > F.col("own_rank")), F.lit(False))))
        wish = written(wish.select("grp", "home", "n", "shard", "to", "g", "moves"), "shard-wishes")
        into = [0] * shards
        for r in wish.where("moves").groupBy("to").agg(F.sum("n").alias("n")).collect():
            into[r.to] = r.n
        if not sum(into):
            break
        # a group moves whole where it fits easily; a very large one goes home by home
        large = F.col("g") * 16 > capacity
        coin = F.pmod(F.xxhash64("grp", F.when(large, F.col("home")).otherwise(-1), F.lit(t)), F.lit(1 << 20))
        share = [int((1 << 20) * min(1.0, room[s] / into[s])) if into[s] else 0 for s in range(shards)]
        go = F.col("moves") & (coin < _by_shard(F.col("to"), share))
        blocks = written(wish.select("grp", "home", "n", F.when(go, F.col("to")).otherwise(F.col("shard")).alias("shard")), "shard-blocks")
    return blocks


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, linked`` for every row of ``docs``."""
    d = long_ids(with_column_names(docs, "doc_id", "text"))
    base = written(d.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text", F.length("text")).alias("grp"), F.col("text").isNotNull().alias("has_text"),
        F.pmod(F.xxhash64("doc_id"), F.lit(HOMES)).cast("int").alias("home"), F.monotonically_increasing_id().alias("rid")), "shard-base")
    # text_crc32 and size join the group's key: equal groups are equal in three digests
    key = ["grp", "text_crc32", "size"]
    total = base.count()
    capacity = -(-total // shards)
    blocks = base.where("has_text").groupBy(*key, "home").agg(F.count(F.lit(1)).alias("n"))
    blocks = blocks.join(blocks.groupBy(*key).agg(F.sum("n").alias("g")).where("g > 1").drop("g"), key, "left_semi")
    group = F.xxhash64(*key)
    blocks = written(blocks.select(group.alias("grp"), "home", "n", (F.col("home") % shards).alias("shard")), "shard-blocks")
    final = propagate(blocks, capacity, shards, rounds).select("grp", "home", F.col("shard").alias("at"))
    placed = (base.withColumn("grp", F.when(F.col("has_text"), group)).join(final, ["grp", "home"], "left")
              .select("rid", "doc_id", "size", "text_crc32", "grp", F.col("at").isNotNull().alias("linked"),
                      F.coalesce("at", F.col("home") % shards).cast("int").alias("shard")))
    # numbered by range: sorted over all tasks, row index in the task, offsets per (task, shard)
    order = [F.col("shard"), ~F.col("linked"), F.when(F.col("linked"), F.col("grp")), F.xxhash64("doc_id"), F.col("rid")]
    rows = written(placed.repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("idx", F.monotonically_increasing_id()).drop("grp", "rid"), "shard-order")
    rows = rows.withColumn("task", F.shiftright("idx", 33))
    tasks = rows.groupBy("task", "shard").agg(F.min("idx").alias("lo"), F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    # as many rows as tasks and shards together
    tasks = tasks.select("task", "shard", (F.coalesce(before, F.lit(0)) - F.col("lo")).alias("shift"))
    rows = rows.join(F.broadcast(tasks), ["task", "shard"]).withColumn("rank", F.col("idx") + F.col("shift"))
    load = [0] * shards
    for r in base_counts(rows, shards):
        load[r.shard] = r.n
    # the shards with the largest loads keep the odd rows
    larger = set(sorted(range(shards), key=lambda s: (-load[s], s))[:total % shards])
    quota = [total // shards + (s in larger) for s in range(shards)]
    over = [max(0, load[s] - quota[s]) for s in range(shards)]
    gap = [max(0, quota[s] - load[s]) for s in range(shards)]
    over_before = [sum(over[:s]) for s in range(shards)]
    spare = F.col("rank") - _by_shard(F.col("shard"), quota) + _by_shard(F.col("shard"), over_before)
    to, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    done = 0
    for s in range(shards):
        if gap[s]:
            inside = (spare >= done) & (spare < done + gap[s])
            to, slot = F.when(inside, s).otherwise(to), F.when(inside, spare - done + load[s]).otherwise(slot)
            done += gap[s]
    kept = F.col("rank") < _by_shard(F.col("shard"), quota)
    return rows.select("doc_id", "size", "text_crc32", F.when(kept, F.col("shard")).otherwise(to).cast("int").alias("shard"),
                       F.when(kept, F.col("rank")).otherwise(slot).cast("long").alias("slot"), "linked")


def base_counts(rows: DataFrame, shards: int):
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per shard


def digest(docs: DataFrame) -> DataFrame:
    """The registered query."""
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                              F.lit(None).cast("int").alias("grown_shard"))
