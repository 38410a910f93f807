"""Upstream walks by shared parts: what a node reaches is itself and what its inputs reach,
one hop further. The inputs of all starts are far fewer than the starts where lineage fans
out (a customer's orders, an order's lines), so each is walked once and its reach, a small
packed list, goes to everything that reads from it.

Down:  pairs(k, urn) JOIN edges ON urn = downstream -> links(k, up); their distinct ``up``
       are the next level's pairs. Each level's nodes are at most half as many as the last's.
Up:    links JOIN reach ON up -> the lists of a key's inputs, merged with the least hop.

A list is packed only up to ``PACK_NODES`` nodes and from ``PACK_INPUTS`` inputs; keys beyond,
keys with several starts and levels that don't shrink (cycles, chains) are walked level by
level (:func:`walk.walk_levels`), so the result is the same for any graph.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .enrich import evidence_count

PACK_INPUTS, PACK_NODES, MAX_LEVELS = 64, 1000, 16


def _present(c: str):
    return F.col(c).isNotNull() & (F.col(c) != "")


@dataclass
class Reach:
    """The downward half of a walk of ``starts(key, urn)``; :meth:`compose` is the upward one."""
    key: str
    starts: DataFrame         # (key, urn), as given
    edges: DataFrame          # (upstream, downstream), a set
    max_hops: int | None
    levels: list              # (pairs(k, urn), links(k, up, many) or None), from the starts up
    several: DataFrame | None     # keys with several starts
    base: DataFrame | None    # (k, urn, hop): the last links' inputs, walked level by level
    shared: bool              # False: nothing to share, all keys are walked level by level
    lists: DataFrame | None = None    # (key, nodes), composed
    made: DataFrame | None = None     # (key, evidence_nodes, columns made of the lists), composed
    left: DataFrame | None = None     # the starts left to a walk by levels
    walked: DataFrame | None = None   # their walk

    def compose(self, extra: DataFrame | None = None, own: str | None = None, by_key: DataFrame | None = None, once: bool = False,
                made: list | None = None) -> "Reach":
        """Composes and writes the lists ``nodes`` of structs ``(urn, hop, *extra, own)``. ``extra`` has
        at most one row an ``urn``. ``own`` is a field made of a node's own reach: ``inputs``, its
        direct inputs, or ``dist``, the hops from the nearest node whose extra ``_sigs`` isn't null
        (None: neither). It needs all lists (:meth:`complete`). ``by_key``, rows of ``key`` and more
        columns, come along as the array ``rows_of_key`` (null: none); ``once`` says that no key repeats in it.

        With ``made``, columns made of ``nodes`` and ``rows_of_key``, these and the lists' lengths are
        written instead of the lists, which take far more; a key's own node (hop 0) has no ``extra`` then."""
        if self.shared:
            reach = None if self.base is None else _packed_rows(_with(self.base, extra), extra, own)
            for i, (pairs, links) in reversed(list(enumerate(self.levels))):
                reach = _composed(pairs, links, reach, extra, own, bare=made is not None and i == 0)
            more = []
            if by_key is not None:   # joined here, where the lists lie by key anyway
                more = ["rows_of_key"]
                rest = F.struct(*[c for c in by_key.columns if c != self.key])
                of = by_key.where(F.col(self.key).isNotNull()).select(F.col(self.key).alias("k"), F.array(rest).alias("rows_of_key")) if once else (
                    by_key.groupBy(F.col(self.key).alias("k")).agg(F.collect_list(rest).alias("rows_of_key")))
                reach = reach.join(of, "k", "left")
            heavy = F.col("nodes").isNull().alias("heavy")
            reach = materialize(reach.select("*", heavy) if made is None else reach.select("k", heavy, F.size("nodes").cast("bigint").alias("evidence_nodes"), *made), "reach")
            heavy = reach.where("heavy").select(F.col("k").alias(self.key))
            left = self.several if heavy.isEmpty() else heavy if self.several is None else heavy.unionByName(self.several)
            self.left = None if left is None else self.starts.join(left, self.key, "left_semi")
            light = reach.where(~F.col("heavy")).withColumnRenamed("k", self.key).drop("heavy")
            if made is None:
                self.lists = light.select(self.key, "nodes", *more)
            else:
                self.made = light
        else:
            self.left = self.starts
        return self

    def complete(self) -> bool:
        """Whether every key has a list, each composed of its inputs' lists."""
        return self.shared and self.base is None and self.left is None

    def counts(self) -> DataFrame:
        """``(key, evidence_nodes)``, the number of every key's rows."""
        if self.made is not None and self.left is None:
            return self.made.select(self.key, "evidence_nodes")
        if self.lists is not None and self.left is None:
            return self.lists.select(self.key, F.size("nodes").cast("bigint").alias("evidence_nodes"))
        return evidence_count(self.rows(), self.key)

    def nodes(self) -> DataFrame:
        """The distinct ``urn`` of all rows: those of the levels, where all keys have lists of them."""
        if self.complete() and self.max_hops is None:
            return reduce(DataFrame.unionByName, [pairs.select("urn") for pairs, _ in self.levels]).distinct()
        return self.rows().select("urn").distinct()

    def rows(self) -> DataFrame:
        """``(key, urn, hop)``."""
        from .walk import walk_levels
        if self.lists is None and (self.shared or self.left is None):
            self.compose()
        out = None if self.lists is None else self.lists.select(self.key, F.inline("nodes")).select(self.key, "urn", "hop")
        if self.left is not None:
            if self.walked is None:
                self.walked = walk_levels(self.left, self.edges, upstream=True, max_hops=self.max_hops, key=self.key, edges_distinct=True)
            out = self.walked if out is None else out.unionByName(self.walked)
        return out


def repeated_keys(df: DataFrame, key: str) -> tuple[DataFrame | None, int]:
    """The hashes ``h`` of the keys that repeat (None: no key does), and the number of rows. Only
    hashes are grouped, so that a key that doesn't repeat but shares another's hash is among them."""
    counts = df.groupBy(F.xxhash64(key).alias("h")).agg(F.count(F.lit(1)).alias("c"))
    rows, more = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 1)).first()
    return (materialize(counts.where("c > 1").select("h"), "repeated-keys") if more else None), rows


def reach_upstream(starts: DataFrame, edges: DataFrame, max_hops: int | None = None, key: str = "incident_id",
                   edges_distinct: bool = False, shrink: float = 0.5) -> Reach:
    """The downward half. A level with more than ``shrink`` times the nodes of the last ends it."""
    from .walk import walk_levels
    edges = edges.select("upstream", "downstream").where(_present("upstream") & _present("downstream"))
    edges = edges if edges_distinct else materialize(edges.distinct(), "edge-set")
    starts = starts.select(key, "urn").where(F.col(key).isNotNull() & _present("urn"))
    pairs, several, size = starts.select(F.col(key).alias("k"), "urn"), None, None
    again, size = repeated_keys(starts, key)
    if again is not None:   # only keys that repeat, if any, are grouped
        of = pairs.withColumn("h", F.xxhash64("k"))
        one = of.join(again, "h", "left_semi").groupBy("k").agg(F.min("urn").alias("urn"), F.max("urn").alias("_last"))
        one = materialize(of.join(again, "h", "left_anti").select("k", "urn", F.col("urn").alias("_last")).unionByName(one), "reach-starts")
        several = one.where("urn != _last").select(F.col("k").alias(key))
        several = None if several.isEmpty() else several
        pairs = one.where("urn = _last").select("k", "urn")
        size = pairs.count()
    out = Reach(key, starts, edges, max_hops, [], several, None, True)
    # nodes with more inputs than a list is packed from, by hash: a node that shares one's hash is walked by levels too
    busy = materialize(edges.groupBy(F.xxhash64("downstream").alias("h")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > PACK_INPUTS).select("h"), "reach-busy")
    busy = None if busy.isEmpty() else busy.withColumn("many", F.lit(True))
    while True:
        hops = None if max_hops is None else max_hops - len(out.levels)
        if hops == 0:
            out.levels.append((pairs, None))
            return out
        links = pairs.join(edges, F.col("urn") == F.col("downstream"))
        links = links.withColumn("many", F.lit(False)) if busy is None else links.withColumn("h", F.xxhash64("urn")).join(busy, "h", "left")
        links = materialize(links.select("k", F.col("upstream").alias("up"), F.coalesce("many", F.lit(False)).alias("many")), "reach-links")
        above = materialize(links.select(F.col("up").alias("k")).distinct(), "reach-nodes").select("k", F.col("k").alias("urn"))
        last, size = size, above.count()
        if size == 0:
            out.levels.append((pairs, None))
            return out
        if size > shrink * last or len(out.levels) == MAX_LEVELS:
            out.shared = bool(out.levels)
            out.levels.append((pairs, links))
            if out.shared:
                out.base = materialize(walk_levels(above, edges, upstream=True, max_hops=None if hops is None else hops - 1,
                                                   key="k", edges_distinct=True), "reach-base")
            return out
        out.levels.append((pairs, links))
        pairs = above


def _with(rows: DataFrame, extra: DataFrame | None) -> DataFrame:
    return rows if extra is None else rows.join(extra, "urn", "left").select(*rows.columns, *[c for c in extra.columns if c != "urn"])


def _names(extra: DataFrame | None) -> list[str]:
    return [] if extra is None else [c for c in extra.columns if c != "urn"]


def _packed_rows(rows: DataFrame, extra: DataFrame | None, own: str | None) -> DataFrame:
    """``(k, nodes)`` of walked rows; ``nodes`` is null where there are too many. The rows of other
    nodes than ``k`` itself tell nothing of those nodes' own reach: ``own`` stays null."""
    kind = {"inputs": "array<string>", "dist": "int"}.get(own)
    node = F.struct("urn", "hop", *_names(extra), *([F.lit(None).cast(kind).alias(own)] if own else []))
    n = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("k")))
    return n.groupBy("k").agg(F.max("_n").alias("_n"), F.collect_list(F.when(F.col("_n") <= PACK_NODES, node)).alias("nodes")).select(
        "k", F.when(F.col("_n") <= PACK_NODES, F.col("nodes")).alias("nodes"))


def _composed(pairs: DataFrame, links: DataFrame | None, above: DataFrame | None, extra: DataFrame | None, own: str | None, bare: bool = False) -> DataFrame:
    """``(k, nodes)`` of one level from its inputs' lists; ``nodes`` is null where an input has no
    list or the lists are too long. ``bare``: the pairs' own nodes are left without ``extra``."""
    names = _names(extra)
    me = pairs.select("k", "urn", *[F.lit(None).cast(extra.schema[c].dataType).alias(c) for c in names]) if bare else _with(pairs, extra)
    me = me.select("k", F.struct("urn", *names).alias("me"))
    first = lambda rest, inputs: F.struct(F.col("me")["urn"].alias("urn"), F.lit(0).alias("hop"), *[F.col("me")[c].alias(c) for c in names],
                                          *([(F.lit(None).cast("int") if bare else _own(own, rest, inputs)).alias(own)] if own else []))
    if links is None:
        empty = F.array().cast("array<struct<hop:int,_sigs:int>>")
        return me.select("k", F.array(first(empty, F.array().cast("array<string>"))).alias("nodes"))
    further = F.transform("nodes", lambda x: x.withField("hop", x["hop"] + 1))
    via = links.join(above.select(F.col("k").alias("up"), further.alias("nodes")), "up", "left").select(
        "k", F.when(~F.col("many"), F.col("nodes")).alias("nodes"), F.when(~F.col("many"), F.col("up")).alias("up"))
    # a window and its row of "me", not a grouping: that would sort the lists twice, before and after the shuffle, for nothing
    w = Window.partitionBy("k")
    ups = [F.collect_list("up").over(w).alias("ups")] if own == "inputs" else []
    both = me.unionByName(via if ups else via.drop("up"), allowMissingColumns=True).select(
        "k", "me", F.count(F.lit(1)).over(w).alias("n"), F.collect_list("nodes").over(w).alias("lists"), *ups).where("me IS NOT NULL")
    ups = ["ups"] if ups else []
    both = both.select("k", "me", *ups, "n", F.when(F.size("lists") == F.col("n") - 1, F.flatten("lists")).alias("all"))
    # one input's list has each node once already
    both = both.select("k", "me", *ups, "n", F.when(F.size("all") < PACK_NODES, F.when(F.col("n") <= 2, F.col("all")).otherwise(F.sort_array("all"))).alias("all"))
    other = lambda x: x["urn"] != F.col("me")["urn"]
    once = F.filter("all", lambda x, i: ((i == 0) | (F.get(F.col("all"), i - 1)["urn"] != x["urn"])) & other(x))
    both = both.select("k", "me", *ups, F.when(F.col("n") <= 2, F.filter("all", other)).otherwise(once).alias("rest"))
    return both.select("k", F.when(F.col("rest").isNotNull(), F.concat(F.array(first(F.col("rest"), F.col("ups") if ups else None)), "rest")).alias("nodes"))


def _own(own: str, rest, inputs):
    if own == "inputs":
        return inputs
    near = F.array_min(F.transform(F.filter(rest, lambda x: x["_sigs"].isNotNull()), lambda x: x["hop"]))
    return F.when(F.col("me")["_sigs"].isNotNull(), F.lit(0)).otherwise(near)
