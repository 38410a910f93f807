"""Bounded lineage walks.

A walk is a breadth-first search run for many start nodes at once. Each start row
carries a key (``incident_id`` by default); the result is one row per
``(key, urn)`` with the hop at which the node was first reached (its minimum hop).

Per level:  frontier JOIN adjacency ON urn = src  (J1)
            -> distinct (key, dst)                 (U1)
            -> LEFT ANTI visited                    (J3)
            -> per-key cap by (hop, urn)            (W1; a small cap before U1 and J3, by key)
            -> written to the shared checkpoint folder (lineage cut)

Scale notes
- Frontier and result rows are (key, urn) pairs; the de-duplication shuffles on both
  columns, so a hub that many keys reach does not land in one task.
- The cap (W1) is a ``row_number() <= literal`` filter; Catalyst plans it as a
  WindowGroupLimit, so each map task keeps at most ``cap`` rows per key before the
  shuffle and a huge key never moves more than ``partitions * cap`` rows.
- A key that reached its cap stops expanding (its frontier rows are dropped).
- The frontier-to-adjacency join is left to AQE: broadcast when the written frontier
  is small, else a shuffle join whose skewed partitions (hub nodes with many
  children, or one node shared by many keys) are split by the skew-join rule.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .closure import reach_upstream


LISTED_NODES = 1000   # up to this cap, what a key has visited is a list


def _nonempty(c):
    return c.isNotNull() & (c != "")


def adjacency(edges: DataFrame, upstream: bool, key: str | None = None) -> DataFrame:
    """Orient the edge set for a walk: ``src`` is the node being expanded, ``urn`` the node reached. Walking upstream follows edges from downstream
    to upstream. With ``key``, the edges are per key (e.g. one evidence subgraph per
    incident) and the walk joins on it too."""
    src, dst = ("downstream", "upstream") if upstream else ("upstream", "downstream")
    keys = [key] if key else []
    return (edges.where(_nonempty(F.col(src)) & _nonempty(F.col(dst)))
            .select(*keys, F.col(src).alias("src"), F.col(dst).alias("urn")).dropDuplicates(keys + ["src", "urn"]))


def _cap_rank(df: DataFrame, key: str, order_cols, cap: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order_cols)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.lit(cap))


def walk(starts: DataFrame, edges: DataFrame | None, *, upstream: bool, max_hops: int | None,
         max_nodes: int | None = None, max_per_node: int | None = None,
         key: str = "incident_id", adj: DataFrame | None = None,
         edges_distinct: bool = False, partition_adjacency: bool = False) -> DataFrame:
    """G1: multi-source walk, as :func:`walk_levels` has it. Upstream walks without caps over an
    edge set share the reach of common inputs (:func:`closure.reach_upstream`)."""
    if upstream and adj is None and max_nodes is None and max_per_node is None and not partition_adjacency:
        return reach_upstream(starts, edges, max_hops, key, edges_distinct).rows()
    return walk_levels(starts, edges, upstream=upstream, max_hops=max_hops, max_nodes=max_nodes, max_per_node=max_per_node, key=key,
                       adj=adj, edges_distinct=edges_distinct, partition_adjacency=partition_adjacency)


def walk_levels(starts: DataFrame, edges: DataFrame | None, *, upstream: bool, max_hops: int | None,
                max_nodes: int | None = None, max_per_node: int | None = None,
                key: str = "incident_id", adj: DataFrame | None = None,
                edges_distinct: bool = False, partition_adjacency: bool = False) -> DataFrame:
    """G1 level by level: bounded multi-source walk.

    ``starts`` has columns ``(key, urn)``; ``edges`` is ``(upstream, downstream)``
    (or pass a prepared ``adj`` from :func:`adjacency`). Returns ``(key, urn, hop)``;
    the start is hop 0 and counts toward ``max_nodes`` (W1, order ``(hop, urn)``).
    ``max_per_node`` caps the neighbours taken per expanded node, in URN order (W2).
    ``max_hops=None`` walks until the frontier is empty (cycles end because reached
    nodes are never re-entered). ``edges_distinct`` skips the edge de-duplication when
    the caller's edge set is already a set. ``partition_adjacency`` hash-partitions and
    persists the adjacency on the join key once, so each level shuffles only its
    frontier; at sf0.1 on one machine persisting cost about what it saved (measured),
    so it is off by default and meant for long walks of large frontiers over very large
    edge sets (small frontiers are broadcast by AQE anyway).

    With a cap, each level row carries ``n``: its key's node count after that level. The
    frontier of the next level takes ``n`` along through the join, so the remaining room
    of a key is known without a per-level counts table; a key at its cap stops.
    """
    if adj is None:
        adj = walk_adjacency(edges, edges_distinct, upstream)
        adj = adj if edges_distinct else materialize(adj, "adjacency")   # a set is read as it is
    capped = max_nodes is not None
    level0 = (starts.select(F.col(key), F.col("urn"))
              .where(_nonempty(F.col("urn")) & F.col(key).isNotNull())
              .dropDuplicates([key, "urn"]))
    cols = [key, "urn", "hop"]
    if capped:
        # several start rows per key: keep the smallest URNs first
        level0 = _cap_rank(level0, key, [F.col("urn")], max_nodes)
        level0 = level0.withColumn("n", F.max("_rn").over(Window.partitionBy(key))).drop("_rn")
        cols = cols + ["n"]
    level0 = materialize(level0.select(key, "urn", F.lit(0).alias("hop"),
                                       *(["n"] if capped else [])), "walk-level")
    levels = [level0]
    frontier = level0.where(F.col("n") < max_nodes) if capped else level0

    on = ([key] if key in adj.columns else []) + ["src"]
    if partition_adjacency:
        # hash-partition the adjacency on the join key once and keep it (memory, then
        # disk; a lost block is recomputed from the written parquet): later levels shuffle
        # only their frontier, not the whole edge set again
        n_parts = int(adj.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        adj = adj.repartition(n_parts, *on).persist(StorageLevel.MEMORY_AND_DISK)
    hop = 0
    while max_hops is None or hop < max_hops:
        if frontier.isEmpty():
            break
        hop += 1
        carry = [F.col("n").alias("n_prev")] if capped else []
        cand = frontier.select(key, F.col("urn").alias("src"), *carry).join(adj, on)
        if max_per_node is not None:
            cand = _per_node(cand, key, max_per_node)
        visited = _union_all([lv.select(key, "urn") for lv in levels])
        if capped and max_nodes <= LISTED_NODES:
            new = _unvisited_of_capped(cand.select(key, "urn", "n_prev"), visited, key, max_nodes)
        else:
            cand = cand.select(key, "urn", *(["n_prev"] if capped else [])).dropDuplicates([key, "urn"])
            new = cand.join(visited, [key, "urn"], "left_anti")
        if capped:
            ranked = _cap_rank(new, key, [F.col("urn")], max_nodes)
            ranked = ranked.where(F.col("_rn") <= F.lit(max_nodes) - F.col("n_prev"))
            # rows left per key are at most the cap, so this window is bounded
            new = ranked.withColumn("n", F.col("n_prev") + F.max("_rn").over(Window.partitionBy(key)))
        new = materialize(new.select(key, "urn", F.lit(hop).alias("hop"),
                                     *(["n"] if capped else [])), "walk-level")
        levels.append(new)
        frontier = new.where(F.col("n") < max_nodes) if capped else new
    if partition_adjacency:
        adj.unpersist()
    return _union_all([lv.select(key, "urn", "hop") for lv in levels])


def _unvisited_of_capped(cand: DataFrame, visited: DataFrame, key: str, cap: int) -> DataFrame:
    """The distinct candidates that their key has not visited, as far as the cap may take them. A key
    has visited ``cap`` nodes at most, so its first ``2 * cap`` distinct candidates hold all that it can
    take, and what it has visited is a short list: all lie by key, and a hub's children are cut
    to these before the shuffle."""
    w = Window.partitionBy(key).orderBy("urn")
    first = cand.withColumn("_dr", F.dense_rank().over(w)).where(F.col("_dr") <= F.lit(2 * cap)).select(key, "urn", "n_prev").dropDuplicates([key, "urn"])
    seen = visited.groupBy(key).agg(F.collect_list("urn").alias("_seen"))
    return first.join(seen, key).where(~F.array_contains("_seen", F.col("urn"))).drop("_seen")


def walk_adjacency(edges: DataFrame, edges_distinct: bool = False, upstream: bool = False) -> DataFrame:
    """What :func:`walk` takes as ``adj``; write it once and share it among walks of a direction."""
    return _no_dedup(edges, upstream) if edges_distinct else adjacency(edges, upstream)


def _no_dedup(edges: DataFrame, upstream: bool) -> DataFrame:
    src, dst = ("downstream", "upstream") if upstream else ("upstream", "downstream")
    return (edges.where(_nonempty(F.col(src)) & _nonempty(F.col(dst)))
            .select(F.col(src).alias("src"), F.col(dst).alias("urn")))


def _per_node(cand: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(key, "src").orderBy("urn")
    return cand.withColumn("_pn", F.row_number().over(w)).where(F.col("_pn") <= F.lit(k)).drop("_pn")


def _union_all(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def walk_upstream(starts: DataFrame, edges: DataFrame, max_hops: int | None = None, max_nodes: int | None = None,
                  key: str = "incident_id", edges_distinct: bool = False) -> DataFrame:
    """G2 (walk part): upstream evidence nodes, the start included at hop 0; all of them
    unless a bound is given."""
    return walk(starts, edges, upstream=True, max_hops=max_hops, max_nodes=max_nodes, key=key,
                edges_distinct=edges_distinct)


def walk_downstream(starts: DataFrame, edges: DataFrame, max_hops: int | None = None, max_nodes: int | None = None,
                    key: str = "incident_id", include_root: bool = False,
                    edges_distinct: bool = False, adj: DataFrame | None = None) -> DataFrame:
    """G3 (walk part): downstream nodes; the root is counted in the cap but excluded (F2)."""
    out = walk(starts, edges, upstream=False, max_hops=max_hops, max_nodes=max_nodes, key=key,
               edges_distinct=edges_distinct, adj=adj)
    return out if include_root else out.where(F.col("hop") > 0)


def walked_edges(nodes: DataFrame, edges: DataFrame, *, upstream: bool, max_hops: int | None,
                 key: str = "incident_id") -> DataFrame:
    """G4 + J4: the real edges a walk traversed, diamonds and cycles included.

    Every node expanded by the walk (``hop < max_hops``) contributes all its edges in the
    walk direction; an edge is kept when both of its ends were reached. The output keeps
    the (upstream, downstream) orientation."""
    src, dst = ("downstream", "upstream") if upstream else ("upstream", "downstream")
    adj = (edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
           .where(_nonempty(F.col("src")) & _nonempty(F.col("dst"))))
    expanded = nodes if max_hops is None else nodes.where(F.col("hop") < max_hops)
    e = (expanded.select(key, F.col("urn").alias("src")).join(adj, "src")
         .join(nodes.select(key, F.col("urn").alias("dst")), [key, "dst"], "left_semi"))
    up, down = (F.col("dst"), F.col("src")) if upstream else (F.col("src"), F.col("dst"))
    return e.select(key, up.alias("upstream"), down.alias("downstream")).dropDuplicates()


def walked_edges_upstream(starts: DataFrame, edges: DataFrame, *, max_hops: int | None, key: str = "incident_id",
                          edges_distinct: bool = False) -> DataFrame:
    """:func:`walked_edges` of an upstream walk without caps: every input of an expanded node is
    reached, so the edges are the expanded nodes' inputs, which the lists carry along."""
    reach = reach_upstream(starts, edges, max_hops, key, edges_distinct).compose(own="inputs")
    if reach.shared and reach.base is None:
        out = reach.lists.select(key, F.inline("nodes"))
        out = (out if max_hops is None else out.where(F.col("hop") < max_hops)).select(
            key, F.explode("inputs").alias("upstream"), F.col("urn").alias("downstream"))
        if reach.left is None:
            return out
        left = walk_levels(reach.left, reach.edges, upstream=True, max_hops=max_hops, key=key, edges_distinct=True)
        return out.unionByName(walked_edges(left, edges, upstream=True, max_hops=max_hops, key=key))
    return walked_edges(reach.rows(), edges, upstream=True, max_hops=max_hops, key=key)


def induced_edges(nodes: DataFrame, edges: DataFrame, key: str = "incident_id") -> DataFrame:
    """Edges whose two ends are both in a key's node set: ``(key, upstream, downstream)``."""
    n = nodes.select(key, "urn")
    return (edges.select("upstream", "downstream")
            .join(n.withColumnRenamed("urn", "downstream"), "downstream")
            .join(n.withColumnRenamed("urn", "upstream"), [key, "upstream"], "left_semi")
            .select(key, "upstream", "downstream").dropDuplicates())


def induced_adjacency(nodes: DataFrame, edges: DataFrame, key: str = "incident_id",
                      edges_distinct: bool = False) -> DataFrame:
    """The walk adjacency (downstream direction) of each key's induced subgraph: edges whose
    two ends are both in the key's node set. The join starts from the
    downstream end (small in-degree), so a hub's fan-out is never expanded per key."""
    n = nodes.select(key, "urn")
    out = (walk_adjacency(edges, True).join(n, "urn").join(n.select(key, F.col("urn").alias("src")), [key, "src"], "left_semi")
           .select(key, "src", "urn"))
    return out if edges_distinct else out.dropDuplicates([key, "src", "urn"])


def reached_adjacency(reached: DataFrame, edges: DataFrame, edges_distinct: bool = False) -> DataFrame:
    """The downstream walk adjacency among the nodes ``reached(urn)``, for all walks together.
    ``reached`` is closed upstream (what unbounded upstream walks reach), so an edge whose
    downstream end is in it has both ends in it."""
    adj = walk_adjacency(edges, edges_distinct)
    return adj.join(reached.select("urn"), "urn", "left_semi").select("src", "urn")


def reach_of_others(roots: DataFrame, edges: DataFrame | None, *, edges_distinct: bool = False,
                    adj: DataFrame | None = None) -> DataFrame:
    """``urn`` of every node downstream of at least one other node of ``roots(urn)``, each once:
    the union of all blast radii without the (root, node) pairs.

    One walk for all roots: a node takes note of the first two roots that reach it and passes on
    just these, so there are at most two rows a node, whatever the number of roots. Two are
    enough: a node that several roots reach has two of them, and a root that only itself reaches
    (in a cycle, or not at all) has one and is left out."""
    if adj is None:
        adj = walk_adjacency(edges, edges_distinct)
        adj = adj if edges_distinct else materialize(adj, "adjacency")
    start = materialize(roots.where(_nonempty(F.col("urn"))).select("urn").distinct().select(
        "urn", F.monotonically_increasing_id().alias("origin")), "reach-roots")
    levels, frontier = [start], start
    while not frontier.isEmpty():
        cand = (frontier.select(F.col("urn").alias("src"), "origin").join(adj, "src")
                .groupBy("urn").agg(F.min("origin").alias("lo"), F.max("origin").alias("hi")))
        known = _union_all([lv.select("urn", "origin") for lv in levels]).groupBy("urn").agg(
            F.count(F.lit(1)).alias("c"), F.min("origin").alias("o"))
        other = F.when(F.col("lo") != F.col("o"), F.col("lo")).when(F.col("hi") != F.col("o"), F.col("hi"))
        add = F.when(F.col("c").isNull(), F.array_distinct(F.array("lo", "hi"))).when((F.col("c") == 1) & other.isNotNull(), F.array(other))
        frontier = materialize(cand.join(known, "urn", "left").select("urn", F.explode(add).alias("origin")), "reach-level")
        levels.append(frontier)
    own = start.select("urn", F.col("origin").alias("own"))
    return (_union_all(levels).join(own, "urn", "left").where(F.col("own").isNull() | (F.col("own") != F.col("origin")))
            .select("urn").distinct())


def hop_label(hop="hop"):
    """Reference parity: the start is 0, every other node 1."""
    return F.least(F.col(hop), F.lit(1))
