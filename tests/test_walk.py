"""Walk operators (G1-G4, W1, W2, F2, J3, J4) on FIXTURES F6 shapes and random graphs,
against a brute-force breadth-first search in Python."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from fixtures import edges_df, starts_df
from tracehound.operators.walk import induced_edges, walk, walk_downstream, walk_upstream, walked_edges
from tracehound.sources.seed import chain_edges


def bfs(edges, start, upstream, max_hops):
    adj = {}
    for u, d in edges:
        s, t = (d, u) if upstream else (u, d)
        adj.setdefault(s, set()).add(t)
    dist = {start: 0}
    q = deque([start])
    while q:
        x = q.popleft()
        if max_hops is not None and dist[x] >= max_hops:
            continue
        for y in adj.get(x, ()):
            if y not in dist:
                dist[y] = dist[x] + 1
                q.append(y)
    return dist


def capped(dist, cap):
    if cap is None:
        return dist
    keep = sorted(dist.items(), key=lambda kv: (kv[1], kv[0]))[:cap]
    return dict(keep)


def run(spark, pairs, starts, upstream, max_hops, max_nodes=None):
    w = walk(starts_df(spark, starts), edges_df(spark, pairs), upstream=upstream, max_hops=max_hops,
             max_nodes=max_nodes)
    out = {}
    for r in w.collect():
        out.setdefault(r.incident_id, {})[r.urn] = r.hop
    return out


DIAMOND = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")]
CYCLE = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
SELF = [("a", "a"), ("a", "b")]
HUB = [("hub", f"k{i:03d}") for i in range(75)] + [("k000", "x")]
DEEP = [(f"n{i}", f"n{i + 1}") for i in range(7)]
ISOLATED = [("a", "b")]


@pytest.mark.parametrize("name,pairs,start,upstream,hops,cap", [
    ("diamond_down", DIAMOND, "a", False, None, None),
    ("diamond_up", DIAMOND, "e", True, 3, None),
    ("cycle", CYCLE, "a", False, None, None),
    ("cycle_up", CYCLE, "d", True, 5, None),
    ("self_loop", SELF, "a", False, 3, None),
    ("hub_capped", HUB, "hub", False, 5, 60),
    ("deep_bounded", DEEP, "n0", False, 5, 60),
    ("deep_up", DEEP, "n7", True, 3, 40),
    ("isolated", ISOLATED, "zz", False, 3, 40),
    ("mid_chain", DEEP, "n3", False, None, None),
])
def test_shapes_against_bfs(spark, name, pairs, start, upstream, hops, cap):
    got = run(spark, pairs, [("i", start)], upstream, hops, cap).get("i", {})
    assert got == capped(bfs(pairs, start, upstream, hops), cap), name


def test_hub_cap_order(spark):
    got = run(spark, HUB, [("i", "hub")], False, 5, 60)["i"]
    assert len(got) == 60 and got["hub"] == 0
    assert "x" not in got  # hop-2 node loses to hop-1 nodes under the cap
    assert max(k for k in got if k != "hub") == "k058"


def test_random_graphs_multi_source(spark):
    rnd = random.Random(7)
    for trial in range(3):
        nodes = [f"v{i}" for i in range(40)]
        pairs = list({(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(90)})
        starts = [(f"s{i}", rnd.choice(nodes)) for i in range(6)]
        for upstream, hops, cap in [(False, 3, None), (True, None, None), (False, 4, 7)]:
            got = run(spark, pairs, starts, upstream, hops, cap)
            for k, s in starts:
                assert got.get(k, {}) == capped(bfs(pairs, s, upstream, hops), cap), (trial, k, upstream, hops, cap)


def test_downstream_excludes_root(spark):
    w = walk_downstream(starts_df(spark, [("i", "a")]), edges_df(spark, CYCLE), max_hops=5, max_nodes=60)
    assert sorted(r.urn for r in w.collect()) == ["b", "c", "d"]


def test_walked_edges_keep_diamond_and_cycle(spark):
    e = edges_df(spark, DIAMOND + [("e", "a")])
    nodes = walk(starts_df(spark, [("i", "e")]), e, upstream=True, max_hops=3)
    got = {(r.upstream, r.downstream) for r in walked_edges(nodes, e, upstream=True, max_hops=3).collect()}
    # hops: e0 d1 b2 c2 a3; expanded: e, d, b, c; edges into reached nodes only
    assert got == {("d", "e"), ("b", "d"), ("c", "d"), ("a", "b"), ("a", "c")}
    inner = {(r.upstream, r.downstream) for r in induced_edges(nodes, e).collect()}
    assert ("e", "a") in inner and len(inner) == 6


def test_per_node_cap(spark):
    w = walk(starts_df(spark, [("i", "hub")]), edges_df(spark, HUB), upstream=False, max_hops=1, max_per_node=50)
    assert w.count() == 51


def test_chain_edges_dense_positions(spark):
    a = spark.createDataFrame([("A", 0, "x"), ("A", 1, "y"), ("A", 2, "z"), ("B", 0, "p")],
                              "chain string, pos int, urn string")
    got = {(r.chain, r.upstream, r.downstream) for r in chain_edges(a).collect()}
    assert got == {("A", "x", "y"), ("A", "y", "z")}


def test_partitioned_adjacency_same_result(spark):
    e = edges_df(spark, CYCLE + DIAMOND)
    s = starts_df(spark, [("i", "a"), ("j", "d")])
    plain = {(r.incident_id, r.urn, r.hop) for r in walk(s, e, upstream=False, max_hops=None).collect()}
    part = {(r.incident_id, r.urn, r.hop) for r in
            walk(s, e, upstream=False, max_hops=None, partition_adjacency=True).collect()}
    assert plain == part and len(plain) > 4


def random_graph(seed, n=40, m=70, cyclic=True):
    import random
    rng = random.Random(seed)
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    return sorted((a, b) if cyclic or a < b else (b, a) for a, b in pairs if a != b)


def below(pairs, root):
    seen, todo = {root}, [root]
    while todo:
        x = todo.pop()
        for a, b in pairs:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen - {root}


@pytest.mark.parametrize("seed", range(4))
def test_reach_of_others_is_the_union_of_blast_radii(spark, seed):
    from tracehound.operators.walk import reach_of_others
    pairs = random_graph(seed)
    roots = [0, 1, 2, 3, 5, 8, 39] if seed else [7]
    edges = edges_df(spark, [(f"n{a}", f"n{b}") for a, b in pairs])
    got = reach_of_others(spark.createDataFrame([(f"n{r}",) for r in roots + roots[:2]] + [(None,), ("",)], "urn string"), edges)
    assert sorted(r.urn for r in got.collect()) == sorted(f"n{x}" for x in set().union(*(below(pairs, r) for r in roots)))


@pytest.mark.parametrize("seed", range(3))
def test_distances_from_one_walk_are_those_of_each_incident(spark, seed):
    """rank_suspects over whole evidence: one walk for all incidents gives what a walk per incident gives."""
    from tracehound import schemas
    from tracehound.operators.ranking import rank_suspects
    pairs = random_graph(seed, cyclic=seed != 1)
    edges = edges_df(spark, [(f"n{a}", f"n{b}") for a, b in pairs])
    inc = spark.createDataFrame([(f"i{k}", "a drop" if k % 2 else "blank", f"n{k}") for k in range(10, 40, 3)], schemas.INCIDENTS)
    sig = spark.createDataFrame([(f"n{k}", None, c, 1.0, 1.0, s, f"{c} at {k}") for k, c, s in (
        (0, "volume", "data"), (4, "drift", "text"), (9, "stale", "text"), (20, "volume", "text"), (20, "drift", "data"))], schemas.SIGNALS)
    ents = spark.createDataFrame([], schemas.ENTITIES)
    ev = walk_upstream(inc.select("incident_id", F.col("affected_urn").alias("urn")), edges)
    reached = ev.select("urn").distinct()
    kept = sig.join(reached, "urn", "left_semi")
    one = rank_suspects(ev, inc, kept, edges, entities=ents, reached=reached)
    each = rank_suspects(ev, inc, kept, edges, entities=ents)
    assert sorted(map(str, one.collect())) == sorted(map(str, each.collect())) and one.count() > 5


@pytest.mark.parametrize("seed", range(2))
def test_capped_walks_by_key_are_those_by_node(spark, seed, monkeypatch):
    """A small cap cuts a hub's children before they are shuffled; revisited nodes take no room."""
    from tracehound.operators import walk as W
    rnd = random.Random(seed)
    names = [f"n{i:02d}" for i in range(30)]
    pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(60)] + [("n00", n) for n in names] + [(names[1], n) for n in names[:20]]
    starts = [(f"k{i % 6}", rnd.choice(names)) for i in range(9)] + [("k0", "n00"), ("k1", "n01")]
    e, s = edges_df(spark, pairs), starts_df(spark, starts)
    for cap, hops in ((2, None), (7, 3), (25, None)):
        monkeypatch.setattr(W, "LISTED_NODES", 1000)
        got = W.walk_levels(s, e, upstream=False, max_hops=hops, max_nodes=cap)
        monkeypatch.setattr(W, "LISTED_NODES", 0)
        want = W.walk_levels(s, e, upstream=False, max_hops=hops, max_nodes=cap)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    visited = s.selectExpr("incident_id", "urn")
    plan = W._unvisited_of_capped(visited.selectExpr("incident_id", "urn", "1 as n_prev"), visited, "incident_id", 3)._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
