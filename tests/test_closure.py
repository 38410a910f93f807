"""Walks by shared parts (closure.py) against the walk level by level and a brute-force search."""

import random

import pytest

from fixtures import edges_df, starts_df
from test_walk import bfs
from tracehound.operators import closure as R
from tracehound.operators.ranking import rank_reached, rank_suspects
from tracehound.operators.walk import walk, walk_levels, walked_edges, walked_edges_upstream

FAN = [("r", "n1"), ("r", "n2"), ("n1", "c1"), ("n1", "c2"), ("n2", "s1")] + [
    e for i in range(12) for e in ((f"c{1 + i % 2}", f"o{i // 2}"), (f"o{i // 2}", f"l{i}"), ("s1", f"l{i}"))]
LINES = [(f"i{i}", f"l{i}") for i in range(12)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_common_inputs_are_walked_once(spark):
    """All rows come from the lists: no walk with a row per key and node is left."""
    reach = R.reach_upstream(starts_df(spark, LINES), edges_df(spark, FAN), shrink=0.9).compose()
    assert reach.complete() and reach.left is None
    assert [p.count() for p, _ in reach.levels][0] == 12 and sum(p.count() for p, _ in reach.levels[1:]) <= 18
    assert rows(reach.rows()) == sorted((k, u, h) for k, s in LINES for u, h in bfs(FAN, s, True, None).items())


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed, monkeypatch):
    """Cycles, several starts a key, keys that share a start, hubs beyond what a list takes."""
    monkeypatch.setattr(R, "PACK_INPUTS", 3)
    monkeypatch.setattr(R, "PACK_NODES", 9)
    monkeypatch.setattr(R, "MAX_LEVELS", seed + 1)
    rnd = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(18)] + [("", "n1"), ("n2", ""), ("n3", "n3")]
    starts = [(f"k{i}", rnd.choice(names)) for i in range(10)] + [("k0", "n5"), ("k1", None), ("k2", ""), (None, "n1"), ("gone", "nowhere")]
    e, s = edges_df(spark, pairs), spark.createDataFrame(starts, "incident_id string, urn string")
    for hops in (None, 0, 2) if seed == 2 else (None,):
        want = walk_levels(s, e, upstream=True, max_hops=hops)
        got = R.reach_upstream(s, e, hops, shrink=99.0)
        assert rows(got.rows()) == rows(want)
        assert rows(walk(s, e, upstream=True, max_hops=hops)) == rows(want)
        assert rows(walked_edges_upstream(s, e, max_hops=hops)) == rows(walked_edges(want, e, upstream=True, max_hops=hops))


def test_rank_from_lists(spark):
    """Scores and distances that come with the lists are those of the joins; an incident that is
    listed twice counts twice in both."""
    inc = spark.createDataFrame([(k, "numbers look frozen" if i % 2 else "a sharp drop, fewer rows", u) for i, (k, u) in enumerate(LINES + LINES[:1])],
                                "incident_id string, symptom string, affected_urn string")
    sig = spark.createDataFrame([("n1", "stale", "data", "late"), ("n1", "volume", "text", "few"), ("o3", "volume", "data", "less"), ("l5", "stale", "data", "x")],
                                "urn string, class string, source string, detail string").selectExpr("*", "date'2024-01-01' as as_of")
    ent = spark.createDataFrame([(u, u, "p", None, [], [], {}) for u in {x for e in FAN for x in e}],
                                "urn string, name string, platform string, description string, owners array<string>, schema_fields array<string>, custom_properties map<string,string>")
    e = edges_df(spark, FAN)
    s = inc.select("incident_id", inc.affected_urn.alias("urn"))
    ev = walk_levels(s, e, upstream=True, max_hops=None)
    reach = R.reach_upstream(s, e, shrink=0.9)
    got = rank_reached(reach, inc, sig, ent)
    assert reach.complete()
    want = rank_suspects(ev, inc, sig, e, entities=ent, reached=ev.select("urn").distinct())
    assert rows(got) == rows(want.select(*got.columns))


def test_levels_join_on_the_edges_as_they_are(spark, tmp_path):
    """No second copy of the edges with wider keys is written for walks over an edge set."""
    import os

    from tracehound.operators.walk import reach_of_others, walk_adjacency
    from tracehound.session import checkpoint_root
    e = edges_df(spark, sorted(set(FAN)))
    assert walk_adjacency(e, True).columns == ["src", "urn"]
    kept = lambda: {x for x in os.listdir(os.path.join(checkpoint_root(spark).removeprefix("file:"), "tracehound")) if "adjacency" in x}
    walk(starts_df(spark, [("x", "n1")]), e, upstream=False, max_hops=1, edges_distinct=True).count()
    before = kept()
    assert walk(starts_df(spark, [("i", "c1")]), e, upstream=False, max_hops=None, edges_distinct=True).count() == len(bfs(FAN, "c1", False, None))
    assert sorted(r.urn for r in reach_of_others(starts_df(spark, [("i", "c1")]).select("urn"), e, edges_distinct=True).collect()) == sorted(set(bfs(FAN, "c1", False, None)) - {"c1"})
    assert kept() == before


def test_guard_from_lists(spark):
    """Suspects among a key's reached nodes are kept, as often as they come."""
    from tracehound.operators.ranking import guard_reached, guard_suspects
    e, s = edges_df(spark, FAN), starts_df(spark, LINES)
    sus = spark.createDataFrame([("i0", "c1", 1), ("i0", "c1", 1), ("i0", "c2", 2), ("i1", None, 1), ("i3", "l3", 1), ("nobody", "c1", 1), (None, "c1", 1)],
                                "incident_id string, urn string, rank int")
    got = guard_reached(R.reach_upstream(s, e, shrink=0.9), sus)
    assert rows(got) == rows(guard_suspects(sus, walk_levels(s, e, upstream=True, max_hops=None)).select(*got.columns)) == [("i0", "c1", 1)] * 2 + [("i0", "c2", 2), ("i3", "l3", 1)]
    assert rows(guard_reached(R.reach_upstream(s.where("incident_id = 'i0'"), e, shrink=0.0), sus)) == [("i0", "c1", 1)] * 2 + [("i0", "c2", 2)]


def test_candidates_are_ranked_within_their_lists(spark):
    """No window over all candidates; the nodes of all evidence come from the levels, counts from the lists."""
    inc = spark.createDataFrame([(k, "fewer rows than usual", u) for k, u in LINES], "incident_id string, symptom string, affected_urn string")
    sig = spark.createDataFrame([("n1", "volume", "data", "few"), ("n1", "stale", "data", "late"), ("s1", "stale", "text", "old")],
                                "urn string, class string, source string, detail string").selectExpr("*", "date'2024-01-01' as as_of")
    ent = spark.createDataFrame([], "urn string, name string, platform string, description string, owners array<string>, schema_fields array<string>, custom_properties map<string,string>")
    e = edges_df(spark, FAN)
    reach = R.reach_upstream(inc.selectExpr("incident_id", "affected_urn as urn"), e, shrink=0.9)
    got = rank_reached(reach, inc, sig, ent)
    assert reach.complete() and "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    top = {r.incident_id: (r.urn, r.score, r["class"], r.why) for r in got.where("rank = 1").collect()}
    assert top == {k: ("n1", 4, "volume", "data signal (volume): few") for k, _ in LINES}
    ev = walk_levels(inc.selectExpr("incident_id", "affected_urn as urn"), e, upstream=True, max_hops=None)
    assert rows(reach.nodes()) == rows(ev.select("urn").distinct())
    assert rows(reach.counts()) == rows(ev.groupBy("incident_id").count())


def test_only_suspects_and_lengths_are_written_for_a_ranking(spark):
    """The lists, many times as large, are written when someone asks for the evidence itself."""
    inc = spark.createDataFrame([(k, "fewer rows than usual", u) for k, u in LINES], "incident_id string, symptom string, affected_urn string")
    sig = spark.createDataFrame([("n1", "volume", "data", "few")], "urn string, class string, source string, detail string").selectExpr("*", "date'2024-01-01' as as_of")
    ent = spark.createDataFrame([], "urn string, name string, platform string, description string, owners array<string>, schema_fields array<string>, custom_properties map<string,string>")
    s, e = inc.selectExpr("incident_id", "affected_urn as urn"), edges_df(spark, FAN)
    reach, kept = R.reach_upstream(s, e, shrink=0.9), R.reach_upstream(s, e, shrink=0.9)
    got, want = rank_reached(reach, inc, sig, ent), rank_reached(kept, inc, sig, ent, keep_lists=True)
    assert reach.lists is None and "nodes" not in reach.made.columns and kept.lists is not None
    assert rows(got) == rows(want)
    assert rows(reach.counts()) == rows(kept.counts()) and rows(reach.rows()) == rows(kept.rows())


def test_starts_are_grouped_only_if_keys_repeat(spark):
    """Keys are told apart by hashes; those that come once are taken as they are."""
    once, some = starts_df(spark, LINES), starts_df(spark, LINES + LINES[:2] + [("i3", "l4")])
    assert R.repeated_keys(once, "incident_id") == (None, 12)
    again, n = R.repeated_keys(some, "incident_id")
    assert again.count() == 3 and n == 15
    reach = R.reach_upstream(once, edges_df(spark, FAN), shrink=0.9)
    assert "Aggregate" not in reach.levels[0][0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in reach.levels[0][1]._jdf.queryExecution().optimizedPlan().toString()
    reach = R.reach_upstream(some, edges_df(spark, FAN), shrink=0.9)
    assert rows(reach.rows()) == rows(walk_levels(some, edges_df(spark, FAN), upstream=True, max_hops=None))
    assert [r.incident_id for r in reach.several.collect()] == ["i3"]
