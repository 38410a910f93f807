"""Deterministic suspect ranking (R1, R4, R5) and the act gate.

Replaces the reference's remote reasoning step with an inspectable rule
(SURVEY 7.3):

- score per evidence node: data signal of the symptom's class 4, other data signal 3,
  text signal of the symptom's class 2, other text signal 1, none 0;
- dist: hops downstream from the nearest scoring node inside the evidence subgraph. When the
  evidence is the whole upstream, every node has all its ancestors in it, so its distance is the
  same for every incident: one walk from all signalled nodes serves them all;
- order: score desc, dist asc (nulls last), hop desc, urn; the symptom node (hop 0)
  is not a suspect; the first ``top`` are kept;
- confidence: high for score 4 (or 2 with ``text_only_high``), medium for any other
  signal or dist 1, else low.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.evidence import owner_label
from ..session import materialize
from .signals import TEXT_RULES, symptom_classes
from .enrich import enrich
from .closure import Reach, repeated_keys
from .walk import induced_adjacency, reached_adjacency, walk

# ---- fixed values: next checks and missing-evidence statements -------------------
CHECK_NEXT = {
    "volume": "Compare daily row counts with the 7-day average and run the backfill.",
    "drift": "Diff the current schema with the previous snapshot and fix the column mappings.",
    "stale": "Check the latest load time and the upstream feed status.",
}
CHECK_NEXT_NONE = "Check this node's recent runs and row counts."
MISSING = {
    "volume": "No volume signal upstream: run a daily row-count check against the 7-day average "
              "on each upstream table.",
    "drift": "No schema signal upstream: diff each upstream table's columns with its previous "
             "snapshot and check null rates per column.",
    "stale": "No freshness signal upstream: check the latest load time and zero-row runs of each "
             "upstream feed.",
}
MISSING_NONE = "No signal upstream: add row-count, schema and freshness checks on the upstream tables."
# -----------------------------------------------------------------------------------


def _by_class(col, table: dict, default: str):
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return out


def best_signal_per_node(signals: DataFrame) -> DataFrame:
    """Pre-aggregate signals to one row per (urn, class, source) before they meet the
    evidence: a node may carry many data signals (one per zero-row day, say)."""
    return (signals.groupBy("urn", "class", "source")
            .agg(F.count(F.lit(1)).alias("n_signals"),
                 F.max_by(F.col("detail"), F.struct(F.col("as_of"), F.col("detail"))).alias("detail")))


def packed_signals(signals: DataFrame) -> DataFrame:
    """``(urn, _sigs)``: the signals pre-aggregated per (urn, class, source) and packed into one
    small array per URN (at most classes x sources entries)."""
    return (best_signal_per_node(signals).groupBy("urn")
            .agg(F.collect_list(F.struct("class", "source", "detail")).alias("_sigs")))


def score_evidence(evidence: DataFrame, incidents: DataFrame, signals: DataFrame,
                   key: str = "incident_id", rules=TEXT_RULES) -> DataFrame:
    """Score every evidence node; keep its best signal (class, source, detail).

    The best signal of each evidence row is an ``array_max`` over scored structs: no window
    and no join back. Ties on the score go to the alphabetically first class, then to data
    over text."""
    return _scored(evidence, incidents, packed_signals(signals), key, rules)


def _scored(evidence: DataFrame, incidents: DataFrame, nodes: DataFrame, key: str, rules, on=("urn",)) -> DataFrame:
    """The evidence rows with their scores from ``nodes(*on, _sigs, ...)``, whose further columns
    come along. Evidence may have its ``sym_classes`` already."""
    # narrow rows only: names, owners and properties are joined back for the top rows
    if "sym_classes" in evidence.columns:
        ev = evidence.select(key, "hop", "sym_classes", *on)
    else:
        ev = evidence.select(key, "hop", *on).join(incidents.select(key, symptom_classes("symptom", rules).alias("sym_classes")), key, "left")
    ev = ev.join(nodes, list(on), "left")
    return _best(ev, key, rules, [c for c in nodes.columns if c not in ("urn", "_sigs")])


def _best(ev: DataFrame, key: str, rules, more: list[str]) -> DataFrame:
    """The scores of evidence rows that have their symptom's ``sym_classes`` and their node's ``_sigs``."""
    best = _best_signal(F.col("sym_classes"), F.col("_sigs"), rules, lambda sg: [sg["detail"].alias("detail")])
    return ev.select(key, "urn", "hop", F.coalesce(best["score"], F.lit(0)).alias("score"),
                     best["class"].alias("class"), best["source"].alias("source"), best["detail"].alias("detail"),
                     *more)


def _best_signal(sym_classes, sigs, rules, more=lambda sg: []):
    """The best of a node's signals for a symptom of these classes, as a struct; null without a signal."""
    classes = sorted({r[0] for r in rules})

    def scored(sg):
        fits = F.coalesce(F.array_contains(sym_classes, sg["class"]), F.lit(False))
        score = F.when(sg["source"] == "data", F.when(fits, 4).otherwise(3)).otherwise(F.when(fits, 2).otherwise(1))
        ck = F.lit(0)
        for i, c in enumerate(classes):
            ck = F.when(sg["class"] == c, F.lit(len(classes) - i)).otherwise(ck)
        sk = F.when(sg["source"] == "data", 2).otherwise(1)
        return F.struct(score.alias("score"), ck.alias("ck"), sk.alias("sk"), sg["class"].alias("class"),
                        sg["source"].alias("source"), *more(sg))

    return F.array_max(F.transform(sigs, scored))


def signal_nodes(signals: DataFrame, reached: DataFrame, edges: DataFrame, edges_distinct: bool = False) -> DataFrame:
    """``(urn, dist, _sigs)`` for every node that carries a signal (dist 0) or lies downstream of
    one: one multi-source walk over the edges among the nodes ``reached(urn)`` by all incidents
    together, however many incidents there are. ``reached`` must be closed upstream."""
    packed = packed_signals(signals)
    starts = packed.select(F.lit(0).alias("all"), "urn")
    adj = materialize(reached_adjacency(reached, edges, edges_distinct), "reached-adjacency")
    dist = walk(starts, None, upstream=False, max_hops=None, key="all", adj=adj)
    return dist.select("urn", F.col("hop").alias("dist")).join(packed, "urn", "left")


def distance_from_signals(scored: DataFrame, edges: DataFrame, key: str = "incident_id",
                          edges_distinct: bool = False) -> DataFrame:
    """Hops downstream from the nearest scoring node, inside each key's evidence subgraph."""
    starts = scored.where(F.col("score") > 0).select(key, "urn")
    # only incidents with a scoring node can have a distance; the others stay NULL
    flagged = scored.select(key, "urn").join(starts.select(key).distinct(), key, "left_semi")
    adj = materialize(induced_adjacency(flagged, edges, key, edges_distinct), "evidence-adjacency")
    d = walk(starts, edges, upstream=False, max_hops=None, key=key, adj=adj)
    return d.select(key, "urn", F.col("hop").alias("dist"))


def rank_reached(reach: Reach, incidents: DataFrame, signals: DataFrame, entities: DataFrame,
                 key: str = "incident_id", top: int = 3, text_only_high: bool = False, rules=TEXT_RULES, keep_lists: bool = False) -> DataFrame:
    """R1 + R5 on every incident's whole upstream, from the composed lists of the walk: a node's
    signals and its distance come with the lists, so no evidence row is joined or shuffled by itself.
    ``signals`` may have those of other nodes too. Only the suspects and the lists' lengths are
    written; ``keep_lists`` writes the lists, for callers that read the evidence as well."""
    inc = incidents.select(key, "symptom")
    sym = inc.select(key, symptom_classes("symptom", rules).alias("sym_classes"))
    packed = materialize(packed_signals(signals), "packed-signals")
    brief = F.transform("_sigs", lambda sg: F.struct(sg["class"].alias("class"), sg["source"].alias("source")))
    first = _top_of_list(rules, top).alias("_top")
    reach.compose(packed.select("urn", brief.alias("_sigs")), "dist", sym, once=repeated_keys(inc, key)[0] is None, made=None if keep_lists else [first])
    if not reach.complete():
        nodes = reach.rows()
        reached = materialize(nodes.select("urn").distinct(), "reached")
        return rank_suspects(nodes, inc, signals.join(reached, "urn", "left_semi"), reach.edges, key=key, top=top,
                             text_only_high=text_only_high, rules=rules, edges_distinct=True, entities=entities, reached=reached)
    ranked = (reach.lists.select(key, first) if keep_lists else reach.made).select(key, F.posexplode("_top").alias("rank", "s"))
    ranked = ranked.select(key, (F.col("rank") + 1).alias("rank"), *[F.col("s")[c].alias(c) for c in ("urn", "hop", "score", "dist", "class", "source")])
    # a signal's text comes with its node's entry, for the suspects only
    of = F.filter("_sigs", lambda sg: sg["class"].eqNullSafe(F.col("class")) & sg["source"].eqNullSafe(F.col("source")))
    ranked = enrich(ranked, entities).join(packed, "urn", "left").withColumn("detail", F.when(F.col("score") > 0, F.get(of, F.lit(0))["detail"]))
    return _explained(ranked, key, text_only_high)


def _top_of_list(rules, top: int):
    """The first ``top`` suspects of a key's list, in the order of :func:`_ranked`: ranked within
    the list's row, so that no candidate is shuffled."""
    def candidate(x):
        n, score = x["n"], F.coalesce(x["best"]["score"], F.lit(0))
        return F.struct((-score).alias("o1"), n["dist"].isNull().alias("o2"), n["dist"].alias("dist"), (-n["hop"]).alias("o3"), n["urn"].alias("urn"),
                        n["hop"].alias("hop"), score.alias("score"), x["best"]["class"].alias("class"), x["best"]["source"].alias("source"))

    def scored(of):   # the best signal in a step of its own, as it is used several times
        return F.transform(above, lambda n: F.struct(n.alias("n"), F.when(n["_sigs"].isNotNull(), _best_signal(of["sym_classes"], n["_sigs"], rules)).alias("best")))

    above = F.filter("nodes", lambda n: n["hop"] > 0)
    incidents = F.coalesce("rows_of_key", F.array(F.lit(None).cast("struct<sym_classes:array<string>>")))
    return F.slice(F.sort_array(F.transform(F.flatten(F.transform(incidents, scored)), candidate)), 1, top)


def rank_suspects(evidence: DataFrame, incidents: DataFrame, signals: DataFrame, edges: DataFrame,
                  key: str = "incident_id", top: int = 3, text_only_high: bool = False,
                  rules=TEXT_RULES, edges_distinct: bool = False,
                  entities: DataFrame | None = None, reached: DataFrame | None = None) -> DataFrame:
    """R1 + R5: the ``top`` suspects per incident with score, distance, confidence, owner,
    reason and next check. ``evidence`` is the upstream walk (hop 0 = symptom), either
    enriched, or narrow ``(key, urn, hop)`` with ``entities`` given: then only the top
    rows are joined with the catalog.

    ``reached``, the distinct ``urn`` of the evidence, says that the evidence is every incident's
    whole upstream (an unbounded walk): distances then come from one walk for all incidents
    (:func:`signal_nodes`). Without it they are found inside each incident's own evidence."""
    if reached is not None:
        nodes = materialize(signal_nodes(signals, reached, edges, edges_distinct), "signal-nodes")
        cand = _scored(evidence, incidents, nodes, key, rules).where(F.col("hop") > 0)
    else:
        scored = materialize(score_evidence(evidence, incidents, signals, key, rules), "scored")
        dist = distance_from_signals(scored, edges, key, edges_distinct)
        cand = scored.where(F.col("hop") > 0).join(dist, [key, "urn"], "left")
    if entities is not None:
        return top_suspects(cand, entities, key, top, text_only_high)
    return _explained(_ranked(cand, key, top).join(
        evidence.select(key, "urn", "name", "owners", "custom_properties"), [key, "urn"]), key, text_only_high)


def top_suspects(cand: DataFrame, entities: DataFrame, key: str = "incident_id", top: int = 3, text_only_high: bool = False) -> DataFrame:
    """The ``top`` of the scored candidates ``(key, urn, hop, score, dist, class, source,
    detail)``, joined with the catalog and explained."""
    return _explained(enrich(_ranked(cand, key, top), entities), key, text_only_high)


def _ranked(cand: DataFrame, key: str, top: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("dist").asc_nulls_last(),
                                        F.col("hop").desc(), F.col("urn"))
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.lit(top))


def _explained(ranked: DataFrame, key: str, text_only_high: bool) -> DataFrame:
    high = F.col("score") == 4
    if text_only_high:
        high = high | (F.col("score") == 2)
    conf = (F.when(high, "high")
            .when((F.col("score") > 0) | (F.col("dist") == 1), "medium")
            .otherwise("low"))
    why = F.when(F.col("score") > 0, F.concat(
        F.col("source"), F.lit(" signal ("), F.col("class"), F.lit("): "), F.coalesce(F.col("detail"), F.lit(""))))\
        .when(F.col("dist").isNotNull(), F.concat(
            F.lit("downstream of a flagged node ("), F.col("dist").cast("string"), F.lit(" hop(s)); no signal of its own")))\
        .otherwise(F.lit("on the upstream path of the symptom; no signal found"))
    return ranked.select(
        key, "rank", "urn", "name", "hop", "score", "dist", "class", "source",
        conf.alias("confidence"), owner_label().alias("owner"), why.alias("why"),
        _by_class(F.col("class"), CHECK_NEXT, CHECK_NEXT_NONE).alias("check_next"))


def missing_evidence(incidents: DataFrame, suspects: DataFrame, key: str = "incident_id",
                     rules=TEXT_RULES) -> DataFrame:
    """Per incident, what to check when no suspect carries a signal (else NULL)."""
    best = suspects.groupBy(key).agg(F.max("score").alias("max_score"))
    return incidents.join(best, key, "left").select(key, missing_statement("symptom", "max_score", rules).alias("missing_evidence"))


def missing_statement(symptom: str, max_score: str, rules=TEXT_RULES):
    """R4 as an expression: what to check for a symptom whose suspects score at most ``max_score``."""
    first_class = F.try_element_at(symptom_classes(symptom, rules), F.lit(1))
    return F.when(F.coalesce(F.col(max_score), F.lit(0)) == 0, _by_class(first_class, MISSING, MISSING_NONE))


def guard_suspects(suspects: DataFrame, evidence: DataFrame, key: str = "incident_id") -> DataFrame:
    """a suspect must be one of the incident's evidence nodes."""
    return suspects.join(evidence.select(key, "urn"), [key, "urn"], "left_semi")


def guard_reached(reach: Reach, suspects: DataFrame) -> DataFrame:
    """F7 on the walk's lists: the suspects meet them where both lie by key, so no evidence row is
    shuffled by itself."""
    reach.compose(by_key=suspects)
    if reach.lists is None or reach.left is not None:
        return guard_suspects(suspects, reach.rows(), reach.key)
    among = F.filter("rows_of_key", lambda s: F.exists(F.col("nodes"), lambda n: n["urn"] == s["urn"]))
    return reach.lists.select(reach.key, F.inline(among)).select(reach.key, "urn", *[c for c in suspects.columns if c not in (reach.key, "urn")])


def act_gate(suspects: DataFrame, key: str = "incident_id", act_on_text: bool = False) -> DataFrame:
    """only the first suspect, confidence high/medium (any case), URN present; by
    default it must also rest on a data signal (``act_on_text`` restores the reference)."""
    ok = ((F.col("rank") == 1) & F.lower(F.col("confidence")).isin("high", "medium")
          & F.col("urn").isNotNull() & (F.col("urn") != ""))
    if not act_on_text:
        ok = ok & (F.col("source") == "data")
    return suspects.where(ok)
