"""The full investigation for a table of incidents.

walk upstream (G2) -> enrich (J2/P10) -> signals (R2 + data checks) -> rank (R1)
-> guard (F7) -> missing evidence (R4) -> [act: gate (F4) -> quarantine (C2) ->
blast radius (C3)] -> one report row per incident.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.containment import TagStore, contain
from ..operators.enrich import enrich, evidence_count
from ..operators.closure import reach_upstream
from ..operators.ranking import act_gate, missing_statement, rank_reached, rank_suspects
from ..operators.signals import text_signals
from ..operators.walk import walk_upstream
from ..session import materialize
from ..sources.catalog import Catalog
from .report import drawing_lines, drawn_incidents


@dataclass
class Investigation:
    suspects: DataFrame      # (incident_id, rank, urn, ..., confidence, owner, why, check_next)
    reports: DataFrame       # one row per incident
    containment: dict | None = None
    reached: DataFrame | None = None   # the distinct urn of the evidence, if it is the whole upstream
    _evidence: Callable[[], DataFrame] | None = None

    @cached_property
    def evidence(self) -> DataFrame:
        """``(incident_id, urn, hop, name, platform, ...)``, for callers: the reports are made
        without these rows, so their lists are written when they are first asked for."""
        return self._evidence()


SUSPECT_FIELDS = ["urn", "why", "check_next", "owner", "confidence", "rank", "score", "dist", "name",
                  "class", "source"]


def reached_nodes(nodes: DataFrame) -> DataFrame:
    """The distinct ``urn`` that the walks of all incidents reached, written once."""
    return materialize(nodes.select("urn").distinct(), "reached")


def evidence_signals(cat: Catalog, urns: DataFrame) -> DataFrame:
    """Text signals of the reached entities only (rules run once per reached URN), plus
    the catalog's data signals for those URNs; ``urns`` has each reached ``urn`` once."""
    sig = text_signals(cat.entities.join(urns, "urn", "left_semi"))
    if cat.signals is not None:
        sig = sig.unionByName(cat.signals.join(urns, "urn", "left_semi"))
    return sig


def catalog_signals(cat: Catalog) -> DataFrame:
    """Text signals of all entities, plus the catalog's data signals."""
    sig = text_signals(cat.entities)
    return sig if cat.signals is None else sig.unionByName(cat.signals)


def investigate(cat: Catalog, *, max_hops: int | None = None, max_nodes: int | None = None, top: int = 3,
                act: bool = False, store: TagStore | None = None, text_only_high: bool = False,
                act_on_text: bool = False, per_root: bool = True, key: str = "incident_id", keep_evidence: bool = False) -> Investigation:
    """Reads the whole upstream of every incident unless a bound is given. ``act`` writes tags and
    needs the ``store`` that they go to; without ``per_root`` it leaves out the reports' blast
    radius, which needs every root's own reach where the tags need only their union. ``keep_evidence``
    is for callers that read the evidence of all incidents: its lists are then written once, with the ranking."""
    if act and store is None:
        raise ValueError("acting writes tags: pass the store that they go to")
    inc = cat.incidents.select(key, "symptom", "affected_urn")
    starts = inc.select(key, F.col("affected_urn").alias("urn"))
    if max_hops is None and max_nodes is None:
        reach = reach_upstream(starts, cat.edges, key=key, edges_distinct=cat.edges_distinct)
        sus = rank_reached(reach, inc, catalog_signals(cat), cat.entities, key=key, top=top, text_only_high=text_only_high, keep_lists=keep_evidence)
        rows, counts, reached = reach.rows, reach.counts(), reach.nodes()
    else:   # bounded evidence has distances of its own
        nodes = walk_upstream(starts, cat.edges, max_hops=max_hops, max_nodes=max_nodes, key=key,
                              edges_distinct=cat.edges_distinct)
        sus = rank_suspects(nodes, inc, evidence_signals(cat, reached_nodes(nodes)), cat.edges, key=key, top=top,
                            text_only_high=text_only_high, edges_distinct=cat.edges_distinct, entities=cat.entities)
        rows, counts, reached = lambda: nodes, evidence_count(nodes, key), None
    # F7 holds by construction here: suspects are ranked evidence rows. guard_suspects is
    # for suspects that come from outside, e.g. parsed stored answers.
    sus = materialize(sus, "suspects")
    # one row per key with all that the report takes from its suspects, in a window: a key has three rows or
    # so, and grouping would sort them before the shuffle as well
    w = Window.partitionBy(key).orderBy("rank")
    all_of_key = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    packed = sus.select(
        key, F.collect_list(F.struct(F.col("rank"), *[F.col(c) for c in SUSPECT_FIELDS if c != "rank"])).over(all_of_key).alias("suspects"),
        F.max("score").over(all_of_key).alias("_max_score"), F.row_number().over(w).alias("_rn")).where("_rn = 1")
    packed = packed.select(key, F.array_sort("suspects").alias("suspects"), "_max_score")
    rep = inc.join(counts, key, "left").join(packed, key, "left").withColumn(
        "missing_evidence", F.when(F.col(key).isNotNull(), missing_statement("symptom", "_max_score")))
    first = F.explode_outer(F.filter("suspects", lambda s: s["rank"] == 1))
    rep = rep.withColumn("_top", first).select(
        "*", F.col("_top")["name"].alias("_n"), F.col("_top")["class"].alias("_c"), F.col("_top")["source"].alias("_s"),
        F.col("_top")["confidence"].alias("_conf"), F.col("_top")["why"].alias("_why"), F.col("_top")["score"].alias("_score"))
    summary = F.when(F.col("_score") > 0, F.concat(
        F.lit("Most likely root cause: "), F.col("_n"), F.lit(" ("), F.col("_c"), F.lit(", "), F.col("_s"),
        F.lit(" signal, confidence "), F.col("_conf"), F.lit("). "), F.col("_why"))).otherwise(F.concat(
            F.lit("No signal found in "), F.coalesce(F.col("evidence_nodes"), F.lit(0)).cast("string"),
            F.lit(" upstream nodes; suspects are ranked by position only.")))
    rep = rep.select(key, "symptom", "affected_urn", summary.alias("summary"),
                     F.coalesce(F.col("suspects"), F.array()).alias("suspects"), "missing_evidence",
                     F.coalesce(F.col("evidence_nodes"), F.lit(0)).alias("evidence_nodes"),
                     F.greatest(F.coalesce(F.col("evidence_nodes"), F.lit(0)) - 1, F.lit(0)).alias("upstream_nodes"))
    containment = None
    if act:
        gated = act_gate(sus, key, act_on_text=act_on_text)
        containment = contain(store, gated, cat.edges, cat.entities, key=key,
                              edges_distinct=cat.edges_distinct, per_root=per_root)
        rep = rep.join(containment["action"], key, "left")
    else:
        rep = rep.withColumn("action", F.lit(None).cast(
            "struct<urn:string,tag:string,applied:boolean,note:string,downstream_warned:boolean>"))
    if act and per_root:
        rep = rep.join(containment["blast_radius"], key, "left")
    else:
        rep = rep.withColumn("blast_radius", F.lit(None).cast(
            "struct<impacted_count:bigint,tagged:bigint,n_assets:bigint,n_dashboards:bigint>"))
    return Investigation(suspects=sus, reports=rep, containment=containment, reached=reached, _evidence=lambda: enrich(rows(), cat.entities))


def drawing(inv: Investigation, cat: Catalog, key: str = "incident_id") -> DataFrame:
    """The drawing that belongs to the reports of an unbounded investigation, as the lines that
    incidents share (``report.drawing_lines``); ``report.lineage_dot`` joins them to a text each."""
    nodes = inv.containment["nodes"] if inv.containment else None
    return drawing_lines(None if inv.reached is not None else inv.evidence, drawn_incidents(inv.reports, key), cat.edges, nodes, key, inv.reached, cat.edges_distinct)
