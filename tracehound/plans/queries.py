"""Named queries over the driver tables, one per operator group of the survey.

Each takes ``(spark, sf_dir)`` and returns a DataFrame whose columns match the DuckDB
oracle of the same name in :mod:`tracehound.plans.oracle`. Every query reads whole
tables; integer outputs are BIGINT, doubles are rounded, lists and maps are emitted as
strings.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.evidence import cols_label, owner_label, props_label
from ..functions.text import action_status, parse_answer, parsed_answers
from ..functions.urn import tag_short, tag_urn, urn_name, urn_platform, urn_tail
from ..operators import containment as C
from ..operators import fusion as FU
from ..operators import signals as X
from ..operators.closure import reach_upstream
from ..operators.enrich import enrich_made, enriched_lines, evidence_count, summaries
from ..operators.evaluate import scenario_results, scenario_score
from ..operators.ranking import act_gate, guard_reached, rank_reached
from ..operators.sequence import next_in_sequence
from ..operators.walk import hop_label, walk, walked_edges_upstream
from ..plans.investigate import catalog_signals, drawing, evidence_signals, investigate
from ..plans.report import lineage_dot, report_json, report_text
from ..session import configure, materialize, scratch_path
from ..sources import fk_catalog as FK
from ..sources.catalog import Catalog, decode_answers, lookup_entities, search_entities
from ..sources.seed import upsert_entities
from ..streaming.intake import start_stream

# ---- fixed parameters of the registered queries ------------------------------------
UP_HOPS = 3                        # hop bound of the bounded upstream walks (F3)
DOWN_HOPS, DOWN_CAP = 5, 60        # the capped walk (W1), where the cap is the feature
DRAW_HOPS, DRAW_CAP, DRAW_PER_NODE = 6, 40, 50   # drawing walk (reference defaults)
STALE_DAYS = 365                   # customer freshness threshold (X4)
DROP_RATIO = 0.6                   # volume anomaly threshold (X1)
SEARCH_TERM = "license"            # keyword for S12
EVENT_PLATFORM = "kafka"
UNKNOWN_TAG = "urn:li:tag:NOT_IN_VOCABULARY"
FUSED_DROP = 0.5                   # X1 on regions
SILENT_DAYS = 20                   # a nation's days without orders that are a fault (X5)
RESULT_AGE = 60                    # days for which a check result counts (X7)
# -------------------------------------------------------------------------------------


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def _big(df: DataFrame, *cols) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("bigint"))
    return df


def fk(spark: SparkSession, sf: str, with_signals: bool = True, needs=("edges", "entities", "incidents")) -> Catalog:
    configure(spark)
    t = FK.read_tables(spark, sf)
    lines = materialize(FK.line_groups(t), "fk-lines")
    # each table is written only for queries that read it
    table = {"edges": FK.edges, "entities": FK.entities, "incidents": FK.incidents}
    made = {k: materialize(table[k](t, lines), f"fk-{k}") if k in needs else None for k in table}
    cat = Catalog(**made, edges_distinct=True)
    if with_signals:
        cat = cat.with_(signals=customer_freshness_signals(spark, sf))
    return cat


def _starts(inc: DataFrame) -> DataFrame:
    return inc.select("incident_id", F.col("affected_urn").alias("urn"))


# ---- walks (G1-G4, W1, W2, W7, S6) ----------------------------------------------------

def q_walk_upstream(spark, sf):
    cat = fk(spark, sf, False, ("edges", "incidents"))
    w = walk(_starts(cat.incidents), cat.edges, upstream=True, max_hops=UP_HOPS, edges_distinct=True)
    return _big(w, "hop")


def q_walk_downstream(spark, sf):
    cat = fk(spark, sf, False, ("edges",))
    starts = _starts(FK.region_incidents(FK.read_tables(spark, sf, ["region"])))
    return _big(walk(starts, cat.edges, upstream=False, max_hops=None, edges_distinct=True), "hop")


def q_walk_multi_source(spark, sf):
    cat = fk(spark, sf, False, ("edges",))
    o = _t(spark, sf, "orders")
    starts = o.select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("incident_id"),
                      FK.node_urn("orders", F.col("o_orderkey")).alias("urn"))
    return _big(walk(starts, cat.edges, upstream=True, max_hops=None, edges_distinct=True), "hop")


def _cust_supp_starts(spark, sf):
    t = FK.read_tables(spark, sf, ["customer", "supplier"])
    c = t["customer"].select(FK.node_urn("customer", F.col("c_custkey")).alias("urn"))
    s = t["supplier"].select(FK.node_urn("supplier", F.col("s_suppkey")).alias("urn"))
    return c.unionByName(s).select(F.col("urn").alias("incident_id"), "urn")


def q_walk_capped(spark, sf):
    cat = fk(spark, sf, False, ("edges",))
    w = walk(_cust_supp_starts(spark, sf), cat.edges, upstream=False, max_hops=DOWN_HOPS, max_nodes=DOWN_CAP, edges_distinct=True)
    return _big(w, "hop")


def _nation_supplier_starts(spark, sf):
    t = FK.read_tables(spark, sf, ["nation", "supplier"])
    n = t["nation"].select(FK.node_urn("nation", F.col("n_nationkey")).alias("urn"))
    s = t["supplier"].select(FK.node_urn("supplier", F.col("s_suppkey")).alias("urn"))
    return n.unionByName(s).select(F.col("urn").alias("incident_id"), "urn")


def q_walk_per_node_cap(spark, sf):
    """W2 + W1: the drawing walk: at most 50 neighbours per expanded node (in URN order),
    40 nodes per walk, 6 hops, downstream from every nation and supplier."""
    cat = fk(spark, sf, False, ("edges",))
    w = walk(_nation_supplier_starts(spark, sf), cat.edges, upstream=False, max_hops=DRAW_HOPS,
             max_nodes=DRAW_CAP, max_per_node=DRAW_PER_NODE, edges_distinct=True)
    return _big(w, "hop")


def event_transition_edges(spark, sf) -> DataFrame:
    """A cyclic lineage graph: event type -> next event type of the same user."""
    e = _t(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    nxt = next_in_sequence(e, "user_id", ["ts", "event_id"], "event_type", "next_type")
    u = lambda c: FK.dataset_urn(F.lit(EVENT_PLATFORM), F.concat(F.lit("events."), F.col(c)))
    return (nxt.where(F.col("next_type").isNotNull())
            .select(u("event_type").alias("upstream"), u("next_type").alias("downstream")).distinct())


def q_walk_cyclic(spark, sf):
    configure(spark)
    edges = event_transition_edges(spark, sf)
    e = _t(spark, sf, "events")
    starts = e.select("event_type").distinct().select(
        F.col("event_type").alias("incident_id"),
        FK.dataset_urn(F.lit(EVENT_PLATFORM), F.concat(F.lit("events."), F.col("event_type"))).alias("urn"))
    return _big(walk(starts, edges, upstream=False, max_hops=None), "hop")


def q_walk_edges(spark, sf):
    cat = fk(spark, sf, False, ("edges", "incidents"))
    return walked_edges_upstream(_starts(cat.incidents), cat.edges, max_hops=UP_HOPS, edges_distinct=True)


def q_chain_edges(spark, sf):
    """S6 + W7: each customer's orders in date order form a chain of n-1 edges. The
    successor is found without sorting a whole customer in one task (operators.sequence)."""
    configure(spark)
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey",
                                       FK.node_urn("orders", F.col("o_orderkey")).alias("upstream"))
    nx = next_in_sequence(o, "o_custkey", ["o_orderdate", "o_orderkey"], "upstream", "downstream")
    return (nx.where(F.col("downstream").isNotNull())
            .select(FK.node_urn("customer", F.col("o_custkey")).alias("chain"), "upstream", "downstream"))


# ---- evidence (J2, P1-P15, A1) ---------------------------------------------------------

def _evidence(spark, sf):
    cat = fk(spark, sf, False)
    return cat, walk(_starts(cat.incidents), cat.edges, upstream=True, max_hops=None, edges_distinct=True)


def q_entity_enrich(spark, sf):
    cat, w = _evidence(spark, sf)
    ev = enrich_made(w, cat.entities, lambda c: {x: c[x] for x in ("name", "platform", "description")} | {"owner": owner_label(c["owners"], c["custom_properties"])})
    return _big(ev.select("incident_id", "urn", "hop", "name", "platform", "description", "owner"), "hop")


def q_node_summary(spark, sf):
    cat, w = _evidence(spark, sf)
    return summaries(w, cat.entities, hop_label()).select("incident_id", "urn", "summary")


def q_evidence_block(spark, sf):
    cat, w = _evidence(spark, sf)
    return _big(enriched_lines(w, cat.entities), "hop")


def q_evidence_count(spark, sf):
    cat = fk(spark, sf, False, ("edges", "incidents"))
    reach = reach_upstream(_starts(cat.incidents), cat.edges, edges_distinct=True)
    return evidence_count(reach.compose(made=[]))


def q_urn_parse(spark, sf):
    ents = FK.entities(FK.read_tables(spark, sf))
    urns = ents.select("urn").unionByName(ents.select(F.explode("owners").alias("urn"))).distinct()
    return urns.select("urn", urn_name("urn").alias("name"), urn_platform("urn").alias("platform"),
                       urn_tail("urn").alias("tail"), tag_short("urn").alias("short"))


def q_owner_label(spark, sf):
    ents = FK.entities(FK.read_tables(spark, sf))
    return ents.select("urn", owner_label().alias("owner_label"), cols_label().alias("cols_label"))


def q_props_label(spark, sf):
    ents = FK.entities(FK.read_tables(spark, sf))
    return ents.select("urn", props_label().alias("props_label"))


def q_props_map(spark, sf):
    """P8 on a JSON map column: one row per (event, key)."""
    configure(spark)
    e = _t(spark, sf, "events")
    m = F.from_json(F.col("props"), "map<string,string>")
    return (e.select("event_id", F.explode(m).alias("key", "value"))
            .where(F.col("key").isNotNull() & (F.col("key") != "")))


# ---- blast radius (G3, F2, F5, A2, A3) ---------------------------------------------------

def _blast(spark, sf):
    configure(spark)
    t = FK.read_tables(spark, sf)
    edges = materialize(FK.edges(t), "fk-edges")
    roots = (t["nation"].select(FK.node_urn("nation", F.col("n_nationkey")).alias("root_urn"))
             .unionByName(t["supplier"].select(FK.node_urn("supplier", F.col("s_suppkey")).alias("root_urn"))))
    return C.blast_radius_nodes(roots, edges, FK.entities(t), edges_distinct=True)


def q_blast_radius(spark, sf):
    s = C.blast_radius_summary(_blast(spark, sf))
    return s.select("root_urn", "impacted_count", "n_dashboards", "n_assets")


def q_blast_nodes(spark, sf):
    """The blast radius itself, one row per root and asset."""
    return _big(_blast(spark, sf).select("root_urn", "urn", "hop", "label", "is_dashboard"), "hop")


# ---- signals and ranking (R1-R5, F4, F7) ----------------------------------------------------

def customer_freshness(spark, sf) -> DataFrame:
    o = _t(spark, sf, "orders")
    f = X.freshness(o, "o_orderdate", ["o_custkey"], STALE_DAYS)
    return f.select(FK.node_urn("customer", F.col("o_custkey")).alias("urn"), "last_day", "as_of", "lag_days",
                    "stale", F.lit(float(STALE_DAYS)).alias("threshold"))


def customer_freshness_signals(spark, sf) -> DataFrame:
    return X.signals_from_checks(stale=customer_freshness(spark, sf))


def q_symptom_class(spark, sf):
    inc = FK.incidents(FK.read_tables(spark, sf, ["lineitem"]))
    return inc.select("incident_id", F.array_join(X.symptom_classes(), ",").alias("classes"))


def q_signals(spark, sf):
    ents = FK.entities(FK.read_tables(spark, sf))
    return X.text_signals(ents).select("urn", "class", "source")


def _ranked(spark, sf, text_only_high=False):
    cat = fk(spark, sf, True)
    reach = reach_upstream(_starts(cat.incidents), cat.edges, edges_distinct=True)
    return cat, rank_reached(reach, cat.incidents, catalog_signals(cat), cat.entities, text_only_high=text_only_high)


def q_rank_suspects(spark, sf):
    _, s = _ranked(spark, sf)
    return _big(s.select("incident_id", "rank", "urn", "score", "dist", "confidence"), "rank", "score", "dist")


def q_act_gate(spark, sf):
    _, s = _ranked(spark, sf)
    return act_gate(s).select("incident_id", "urn", "confidence", "source")


# ---- containment and write-back (C1-C4, C7, J5, J6, S7, A5, A6) -------------------------------

def _contained(spark, sf, per_root=True, keep_evidence=False):
    cat = fk(spark, sf, True)
    store = C.TagStore.fresh(spark)
    inv = investigate(cat, act=True, store=store, per_root=per_root, keep_evidence=keep_evidence)
    return cat, inv, store


def q_tags_add(spark, sf):
    _, inv, _ = _contained(spark, sf, per_root=False)
    store_root = inv.containment
    return store_root["quarantine_applied"].unionByName(store_root["impact_applied"]).select(
        "entity_urn", "tag_urn").distinct()


def q_tags_verify(spark, sf):
    """J5 + J6: what containment requested, and one request per region for a tag that the
    vocabulary lacks: it is rejected, and found missing in the read-back."""
    _, inv, store = _contained(spark, sf, per_root=False)
    c = inv.containment
    unknown = FK.read_tables(spark, sf, ["region"])["region"].select(
        FK.node_urn("region", F.col("r_regionkey")).alias("entity_urn"), F.lit(UNKNOWN_TAG).alias("tag_urn"))
    accepted, rejected = store.add_tags(unknown)
    asked = c["quarantine_applied"].unionByName(c["impact_applied"]).select("entity_urn", "tag_urn").distinct()
    found = C.verify(asked.unionByName(accepted.select("entity_urn", "tag_urn")).unionByName(rejected), store.entity_tags())
    return found.join(rejected.withColumn("_r", F.lit(True)), ["entity_urn", "tag_urn"], "left").select(
        "entity_urn", "tag_urn", "applied", F.coalesce("_r", F.lit(False)).alias("rejected"))


def q_tags_remove(spark, sf):
    _, _, store = _contained(spark, sf, per_root=False)  # containment writes run inside
    removal = store.entity_tags().where(F.col("tag_urn") == C.QUARANTINE_TAG)
    return store.remove_tags(removal)


def q_writeback_proof(spark, sf):
    """Leftover tags (every customer impacted, every region quarantined) -> removed -> clean
    slate -> act -> fresh read-back; per acted incident whether its root is quarantined and how
    many of its blast-radius nodes carry the impact tag."""
    cat = fk(spark, sf, True)
    store = C.TagStore.fresh(spark)
    store.ensure_vocabulary()
    t = FK.read_tables(spark, sf, ["customer", "region"])
    store.add_tags(t["customer"].select(FK.node_urn("customer", F.col("c_custkey")).alias("entity_urn"), F.lit(C.IMPACT_TAG).alias("tag_urn"))
                   .unionByName(t["region"].select(FK.node_urn("region", F.col("r_regionkey")), F.lit(C.QUARANTINE_TAG))
                                .toDF("entity_urn", "tag_urn")))
    leftover = store.entity_tags()
    n_left = leftover.count()
    store.remove_tags(leftover.where(F.col("tag_urn").isin(C.QUARANTINE_TAG, C.IMPACT_TAG)))
    before = store.entity_tags()
    clean = before.where(F.col("tag_urn").isin(C.QUARANTINE_TAG, C.IMPACT_TAG)).isEmpty()  # A5
    inv = investigate(cat, act=True, store=store)
    acted = inv.reports.where(F.col("action").isNotNull()).select("incident_id", F.col("action")["urn"].alias("root"))
    after = C.TagStore(spark, store.root).entity_tags()  # independent read of the latest snapshot
    q = after.where(F.col("tag_urn") == C.QUARANTINE_TAG).select(F.col("entity_urn").alias("root"),
                                                                 F.lit(True).alias("root_quarantined"))
    imp = after.where(F.col("tag_urn") == C.IMPACT_TAG).select(F.col("entity_urn").alias("urn"))
    nodes = inv.containment["nodes"].join(imp, "urn", "left_semi")
    tagged = nodes.groupBy(F.col("root_urn").alias("root")).agg(F.count(F.lit(1)).alias("downstream_tagged"))
    out = (acted.join(q, "root", "left").join(tagged, "root", "left")
           .select("incident_id", F.coalesce("root_quarantined", F.lit(False)).alias("root_quarantined"),
                   F.coalesce("downstream_tagged", F.lit(0)).cast("bigint").alias("downstream_tagged")))
    out = out.withColumn("tags_removed", F.lit(n_left).cast("bigint"))
    return out.withColumn("pass", F.lit(clean) & F.col("root_quarantined") & (F.col("downstream_tagged") >= 1))


# ---- data checks (X1-X7) ----------------------------------------------------------------------

def q_volume_anomaly(spark, sf):
    configure(spark)
    v = X.volume_anomaly(faulty_events(spark, sf), "ts", ["event_type"], DROP_RATIO)
    return v.select("event_type", F.col("day").cast("string").alias("day"), "n_rows",
                    F.round("prior_avg", 4).alias("prior_avg"), F.round("ratio", 4).alias("ratio"), "flagged")


def faulty_events(spark, sf) -> DataFrame:
    """``events`` with faults by rule, so that the checks have something to find: on the 20th of
    a month three rows of four are missing (X1), on the 10th every eleventh value is null
    (X2), from the 12th to the 15th the property map has one more key (X3)."""
    e = _t(spark, sf, "events")
    day = F.dayofmonth("ts")
    return (e.where((day != 20) | (F.col("event_id") % 4 == 0))
            .withColumn("value", F.when((day == 10) & (F.col("event_id") % 11 == 0), None).otherwise(F.col("value")))
            .withColumn("props", F.when(day.between(12, 15), F.concat(F.lit('{"src": 1, '), F.substring("props", 2, 1 << 30)))
                        .otherwise(F.col("props"))))


EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def q_null_rate(spark, sf):
    configure(spark)
    n = X.null_rates(faulty_events(spark, sf), "ts", EVENT_COLUMNS)
    return n.select(F.col("day").cast("string").alias("day"), "column", "n_rows", "n_null",
                    F.round("null_rate", 6).alias("null_rate"), F.round("prev_rate", 6).alias("prev_rate"),
                    F.round("delta", 6).alias("delta"))


def q_null_spikes(spark, sf):
    """X2 with its rule: per event type, the days on which a column's null rate spikes."""
    configure(spark)
    columns = [c for c in EVENT_COLUMNS if c != "event_type"]
    s = X.null_spikes(X.null_rates(faulty_events(spark, sf), "ts", columns, ["event_type"]), ["event_type"])
    return s.select("event_type", F.col("day").cast("string").alias("day"), "column", "n_null", F.round("null_rate", 6).alias("null_rate"),
                    F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), "spike")


def event_columns(spark, sf) -> DataFrame:
    """The column lists of the event feeds per day, from their property maps, with schema changes by
    rule: from the 15th ``k`` is ``key``; from the 22nd ``lat`` and ``lon`` are ``latitude`` and
    ``longitude``; on the 26th ``lat`` holds text; the 17th has no rows."""
    e = _t(spark, sf, "events")
    day = F.dayofmonth("ts")
    k = F.get_json_object("props", "$.k")
    props = F.concat(F.when(day < 15, F.lit('{"k": ')).otherwise(F.lit('{"key": ')), k,
                     F.when(day < 22, F.lit(', "lat": 1, "lon": 2')).when(day == 26, F.lit(', "latitude": "n/a", "longitude": 2'))
                     .otherwise(F.lit(', "latitude": 1, "longitude": 2')), F.lit("}"))
    entries = F.explode(F.map_entries(F.from_json(props, "map<string,string>")))
    c = e.where(day != 17).select("event_type", F.to_date("ts").alias("snapshot"), entries.alias("e"))
    return c.select("event_type", "snapshot", F.col("e")["key"].alias("column"),
                    F.when(F.col("e")["value"].rlike(r"^-?[0-9.]+$"), "number").otherwise("text").alias("type")).distinct()


def q_column_diff(spark, sf):
    """X3 on column lists: added, dropped, retyped and renamed columns of every feed, each day
    against the feed's last day with rows."""
    configure(spark)
    d = X.schema_changes(event_columns(spark, sf), ["event_type"])
    return d.select("event_type", F.col("snapshot").cast("string").alias("snapshot"), F.col("prev_snapshot").cast("string").alias("prev_snapshot"),
                    "change", "column", "type", "renamed_to")


def q_schema_diff(spark, sf):
    """X3 on payload keys; the 12th, the first of the days with one more key, has no rows."""
    configure(spark)
    d = X.json_key_drift(faulty_events(spark, sf).where(F.dayofmonth("ts") != 12), "ts", "props")
    return d.select(F.col("day").cast("string").alias("day"), "key", "change")


def q_freshness(spark, sf):
    configure(spark)
    f = customer_freshness(spark, sf)
    return f.select("urn", F.col("last_day").cast("string").alias("last_day"),
                    F.col("as_of").cast("string").alias("as_of"), F.col("lag_days").cast("bigint").alias("lag_days"),
                    "stale")


def q_zero_row_days(spark, sf):
    configure(spark)
    z = X.zero_row_days(_t(spark, sf, "orders"), "o_orderdate", ["o_orderpriority"])
    return z.select("o_orderpriority", F.col("day").cast("string").alias("day"))


def q_zero_row_runs(spark, sf):
    """X5 as runs: every customer's stretches without an order, up to the table's latest day."""
    configure(spark)
    r = X.zero_row_runs(_t(spark, sf, "orders"), "o_orderdate", ["o_custkey"])
    return r.select("o_custkey", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"),
                    F.col("n_days").cast("bigint").alias("n_days"), "open")


def orders_by_place(spark, sf) -> DataFrame:
    """Orders with their day, customer, nation and region."""
    o, c, n = (_t(spark, sf, x) for x in ("orders", "customer", "nation"))
    return (o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("o_orderkey", "o_custkey", "n_nationkey", "n_regionkey", F.to_date("o_orderdate").alias("day")))


def q_volume_regions(spark, sf):
    """X1 on untouched tables: orders per region and day."""
    configure(spark)
    v = X.volume_anomaly(orders_by_place(spark, sf), "day", ["n_regionkey"], FUSED_DROP)
    return v.select("n_regionkey", F.col("day").cast("string").alias("day"), "n_rows", F.round("prior_avg", 4).alias("prior_avg"), "flagged")


def stage_volumes(spark, sf) -> DataFrame:
    """Daily volumes ``(urn, day, n_rows)`` of the six tables as stages: the orders of a day that
    have arrived at region, nation, customer and orders, and their lines at supplier and
    lineitem. On the 20th of a month three of four orders are lost between nation and customer."""
    o = orders_by_place(spark, sf).where(F.col("day").isNotNull()).withColumn("kept", (F.dayofmonth("day") != 20) | (F.col("o_orderkey") % 4 == 0))
    li = _t(spark, sf, "lineitem").select("l_orderkey")
    per_order = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    o = o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
    kept = F.when(F.col("kept"), 1).otherwise(0)
    daily = o.groupBy("day").agg(*[F.sum(x).cast("long").alias(name) for name, x in (
        ("region", F.lit(1)), ("nation", F.lit(1)), ("customer", kept), ("orders", kept), ("supplier", F.col("lines")), ("lineitem", kept * F.col("lines")))])
    return daily.unpivot(["day"], list(FK.TABLES), "name", "n_rows").select(FK.table_urn(F.col("name")).alias("urn"), "day", "n_rows")


def q_first_drop(spark, sf):
    """Per day and table, the edge of the tables' lineage at which a drop first appears."""
    cat = fk(spark, sf, False, ("edges",))
    edges = materialize(FK.table_edges(cat.edges), "table-edges")
    d = X.first_drops(X.edge_breaks(stage_volumes(spark, sf), edges, DROP_RATIO), edges)
    return d.select(F.col("day").cast("string").alias("day"), "upstream", "downstream", F.round("ratio", 4).alias("ratio"),
                    F.round("usual", 4).alias("usual"), "urn", F.col("hops").cast("bigint").alias("hops"))


ORDERS_TABLE_URN = "urn:li:dataset:(urn:li:dataPlatform:looker,orders,PROD)"
LINEITEM_TABLE_URN = "urn:li:dataset:(urn:li:dataPlatform:looker,lineitem,PROD)"


def q_hop_volume(spark, sf):
    """X6 on the table-level edge orders -> lineitem: per order day, the orders placed and
    the line rows those orders produced."""
    configure(spark)
    o = _t(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    li = _t(spark, sf, "lineitem").select("l_orderkey")
    m_o = o.groupBy("day").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("urn", F.lit(ORDERS_TABLE_URN))
    m_l = (li.join(o, li.l_orderkey == o.o_orderkey).groupBy("day").agg(F.count(F.lit(1)).alias("n_rows"))
           .withColumn("urn", F.lit(LINEITEM_TABLE_URN)))
    edges = spark.createDataFrame([(ORDERS_TABLE_URN, LINEITEM_TABLE_URN)], "upstream string, downstream string")
    hv = X.hop_volume(m_o.unionByName(m_l), edges)
    return hv.select("upstream", "downstream", F.col("day").cast("string").alias("day"), "up_rows", "down_rows",
                     F.round("ratio", 4).alias("ratio"))


def fused_results(spark, sf) -> DataFrame:
    """The results of X1 to X5 on the assets whose rows they check: order volume per region,
    null rates of line discounts per supplier's nation and month, column lists per supplier and
    month, freshness per customer, runs without orders per nation. Faults by rule for X2 (in
    April and October every fifth order has no discounts in every third nation) and X3 (in every
    eighth month every seventh supplier calls the discount by another name)."""
    place = materialize(orders_by_place(spark, sf).where(F.col("day").isNotNull()), "place")
    urn = lambda table, c: FK.node_urn(table, F.col(c))
    v = X.volume_anomaly(place, "day", ["n_regionkey"], FUSED_DROP)
    out = FU.result_rows("volume", v, urn("region", "n_regionkey"), F.col("day"), F.col("flagged"), F.col("ratio"),
                         F.concat(F.lit("rows "), F.col("n_rows").cast("string")))
    s = _t(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    li = _t(spark, sf, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    li = li.where(F.col("l_shipdate").isNotNull()).withColumn("month", F.trunc("l_shipdate", "month"))
    bare = F.month("month").isin(4, 10) & (F.col("l_orderkey") % 5 == 0) & (F.col("s_nationkey") % 3 == 0)
    n = X.null_rates(li.withColumn("l_discount", F.when(bare, None).otherwise(F.col("l_discount"))), "month", ["l_discount"], ["s_nationkey"])
    n = X.null_spikes(n, ["s_nationkey"], window_rows=12)
    out = out.unionByName(FU.result_rows("nulls", n, urn("nation", "s_nationkey"), F.last_day("day"), F.col("spike"), F.col("null_rate"),
                                         F.concat("column", F.lit(" null in "), F.col("n_null").cast("string"))))
    feeds = li.select("s_suppkey", "month").distinct()
    other = (F.col("s_suppkey") % 7 == 3) & ((12 * F.year("month") + F.month("month")) % 8 == 0)
    names = F.transform(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type")) for c, t in X.columns_of(_t(spark, sf, "lineitem"))]),
                        lambda x: F.struct(F.when(other & (x["column"] == "l_discount"), "l_discount_pct").otherwise(x["column"]).alias("column"), x["type"]))
    changes = X.schema_list_changes(feeds.select("s_suppkey", F.col("month").alias("snapshot"), names.alias("columns")), ["s_suppkey"])
    changes = feeds.join(changes.groupBy("s_suppkey", F.col("snapshot").alias("month")).agg(F.count(F.lit(1)).alias("n")), ["s_suppkey", "month"], "left")
    out = out.unionByName(FU.result_rows("schema", changes, urn("supplier", "s_suppkey"), F.col("month"), F.col("n") > 0, F.coalesce("n", F.lit(0)),
                                         F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" columns changed"))))
    days = place.select("o_custkey", "day").distinct()
    days = days.withColumn("next_day", F.lead("day").over(Window.partitionBy("o_custkey").orderBy("day")))
    as_of = place.select(F.max("day")).scalar()
    out = out.unionByName(FU.freshness_results(days, urn("customer", "o_custkey"), STALE_DAYS, as_of))
    return out.unionByName(FU.zero_run_results(X.zero_row_runs(place, "day", ["n_nationkey"]), urn("nation", "n_nationkey"), SILENT_DAYS))


def q_check_results(spark, sf):
    """The results of all checks as one typed table."""
    configure(spark)
    return fused_results(spark, sf).select("urn", F.col("as_of").cast("string").alias("as_of"), "check", "class", "flagged",
                                           F.round("measure", 4).alias("measure"), "detail")


def q_rank_fused(spark, sf):
    """X7 + R1: suspects from the results of all five checks as of each incident's day, and text."""
    cat = fk(spark, sf, False)
    reach = reach_upstream(_starts(cat.incidents), cat.edges, edges_distinct=True)
    inc = cat.incidents.join(FK.incident_days(FK.read_tables(spark, sf, ["lineitem"])), "incident_id", "left")
    ev = FU.dated_evidence(reach, inc)
    results = materialize(fused_results(spark, sf), "check-results")
    text = evidence_signals(cat, materialize(reach.nodes(), "reached"))
    s = FU.rank_as_of(ev, inc, results, text, cat.edges, cat.entities, max_age_days=RESULT_AGE, edges_distinct=True)
    return _big(s.select("incident_id", "rank", "urn", "score", "dist", "class", "source", "confidence", "why"), "rank", "score", "dist")


EVENTS_TABLE = "urn:li:dataset:(urn:li:dataPlatform:kafka,events.{},PROD)"
ORDERS_FEED = "urn:li:dataset:(urn:li:dataPlatform:looker,orders.priority.{},PROD)"


def q_signals_union(spark, sf):
    """Volume, freshness and zero-row checks as one typed signal table."""
    configure(spark)
    v = X.volume_anomaly(faulty_events(spark, sf), "ts", ["event_type"], DROP_RATIO).select(
        "*", FK.dataset_urn(F.lit(EVENT_PLATFORM), F.concat(F.lit("events."), F.col("event_type"))).alias("urn"),
        F.lit(DROP_RATIO).alias("threshold"))
    z = X.zero_row_days(_t(spark, sf, "orders"), "o_orderdate", ["o_orderpriority"]).select(
        "*", FK.dataset_urn(F.lit("looker"), F.concat(F.lit("orders.priority."), F.col("o_orderpriority"))).alias("urn"))
    s = X.signals_from_checks(volume=v, stale=customer_freshness(spark, sf), zero_days=z)
    return s.select("urn", F.col("as_of").cast("string").alias("as_of"), "class",
                    F.round("measure", 4).alias("measure"), F.round("threshold", 4).alias("threshold"), "source")


# ---- search and answers (S12, P16, P17) ----------------------------------------------------------

def q_search_entities(spark, sf):
    d = _t(spark, sf, "documents")
    ents = d.select(F.concat(F.lit("doc."), F.col("doc_id").cast("string")).alias("name"),
                    F.col("text").alias("description"), "doc_id")
    return search_entities(ents, SEARCH_TERM).select("doc_id")


def stored_answers(spark, sf) -> DataFrame:
    """Reasoning answers as they would be stored: each conversation turn wrapped as a JSON
    answer with up to three suspects; by turn, fenced with 'json', bare, or left as plain
    prose; every seventh conversation's JSON is broken."""
    c = _t(spark, sf, "conversations")
    suspect = F.struct(FK.dataset_urn(F.lit(EVENT_PLATFORM), F.concat(F.lit("turn."), F.col("turn").cast("string"))).alias("urn"),
                       F.lit("high").alias("confidence"))
    obj = F.to_json(F.struct(F.col("text").alias("summary"),
                             F.array_repeat(suspect, F.pmod(F.col("conv_id"), F.lit(4)).cast("int")).alias("suspects"),
                             F.lit(None).cast("string").alias("missing_evidence")))
    k = F.pmod(F.col("turn"), F.lit(3))
    wrapped = (F.when(k == 0, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
               .when(k == 1, obj).otherwise(F.col("text")))
    broken = F.concat(F.lit('{"summary": '), F.col("text"))
    wrapped = F.when(F.pmod(F.col("conv_id"), F.lit(7)) == 3, broken).otherwise(wrapped)
    return c.select("conv_id", "turn", wrapped.alias("answer"))


def q_report_parse(spark, sf):
    a = stored_answers(spark, sf)
    p = parse_answer(F.col("answer"))
    return a.select("conv_id", "turn", p["summary"].alias("summary"), p["missing_evidence"].alias("missing_evidence"),
                    F.size(p["suspects"]).cast("bigint").alias("n_suspects"))


# ---- raw catalog answers (S2-S4, P4-P10) -------------------------------------------------------

def _number(name):
    return F.regexp_extract(name, "([0-9]+)", 1).cast("long")


def raw_entity_answers(ents: DataFrame) -> DataFrame:
    """A JSON answer ``(answer_id, text)`` per entity in the shapes that a catalog service gives, by
    the number in its name: a list or an object, names, descriptions, owners and columns in
    their alternative places, repeated and empty property keys, an entity without an URN; some
    cut off, some empty, some with text behind them."""
    # numbers and texts are columns of steps of their own, so that each is found once a row
    ents = ents.withColumn("_k", _number("name"))
    k, v = F.col("_k"), F.col("_k") % 6
    s = lambda **c: F.struct(*[x.alias(n) for n, x in c.items()])
    none = F.lit(None).cast("string")
    kv = lambda a, b: s(key=a, value=b)
    props = F.transform(F.map_entries("custom_properties"), lambda x: kv(x["key"], x["value"]))
    props = F.when(v == 0, F.concat(F.array(kv(F.lit("run_status"), F.lit("old")), kv(F.lit(""), F.lit("no key"))), props)).when(v != 4, props)
    owners = F.transform("owners", lambda u: s(owner=s(urn=F.when(v != 3, u)), ownerUrn=F.when(v == 3, u)))
    owners = F.when(v == 3, F.concat(owners, F.array(s(owner=s(urn=none), ownerUrn=none)))).otherwise(owners)
    fields = s(fields=F.transform("schema_fields", lambda f: s(fieldPath=f)))
    entity = s(urn=F.col("urn"), name=F.when(v == 0, "").when(v != 4, F.col("name")), platform=s(name=F.col("platform")),
               properties=s(name=F.when(v == 0, F.concat(F.col("name"), F.lit(" (stored)"))), description=F.when(v != 4, F.col("description")), customProperties=props),
               editableProperties=s(description=F.when(v == 2, "").when(v == 3, F.concat(F.lit("edited: "), "description"))),
               ownership=s(owners=owners), schemaMetadata=F.when(v != 1, fields), schema=F.when(v == 1, fields),
               tags=F.when(k % 4 == 0, s(tags=F.array(s(tag=s(urn=F.lit(C.IMPACT_TAG)))))))
    listed = F.to_json(F.when(v == 5, F.array(entity, entity.withField("urn", none))).otherwise(F.array(entity)))
    ents = ents.select("name", "_k", listed.alias("_listed"))
    listed = F.col("_listed")
    ents = ents.select("name", "_k", F.when((v == 1) | (v == 3), F.concat(F.lit('{"entities": '), listed, F.lit("}"))).otherwise(F.concat(F.lit(" "), listed, F.lit("\n"))).alias("_text"))
    text = F.col("_text")
    text = F.when(k % 11 == 10, F.substring(text, 1, 30)).when(k % 13 == 12, F.lit(" ")).when(k % 17 == 16, F.concat(text, F.lit(" and so on"))).otherwise(text)
    return ents.select(F.col("name").alias("answer_id"), text.alias("text"))


def q_answers_entities(spark, sf):
    """Entity answers decoded in one pass, rejects beside the entities."""
    configure(spark)
    d = decode_answers(raw_entity_answers(FK.entities(FK.read_tables(spark, sf))), "entities", keep=("answer_id",))
    props = F.array_sort(F.transform(F.map_entries("custom_properties"), lambda x: F.concat_ws("=", x["key"], x["value"])))
    good = F.col("reject").isNull()
    return d.select("answer_id", "reject", "urn", F.when(good, F.col("name")).alias("name"), "platform", "description",
                    F.when(good, F.array_join("owners", ", ")).alias("owners"), F.when(good, F.array_join("schema_fields", ", ")).alias("fields"),
                    F.when(good, F.array_join(props, "|")).alias("props"), F.when(good, F.array_join("tag_urns", ", ")).alias("tags"))


def q_answers_lineage(spark, sf):
    """S3: upstream answers per asset, from the edges into it; some have the other direction only,
    some an entity without an URN, some are cut off."""
    cat = fk(spark, sf, False, ("edges",))
    key = _number(F.substring_index(F.regexp_extract("start_urn", r"dataPlatform:[^,]+,([^,]+),", 1), ".", -1))
    into = cat.edges.groupBy(F.col("downstream").alias("start_urn")).agg(F.collect_list("upstream").alias("up"))   # an asset's few inputs
    into = into.select("start_urn", "up", key.alias("_key"))   # found once a row, as is the text
    key = F.col("_key")
    found = F.transform(F.when(key % 9 == 4, F.concat("up", F.array(F.lit("")))).otherwise(F.col("up")),
                        lambda u: F.struct(F.struct(u.alias("urn")).alias("entity")))
    block = F.struct(found.alias("searchResults"))
    text = F.to_json(F.struct(F.when(key % 5 != 0, block).alias("upstreams"), F.when(key % 5 == 0, block).alias("downstreams")))
    into = into.select("start_urn", "_key", text.alias("_answer"))
    text = F.col("_answer")
    text = F.when(key % 7 == 3, F.concat(F.substring(text, 1, 40), F.lit("..."))).otherwise(text)
    d = decode_answers(into.select("start_urn", text.alias("text")), "upstreams", keep=("start_urn",))
    return d.select("start_urn", "urn", "reject")


def q_entity_lookup(spark, sf):
    """S2 by key: the entities of the suppliers of all lines, each asked for as often as it has
    lines, beside empty and unknown URNs."""
    configure(spark)
    t = FK.read_tables(spark, sf)
    asked = t["lineitem"].select(FK.node_urn("supplier", F.col("l_suppkey")).alias("urn"))
    asked = asked.unionByName(t["region"].select(F.lit("").alias("urn"))).unionByName(t["nation"].select(FK.node_urn("nation", -F.col("n_nationkey") - 1).alias("urn")))
    return lookup_entities(FK.entities(t), asked).select("urn", "name", "platform")


def q_guarded_answers(spark, sf):
    """F7 on P16: stored answers for every incident name its order, a customer with the incident's
    line number and an asset that doesn't exist; only suspects among its evidence are kept."""
    cat = fk(spark, sf, False, ("edges", "incidents"))
    reach = reach_upstream(_starts(cat.incidents), cat.edges, edges_distinct=True)
    order, line = (F.regexp_extract("incident_id", r"L([0-9]+)-([0-9]+)", k) for k in (1, 2))
    sus = F.array(*[F.struct(FK.node_urn(t, k).alias("urn"), F.lit("high").alias("confidence")) for t, k in (
        ("orders", order), ("customer", line), ("region", F.concat(F.lit("made-up-"), line)))])
    answers = cat.incidents.select("incident_id", F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("symptom").alias("summary"), sus.alias("suspects"))),
                                                           F.lit("\n```")).alias("answer"))
    named = parsed_answers(answers, "answer").select("incident_id", F.posexplode_outer(F.col("parsed")["suspects"]).alias("pos", "s")).where("pos IS NOT NULL").select(   # else the answers are parsed again, to see which have suspects
        "incident_id", (F.col("pos") + 1).cast("bigint").alias("rank"), F.col("s")["urn"].alias("urn"))
    return guard_reached(reach, named)


# ---- vocabulary, seed, evaluation (S5, S7, C6, A4, P21, W6) --------------------------------------

def q_vocab_ensure(spark, sf):
    """S7 on a store that holds tags already: one per nation, and the quarantine tag under a name
    of its own, which is kept."""
    configure(spark)
    store = C.TagStore.fresh(spark)
    n = _t(spark, sf, "nation")
    mine = n.select(tag_urn(F.col("n_name")).alias("tag_urn"), F.col("n_name").alias("name"), F.lit("of a nation").alias("description"))
    kept = _t(spark, sf, "region").where("r_regionkey = 0").select(F.lit(C.QUARANTINE_TAG).alias("tag_urn"), F.lit("ours").alias("name"), "r_name")
    store.ensure_vocabulary_from(mine.unionByName(kept.toDF("tag_urn", "name", "description")))
    store.ensure_vocabulary()
    return store.ensure_vocabulary()


def q_upsert_entities(spark, sf):
    """Customers as entities, updated by every order of theirs; the latest order's stays."""
    configure(spark)
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    cur = c.select(FK.node_urn("customer", F.col("c_custkey")).alias("urn"), F.col("c_name").alias("name"),
                   F.lit("dbt").alias("platform"), F.lit("never ordered").alias("description"), F.lit(-1).cast("long").alias("version"))
    upd = o.select(F.lit("dbt").alias("platform"), F.concat(F.lit("customer."), F.col("o_custkey").cast("string")).alias("name"),
                   F.concat(F.lit("ordered "), F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority").alias("description"),
                   F.col("o_orderkey").cast("long").alias("version"))
    return upsert_entities(cur, upd).select("urn", "name", "description", "version")


def q_scenario_results(spark, sf):
    """Every incident is a scenario whose expected root is its supplier."""
    return _scenarios(spark, sf).select("incident_id", "expected_root", "top_urn", "ok")


def _scenarios(spark, sf):
    cat, s = _ranked(spark, sf)
    li = _t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("s"))
    expected = li.select(F.concat(F.lit("L"), FK.line_key()).alias("incident_id"), F.concat(F.lit("supplier."), F.col("s").cast("string"), F.lit(",")).alias("expected_root"))
    return scenario_results(s, expected)


def q_scenario_score(spark, sf):
    """A4: how many of them passed."""
    return scenario_score(_scenarios(spark, sf))


def q_action_status(spark, sf):
    """P21, both ways: the status of every requested tag, among them ones that the vocabulary lacks."""
    return q_tags_verify(spark, sf).select("entity_urn", tag_short("tag_urn").alias("tag"), action_status("applied").alias("status"))


def q_evidence_columns(spark, sf):
    """The evidence of every incident with the first four columns of each asset."""
    cat, w = _evidence(spark, sf)
    return _big(enriched_lines(w, cat.entities, max_columns=4), "hop")


# ---- intake (S8) ----------------------------------------------------------------------------------

def q_incident_stream(spark, sf):
    """All incidents, those of every third order sent again in a second write and all in a third,
    through the intake stream, a batch per write; each comes out once."""
    configure(spark)
    inc = FK.incidents(FK.read_tables(spark, sf, ["lineitem"]))
    again = F.regexp_extract("incident_id", "L([0-9]+)-", 1).cast("long") % 3 == 0
    source, sink, ckpt = (scratch_path(spark, f"intake-{x}") for x in ("source", "sink", "checkpoint"))
    for part in (inc.where(~again), inc.where(again), inc):
        part.write.mode("append").parquet(source)
        start_stream(spark, source, sink, lambda b: b, checkpoint_location=ckpt).awaitTermination()
    return spark.read.schema(inc.schema).parquet(sink).select("incident_id", "symptom", "affected_urn")


# ---- reports (S9-S11, C5) ---------------------------------------------------------------------

def q_investigate(spark, sf):
    cat = fk(spark, sf, True)
    inv = investigate(cat, act=False)
    return inv.reports.select("incident_id", "summary", "missing_evidence", "evidence_nodes", "upstream_nodes",
                              F.size("suspects").cast("bigint").alias("n_suspects"))


def q_report_json(spark, sf):
    """S9, read back: the fields of the JSON documents, absent values as JSON nulls."""
    docs = report_json(investigate(fk(spark, sf, True), act=False).reports)
    get = lambda path: F.get_json_object("report_json", path)
    null = F.col("report_json").contains('"missing_evidence":null')
    return docs.select("incident_id", get("$.summary").alias("summary"), get("$.missing_evidence").alias("missing_evidence"),
                       null.alias("missing_is_null"), get("$.evidence_nodes").cast("bigint").alias("evidence_nodes"),
                       get("$.suspects[0].urn").alias("top_urn"))


def q_report_text(spark, sf):
    return report_text(_contained(spark, sf)[1].reports)


def q_drawing_lines(spark, sf):
    """S11 + G6: the lines that all drawings share, once each."""
    cat, inv, _ = _contained(spark, sf)
    return _big(drawing(inv, cat).select("scope", "id", "part", "line"), "part")


def q_lineage_dot(spark, sf):
    cat, inv, _ = _contained(spark, sf, keep_evidence=True)
    return _big(lineage_dot(inv.evidence, inv.reports, cat.edges, inv.containment["nodes"], reached=inv.reached, edges_distinct=True), "part")


QUERIES = {
    "walk_upstream": q_walk_upstream,
    "walk_downstream": q_walk_downstream,
    "walk_multi_source": q_walk_multi_source,
    "walk_capped": q_walk_capped,
    "walk_cyclic": q_walk_cyclic,
    "walk_per_node_cap": q_walk_per_node_cap,
    "walk_edges": q_walk_edges,
    "chain_edges": q_chain_edges,
    "entity_enrich": q_entity_enrich,
    "node_summary": q_node_summary,
    "evidence_block": q_evidence_block,
    "evidence_count": q_evidence_count,
    "urn_parse": q_urn_parse,
    "owner_label": q_owner_label,
    "props_label": q_props_label,
    "props_map": q_props_map,
    "blast_radius": q_blast_radius,
    "blast_nodes": q_blast_nodes,
    "symptom_class": q_symptom_class,
    "signals": q_signals,
    "rank_suspects": q_rank_suspects,
    "act_gate": q_act_gate,
    "tags_add": q_tags_add,
    "tags_verify": q_tags_verify,
    "tags_remove": q_tags_remove,
    "writeback_proof": q_writeback_proof,
    "volume_anomaly": q_volume_anomaly,
    "null_rate": q_null_rate,
    "null_spikes": q_null_spikes,
    "schema_diff": q_schema_diff,
    "column_diff": q_column_diff,
    "freshness": q_freshness,
    "zero_row_days": q_zero_row_days,
    "zero_row_runs": q_zero_row_runs,
    "volume_regions": q_volume_regions,
    "hop_volume": q_hop_volume,
    "first_drop": q_first_drop,
    "signals_union": q_signals_union,
    "check_results": q_check_results,
    "rank_fused": q_rank_fused,
    "search_entities": q_search_entities,
    "report_parse": q_report_parse,
    "investigate": q_investigate,
    "report_json": q_report_json,
    "report_text": q_report_text,
    "lineage_dot": q_lineage_dot,
    "drawing_lines": q_drawing_lines,
    "answers_entities": q_answers_entities,
    "answers_lineage": q_answers_lineage,
    "entity_lookup": q_entity_lookup,
    "guarded_answers": q_guarded_answers,
    "vocab_ensure": q_vocab_ensure,
    "upsert_entities": q_upsert_entities,
    "scenario_results": q_scenario_results,
    "scenario_score": q_scenario_score,
    "action_status": q_action_status,
    "evidence_columns": q_evidence_columns,
    "incident_stream": q_incident_stream,
}
