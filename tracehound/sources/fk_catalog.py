"""A lineage catalog derived from the driver's TPC-H-style tables.

Every row of region, nation, customer, supplier, orders and lineitem is an asset;
every foreign key is a lineage edge from the referenced row to the referencing row:

    region -> nation -> {customer, supplier};  customer -> orders -> lineitem;
    supplier -> lineitem

Line items are keyed ``<orderkey>-<linenumber>``; that pair repeats in the data, so
nodes and edges are de-duplicated. Entity metadata (owner, run status, run note) is
derived from the rows by fixed rules, so the catalog grows with the tables.

The DuckDB twin of this construction lives in ``tracehound.plans.oracle``; the two
must be changed together.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urn import dataset_urn
from .catalog import Catalog

TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem")

# ---- fixed values of the demo catalog ------------------------------------------
PLATFORM = {"region": "bigquery", "nation": "bigquery", "customer": "dbt",
            "supplier": "dbt", "orders": "looker", "lineitem": "looker"}
SCHEMA_FIELDS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"],
}
# Run note chosen by (numeric key mod NOTE_MOD); keys with no entry get no note.
NOTE_MOD = 29
NOTES = {
    0: "only 61 of 100 expected batches arrived, fewer rows than usual",
    1: "upstream schema changed: column code renamed to code_v2",
    2: "partner endpoint unreachable since Tuesday, feed went down",
    3: "all checks passed, no fewer rows than yesterday",
    4: "not stale: loaded 02:00",
}
# Symptom per line item, chosen by its largest return flag.
SYMPTOMS = {
    "R": "returned revenue shows a sharp drop, fewer rows than usual",
    "A": "report shows blank/null discount values for many lines",
    "N": "shipment numbers look frozen, stuck since last week",
}
# ----------------------------------------------------------------------------------


def read_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(os.path.join(sf_dir, f"{n}.parquet")) for n in names}


def node_urn(table: str, key: Column) -> Column:
    return dataset_urn(F.lit(PLATFORM[table]), F.concat(F.lit(table + "."), key.cast("string")))


def line_key(orderkey="l_orderkey", linenumber="l_linenumber") -> Column:
    return F.concat(F.col(orderkey).cast("string"), F.lit("-"), F.col(linenumber).cast("string"))


def line_groups(t: dict[str, DataFrame]) -> DataFrame:
    """One row per line id ``(l_orderkey, l_linenumber)``: its row count and largest
    return flag (fixed-size aggregates, partially computed before the shuffle). Shared
    by edges, entities and incidents."""
    return t["lineitem"].groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("l_returnflag").alias("flag"))


def edges(t: dict[str, DataFrame], lines: DataFrame | None = None) -> DataFrame:
    """The six foreign keys as (upstream, downstream) URN pairs, de-duplicated.

    Order-to-line edges come from the per-line groups (unique by construction);
    supplier-to-line edges are a ``distinct`` over (order, line, supplier), which
    de-duplicates map-side, so a line id repeated very often costs no large group."""
    lines = lines if lines is not None else line_groups(t)
    parts = [
        t["nation"].select(node_urn("region", F.col("n_regionkey")).alias("upstream"),
                           node_urn("nation", F.col("n_nationkey")).alias("downstream")),
        t["customer"].select(node_urn("nation", F.col("c_nationkey")).alias("upstream"),
                             node_urn("customer", F.col("c_custkey")).alias("downstream")),
        t["supplier"].select(node_urn("nation", F.col("s_nationkey")).alias("upstream"),
                             node_urn("supplier", F.col("s_suppkey")).alias("downstream")),
        t["orders"].select(node_urn("customer", F.col("o_custkey")).alias("upstream"),
                           node_urn("orders", F.col("o_orderkey")).alias("downstream")),
    ]
    small = parts[0]
    for p in parts[1:]:
        small = small.unionByName(p)
    by_order = lines.select(node_urn("orders", F.col("l_orderkey")).alias("upstream"),
                            node_urn("lineitem", line_key()).alias("downstream"))
    by_supplier = (t["lineitem"].select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
                   .select(node_urn("supplier", F.col("l_suppkey")).alias("upstream"),
                           node_urn("lineitem", line_key()).alias("downstream")))
    li_edges = by_order.unionByName(by_supplier)
    ok = F.col("upstream").isNotNull() & F.col("downstream").isNotNull()
    return small.where(ok).distinct().unionByName(li_edges.where(ok))


def _note(key: Column) -> Column:
    k = F.pmod(key.cast("long"), F.lit(NOTE_MOD))
    out = F.lit(None).cast("string")
    for i in sorted(NOTES, reverse=True):
        out = F.when(k == i, F.lit(NOTES[i])).otherwise(out)
    return out


def _props(owner: Column | None, note: Column) -> Column:
    entries = [F.struct(F.lit("run_status").alias("key"), F.lit("success").alias("value")),
               F.struct(F.lit("last_run_note").alias("key"), note.alias("value"))]
    if owner is not None:
        entries.insert(0, F.struct(F.lit("owner").alias("key"), owner.alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def _entity(table: str, key: Column, description: Column, owners: Column | None,
            owner_prop: Column | None, note_key: Column) -> list[Column]:
    urn = node_urn(table, key)
    return [
        urn.alias("urn"),
        F.concat(F.lit(table + "."), key.cast("string")).alias("name"),
        F.lit(PLATFORM[table]).alias("platform"),
        description.alias("description"),
        (owners if owners is not None else F.array().cast("array<string>")).alias("owners"),
        F.array(*[F.lit(c) for c in SCHEMA_FIELDS[table]]).alias("schema_fields"),
        _props(owner_prop, _note(note_key)).alias("custom_properties"),
    ]


def entities(t: dict[str, DataFrame], lines: DataFrame | None = None) -> DataFrame:
    """One entity per node, schema ``tracehound.schemas.ENTITIES``."""
    r, n, c, s, o = (t[x] for x in TABLES[:5])
    lines = lines if lines is not None else line_groups(t)
    parts = [
        r.select(*_entity("region", F.col("r_regionkey"), F.concat(F.lit("Region "), F.col("r_name")),
                          None, F.concat(F.lower(F.col("r_name")), F.lit("@geo")), F.col("r_regionkey"))),
        n.select(*_entity("nation", F.col("n_nationkey"), F.concat(F.lit("Nation "), F.col("n_name")),
                          F.array(F.concat(F.lit("urn:li:corpuser:"), F.lower(F.col("n_name")))), None,
                          F.col("n_nationkey"))),
        c.select(*_entity("customer", F.col("c_custkey"),
                          F.concat(F.col("c_name"), F.lit(" ("), F.col("c_mktsegment"), F.lit(")")),
                          None, F.concat(F.lower(F.col("c_mktsegment")), F.lit("@crm")), F.col("c_custkey"))),
        s.select(*_entity("supplier", F.col("s_suppkey"), F.col("s_name"),
                          F.array(F.lit("urn:li:corpuser:procurement")), None, F.col("s_suppkey"))),
        o.select(*_entity("orders", F.col("o_orderkey"),
                          F.concat(F.lit("Order status "), F.col("o_orderstatus"), F.lit(", priority "),
                                   F.col("o_orderpriority")),
                          None, F.concat(F.lit("sales@"), F.lower(F.col("o_orderpriority"))),
                          F.col("o_orderkey"))),
        lines.select(*_entity("lineitem", line_key(),
                              F.concat(F.lit("Order line, "), F.col("n_rows").cast("string"), F.lit(" row(s)")),
                              None, None, F.col("l_orderkey"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def incidents(t: dict[str, DataFrame], lines: DataFrame | None = None) -> DataFrame:
    """One incident per distinct line item; the symptom follows its largest return flag."""
    lines = lines if lines is not None else line_groups(t)
    sym = F.lit(None).cast("string")
    for k in sorted(SYMPTOMS, reverse=True):
        sym = F.when(F.col("flag") == k, F.lit(SYMPTOMS[k])).otherwise(sym)
    return (lines
            .select(F.concat(F.lit("L"), line_key()).alias("incident_id"), sym.alias("symptom"),
                    node_urn("lineitem", line_key()).alias("affected_urn")))


def incident_days(t: dict[str, DataFrame]) -> DataFrame:
    """``(incident_id, day)``: each line item's incident is reported on its latest ship date."""
    return t["lineitem"].groupBy("l_orderkey", "l_linenumber").agg(F.max(F.to_date("l_shipdate")).alias("day")).select(
        F.concat(F.lit("L"), line_key()).alias("incident_id"), "day")


def table_urn(name: Column) -> Column:
    """The asset of a whole table, by its name."""
    platform = F.lit(None).cast("string")
    for k, v in PLATFORM.items():
        platform = F.when(name == k, F.lit(v)).otherwise(platform)
    return dataset_urn(platform, name)


def table_edges(row_edges: DataFrame) -> DataFrame:
    """The lineage between whole tables: the distinct table pairs of the row-level edges."""
    name = lambda c: table_urn(F.regexp_extract(c, r"dataPlatform:[^,]+,([a-z]+)\.", 1))
    return row_edges.select(name("upstream").alias("upstream"), name("downstream").alias("downstream")).distinct()


def region_incidents(t: dict[str, DataFrame]) -> DataFrame:
    """One incident per region (a hub start: its downstream reaches a fifth of all nodes)."""
    return t["region"].select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("incident_id"),
                              F.lit("every downstream number looks frozen").alias("symptom"),
                              node_urn("region", F.col("r_regionkey")).alias("affected_urn"))


def build(spark: SparkSession, sf_dir: str) -> Catalog:
    t = read_tables(spark, sf_dir)
    lines = line_groups(t)
    return Catalog(edges=edges(t, lines), entities=entities(t, lines), incidents=incidents(t, lines))
