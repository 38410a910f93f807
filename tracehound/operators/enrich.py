"""Enrichment of walked nodes with catalog metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import evidence_item, item_of_node, node_summary, owner_label, summary_of_node
from ..functions.urn import urn_name

ENTITY_COLS = ["name", "platform", "description", "owners", "schema_fields", "custom_properties"]


def enrich(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """Nodes LEFT JOIN entities on ``urn``. A node the catalog does not know becomes a
    stub that has only its URN: name from the URN (P4/P1), empty owners/columns/properties.

    The join is on ``urn`` only, so a node shared by many incidents (a hub) is a hot key
    on the nodes side; AQE's skew-join rule splits that partition and replicates the one
    matching entity row."""
    e = entities.select("urn", *ENTITY_COLS)
    j = nodes.join(e, "urn", "left")
    return j.select(*[c for c in nodes.columns], *[c.alias(name) for name, c in _filled(F.col).items()])


def _filled(of) -> dict[str, Column]:
    """An entity's columns ``of(name)`` as J2 gives them, absent ones filled."""
    return {"name": F.coalesce(F.nullif(of("name"), F.lit("")), urn_name(F.col("urn"))),
            "platform": of("platform"), "description": of("description"),
            "owners": F.coalesce(of("owners"), F.array().cast("array<string>")),
            "schema_fields": F.coalesce(of("schema_fields"), F.array().cast("array<string>")),
            "custom_properties": F.coalesce(of("custom_properties"), F.create_map().cast("map<string,string>"))}


def enrich_made(nodes: DataFrame, entities: DataFrame, make) -> DataFrame:
    """J2 with the columns that ``make(columns of a node)`` gives by name. They tell of the node alone,
    so they are made once an entity, not once for each key that reaches it; a node that the catalog
    does not know gets its stub's."""
    types = {"owners": "array<string>", "schema_fields": "array<string>", "custom_properties": "map<string,string>"}
    made = entities.select("urn", F.lit(True).alias("_known"), *[c.alias(f"_{name}") for name, c in make(_filled(F.col)).items()])
    stub = make(_filled(lambda c: F.lit(None).cast(types.get(c, "string"))))
    return nodes.join(made, "urn", "left").select(*nodes.columns, *[F.when(F.col("_known"), F.col(f"_{name}")).otherwise(c).alias(name) for name, c in stub.items()])


def with_labels(ev: DataFrame, hop: str = "hop") -> DataFrame:
    """P11 + P14 + P15 (one node): owner label, summary line and evidence item."""
    return ev.select("*", owner_label().alias("owner"), node_summary(hop=hop).alias("summary"),
                     evidence_item(hop=hop).alias("evidence_item"))


def evidence_lines(ev: DataFrame, key: str = "incident_id", hop: str = "hop", max_columns: int | None = None) -> DataFrame:
    """The evidence of each key as rows ``(key, hop, urn, line)``; sorted by hop and URN they
    are its text. Rows, not one text per key, so that a key may reach any number of nodes."""
    return ev.select(key, hop, "urn", evidence_item(hop=hop, max_columns=max_columns).alias("line"))


def summaries(nodes: DataFrame, entities: DataFrame, hop: Column) -> DataFrame:
    """J2 + P14: the walked ``nodes`` with their ``summary`` lines."""
    ev = enrich_made(nodes, entities, lambda c: {"summary": summary_of_node(c["name"], "urn", c["platform"], c["owners"], c["schema_fields"], c["custom_properties"])})
    return ev.withColumn("summary", F.concat(F.lit("["), hop.cast("string"), F.lit(" hop] "), F.col("summary")))


def enriched_lines(nodes: DataFrame, entities: DataFrame, key: str = "incident_id", hop: str = "hop", max_columns: int | None = None) -> DataFrame:
    """J2 + P15: :func:`evidence_lines` of walked ``nodes``."""
    ev = enrich_made(nodes, entities, lambda c: {"line": item_of_node(c["name"], "urn", c["platform"], c["description"], c["owners"], c["schema_fields"],
                                                                      c["custom_properties"], max_columns)})
    return ev.select(key, hop, "urn", F.concat(F.lit("- ["), F.col(hop).cast("string"), F.lit(" hop] "), F.col("line")).alias("line"))


def evidence_count(nodes, key: str = "incident_id") -> DataFrame:
    """A1: evidence nodes per key, the symptom node included, of walked rows or of a walk's lists
    (:class:`closure.Reach`), whose lengths they are."""
    if not isinstance(nodes, DataFrame):
        return nodes.counts()
    return nodes.groupBy(key).agg(F.count(F.lit(1)).alias("evidence_nodes"))
