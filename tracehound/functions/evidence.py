"""Evidence projections (P4-P15): raw entity -> evidence columns -> summary text.

Every function returns a Column built from built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urn import urn_name


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


# ---- raw entity struct -> normalised columns (P4-P9) ------------------------

def raw_name(e="e") -> Column:
    """Entity name, then properties.name, then the URN-derived name."""
    e = _c(e)
    return F.coalesce(_blank_to_null(e["name"]), _blank_to_null(e["properties"]["name"]),
                      urn_name(F.coalesce(e["urn"], F.lit(""))))


def raw_description(e="e") -> Column:
    """P5: edited description over the ingested one."""
    e = _c(e)
    return F.coalesce(_blank_to_null(e["editableProperties"]["description"]),
                      e["properties"]["description"])


def raw_owners(e="e") -> Column:
    """Owner URN per item (owner.urn, else ownerUrn); empty dropped, duplicates kept."""
    e = _c(e)
    owners = F.coalesce(e["ownership"]["owners"], F.array())
    picked = F.transform(owners, lambda o: F.coalesce(_blank_to_null(o["owner"]["urn"]),
                                                      _blank_to_null(o["ownerUrn"])))
    return F.filter(picked, lambda x: x.isNotNull())


def raw_schema_fields(e="e") -> Column:
    """Field paths of schemaMetadata, else of schema; empty paths dropped."""
    e = _c(e)
    fields = F.coalesce(e["schemaMetadata"]["fields"], e["schema"]["fields"], F.array())
    paths = F.transform(fields, lambda f: f["fieldPath"])
    return F.filter(paths, lambda x: x.isNotNull() & (x != ""))


def raw_custom_properties(e="e") -> Column:
    """key/value list -> map; empty keys dropped; a repeated key keeps its last value
    (needs spark.sql.mapKeyDedupPolicy=LAST_WIN, set by tracehound.session)."""
    e = _c(e)
    kvs = F.coalesce(e["properties"]["customProperties"], F.array())
    kept = F.filter(kvs, lambda kv: kv["key"].isNotNull() & (kv["key"] != ""))
    return F.map_from_entries(kept)


def raw_platform(e="e") -> Column:
    """Platform name."""
    return _c(e)["platform"]["name"]


def normalise_entity(e="e") -> list[Column]:
    """P10: the select list turning one raw entity struct into an evidence row."""
    e = _c(e)
    return [
        F.coalesce(e["urn"], F.lit("")).alias("urn"),
        raw_name(e).alias("name"),
        raw_platform(e).alias("platform"),
        raw_description(e).alias("description"),
        raw_owners(e).alias("owners"),
        raw_schema_fields(e).alias("schema_fields"),
        raw_custom_properties(e).alias("custom_properties"),
    ]


def raw_tag_urns(e="e") -> Column:
    """Tag URNs attached to a raw entity."""
    tags = F.coalesce(_c(e)["tags"]["tags"], F.array())
    return F.transform(tags, lambda t: t["tag"]["urn"])


# ---- evidence labels (P11-P15) -----------------------------------------------

def owner_label(owners="owners", props="custom_properties") -> Column:
    """Owners joined, else the 'owner' property, else 'unknown'."""
    return F.coalesce(_blank_to_null(F.array_join(F.coalesce(_c(owners), F.array()), ", ")),
                      _blank_to_null(F.try_element_at(_c(props), F.lit("owner"))),
                      F.lit("unknown"))


def cols_label(fields="schema_fields") -> Column:
    """P12: 'N cols' or 'schema n/a'."""
    n = F.size(F.coalesce(_c(fields), F.array()))
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(" cols"))).otherwise(F.lit("schema n/a"))


def props_label(props="custom_properties") -> Column:
    """P13: 'k=v' pairs in map order, two-space joined, the 'owner' key left out.
    A null value prints as 'None', as the reference's formatting does."""
    m = F.map_filter(F.coalesce(_c(props), F.create_map().cast("map<string,string>")),
                     lambda k, v: k != "owner")
    pairs = F.transform(F.map_entries(m), lambda kv: F.concat(
        kv["key"], F.lit("="), F.coalesce(kv["value"], F.lit("None"))))
    return F.array_join(pairs, "  ")


def node_summary(hop="hop", name="name", urn="urn", platform="platform", owners="owners",
                 fields="schema_fields", props="custom_properties") -> Column:
    """One summary line (plus a properties line when there are any)."""
    return F.concat(F.lit("["), _c(hop).cast("string"), F.lit(" hop] "), summary_of_node(name, urn, platform, owners, fields, props))


def summary_of_node(name="name", urn="urn", platform="platform", owners="owners", fields="schema_fields",
                    props="custom_properties") -> Column:
    """What P14 says of a node whatever its hop."""
    p = props_label(props)
    head = F.concat(
        F.coalesce(_blank_to_null(_c(name)), _c(urn)),
        F.lit(" ("), F.coalesce(_blank_to_null(_c(platform)), F.lit("?")), F.lit(", "),
        cols_label(fields), F.lit(", owner: "), owner_label(owners, props), F.lit(")"))
    return F.concat(head, F.when(p != "", F.concat(F.lit("\n    properties: "), p)).otherwise(F.lit("")))


def evidence_item(hop="hop", max_columns: int | None = None) -> Column:
    """P15 (one node): '- summary', urn, description, columns (W6: the first ``max_columns``
    if that is given, else all)."""
    return F.concat(F.lit("- ["), _c(hop).cast("string"), F.lit(" hop] "), item_of_node(max_columns=max_columns))


def item_of_node(name="name", urn="urn", platform="platform", description="description", owners="owners", fields="schema_fields",
                 props="custom_properties", max_columns: int | None = None) -> Column:
    """What P15 says of a node whatever its hop."""
    summary = summary_of_node(name, urn, platform, owners, fields, props)
    fields = F.coalesce(_c(fields), F.array())
    desc = _blank_to_null(_c(description))
    return F.concat(
        summary, F.lit("\n    urn: "), _c(urn),
        F.when(desc.isNotNull(), F.concat(F.lit("\n    description: "), desc)).otherwise(F.lit("")),
        F.when(F.size(fields) > 0, F.concat(F.lit("\n    columns: "),
                                             F.array_join(fields if max_columns is None else F.slice(fields, 1, max_columns), ", ")))
        .otherwise(F.lit("")))
