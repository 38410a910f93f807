"""Explicit schemas (never inferred) for the catalog tables and raw answers."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, B, D = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType()


def _arr(t):
    return T.ArrayType(t, True)


ENTITIES = T.StructType([
    T.StructField("urn", S, False),
    T.StructField("name", S, True),
    T.StructField("platform", S, True),
    T.StructField("description", S, True),
    T.StructField("owners", _arr(S), True),
    T.StructField("schema_fields", _arr(S), True),
    T.StructField("custom_properties", T.MapType(S, S, True), True),
])

EDGES = T.StructType([
    T.StructField("upstream", S, False),
    T.StructField("downstream", S, False),
])

INCIDENTS = T.StructType([
    T.StructField("incident_id", S, False),
    T.StructField("symptom", S, True),
    T.StructField("affected_urn", S, True),
])

TAGS = T.StructType([
    T.StructField("tag_urn", S, False),
    T.StructField("name", S, True),
    T.StructField("description", S, True),
])

ENTITY_TAGS = T.StructType([
    T.StructField("entity_urn", S, False),
    T.StructField("tag_urn", S, False),
])

SIGNALS = T.StructType([
    T.StructField("urn", S, False),
    T.StructField("as_of", T.DateType(), True),
    T.StructField("class", S, False),
    T.StructField("measure", D, True),
    T.StructField("threshold", D, True),
    T.StructField("source", S, False),
    T.StructField("detail", S, True),
])

# Raw catalog entity as answered by the catalog service.
_KV = T.StructType([T.StructField("key", S), T.StructField("value", S)])
_FIELDS = T.StructType([T.StructField("fields", _arr(T.StructType([T.StructField("fieldPath", S)])))])
RAW_ENTITY = T.StructType([
    T.StructField("urn", S),
    T.StructField("name", S),
    T.StructField("platform", T.StructType([T.StructField("name", S)])),
    T.StructField("properties", T.StructType([
        T.StructField("name", S),
        T.StructField("description", S),
        T.StructField("customProperties", _arr(_KV)),
    ])),
    T.StructField("editableProperties", T.StructType([T.StructField("description", S)])),
    T.StructField("ownership", T.StructType([T.StructField("owners", _arr(T.StructType([
        T.StructField("owner", T.StructType([T.StructField("urn", S)])),
        T.StructField("ownerUrn", S),
    ])))])),
    T.StructField("schemaMetadata", _FIELDS),
    T.StructField("schema", _FIELDS),
    T.StructField("tags", T.StructType([T.StructField("tags", _arr(T.StructType([
        T.StructField("tag", T.StructType([T.StructField("urn", S)])),
    ])))])),
])

# Lineage answer: {"upstreams"|"downstreams": {"searchResults": [{"entity": {...}}]}}
_BLOCK = T.StructType([T.StructField("searchResults", _arr(T.StructType([
    T.StructField("entity", RAW_ENTITY)])))])
RAW_LINEAGE = T.StructType([
    T.StructField("upstreams", _BLOCK),
    T.StructField("downstreams", _BLOCK),
])

# Entity answer in its list-wrapped form: {"entities": [...]}
RAW_ENTITY_LIST = T.StructType([T.StructField("entities", _arr(RAW_ENTITY))])

# Reasoning answer (the report contract, SURVEY 1.2).
SUSPECT = T.StructType([
    T.StructField("urn", S),
    T.StructField("why", S),
    T.StructField("check_next", S),
    T.StructField("owner", S),
    T.StructField("confidence", S),
])
ANSWER = T.StructType([
    T.StructField("summary", S),
    T.StructField("suspects", _arr(SUSPECT)),
    T.StructField("missing_evidence", S),
])
