"""Catalog tables and readers.

A catalog is a set of DataFrames: ``edges(upstream, downstream)``, ``entities``
(schema ``tracehound.schemas.ENTITIES``), ``tags``, ``entity_tags`` and
``incidents``. Readers decode the catalog service's JSON answers with explicit
schemas; nothing is inferred.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.evidence import normalise_entity, raw_tag_urns
from ..functions.urn import strip_ws


@dataclass(frozen=True)
class Catalog:
    edges: DataFrame
    entities: DataFrame
    incidents: DataFrame | None = None
    tags: DataFrame | None = None
    entity_tags: DataFrame | None = None
    signals: DataFrame | None = None
    edges_distinct: bool = False   # True when ``edges`` is already a set (skips a shuffle)

    def with_(self, **kw) -> "Catalog":
        return replace(self, **kw)


def _nonempty(c):
    return c.isNotNull() & (c != "")


def clean_edges(edges: DataFrame) -> DataFrame:
    """F1 + U3: drop edges with a missing end; edges are a set."""
    return (edges.select(F.col("upstream").cast("string"), F.col("downstream").cast("string"))
            .where(_nonempty(F.col("upstream")) & _nonempty(F.col("downstream")))
            .dropDuplicates(["upstream", "downstream"]))


def read_catalog(spark: SparkSession, path: str) -> Catalog:
    """Read a catalog written by :func:`write_catalog` (parquet per table)."""
    def opt(name, schema):
        p = os.path.join(path, name)
        try:
            return spark.read.schema(schema).parquet(p)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None  # table not written: absent, not empty
    return Catalog(
        edges=spark.read.schema(schemas.EDGES).parquet(os.path.join(path, "edges")),
        entities=spark.read.schema(schemas.ENTITIES).parquet(os.path.join(path, "entities")),
        incidents=opt("incidents", schemas.INCIDENTS),
        tags=opt("tags", schemas.TAGS),
        entity_tags=opt("entity_tags", schemas.ENTITY_TAGS),
        signals=opt("signals", schemas.SIGNALS),
    )


def write_catalog(cat: Catalog, path: str, mode: str = "errorifexists") -> None:
    for name in ("edges", "entities", "incidents", "tags", "entity_tags", "signals"):
        df = getattr(cat, name)
        if df is not None:
            df.write.mode(mode).parquet(os.path.join(path, name))


# ---- S2, S3: entity and lineage answers -------------------------------------------

def _body(text, schema):
    """The JSON document that is the whole of ``text``, as ``body``; :func:`_bad` tells whether it isn't
    one. It is parsed as the first field of an object with a corrupt-record column: cut off text, text after the
    document and another kind of document make that record corrupt, or it ends before its last
    field (a brace too many; the parser passes over what follows a document)."""
    checked = schemas.T.StructType([schemas.T.StructField("body", schema), schemas.T.StructField("_end_of_answer", schemas.B),
                                    schemas.T.StructField("_corrupt", schemas.S)])
    return F.from_json(F.concat(F.lit('{"body":'), text, F.lit(',"_end_of_answer":true}')), checked,
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})


def _bad(doc: str):
    return F.col(doc)["_corrupt"].isNotNull() | F.col(doc)["_end_of_answer"].isNull()


def decode_answers(answers: DataFrame, kind: str = "entities", text_col: str = "text", keep=()) -> DataFrame:
    """S2, S3, S4 and P10 in one pass: JSON answers of ``kind`` "entities" (a list, or
    {"entities": [...]}), "upstreams" or "downstreams" -> a row per entity with the columns
    ``keep``, the normalised entity, its ``tag_urns`` and ``reject``.

    ``reject`` is null on entity rows. An answer that can't be read is a row of its own:
    "malformed" (not exactly one document of the kind) or "empty" (null or blank), so that it is
    never taken for "no entities" or "no lineage". Only the wanted direction's block is used
    (SURVEY 2.12 #3); entities without an URN are dropped (F1)."""
    # text and document are columns of a step of their own, so that each answer is parsed once
    rows = answers.select(*keep, strip_ws(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    t = F.col("_text")
    if kind == "entities":
        listed = t.startswith("[")
        rows = rows.select(*keep, "_text", F.when(listed, _body(t, schemas.T.ArrayType(schemas.RAW_ENTITY))).alias("_many"),
                           F.when(~listed, _body(t, schemas.RAW_ENTITY_LIST)).alias("_one"))
        found = F.when(listed, F.col("_many")["body"]).otherwise(F.col("_one")["body"]["entities"])
        bad = F.when(listed, _bad("_many")).otherwise(_bad("_one"))
    else:
        rows = rows.select(*keep, "_text", _body(t, schemas.RAW_LINEAGE).alias("_doc"))
        found, bad = F.transform(F.col("_doc")["body"][kind]["searchResults"], lambda r: r["entity"]), _bad("_doc")
    reject = F.when(t == "", "empty").when(bad, "malformed")
    rows = rows.select(*keep, reject.alias("reject"), found.alias("_found"))
    good = F.filter(F.coalesce("_found", F.array().cast(schemas.T.ArrayType(schemas.RAW_ENTITY))), lambda e: _nonempty(e["urn"]))
    rows = rows.select(*keep, "reject", F.explode_outer(F.when(F.col("reject").isNull(), good)).alias("e"))
    rows = rows.where(F.col("e").isNotNull() | F.col("reject").isNotNull())
    return rows.select(*keep, "reject", *normalise_entity("e"), raw_tag_urns("e").alias("tag_urns")).withColumn(
        "urn", F.when(F.col("reject").isNull(), F.col("urn")))


def decode_lineage(answers: DataFrame, upstream: bool = True, text_col: str = "text",
                   keep=("start_urn",)) -> DataFrame:
    """S3: one JSON lineage answer per row -> one row per reached entity (normalised): the good
    rows of :func:`decode_answers`."""
    keep_cols = [c for c in keep if c in answers.columns]
    rows = decode_answers(answers, "upstreams" if upstream else "downstreams", text_col, keep_cols)
    return rows.where(F.col("reject").isNull()).drop("reject", "tag_urns")


def decode_entities(answers: DataFrame, text_col: str = "text") -> DataFrame:
    """JSON entity answers -> normalised entities with their tags: the good rows of
    :func:`decode_answers`."""
    return decode_answers(answers, "entities", text_col).where(F.col("reject").isNull()).drop("reject")


def malformed_answers(answers: DataFrame, text_col: str = "text") -> DataFrame:
    """Answers with a text that is not JSON (for instance cut off): to be asked again, not to
    be read as "no lineage" or "no entities"."""
    t = F.trim(F.col(text_col))
    return answers.where((t != "") & F.try_parse_json(t).isNull())


def entity_tags_from_entities(decoded: DataFrame) -> DataFrame:
    """Nested tag lists -> the entity_tags set."""
    return (decoded.select(F.col("urn").alias("entity_urn"), F.explode("tag_urns").alias("tag_urn"))
            .where(_nonempty(F.col("tag_urn"))).dropDuplicates())


def lookup_entities(entities: DataFrame, urns: DataFrame) -> DataFrame:
    """S2 by key: entities for the given URNs (dedup keys first, one batched join)."""
    keys = urns.select("urn").where(_nonempty(F.col("urn"))).distinct()
    return entities.join(keys, "urn", "left_semi")


# ---- S8: incident intake -----------------------------------------------------------

def read_incidents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schemas.INCIDENTS)
    return reader.format(fmt).load(path)


# ---- S12: keyword search ---------------------------------------------------------------

def search_entities(entities: DataFrame, query: str, text_cols=("name", "description")) -> DataFrame:
    """Case-insensitive substring search over name and description (filter only; the
    service's ranking is unknown)."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text_cols]))
    return entities.where(hay.contains(query.lower()))
