"""URN, evidence and text functions (P1-P21, S2-S4) on the FIXTURES F3-F5 cases."""

import json

import pytest
from pyspark.sql import functions as F

from tracehound.functions import evidence as EV
from tracehound.functions import text as TX
from tracehound.functions.urn import tag_short, urn_name, urn_platform, urn_tail
from tracehound.sources.catalog import decode_entities, decode_lineage, entity_tags_from_entities, malformed_answers

F5 = [
    ("urn:li:dataset:(urn:li:dataPlatform:bigquery,prod.raw.orders,PROD)", "prod.raw.orders", "bigquery"),
    ("urn:li:tag:X", "urn:li:tag:X", ""),
    ("urn:li:dashboard:(looker,bi.x)", "looker", ""),
    ("urn:li:schemaField:(urn:li:dataset:(urn:li:dataPlatform:dbt,a.b,PROD),email)", "PROD)", "dbt"),
    ("urn:li:dataset:(urn:li:dataPlatform:s3,bucket/a,b.csv,PROD)", "b.csv", "s3"),
]


def test_urn_functions(spark):
    df = spark.createDataFrame([(u,) for u, _, _ in F5], "urn string")
    got = {r.urn: (r.name, r.platform) for r in df.select("urn", urn_name("urn").alias("name"),
                                                          urn_platform("urn").alias("platform")).collect()}
    for u, name, plat in F5:
        assert got[u] == (name, plat), u


def test_urn_tail_and_tag_short(spark):
    r = spark.createDataFrame([("urn:li:dataset:(urn:li:dataPlatform:looker,bi.x,PROD)", "urn:li:tag:QUARANTINE_INCIDENT")],
                              "u string, t string").select(urn_tail("u").alias("tail"), tag_short("t").alias("s")).first()
    assert r.tail == "urn:li:dataPlatform:looker,bi.x,PROD"
    assert r.s == "QUARANTINE_INCIDENT"


def test_name_strips_whitespace(spark):
    r = spark.createDataFrame([("urn:li:dataset:(urn:li:dataPlatform:x,\t a.b \n,PROD)",)], "u string") \
        .select(urn_name("u").alias("n")).first()
    assert r.n == "a.b"


RAW = [
    {"urn": "u:all", "name": "", "platform": {"name": "dbt"},
     "properties": {"name": "from_props", "description": "ingested",
                    "customProperties": [{"key": "a", "value": "1"}, {"key": "", "value": "x"},
                                         {"key": "b", "value": "2"}, {"key": "a", "value": "3"}]},
     "editableProperties": {"description": "edited"},
     "ownership": {"owners": [{"owner": {"urn": "urn:li:corpuser:o1"}}, {"ownerUrn": "urn:li:corpuser:o2"},
                              {"owner": {}}, {"owner": {"urn": "urn:li:corpuser:o1"}}]},
     "schema": {"fields": [{"fieldPath": f"c{i}"} for i in range(25)] + [{"fieldPath": ""}]},
     "tags": {"tags": [{"tag": {"urn": "urn:li:tag:T"}}]}},
    {"urn": "urn:li:dataset:(urn:li:dataPlatform:bq,only.urn,PROD)"},
    {"urn": "u:ed", "properties": {"description": "ingested"}, "editableProperties": {"description": ""},
     "schemaMetadata": {"fields": [{"fieldPath": "x"}]}},
]


def test_decode_entities_forms(spark):
    texts = [json.dumps(RAW), json.dumps({"entities": RAW[:1]}), "not json", "[]"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = decode_entities(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r.urn, []).append(r)
    assert len(by["u:all"]) == 2 and len(rows) == 4
    a = by["u:all"][0]
    assert a.name == "from_props"                      # P4: empty name falls back
    assert a.description == "edited"                   # P5
    assert a.owners == ["urn:li:corpuser:o1", "urn:li:corpuser:o2", "urn:li:corpuser:o1"]  # P6
    assert len(a.schema_fields) == 25                  # P7: schema fallback, empty path dropped
    assert list(a.custom_properties.items()) == [("a", "3"), ("b", "2")]  # P8: last wins, order kept
    assert a.platform == "dbt"
    o = by["urn:li:dataset:(urn:li:dataPlatform:bq,only.urn,PROD)"][0]
    assert o.name == "only.urn" and o.owners == [] and o.schema_fields == []
    e = by["u:ed"][0]
    assert e.description == "ingested" and e.schema_fields == ["x"]
    tags = entity_tags_from_entities(decode_entities(df)).collect()
    assert {(t.entity_urn, t.tag_urn) for t in tags} == {("u:all", "urn:li:tag:T")}


def test_decode_lineage_direction_and_empty_urns(spark):
    ans = {"upstreams": {"searchResults": [{"entity": {"urn": "a"}}, {"entity": {"urn": ""}}, {"entity": {}},
                                           {"entity": {"urn": "b", "name": "B"}}]},
           "downstreams": {"searchResults": [{"entity": {"urn": "z"}}]}}
    df = spark.createDataFrame([("s", json.dumps(ans)), ("t", "garbage")], "start_urn string, text string")
    assert [r.start_urn for r in malformed_answers(df).collect()] == ["t"]  # told apart from "no lineage"
    up = decode_lineage(df, upstream=True).collect()
    assert sorted(r.urn for r in up) == ["a", "b"]
    down = decode_lineage(df, upstream=False).collect()
    assert [r.urn for r in down] == ["z"]


def test_decode_answers_keeps_rejects_beside_the_rows(spark):
    from tracehound.sources.catalog import decode_answers
    texts = {"ok": json.dumps(RAW), "wrapped": json.dumps({"entities": RAW[:1]}), "none": "[]", "also_none": "{}", "blank": "  ", "null": None,
             "prose": "not json", "cut": json.dumps(RAW)[:-3], "trailing": json.dumps(RAW) + " ok?", "two": "[] []", "number": "7"}
    df = spark.createDataFrame(list(texts.items()), "answer_id string, text string")
    rows = decode_answers(df, keep=("answer_id",)).collect()
    assert {r.answer_id: r.reject for r in rows if r.reject} == {
        "blank": "empty", "null": "empty", "prose": "malformed", "cut": "malformed", "trailing": "malformed", "two": "malformed", "number": "malformed"}
    good = [r for r in rows if r.reject is None]
    assert {r.answer_id for r in good} == {"ok", "wrapped"} and all(r.urn for r in good)
    lin = spark.createDataFrame([("s", json.dumps({"upstreams": {"searchResults": [{"entity": {"urn": "a"}}, {"entity": {}}]}})), ("z", "{}"),
                                 ("d", json.dumps({"downstreams": {"searchResults": [{"entity": {"urn": "b"}}]}})), ("t", "{}}"), ("l", "[1]")],
                                "start_urn string, text string")
    got = {(r.start_urn, r.urn, r.reject) for r in decode_answers(lin, "upstreams", keep=("start_urn",)).collect()}
    assert got == {("s", "a", None), ("t", None, "malformed"), ("l", None, "malformed")}


def test_every_answer_is_parsed_once(spark):
    from tracehound.sources.catalog import decode_answers
    df = spark.range(3).selectExpr("cast(id as string) answer_id", "concat('[', id, ']') text")
    plan = lambda kind: decode_answers(df, kind, keep=("answer_id",))._jdf.queryExecution().executedPlan().toString()
    assert plan("upstreams").count("from_json(") == 1
    assert plan("entities").count("from_json(") == 2   # one of a list, one of an object; a row has either


def test_labels(spark):
    df = spark.createDataFrame(
        [("u1", "n", "p", ["o1", "o2"], ["c1"], [("owner", "x"), ("k", "v"), ("z", None)]),
         ("u2", None, None, [], [], [("owner", "po")]),
         ("u3", "", None, [], [], [])],
        "urn string, name string, platform string, owners array<string>, schema_fields array<string>, "
        "kv array<struct<key:string,value:string>>").withColumn(
        "custom_properties", F.map_from_entries("kv"))
    r = {x.urn: x for x in df.select("urn", EV.owner_label().alias("o"), EV.cols_label().alias("c"),
                                     EV.props_label().alias("p"),
                                     EV.node_summary(hop=F.lit(1)).alias("s")).collect()}
    assert r["u1"].o == "o1, o2" and r["u2"].o == "po" and r["u3"].o == "unknown"
    assert r["u1"].c == "1 cols" and r["u2"].c == "schema n/a"
    assert r["u1"].p == "k=v  z=None" and r["u2"].p == ""
    assert r["u1"].s == "[1 hop] n (p, 1 cols, owner: o1, o2)\n    properties: k=v  z=None"
    assert r["u3"].s == "[1 hop] u3 (?, schema n/a, owner: unknown)"


F4 = [
    ("valid", '{"summary": "s", "suspects": [{"urn": "u", "confidence": "High"}], "missing_evidence": null}', True, "s"),
    ("fence_json", '```json\n{"summary": "f"}\n```', True, "f"),
    ("fence_plain", '```\n{"summary": "g"}\n```', True, "g"),
    ("fence_after_prose", 'Here:\n```json\n{"summary": "h"}\n```', False, None),
    ("not_json", "just words", False, "just words"),
    ("trailing", '{"summary": "t"} and more', False, '{"summary": "t"} and more'),
    ("empty", "", False, ""),
    ("list", '[{"summary": "x"}]', False, '[{"summary": "x"}]'),
]


@pytest.mark.parametrize("case,text,valid,summary", F4)
def test_parse_answer(spark, case, text, valid, summary):
    r = spark.createDataFrame([(text,)], "t string").select(
        TX.answer_is_valid("t").alias("ok"), TX.parse_answer("t").alias("p")).first()
    assert r.ok == valid, case
    if summary is not None:
        assert r.p.summary == summary, case
    if not valid:
        assert r.p.suspects == [] and r.p.missing_evidence == TX.FALLBACK_MISSING


def test_icons_owner_status(spark):
    df = spark.createDataFrame([("High", None, True), ("medium", "", False), ("LOW", "x", None), ("weird", "y", True)],
                               "c string, o string, a boolean")
    rows = df.select(TX.conf_icon("c").alias("i"), TX.owner_display("o").alias("w"),
                     TX.action_status("a").alias("s")).collect()
    assert [r.i for r in rows] == ["[!!!]", "[!! ]", "[!  ]", "•"]
    assert [r.w for r in rows] == ["owner unknown", "owner unknown", "x", "y"]
    assert [r.s for r in rows] == ["[OK] APPLIED", "[..] attempted", "[..] attempted", "[OK] APPLIED"]


def test_intermediates_are_written_with_zstd(spark):
    from tracehound.session import materialize
    df = materialize(spark.range(3), "zstd-test")
    assert df.inputFiles() and all(f.endswith(".zstd.parquet") for f in df.inputFiles()) and df.count() == 3


def test_an_answer_is_stripped_and_parsed_once_a_row(spark):
    """F7's suspects come from one parse a row, not one for each mention of it or a filter on it."""
    good = '{"summary": "s", "suspects": [{"urn": "u", "confidence": "high"}, {"urn": "v", "confidence": "low"}], "missing_evidence": null}'
    texts = [f"```json\n{good}\n```", good, f" {good}\n", f"{good} and so on", "```", "[1]", "prose", "", None, '{"summary": "cut']
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = TX.parsed_answers(df, "text")
    assert got.columns == ["k", "text", "parsed"]
    assert sorted(got.select("k", "parsed").collect()) == sorted(df.select("k", TX.parse_answer(F.col("text")).alias("parsed")).collect())
    named = got.select("k", F.posexplode_outer(F.col("parsed")["suspects"]).alias("pos", "s")).where("pos IS NOT NULL")
    assert sorted((r.k, r.pos, r.s.urn) for r in named.collect()) == [(k, i, u) for k in range(3) for i, u in enumerate("uv")]
    assert named._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_labels_are_made_once_an_entity(spark):
    """P11, P14 and P15 of a node are found before it meets the keys that reach it; unknown nodes
    and entities that come twice give what they gave."""
    from tracehound import schemas
    from tracehound.functions.evidence import node_summary, owner_label
    from tracehound.operators.enrich import enrich, enrich_made, enriched_lines, evidence_lines, summaries
    urn = lambda n: f"urn:li:dataset:(urn:li:dataPlatform:dbt,{n},PROD)"
    rows = [(urn("a"), "", None, None, None, None, None), (urn("b"), "bee", "dbt", "a thing", ["o1", "o2"], ["x", "y", "z"], {"owner": "me", "k": "v"}),
            (urn("b"), "bee2", "dbt", "", [], [], {"owner": "you"})]
    ents = spark.createDataFrame(rows, schemas.ENTITIES)
    nodes = spark.createDataFrame([(f"i{i}", u, i) for i in range(3) for u in (urn("a"), urn("b"), urn("none"), "odd", None)] + [("j", urn("b"), None)],
                                  "incident_id string, urn string, hop int")
    ev = enrich(nodes, ents)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    got = summaries(nodes, ents, F.least("hop", F.lit(1)))
    assert same(got, ev.withColumn("summary", node_summary(hop=F.least("hop", F.lit(1)))))
    for n in (None, 2):
        assert same(enriched_lines(nodes, ents, max_columns=n), evidence_lines(ev, max_columns=n))
    owners = enrich_made(nodes, ents, lambda c: {x: c[x] for x in ("name", "platform", "description")} | {"owner": owner_label(c["owners"], c["custom_properties"])})
    assert same(owners, ev.withColumn("owner", owner_label()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "map_filter" in plan.split("Join LeftOuter")[1]
