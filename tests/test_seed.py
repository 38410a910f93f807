"""Seed writes as set operations (S5) and catalog search/lookup."""

from tracehound.sources.catalog import lookup_entities, search_entities
from tracehound.sources.seed import upsert_entities


def test_upsert_keeps_latest_version(spark):
    cur = spark.createDataFrame([("u1", "a", "old", 1), ("u2", "b", "keep", 1)],
                                "urn string, name string, description string, version int")
    upd = spark.createDataFrame([("bigquery", "a", "new", 2), ("dbt", "c", "added", 1)],
                                "platform string, name string, description string, version int")
    upd = upd.selectExpr("platform", "name", "description", "version",
                         "CASE WHEN name = 'a' THEN 'u1' END AS urn")
    out = {r.urn: r.description for r in upsert_entities(cur, upd).collect()}
    assert out["u1"] == "new" and out["u2"] == "keep"
    assert out["urn:li:dataset:(urn:li:dataPlatform:dbt,c,PROD)"] == "added"
    assert len(out) == 3


def test_search_and_lookup(spark):
    ents = spark.createDataFrame([("u1", "Orders", "Raw ORDERS feed"), ("u2", "x", None), ("u3", None, "orders mart")],
                                 "urn string, name string, description string")
    assert sorted(r.urn for r in search_entities(ents, "orders").collect()) == ["u1", "u3"]
    keys = spark.createDataFrame([("u2",), ("u2",), ("",), ("zz",)], "urn string")
    assert [r.urn for r in lookup_entities(ents, keys).collect()] == ["u2"]


def test_tasks_take_bounded_shares(spark):
    """what a task scans, and what one gets after a shuffle, is bounded whatever the input's size."""
    from tracehound.session import configure
    configure(spark)
    jconf = spark._jsparkSession.sessionState().conf()
    assert jconf.filesMaxPartitionBytes() <= 16 << 20
    assert jconf.getConfString("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"
