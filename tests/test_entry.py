"""Driver contract: entry() smoke run, and every oracle-backed query against DuckDB at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from fixtures import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "incident_id" in df.columns


def test_registry_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 58 and len(s) >= 58


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _rows(pdf):
    import pandas as pd

    def n(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, float):
            return round(v, 6)
        return v.item() if hasattr(v, "item") else v
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(n(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)), key=str)


FAST = ["walk_upstream", "walk_cyclic", "chain_edges", "urn_parse", "owner_label", "props_label", "props_map",
        "symptom_class", "signals", "volume_anomaly", "null_rate", "schema_diff", "freshness", "zero_row_days",
        "hop_volume", "signals_union", "search_entities", "evidence_block", "rank_suspects", "blast_radius",
        "walk_per_node_cap", "report_parse", "investigate", "report_text", "tags_verify", "writeback_proof", "lineage_dot", "blast_nodes", "report_json",
        "null_spikes", "column_diff", "zero_row_runs", "volume_regions", "first_drop", "check_results", "rank_fused", "drawing_lines",
        "answers_entities", "answers_lineage", "entity_lookup", "guarded_answers", "vocab_ensure", "upsert_entities",
        "scenario_score", "incident_stream"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dk = duck.execute(E.oracle_sql()[name]).df()
    assert _rows(sp) == _rows(dk)
