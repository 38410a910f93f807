"""Small fixtures (FIXTURES.md F1-F6). Test-only: no registered query runs on these."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracehound import schemas
from tracehound.sources.catalog import Catalog


SF_SMALL = "/root/testdata/sf0.001"


def ds(platform: str, name: str) -> str:
    return f"urn:li:dataset:(urn:li:dataPlatform:{platform},{name},PROD)"


# three chains, each with one note at its head that carries the signal.
F1_ASSETS = [
    # chain, platform, name, description, properties
    ("A", "bigquery", "lake.intake.parcel_scans", "Hand scanner events from all depots.",
     {"owner": "uma@intake", "run_status": "success",
      "last_run_note": "3 of 8 depots did not upload: fewer rows than on any Monday, backfill not started"}),
    ("A", "dbt", "wh.clean.scans", "Scans without test parcels.", {"owner": "lin@warehouse", "tests": "passed"}),
    ("A", "dbt", "wh.agg.daily_parcels", "Parcels by depot and day.", {"owner": "lin@warehouse", "tests": "passed"}),
    ("A", "looker", "bi.depot_board", "Wall board of the depots.", {"owner": "kai@ops"}),
    ("B", "bigquery", "lake.intake.members", "Member list, sent by the club office.",
     {"owner": "uma@intake", "run_status": "success", "last_run_note": "file version 7: phone_no renamed to phone"}),
    ("B", "dbt", "wh.clean.members", "Members with typed fields.", {"owner": "lin@warehouse"}),
    ("B", "dbt", "wh.agg.member_cards", "One card per member.", {"owner": "lin@warehouse", "tests": "passed"}),
    ("B", "looker", "bi.member_desk", "Desk view of a member.", {"owner": "noor@desk"}),
    ("C", "bigquery", "lake.ref.fuel_prices", "Pump prices of the region.",
     {"owner": "sol@reference", "last_run_note": "price feed is down since the third, the job wrote no new rows"}),
    ("C", "dbt", "wh.agg.trip_costs", "Cost of each trip.", {"owner": "lin@warehouse", "tests": "passed"}),
    ("C", "looker", "bi.cost_chart", "Costs by week.", {"owner": "kai@ops"}),
]

F1_INCIDENTS = [
    ("A", "parcels on the depot board show a drop since noon", ds("looker", "bi.depot_board"), "intake.parcel_scans"),
    ("B", "phone is blank for most members at the desk", ds("looker", "bi.member_desk"), "intake.members"),
    ("C", "the cost chart is stuck at last week", ds("looker", "bi.cost_chart"), "fuel_prices"),
]

EXPECTED_SUSPECTS = {
    "A": ["lake.intake.parcel_scans", "wh.clean.scans", "wh.agg.daily_parcels"],
    "B": ["lake.intake.members", "wh.clean.members", "wh.agg.member_cards"],
    "C": ["lake.ref.fuel_prices", "wh.agg.trip_costs"],
}


def f1_entity_rows():
    return [(ds(p, n), n, p, d, [], [], props) for _, p, n, d, props in F1_ASSETS]


def f1_edge_rows():
    rows = []
    for chain in "ABC":
        urns = [ds(p, n) for c, p, n, _, _ in F1_ASSETS if c == chain]
        rows += list(zip(urns, urns[1:]))
    return rows


def f1_catalog(spark: SparkSession) -> Catalog:
    ents = spark.createDataFrame(f1_entity_rows(), schemas.ENTITIES)
    edges = spark.createDataFrame(f1_edge_rows(), schemas.EDGES)
    inc = spark.createDataFrame([r[:3] for r in F1_INCIDENTS], schemas.INCIDENTS)
    return Catalog(edges=edges, entities=ents, incidents=inc)


def f1_expected(spark: SparkSession):
    return spark.createDataFrame([(r[0], r[3]) for r in F1_INCIDENTS], "incident_id string, expected_root string")


def edges_df(spark, pairs):
    return spark.createDataFrame(pairs, schemas.EDGES)


def starts_df(spark, rows):
    return spark.createDataFrame(rows, "incident_id string, urn string").select(
        "incident_id", F.col("urn"))
