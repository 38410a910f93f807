"""Data checks (X1-X6) against pandas brute force on the sf0.001 driver tables."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixtures import SF_SMALL
from tracehound.operators import signals as X


@pytest.fixture(scope="module")
def events_pd():
    return pd.read_parquet(f"{SF_SMALL}/events.parquet")


def test_volume_anomaly(spark, events_pd):
    got = X.volume_anomaly(spark.read.parquet(f"{SF_SMALL}/events.parquet"), "ts", ["event_type"], 0.6).toPandas()
    e = events_pd.assign(day=events_pd.ts.dt.normalize())
    d = e.groupby(["event_type", "day"]).size().rename("n").reset_index()
    for _, r in got.iterrows():
        day = pd.Timestamp(r.day)
        prior = d[(d.event_type == r.event_type) & (d.day >= day - pd.Timedelta(days=7)) & (d.day < day)]
        if prior.empty:
            assert pd.isna(r.prior_avg)
        else:
            assert abs(prior.n.mean() - r.prior_avg) < 1e-9
            assert r.flagged == (r.n_rows / prior.n.mean() < 0.6)
    assert len(got) == len(d)


def test_null_rates_and_unpivot(spark):
    df = spark.createDataFrame([("2024-01-01 01:00:00", 1, None), ("2024-01-01 02:00:00", None, None),
                                ("2024-01-02 01:00:00", 3, "x")], "ts string, a int, b string") \
        .withColumn("ts", F.to_timestamp("ts"))
    got = {(str(r.day), r.column): (r.null_rate, r.delta) for r in X.null_rates(df, "ts", ["a", "b"]).collect()}
    assert got[("2024-01-01", "a")] == (0.5, None) and got[("2024-01-01", "b")] == (1.0, None)
    assert got[("2024-01-02", "a")] == (0.0, -0.5) and got[("2024-01-02", "b")] == (0.0, -1.0)


def test_schema_diff_and_key_drift(spark):
    before = spark.createDataFrame([("id", "bigint"), ("email", "string"), ("n", "int")], "column string, type string")
    after = spark.createDataFrame([("id", "bigint"), ("email_addr", "string"), ("m", "double")],
                                  "column string, type string")
    got = {(r.column, r.change, r.renamed_to) for r in X.schema_diff(before, after).collect()}
    assert ("email", "rename_candidate", "email_addr") in got
    assert ("m", "added", None) in got and ("n", "dropped", None) in got
    assert not any(c == "rename_candidate" and col == "n" for col, c, _ in got)  # types differ
    ev = spark.createDataFrame([("2024-01-01 00:00:00", '{"a":1}'), ("2024-01-02 00:00:00", '{"a":1,"b":2}'),
                                ("2024-01-03 00:00:00", '{"b":2}'), ("2024-01-05 00:00:00", '{"c":1}')],
                               "ts string, p string").withColumn("ts", F.to_timestamp("ts"))
    d = {(str(r.day), r.key, r.change) for r in X.json_key_drift(ev, "ts", "p").collect()}
    # 01-05 is compared with 01-03, the last day that has rows
    assert d == {("2024-01-02", "b", "added"), ("2024-01-03", "a", "dropped"), ("2024-01-05", "b", "dropped"), ("2024-01-05", "c", "added")}


def test_freshness_and_zero_days(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    op = pd.read_parquet(f"{SF_SMALL}/orders.parquet")
    f = X.freshness(o, "o_orderdate", ["o_custkey"], 365).toPandas().set_index("o_custkey")
    as_of = op.o_orderdate.max().normalize()
    last = op.groupby("o_custkey").o_orderdate.max().dt.normalize()
    lag = (as_of - last).dt.days
    assert (f.lag_days.sort_index() == lag.sort_index()).all()
    z = X.zero_row_days(o, "o_orderdate", ["o_orderpriority"]).toPandas()
    exp = 0
    for p, g in op.groupby("o_orderpriority"):
        days = set(g.o_orderdate.dt.normalize())
        exp += len(pd.date_range(min(days), as_of)) - len(days)
    assert len(z) == exp


def test_hop_volume(spark):
    m = spark.createDataFrame([("u", "2024-01-01", 10), ("d", "2024-01-01", 5), ("u", "2024-01-02", 4)],
                              "urn string, day string, n_rows long")
    e = spark.createDataFrame([("u", "d")], "upstream string, downstream string")
    got = {r.day: (r.up_rows, r.down_rows, r.ratio) for r in X.hop_volume(m, e).collect()}
    assert got == {"2024-01-01": (10, 5, 0.5), "2024-01-02": (4, 0, 0.0)}
    m = m.unionByName(spark.createDataFrame([("d", "2024-01-03", 7)], m.schema))   # a day that only the lower end has
    got = {r.day: (r.up_rows, r.down_rows, r.ratio) for r in X.hop_volume(m, e).collect()}
    assert got["2024-01-03"] == (0, 7, None) and len(got) == 3


def days(start, n):
    return [str(d.date()) for d in pd.date_range(start, periods=n)]


def test_null_spikes_flags_the_spike_only(spark):
    """A noisy column at 10 %, a clean one and one that is always null; spikes on two days, the second
    while the first is in the baseline; a small rise is none."""
    rows = []
    for k, d in enumerate(days("2024-03-01", 25)):
        for i in range(100):
            spike = k in (12, 15)
            rows.append((d, None if i < (60 if spike else 8 + k % 5) else 1, None if i < (30 if k == 15 else 1 if k == 20 else 0) else 1, None))
    df = spark.createDataFrame(rows, "ts string, noisy int, clean int, never int").withColumn("ts", F.to_timestamp("ts"))
    s = X.null_spikes(X.null_rates(df, "ts", ["noisy", "clean", "never"]))
    assert {(str(r.day), r.column) for r in s.where("spike").collect()} == {("2024-03-13", "noisy"), ("2024-03-16", "noisy"), ("2024-03-16", "clean")}
    first = s.where("column = 'clean'").orderBy("day").first()
    assert first.median is None and first.mad is None and not first.spike
    assert X.null_spikes(X.null_rates(df.limit(0), "ts", ["noisy"])).collect() == []


def test_schema_changes_match_one_to_one(spark):
    rows = [("t", s, c, "int") for s in ("2024-01-01",) for c in ("lat", "lon", "id")]
    rows += [("t", "2024-01-09", c, "int") for c in ("latitude", "longitude", "id")]           # after a gap of a week
    rows += [("t", "2024-01-10", c, t) for c, t in (("latitude", "int"), ("longitude", "int"), ("id", "string"), ("extra", "int"))]
    rows += [("u", "2024-01-09", "lat", "int")]                                                 # first snapshot: nothing to compare
    rows += [("v", "1", c, "int") for c in ("b_a", "b_b")] + [("v", "2", c, "int") for c in ("b_c", "zzzzzzzzzz")]
    df = spark.createDataFrame(rows + rows[:2], "table string, snapshot string, column string, type string")
    got = sorted((r.table, r.snapshot, r.prev_snapshot, r.change, r.column, r.type, r.renamed_to) for r in X.schema_changes(df, ["table"]).collect())
    assert got == sorted([
        ("t", "2024-01-09", "2024-01-01", "renamed", "lat", "int", "latitude"),
        ("t", "2024-01-09", "2024-01-01", "renamed", "lon", "int", "longitude"),
        ("t", "2024-01-10", "2024-01-09", "retyped", "id", "string", None),
        ("t", "2024-01-10", "2024-01-09", "added", "extra", "int", None),
        ("v", "2", "1", "renamed", "b_a", "int", "b_c"), ("v", "2", "1", "dropped", "b_b", "int", None),
        ("v", "2", "1", "added", "zzzzzzzzzz", "int", None)])


def test_schema_lists_are_taken_apart_only_where_they_differ(spark):
    """F32: as the row form, and equal lists are never made into rows."""
    rows = [("t", 1, [("a", "int"), ("b", "int")]), ("t", 2, [("b", "int"), ("a", "int")]), ("t", 3, [("b", "int"), ("a", "string")]),
            ("t", None, [("z", "int")]), (None, 1, [("a", "int")]), (None, 2, [("b", "int")]),
            ("u", 1, [("a", "int"), ("a", "string")]), ("u", 2, [("a", "string"), ("a", "int")]),     # a column twice
            ("v", 1, [(None, "int")]), ("v", 2, [(None, "int")]), ("w", 1, [("c", None)]), ("w", 2, [("c", None)])]
    df = spark.createDataFrame(rows, "table string, snapshot int, columns array<struct<column:string,type:string>>")
    key = lambda r: (r.table, r.snapshot, r.prev_snapshot, r.change, r.column, r.type, r.renamed_to)
    out = X.schema_list_changes(df, ["table"])
    got = sorted(map(key, out.collect()), key=str)
    assert got == sorted(map(key, X.schema_changes(df.select("table", "snapshot", F.inline("columns")), ["table"]).collect()), key=str)
    assert got == sorted([("t", 3, 2, "retyped", "a", "string", None),
                          ("u", 2, 1, "retyped", "a", "int", None), ("u", 2, 1, "retyped", "a", "string", None),
                          ("v", 2, 1, "added", None, "int", None), ("v", 2, 1, "dropped", None, "int", None),
                          ("w", 2, 1, "added", "c", None, None), ("w", 2, 1, "dropped", "c", None, None)], key=str)
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    for k, line in enumerate(plan):
        if "Generate inline" in line:
            assert "ShuffledHashJoin" in "".join(plan[k + 1:k + 4])


def test_zero_row_runs(spark):
    rows = [("a", d) for d in ("2024-01-01", "2024-01-02", "2024-01-06", "2024-01-06")] + [("b", "2024-01-10"), ("c", None)]
    df = spark.createDataFrame(rows, "feed string, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = sorted((r.feed, str(r.start), str(r.end), r.n_days, r.open) for r in X.zero_row_runs(df, "ts", ["feed"]).collect())
    assert got == [("a", "2024-01-03", "2024-01-05", 3, False), ("a", "2024-01-07", "2024-01-10", 4, True)]   # frozen until today
    later = X.zero_row_runs(df, "ts", ["feed"], as_of=F.lit("2024-01-12").cast("date"))
    assert {(r.feed, r.n_days) for r in later.where("open").collect()} == {("a", 6), ("b", 2)}


def test_first_drop_is_found_three_hops_up(spark):
    """src -> load -> clean -> mart -> board and src -> side -> mart; load loses rows on one day."""
    edges = spark.createDataFrame([("src", "load"), ("load", "clean"), ("clean", "mart"), ("mart", "board"), ("src", "side"), ("side", "mart")],
                                  "upstream string, downstream string")
    rows = []
    for k, d in enumerate(days("2024-01-01", 12)):
        lost = k == 9
        for urn, n in (("src", 1000), ("side", 100), ("load", 400 if lost else 1000), ("clean", 400 if lost else 1000),
                       ("mart", 100 if lost else 1000), ("board", 10 if lost else 100)):
            rows.append((urn, d, n))
    m = spark.createDataFrame(rows, "urn string, day string, n_rows long").withColumn("day", F.to_date("day"))
    b = X.edge_breaks(m, edges)
    assert {(r.upstream, r.downstream) for r in b.where("broken").collect()} == {("src", "load"), ("clean", "mart"), ("side", "mart")}
    got = {(str(r.day), r.upstream, r.downstream, r.urn, r.hops) for r in X.first_drops(b, edges).collect()}
    day = "2024-01-10"   # clean -> mart lies below src -> load: a consequence; side -> mart has nothing broken above it
    assert got == {(day, "src", "load", "load", 1), (day, "src", "load", "clean", 2), (day, "src", "load", "mart", 3), (day, "src", "load", "board", 4),
                   (day, "side", "mart", "mart", 1), (day, "side", "mart", "board", 2)}
    assert X.first_drops(X.edge_breaks(m.limit(0), edges), edges).collect() == []
