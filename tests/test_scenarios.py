"""End-to-end scenarios (FIXTURES F1, F2, F6 mid-chain, F8 negations) and write-back proof."""

import pytest
from pyspark.sql import functions as F

from fixtures import EXPECTED_SUSPECTS, ds, f1_catalog, f1_expected
from tracehound import schemas
from tracehound.operators import containment as C
from tracehound.operators.enrich import evidence_lines
from tracehound.operators.evaluate import clean_slate, scenario_results, scenario_score, writeback_check
from tracehound.operators.signals import text_signals
from tracehound.plans.investigate import investigate
from tracehound.plans.report import lineage_dot, report_json, report_text
from tracehound.sources.catalog import Catalog


@pytest.fixture(scope="module")
def parity(spark):
    cat = f1_catalog(spark)
    return cat, investigate(cat, text_only_high=True, act=True, act_on_text=True, store=C.TagStore.fresh(spark))


def test_suspects_order_and_confidence(parity):
    _, inv = parity
    rows = inv.suspects.orderBy("incident_id", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r.incident_id, []).append((r.name, r.confidence))
    for k, names in EXPECTED_SUSPECTS.items():
        assert [n for n, _ in got[k]] == names
    assert [c for _, c in got["A"]] == ["high", "medium", "low"]
    assert [c for _, c in got["C"]] == ["high", "medium"]


def test_evidence_counts_and_scenario_score(spark, parity):
    _, inv = parity
    counts = {r.incident_id: r.evidence_nodes for r in inv.reports.collect()}
    assert counts == {"A": 4, "B": 4, "C": 3}
    res = scenario_results(inv.suspects, f1_expected(spark))
    s = scenario_score(res).first()
    assert (s.passed, s.total, s.all_passed) == (3, 3, True)


def test_blast_radius_and_tags(parity):
    _, inv = parity
    a = inv.reports.where("incident_id = 'A'").first()
    assert a.action.applied and a.action.urn == ds("bigquery", "lake.intake.parcel_scans")
    br = a.blast_radius
    assert (br.impacted_count, br.tagged) == (3, 3)
    assert (br.n_dashboards, br.n_assets) == (1, 2)
    nodes = inv.containment["nodes"].where(F.col("root_urn") == a.action.urn).collect()
    assert sorted((r.label, r.is_dashboard) for r in nodes) == [
        ("bi.depot_board", True), ("wh.agg.daily_parcels", False), ("wh.clean.scans", False)]


def test_reports_render(spark, parity):
    cat, inv = parity
    txt = {r.incident_id: r.report_text for r in report_text(inv.reports).collect()}
    assert "suspect 1: lake.intake.parcel_scans [!!!] confidence high; ask uma@intake" in txt["A"]
    assert "reach: 3 below it, of them dashboards 1, others 2, tagged 3" in txt["A"]
    assert "nodes read, itself included: 3" in txt["C"]
    js = {r.incident_id: r.report_json for r in report_json(inv.reports).collect()}
    assert '"evidence_nodes":4' in js["A"] and '"missing_evidence":null' in js["A"]
    dot = drawing(lineage_dot(inv.evidence, inv.reports, cat.edges, inv.containment["nodes"]), "A")
    assert "[quarantined]" in dot and "[symptom]" in dot and dot.startswith("digraph") and dot.endswith("}")
    assert dot.count("->") == 3


def drawing(lines, incident):
    rows = lines.where(F.col("incident_id") == incident).orderBy("part", "line").collect()
    return "\n".join(r.line for r in rows)


def test_default_gate_needs_data_signal(spark):
    cat = f1_catalog(spark)
    with pytest.raises(ValueError):
        investigate(cat, act=True)  # tags need a store to go to
    inv = investigate(cat, act=True, store=C.TagStore.fresh(spark))
    assert inv.reports.where(F.col("action").isNotNull()).count() == 0
    # a data signal on the root turns it into an action
    sig = spark.createDataFrame([(ds("bigquery", "lake.intake.parcel_scans"), None, "volume", 0.6, 0.6, "data", "rows fell")],
                                schemas.SIGNALS)
    inv2 = investigate(cat.with_(signals=sig), act=True, store=C.TagStore.fresh(spark))
    acted = inv2.reports.where(F.col("action").isNotNull()).collect()
    assert [r.incident_id for r in acted] == ["A"]
    top = inv2.suspects.where("incident_id = 'A' and rank = 1").first()
    assert (top.score, top.confidence, top.source) == (4, "high", "data")


def test_writeback_idempotent_and_rejects_unknown(spark):
    cat = f1_catalog(spark)
    store = C.TagStore.fresh(spark)
    store.ensure_vocabulary()
    chain = spark.createDataFrame([(u,) for u in [ds("bigquery", "lake.intake.parcel_scans"),
                                                  ds("dbt", "wh.clean.scans")]], "urn string")
    assert clean_slate(store.entity_tags(), chain).first().clean
    investigate(cat, act=True, act_on_text=True, text_only_high=True, store=store)
    after = C.TagStore(spark, store.root).entity_tags()
    n1 = after.count()
    assert n1 == 3 + 8  # 3 roots quarantined; 3 + 3 + 2 impacted
    investigate(cat, act=True, act_on_text=True, text_only_high=True, store=store)
    assert C.TagStore(spark, store.root).entity_tags().count() == n1  # acting twice changes nothing
    applied, rejected = store.add_tags(spark.createDataFrame([("x", "urn:li:tag:NOPE")], schemas.ENTITY_TAGS))
    assert applied.count() == 0 and rejected.count() == 1
    down = spark.createDataFrame([(ds("dbt", "wh.clean.scans"),)], "urn string")
    wb = writeback_check(C.TagStore(spark, store.root).entity_tags(), ds("bigquery", "lake.intake.parcel_scans"), down, True).first()
    assert wb.root_quarantined and wb.downstream_tagged == 1 and wb["pass"]
    removed = store.remove_tags(store.entity_tags().where(F.col("tag_urn") == C.QUARANTINE_TAG))
    assert removed.where(F.col("tag_urn") == C.QUARANTINE_TAG).count() == 0


def test_mid_chain_root_and_two_signals(spark):
    # x -> y -> z -> w -> dash ; the signal sits mid-chain at z, a harmless note at x
    urns = {k: ds("dbt", k) for k in ["x", "y", "z", "w", "dash"]}
    ents = spark.createDataFrame([
        (urns["x"], "x", "dbt", "source", [], [], {"last_run_note": "backfill not needed, all good"}),
        (urns["y"], "y", "dbt", "", [], [], {}),
        (urns["z"], "z", "dbt", "", [], [], {"last_run_note": "column email dropped in the new export"}),
        (urns["w"], "w", "dbt", "", [], [], {}),
        (urns["dash"], "dash", "looker", "", [], [], {}),
    ], schemas.ENTITIES)
    edges = spark.createDataFrame([(urns["x"], urns["y"]), (urns["y"], urns["z"]), (urns["z"], urns["w"]),
                                   (urns["w"], urns["dash"])], schemas.EDGES)
    inc = spark.createDataFrame([("M", "emails are blank", urns["dash"])], schemas.INCIDENTS)
    inv = investigate(Catalog(edges=edges, entities=ents, incidents=inc), max_hops=4, text_only_high=True)
    top = [r.name for r in inv.suspects.orderBy("rank").collect()]
    assert top == ["z", "w", "x"]


F8_HARMLESS = ["all checks passed, no fewer rows than yesterday",
               "schema changed last year, mappings updated and verified",
               "feed not down, latency normal", "not stale: loaded 02:00", "backfill not needed", "nightly run ok"]


def test_negated_notes_raise_no_signal(spark):
    ents = spark.createDataFrame([(f"u{i}", None, None, None, [], [], {"last_run_note": t})
                                  for i, t in enumerate(F8_HARMLESS)], schemas.ENTITIES)
    assert text_signals(ents).count() == 0


def test_tagstore_skips_partial_version(spark):
    import os
    store = C.TagStore.fresh(spark)
    store.ensure_vocabulary()
    store.seed(spark.createDataFrame([("a", C.IMPACT_TAG)], schemas.ENTITY_TAGS))
    # a failed write leaves v=1 without _SUCCESS
    root = store.root.replace("file:", "")
    os.makedirs(os.path.join(root, "entity_tags", "v=1"))
    assert store.entity_tags().count() == 1
    applied, _ = store.add_tags(spark.createDataFrame([("b", C.IMPACT_TAG)], schemas.ENTITY_TAGS))
    assert applied.first().applied and store.entity_tags().count() == 2


def test_guard_drops_suspects_outside_evidence(spark):
    from tracehound.functions.text import parse_answer
    from tracehound.operators.ranking import guard_suspects
    cat = f1_catalog(spark)
    inv = investigate(cat, text_only_high=True)
    json_answer = '{"summary": "s", "suspects": [{"urn": "%s", "confidence": "high"}, ' \
        '{"urn": "urn:li:dataset:(urn:li:dataPlatform:x,made.up,PROD)", "confidence": "high"}]}' % \
        ds("bigquery", "lake.intake.parcel_scans")
    parsed = spark.createDataFrame([("A", json_answer)], "incident_id string, text string").select(
        "incident_id", F.posexplode(parse_answer("text")["suspects"]).alias("pos", "s")).select(
        "incident_id", F.col("s")["urn"].alias("urn"))
    kept = [r.urn for r in guard_suspects(parsed, inv.evidence).collect()]
    assert kept == [ds("bigquery", "lake.intake.parcel_scans")]


def test_dot_marks_unverified_root_as_suspect(spark):
    cat = f1_catalog(spark)
    inv = investigate(cat, text_only_high=True)  # no action taken
    dot = drawing(lineage_dot(inv.evidence, inv.reports, cat.edges), "A")
    assert "[quarantined]" not in dot
    line = [x for x in dot.splitlines() if "lake.intake.parcel_scans" in x and "label" in x][0]
    assert "[suspect]" in line


def test_tagstore_keeps_a_write_that_came_in_between(spark):
    store = C.TagStore.fresh(spark)
    store.ensure_vocabulary()
    other = spark.createDataFrame([("theirs", C.IMPACT_TAG)], schemas.ENTITY_TAGS)
    calls = []

    def change(t):
        if not calls:  # another writer commits after our base was read
            calls.append(1)
            store.seed(other)
        return t.unionByName(spark.createDataFrame([("ours", C.IMPACT_TAG)], schemas.ENTITY_TAGS))

    store._update("entity_tags", schemas.ENTITY_TAGS, change)
    assert sorted(r.entity_urn for r in store.entity_tags().collect()) == ["ours", "theirs"]


def test_tagstore_many_writers_at_once(spark):
    """Writers that commit at the same time: every write is kept, each in a version of its own."""
    from concurrent.futures import ThreadPoolExecutor
    store = C.TagStore.fresh(spark)
    store.ensure_vocabulary()

    def write(k):
        mine = C.TagStore(spark, store.root)
        applied, _ = mine.add_tags(spark.createDataFrame([(f"w{k}", C.IMPACT_TAG)], schemas.ENTITY_TAGS))
        return applied.first().applied
    with ThreadPoolExecutor(4) as pool:
        assert all(pool.map(write, range(6)))
    assert sorted(r.entity_urn for r in store.entity_tags().collect()) == [f"w{k}" for k in range(6)]
    assert store._versions("entity_tags") == list(range(6))


def test_tagstore_claim_of_a_dead_writer_is_an_error(spark):
    import os
    store = C.TagStore.fresh(spark)
    store.seed(spark.createDataFrame([("a", C.IMPACT_TAG)], schemas.ENTITY_TAGS))
    open(os.path.join(store.root.replace("file:", ""), "entity_tags", "_claim-1"), "w").close()
    with pytest.raises(RuntimeError, match="_claim-1"):
        store._update("entity_tags", schemas.ENTITY_TAGS, lambda t: t, attempts=2, patience=0.01)
    assert store.entity_tags().count() == 1


def test_tags_without_per_root_blast(spark):
    """The union walk tags the same assets as the blast radii, among them a root below another."""
    cat = f1_catalog(spark)
    clean = ds("dbt", "wh.clean.scans")
    sig = spark.createDataFrame([(ds("bigquery", "lake.intake.parcel_scans"), None, "volume", 0.6, 0.6, "data", "rows fell"),
                                 (clean, None, "volume", 0.6, 0.6, "data", "rows fell")], schemas.SIGNALS)
    inc = cat.incidents.unionByName(spark.createDataFrame([("D", "a drop", ds("dbt", "wh.agg.daily_parcels"))], schemas.INCIDENTS))
    stores = []
    for per_root in (True, False):
        stores.append(C.TagStore.fresh(spark))
        inv = investigate(cat.with_(signals=sig, incidents=inc), act=True, store=stores[-1], per_root=per_root)
        assert (inv.containment["nodes"] is None) == (not per_root)
        radius = {r.incident_id: r.blast_radius for r in inv.reports.collect()}
        assert radius["B"] is None and (radius["A"] is not None) == per_root
    a, b = (sorted(map(tuple, s.entity_tags().collect())) for s in stores)
    assert a == b and len(a) >= 4


def test_nothing_is_cut_by_default(spark):
    """A root with 300 assets below it in a chain of 8 hops, and a symptom with as long an upstream."""
    urn = lambda k: ds("dbt", f"n{k}")
    pairs = [(urn(k), urn(k + 1)) for k in range(8)] + [(urn(8), urn(100 + k)) for k in range(300)]
    ents = spark.createDataFrame([(urn(k), f"n{k}", "dbt", "", [], [f"c{i}" for i in range(30)],
                                   {"last_run_note": "fewer rows"} if k == 0 else {}) for k in [*range(9), *range(100, 400)]], schemas.ENTITIES)
    inc = spark.createDataFrame([("M", "a drop", urn(150))], schemas.INCIDENTS)
    cat = Catalog(edges=spark.createDataFrame(pairs, schemas.EDGES), entities=ents, incidents=inc)
    inv = investigate(cat, act=True, act_on_text=True, text_only_high=True, store=C.TagStore.fresh(spark))
    r = inv.reports.first()
    assert r.evidence_nodes == 10 and r.suspects[0].urn == urn(0)
    assert (r.blast_radius.impacted_count, r.blast_radius.tagged) == (308, 308)
    line = evidence_lines(inv.evidence).where("hop = 9").first().line
    assert "c29" in line  # all columns, not the first twenty


def test_an_incident_without_id_misses_no_evidence(spark):
    cat = f1_catalog(spark)
    inc = cat.incidents.unionByName(cat.incidents.limit(1).withColumn("incident_id", F.lit(None).cast("string")))
    row, = investigate(cat.with_(incidents=inc)).reports.where("incident_id IS NULL").collect()
    assert row.missing_evidence is None and row.suspects == [] and row.evidence_nodes == 0
