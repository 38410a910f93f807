"""Streaming intake: incident files -> micro-batch investigations -> idempotent report sink."""

import json
import tempfile

from fixtures import f1_catalog
from tracehound.streaming.intake import read_reports, start_intake


def test_intake_stream(spark):
    cat = f1_catalog(spark)
    inc_dir = tempfile.mkdtemp(prefix="th-inc-")
    out_dir = tempfile.mkdtemp(prefix="th-out-")
    ckpt = tempfile.mkdtemp(prefix="th-ckpt-")
    cat.incidents.where("incident_id in ('A', 'B')").write.mode("append").parquet(inc_dir)
    q = start_intake(spark, inc_dir, out_dir, lambda: cat, checkpoint_location=ckpt,
                     text_only_high=True)
    q.awaitTermination(300)
    cat.incidents.where("incident_id = 'C'").write.mode("append").parquet(inc_dir)
    q = start_intake(spark, inc_dir, out_dir, lambda: cat, checkpoint_location=ckpt,
                     text_only_high=True)
    q.awaitTermination(300)
    reps = {r.incident_id: json.loads(r.report_json) for r in read_reports(spark, out_dir).collect()}
    assert sorted(reps) == ["A", "B", "C"]  # each incident exactly once over two runs
    assert reps["C"]["evidence_nodes"] == 3
    assert reps["A"]["suspects"][0]["name"] == "lake.intake.parcel_scans"


def test_an_incident_sent_twice_is_investigated_once(spark):
    """Three epochs, a restart before each, and a file with repeats within itself."""
    cat = f1_catalog(spark)
    inc_dir, out_dir, ckpt = (tempfile.mkdtemp(prefix=f"th-{x}-") for x in ("inc", "out", "ckpt"))
    send = [("'A', 'B'", 1), ("'B', 'C'", 2), ("'A', 'B', 'C'", 1)]
    for ids, times in send:
        part = cat.incidents.where(f"incident_id in ({ids})")
        for _ in range(times):
            part.write.mode("append").parquet(inc_dir)
        start_intake(spark, inc_dir, out_dir, lambda: cat, checkpoint_location=ckpt, text_only_high=True).awaitTermination(300)
    assert sorted(r.incident_id for r in read_reports(spark, out_dir).collect()) == ["A", "B", "C"]
    out2 = tempfile.mkdtemp(prefix="th-out-")
    start_intake(spark, inc_dir, out2, lambda: cat, checkpoint_location=tempfile.mkdtemp(prefix="th-ckpt-"), dedupe_within=None).awaitTermination(300)
    assert read_reports(spark, out2).count() >= 9   # every row as it came
