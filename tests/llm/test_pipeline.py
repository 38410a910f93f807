"""The pipeline's stages one after the other on a small corpus, against plain versions."""
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_pairs import brute_components
from tracehound.llm import quality_rules
from tracehound.session import materialize

from corpora import sentence, vocabulary


def test_stages(spark, make_docs, tmp_path):
    rng = random.Random(31)
    v = vocabulary(rng, 1500)
    items = [(k, sentence(rng, 30, v)) for k in range(10)]
    rows = []
    for k in range(120):
        t = sentence(rng, 80, v) + (" vile nasty vile vile" if k % 6 == 0 else "")
        rows.append((k, t))
        if k % 5 == 0:
            rows.append((1000 + k, t))  # an exact copy
        if k % 5 == 1:
            rows.append((2000 + k, t + " and two"))  # a near copy
        if k % 10 == 2:
            rows.append((3000 + k, sentence(rng, 40, v) + " " + items[k // 12][1].upper()))  # contaminated
        if k % 10 == 3:
            rows.append((4000 + k, " ".join(w + "###" for w in t.split())))  # junk
    rows += [(5000, None), (5001, "short")]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(k, 1, int(k % 6 == 0)) for k in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "decontamination", "mixing", "sharding"]
    text = dict(rows)

    def step(name, docs):
        out = materialize(stages[name](spark, docs, str(tmp_path)), f"test-{name}")
        assert name == "sharding" or out.columns == docs.columns
        return out, [r.doc_id for r in out.select("doc_id").collect()]

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs, ids = step("quality_rules", docs)
    fails = lambda t: any(eval(c, {}, dict(zip(quality_rules.MEASURES, quality_rules.measure(t)))) for c in quality_rules.RULES.values())
    assert sorted(ids) == sorted(k for k, t in rows if not fails(t))
    comps = brute_components([(k, text[k]) for k in ids])
    docs, ids = step("near_duplicates", docs)
    assert sorted(ids) == sorted({c for _, c in comps.values()})
    docs, ids2 = step("decontamination", docs)
    assert sorted(ids2) == sorted(k for k in ids if not any(t in text[k].lower() for _, t in items)) and len(ids2) < len(ids)
    docs, ids = step("mixing", docs)
    toxic = [k for k in ids2 if "vile" in text[k]]
    assert len(set(ids) & set(toxic)) <= 0.1 * len(toxic) and len(set(ids) - set(toxic)) >= 0.9 * (len(ids2) - len(toxic))
    docs, last = step("sharding", docs)
    assert sorted(last) == sorted(ids)
    counts = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) - min(counts) <= 1


def test_run_is_the_stages(spark, make_docs, tmp_path):
    rng = random.Random(1)
    v = vocabulary(rng)
    make_docs([(k, sentence(rng, 40, v)) for k in range(12)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == list(range(12))


def test_clean_documents_stay_exactly_once(spark, make_docs, tmp_path):
    rng = random.Random(17)
    v = vocabulary(rng, 1500)
    rows = [(k, sentence(rng, rng.randint(40, 120), v) + (" vile nasty vile" if k % 9 == 0 else "")) for k in range(400)]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, int(k % 9 == 0)) for k in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.mixing_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == [k for k in range(400) if k % 9]


def test_null_and_repeated_ids(spark, make_docs, tmp_path):
    rng = random.Random(19)
    v = vocabulary(rng, 1500)
    item = sentence(rng, 30, v)
    a, b, c, d, e = (sentence(rng, 60, v) for _ in range(5))
    held = sentence(rng, 20, v) + " " + item
    make_docs([(None, a), (None, b), (None, b), (7, c), (7, d), (7, held), (None, held + " more"), (8, e), (None, e)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda df: sorted((r.doc_id or 0, r.text) for r in df.select("doc_id", "text").collect())
    one = corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path))
    assert key(one) == sorted([(0, a), (0, b), (7, c), (7, d), (7, held), (8, e)])
    clean = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert key(clean) == sorted([(0, a), (0, b), (0, b), (7, c), (7, d), (8, e), (0, e)])
