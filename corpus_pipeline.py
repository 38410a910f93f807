"""The corpus pipeline: quality rules, n-gram Jaccard join, benchmark decontamination, mixing
to target weights, sharding.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and returns
a DataFrame, written as Parquet in the shared folder and read again as the next one's ``docs``.
Every stage but the last returns the columns it was given; ``docs`` must be a table read from
files (rows are numbered by their place in it, twice alike).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracehound.llm import decontaminate, jaccard_join, mixing, quality_rules, sharding
from tracehound.llm.common import long_ids, table, with_column_names
from tracehound.session import materialize

_ROW = "__row"


def quality_stage(spark, docs, sf_dir):
    """Documents that the rule policy rejects go (a null doc_id is judged by its row)."""
    numbered = docs.withColumn(_ROW, F.monotonically_increasing_id())
    ledger = quality_rules.rule_ledger(numbered.withColumn("doc_id", F.col(_ROW)))
    kept = quality_rules.apply_policy(ledger).where("kept").select(F.col("doc_id").alias(_ROW))
    return numbered.join(kept, _ROW, "left_semi").drop(_ROW)


def near_duplicate_stage(spark, docs, sf_dir):
    """Of every group of linked documents the one with the smallest doc_id stays (null after all
    others); documents without a shingle are in no group and stay."""
    numbered = docs.withColumn(_ROW, F.monotonically_increasing_id())
    rows = jaccard_join.classes(numbered, row_id=_ROW)
    first = rows.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("m"))
    keep = first.select(F.col("m.rid").alias(_ROW)).union(rows.where("n_shingles = 0").select("rid"))
    return numbered.join(keep, _ROW, "left_semi").drop(_ROW)


def decontamination_stage(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    numbered = docs.withColumn(_ROW, F.monotonically_increasing_id())
    found = decontaminate.matches(numbered, table(spark, sf_dir, "benchmark"), row_id=_ROW).select(F.col("rid").alias(_ROW)).distinct()
    return numbered.join(found, _ROW, "left_anti").select(*docs.columns)


def mixing_stage(spark, docs, sf_dir):
    """The corpus is brought to the mix of its surely clean documents, which stay, each once;
    none is repeated."""
    labels = long_ids(with_column_names(table(spark, sf_dir, "labels"), "doc_id", "toxic"))
    labelled = labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").alias("domain"))
    numbered = docs.withColumn(_ROW, F.monotonically_increasing_id())
    kept = mixing.keep_domain(numbered, labelled, "clean", ["toxic"], _ROW).where("copies > 0").select(F.col("rid").alias(_ROW))
    return numbered.join(kept, _ROW, "left_semi").select(*docs.columns)


def sharding_stage(spark, docs, sf_dir):
    """Every remaining row gets its shard and slot."""
    return sharding.digest(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Classifier posteriors, iterative fitting and label propagation are beyond SQL; the stages
#: are tested against brute-force versions in tests/llm.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
