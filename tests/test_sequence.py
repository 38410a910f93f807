"""Skew-safe successor against lead() on a hot key spread over many partitions."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracehound.operators.sequence import next_in_sequence


def test_matches_lead_with_hot_key(spark):
    rnd = random.Random(3)
    rows = [(0 if rnd.random() < 0.6 else rnd.randint(1, 5), rnd.randint(0, 50), i, f"v{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "k int, t int, id int, v string")
    got = {r.id: r.nxt for r in next_in_sequence(df, "k", ["t", "id"], "v", "nxt", num_partitions=7).collect()}
    w = Window.partitionBy("k").orderBy("t", "id")
    exp = {r.id: r.nxt for r in df.select("id", F.lead("v").over(w).alias("nxt")).collect()}
    assert got == exp and len(got) == 600


@pytest.mark.parametrize("parts", [8, 32])
def test_two_million_rows_with_a_hot_key(spark, parts):
    """60 % of the rows on one key; every successor must be lead()'s."""
    df = spark.range(0, 2_000_000, numPartitions=8).select(
        F.when(F.pmod(F.xxhash64("id"), F.lit(10)) < 6, 0).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) + 1).alias("k"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100_000)).alias("t"), "id")
    got = next_in_sequence(df, "k", ["t", "id"], "id", "nxt", num_partitions=parts).select("id", "nxt")
    want = df.select("id", F.lead("id").over(Window.partitionBy("k").orderBy("t", "id")).alias("want"))
    both = got.join(want, "id", "full")
    assert both.count() == 2_000_000 and both.where("not (nxt <=> want)").count() == 0
