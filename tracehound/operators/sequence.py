"""Successor in a sequence without putting a whole key in one task (W7 at scale).

``lead(v) OVER (PARTITION BY key ORDER BY o)`` sorts every key in one task; a key that
holds a third of all rows becomes one straggler. Here the rows are range-partitioned by
``(key, o)``, so a hot key is spread over many partitions in order; ``lead`` runs per
``(key, partition)`` piece, and the last row of each piece takes the first value of the
key's next non-empty piece, found on a per-key summary of at most one row per partition.

The partitioned rows are written once: three branches use their partition numbers, and a
range shuffle done anew for each branch may draw other bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def next_in_sequence(df: DataFrame, key: str, order: list[str], value: str, out: str = "next_value",
                     num_partitions: int | None = None) -> DataFrame:
    """All columns of ``df`` plus ``out`` = the next row's ``value`` within ``key`` in
    ``order`` (NULL for the last row). ``order`` must make the sequence total."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = materialize(df.repartitionByRange(n, F.col(key), *[F.col(c) for c in order]).withColumn(
        "_pid", F.spark_partition_id()), "sequence")
    w = Window.partitionBy(key, "_pid").orderBy(*order)
    r = r.withColumn(out, F.lead(value).over(w)).withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    ordkey = F.struct(*[F.col(c) for c in order])
    pieces = (r.groupBy(key, "_pid").agg(F.min_by(F.col(value), ordkey).alias("_first"))
              .withColumn("_next_first", F.lead("_first").over(Window.partitionBy(key).orderBy("_pid")))
              .select(key, "_pid", "_next_first"))
    inner = r.where(~F.col("_last"))
    last = (r.where(F.col("_last")).drop(out).join(pieces, [key, "_pid"], "left")
            .withColumnRenamed("_next_first", out))
    cols = df.columns + [out]
    return inner.select(*cols).unionByName(last.select(*cols))
