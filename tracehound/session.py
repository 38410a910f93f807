"""Session helpers: one place for the configuration the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the library depends on for correct results (not tuning).
REQUIRED_CONF = {
    # A key repeated in a property list keeps its last value.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Oracle parity and day arithmetic are in UTC.
    "spark.sql.session.timeZone": "UTC",
}

# Settings for scale: runtime re-planning, skew splitting, partition coalescing.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Written intermediates are parquet with dictionary-encoded URN columns; their
    # in-memory size is several times their file size. Scale file-size estimates so the
    # broadcast threshold bounds the real hash-table size, not the compressed bytes.
    "spark.sql.sources.fileCompressionFactor": "8",
    # Keys and URNs compress ten times and more, so a task's rows in memory are many times what it
    # reads. These bound that, whatever the input's size: with the defaults (128m, 64m) a task that groups or
    # sorts them holds gigabytes.
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # URNs begin alike, so sorting rows by them compares some fifty bytes a time. A join whose partitions are
    # all known to be small hashes the smaller side instead; a hub's partition is larger and is sorted.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "24m",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tracehound", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**SCALE_CONF, **REQUIRED_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the required and the scale settings to an existing session (e.g. the
    driver's). All of them are runtime SQL settings."""
    for k, v in {**SCALE_CONF, **REQUIRED_CONF}.items():
        spark.conf.set(k, v)
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written snapshots.

    Read from the session (``spark.checkpoint.dir`` or the context's checkpoint dir). Only a
    session in local mode, whose tasks all run on this machine, may leave both unset and gets
    a temporary folder; on a cluster that is an error, since executors don't share it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0] if _is_uuid_leaf(current) else current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tracehound-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def _is_uuid_leaf(path: str) -> bool:
    leaf = path.rstrip("/").rsplit("/", 1)[-1]
    try:
        uuid.UUID(leaf)
        return True
    except ValueError:
        return False


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh directory name under the shared checkpoint folder."""
    root = checkpoint_root(spark)
    return os.path.join(root, "tracehound", f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df, name: str):
    """Cut lineage: write ``df`` as parquet under the shared checkpoint folder and read it
    back. Survives executor loss (unlike a local checkpoint) and gives the optimizer the
    real size of the result for its join choices. The schema is given, so reading back starts
    no job that looks into the files for it; zstd takes the URNs' common parts better than snappy."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
