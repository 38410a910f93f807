"""S8 as a stream: incidents arrive as files; each micro-batch is investigated.

``readStream`` of the incidents folder -> duplicates removed -> ``foreachBatch``. An incident that
is sent again in another file, also after a restart, is investigated once: the ids seen are the
stream's state, kept for ``dedupe_within`` of the files' times behind a watermark and then
dropped, so the state is bounded by what arrives in that time.

The batch is written to the
shared folder (its lineage cut, so the investigation reads it more than once without
re-reading the source), investigated against the current catalog, and the reports are
written to ``<output>/epoch=<id>``. A retried epoch overwrites its own folder, so the
sink is idempotent; the stream's progress lives in the checkpoint location.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..plans.investigate import investigate
from ..plans.report import report_json
from ..session import checkpoint_root, materialize
from ..sources.catalog import Catalog


def start_intake(spark: SparkSession, incidents_dir: str, output_dir: str,
                 catalog: Callable[[], Catalog], *, act: bool = False,
                 checkpoint_location: str | None = None, available_now: bool = True,
                 fmt: str = "parquet", dedupe_within: str | None = "30 days", max_files: int | None = None,
                 **investigate_kw) -> StreamingQuery:
    """Start the intake stream. ``catalog`` is called per batch, so each batch sees the
    catalog as it is then (new edges, entities, signals). ``max_files`` bounds the files of a
    batch; ``dedupe_within=None`` takes every row as it comes."""
    def reports(incidents: DataFrame) -> DataFrame:
        return report_json(investigate(catalog().with_(incidents=incidents), act=act, **investigate_kw).reports)
    return start_stream(spark, incidents_dir, output_dir, reports, checkpoint_location=checkpoint_location,
                        available_now=available_now, fmt=fmt, dedupe_within=dedupe_within, max_files=max_files)


def new_incidents(stream: DataFrame, within: str) -> DataFrame:
    """The rows of a file stream whose ``incident_id`` has not come ``within`` that time before (by
    the files' modification times)."""
    timed = stream.select("*", F.col("_metadata.file_modification_time").alias("_arrived"))
    return timed.withWatermark("_arrived", within).dropDuplicatesWithinWatermark(["incident_id"]).drop("_arrived")


def start_stream(spark: SparkSession, incidents_dir: str, output_dir: str, handle: Callable[[DataFrame], DataFrame], *,
                 checkpoint_location: str | None = None, available_now: bool = True, fmt: str = "parquet",
                 dedupe_within: str | None = "30 days", max_files: int | None = None) -> StreamingQuery:
    """The stream behind :func:`start_intake`: writes ``handle(incidents)`` of each micro-batch."""
    ckpt = checkpoint_location or os.path.join(checkpoint_root(spark), "tracehound", "intake-stream")
    reader = spark.readStream.schema(schemas.INCIDENTS).format(fmt)
    stream = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(incidents_dir)
    if dedupe_within:
        stream = new_incidents(stream, dedupe_within)

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        incidents = materialize(batch, f"intake-{epoch_id}")   # the state is read and updated once a batch
        if incidents.isEmpty():
            return
        handle(incidents).write.mode("overwrite").parquet(os.path.join(output_dir, f"epoch={epoch_id}"))

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def read_reports(spark: SparkSession, output_dir: str) -> DataFrame:
    return spark.read.parquet(output_dir)
