"""The same pipelines over arriving files, with Structured Streaming.

Every record transform (filter, mutate, coercion, adjoin against a static table, conjoin) is
stateless, so a streaming DataFrame goes through exactly the code a batch one does. The file
source's checkpoint remembers which files were processed -- the stored high-water mark of the
incremental synchronisation becomes the stream checkpoint. ``availableNow`` processes everything
present and stops, so the same job runs as a scheduled incremental batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.engram import apply_engram, load_engram, to_struct
from ..plans.transfer import run_transforms
from ..sinks.files import json_ready
from ..sources.files import text_schema


def read_stream(spark: SparkSession, path: str, fmt: str = "json", engram=None, schema=None,
                options: dict | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming scan of files arriving at ``path``; a declared encoding gives the schema."""
    r = spark.readStream.format(fmt).options(**(options or {}))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if engram is not None:
        st = to_struct(load_engram(engram))
        df = r.schema(text_schema(st) if fmt in ("json", "csv") else st).load(path)
        return apply_engram(df, engram)
    return r.schema(schema).load(path)


def transfer_stream(spark: SparkSession, path: str, steps, sink_path: str, checkpoint: str, fmt: str = "json",
                    engram=None, schema=None, sink_fmt: str = "parquet", read_options: dict | None = None,
                    available_now: bool = True, interval: str = "10 seconds"):
    """Origin files -> transforms -> file sink, exactly once per file (checkpointed)."""
    df = read_stream(spark, path, fmt, engram, schema, read_options)
    df = run_transforms(df, steps, {"spark": spark, "datasets": {}})
    if sink_fmt == "json":
        df = json_ready(df)
    w = (df.writeStream.format(sink_fmt).option("path", sink_path).option("checkpointLocation", checkpoint)
         .outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def foreach_batch(df: DataFrame, sinks: list, checkpoint: str, available_now: bool = True,
                  output_mode: str = "append", interval: str = "10 seconds"):
    """Streaming tee / upsert: each micro-batch is persisted once and handed to every sink as
    ``sink(batch_df, batch_id)``; sinks should be idempotent per ``batch_id`` (e.g. a keyed
    upsert), so a replayed batch after a failure does not duplicate rows.

    ``output_mode="complete"`` (or ``"update"``) lets an ``aggregate`` step run over the stream:
    Spark keeps the running groups in its checkpointed state store and hands each batch the
    current totals (complete) or the changed groups (update)."""
    def run(batch: DataFrame, batch_id: int):
        b = batch.persist()
        try:
            for s in sinks:
                s(b, batch_id)
        finally:
            b.unpersist()

    w = df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).outputMode(output_mode)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def upsert_stream(df: DataFrame, store: str, keys: list[str], checkpoint: str, order: list[str] | None = None,
                  name: str | None = None, available_now: bool = True, interval: str = "10 seconds"):
    """Streaming keyed upsert into a store (:mod:`skein.sinks.store`), each batch exactly once.

    The number of a batch is noted in the store together with its rows. Spark hands a batch over again if
    the job died before its checkpoint was written; the store then knows it and changes nothing. The
    ledger belongs to ``name`` (the checkpoint's path unless given): another stream has its own.
    """
    from ..sinks.store import upsert_store

    name = name or checkpoint.rstrip("/")

    def run(batch: DataFrame, batch_id: int):
        upsert_store(batch, store, keys, order, batch=(name, batch_id))

    w = df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def sync_stream(spark: SparkSession, src_path: str, dst_path: str, checkpoint: str, fmt: str = "parquet",
                schema=None, steps=None):
    """Continuous incremental synchronisation: new source files are appended to the destination;
    the checkpoint replaces the stored "last value" state."""
    df = read_stream(spark, src_path, fmt, schema=schema or spark.read.format(fmt).load(src_path).schema)
    if steps:
        df = run_transforms(df, steps, {"spark": spark, "datasets": {}})
    return (df.writeStream.format("parquet").option("path", dst_path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())
