"""Incremental ingest of tracking parts with Structured Streaming.

The tracking data arrives as weekly files.  Instead of re-reading and
re-merging everything when a week lands, a file-source stream picks up new
parts, merges each micro-batch with the static dimensions (stream-static
left joins), and appends to the merged table.  Progress lives in a
checkpoint under the shared checkpoint folder, so a restarted or failed job
resumes without duplicating or losing parts; ``availableNow`` processes what
is there and stops, which suits scheduled runs."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huddle.operators.joins import merge_frames
from huddle.session import checkpoint_dir


def read_parts_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(folder)


def stream_merge(spark: SparkSession, folder: str, schema: T.StructType, plays: DataFrame, games: DataFrame,
                 players: DataFrame, out_path: str, name: str = "tracking_merge", fmt: str = "parquet",
                 play_on: Sequence = ("gameId", "playId"), game_on: Sequence = ("gameId",),
                 player_on: Sequence = ("displayName",), rename: dict | None = None,
                 partition_by: Sequence[str] = (), available_now: bool = True):
    """Start the merge stream; returns the StreamingQuery."""
    stream = read_parts_stream(spark, folder, schema, fmt)
    merged = merge_frames(stream, plays, games, players, play_on, game_on, player_on, rename)
    ckpt = os.path.join(checkpoint_dir(spark), "streams", name)
    w = (merged.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", ckpt).outputMode("append"))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def stream_event_rows(spark: SparkSession, merged_folder: str, schema: T.StructType, event_col: str,
                      event_value: str, out_path: str, name: str = "event_rows"):
    """Keep the rows of one event tag as the merged table grows (the input
    of the feature plans), with the same resumable checkpointing."""
    stream = read_parts_stream(spark, merged_folder, schema).filter(F.col(event_col) == F.lit(event_value))
    ckpt = os.path.join(checkpoint_dir(spark), "streams", name)
    return (stream.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", ckpt)
            .outputMode("append").trigger(availableNow=True).start())


def stream_wide_features(spark: SparkSession, folder: str, schema: T.StructType, layout, out_path: str,
                         name: str = "wide_features", event_value: str | None = "ball_snap",
                         available_now: bool = True, max_files_per_trigger: int | None = None):
    """Wide feature rows as parts of the merged table arrive.

    Each micro-batch keeps its rows at the event under ``<out>_rows`` and
    recomputes, with the batch plan (``snap_features``), the plays it touched
    from all rows kept so far, so a play whose rows span several batches ends
    up whole.  A play may so be written by several batches: read the result
    with :func:`read_wide_features`, where the last one counts.  Each batch
    writes its own folders, named by the batch id, with overwrite, so a batch
    replayed after a failure replaces its own output."""
    from huddle.plans.features import snap_features
    out, kept = out_path.rstrip("/"), out_path.rstrip("/") + "_rows"

    def write_batch(batch_df: DataFrame, batch_id: int) -> None:
        at_event = batch_df if event_value is None else batch_df.filter(F.col(layout.event) == F.lit(event_value))
        at_event.write.mode("overwrite").parquet(f"{kept}/batch={batch_id}")
        rows = spark.read.option("basePath", kept).schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(
            f"{kept}/batch=*").filter(F.col("batch") <= batch_id)
        touched = rows.filter(F.col("batch") == batch_id).select(*layout.keys).distinct()
        wide = snap_features(rows.drop("batch").join(touched, list(layout.keys), "left_semi"), layout, event_value)
        wide.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = read_parts_stream(spark, folder, schema, max_files_per_trigger=max_files_per_trigger)
    ckpt = os.path.join(checkpoint_dir(spark), "streams", name)
    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_wide_features(spark: SparkSession, out_path: str, layout) -> DataFrame:
    """The rows of each play's last batch."""
    rows = spark.read.parquet(out_path)
    last = rows.groupBy(*layout.keys).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*layout.keys, "batch"], "left_semi").drop("batch")
