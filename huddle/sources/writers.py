"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "snappy",
                  partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode(mode).option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_clustered(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = (),
                    num_partitions: int | None = None, mode: str = "overwrite",
                    partition_by: Sequence[str] = ()) -> None:
    """Write a keyed table clustered by ``keys`` and sorted by ``keys + order``
    within each file: later key filters skip row groups by min/max, and a
    play's rows sit together.  Replaces a round-robin repartition, which
    scatters each play over every file.

    The shuffle is a REBALANCE on the keys, not a plain repartition: AQE
    splits a partition that grows past the advisory size (a play holding a
    third of all rows is written by several tasks) and merges small ones,
    without an extra sampling pass over the input."""
    args = ([num_partitions] if num_partitions else []) + list(keys)
    parts = df.hint("rebalance", *args).sortWithinPartitions(*partition_by, *keys, *order)
    write_parquet(parts, path, mode=mode, partition_by=partition_by)
