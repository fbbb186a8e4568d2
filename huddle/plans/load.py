"""Load and merge: CSV sources to Parquet, then the four-table merge.

``load_csv_tables`` reads the game, play, player and tracking CSVs (the
tracking table from many weekly parts in one scan) with pandas-compatible
null handling and writes each as snappy Parquet.  ``merge_tables`` joins
tracking with plays, games and players and writes the merged table
clustered by play, which is what every feature plan groups by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huddle.operators.joins import fanout_report, merge_frames
from huddle.sources.readers import read_csv, read_parts
from huddle.sources.writers import write_clustered, write_parquet


def load_csv_tables(spark: SparkSession, tables: dict[str, str | Sequence[str]], out_dir: str,
                    schemas: dict | None = None, part_column: str = "tracking_week",
                    part_pattern: str = r"(\d+)\.csv$") -> dict[str, DataFrame]:
    """``tables``: name -> CSV path or list of part paths.  Each is written to
    ``<out_dir>/<name>.parquet``; returns the written tables re-read.

    A table given as parts (the weekly tracking files) is read in one scan,
    each row tagged with its part number taken from the file name
    (``_metadata.file_path``), and written partitioned by it: later reads
    prune by week, and a new week is a new partition."""
    out = {}
    for name, src in tables.items():
        schema = (schemas or {}).get(name)
        path = f"{out_dir.rstrip('/')}/{name}.parquet"
        if isinstance(src, str):
            write_parquet(read_csv(spark, src, schema=schema), path)
        else:
            df = read_parts(spark, list(src), fmt="csv", schema=schema)
            df = df.withColumn(part_column, F.regexp_extract(F.col("_metadata.file_path"), part_pattern, 1)
                               .cast("int"))
            write_parquet(df, path, partition_by=[part_column])
        out[name] = spark.read.parquet(path)
    return out


def merge_tables(tracking: DataFrame, plays: DataFrame, games: DataFrame, players: DataFrame,
                 out_path: str | None = None, num_partitions: int | None = None,
                 keys: Sequence[str] = ("gameId", "playId"), order: Sequence[str] = ("frameId",)):
    """The merge, plus the fan-out report of the name join.  Written
    clustered by the play keys (each play in one file, sorted by frame)."""
    merged = merge_frames(tracking, plays, games, players, rename={"nflId": "player_nflId"})
    report = fanout_report(players, "displayName", "nflId")
    if out_path:
        # keep the week partitions of the loaded tracking table, if any
        weeks = ["tracking_week"] if "tracking_week" in tracking.columns else []
        write_clustered(merged, out_path, list(keys), list(order), num_partitions, partition_by=weeks)
    return merged, report
