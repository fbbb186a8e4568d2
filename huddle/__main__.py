"""Command line: the reference's run order as three steps.

    python -m huddle load   --csv-dir DIR --out DIR           CSV -> Parquet (tracking from weekly parts)
    python -m huddle merge  --parquet-dir DIR --out PATH      four-table merge, clustered by play
    python -m huddle report --merged PATH --out DIR [--event ball_snap | --before-event | --event line_set]

Each report table is written as Parquet under --out/<name>.
"""

from __future__ import annotations

import argparse
import sys


def _there(spark, path: str) -> bool:
    """Whether Spark finds ``path``, in whatever store it is."""
    from pyspark.errors import AnalysisException
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="huddle")
    sub = ap.add_subparsers(dest="cmd", required=True)
    ld = sub.add_parser("load")
    ld.add_argument("--csv-dir", required=True)
    ld.add_argument("--out", required=True)
    mg = sub.add_parser("merge")
    mg.add_argument("--parquet-dir", required=True)
    mg.add_argument("--out", required=True)
    mg.add_argument("--partitions", type=int, default=None)
    rp = sub.add_parser("report")
    rp.add_argument("--merged", required=True)
    rp.add_argument("--out", required=True)
    rp.add_argument("--event", default="ball_snap")
    rp.add_argument("--before-event", action="store_true")
    rp.add_argument("--one-frame", action="store_true", help="keep only the last tagged frame of a play")
    rp.add_argument("--master", default=None)
    a = ap.parse_args(argv)

    from pyspark.sql import SparkSession
    b = SparkSession.builder.appName("huddle")
    if getattr(a, "master", None):
        b = b.master(a.master)
    spark = b.getOrCreate()

    if a.cmd == "load":
        from huddle.plans.load import load_csv_tables
        d = a.csv_dir.rstrip("/")
        # Spark lists the files itself (any store); a missing one is an error,
        # but for player_play, which no later step reads
        tables = {n: f"{d}/{n}.csv" for n in ("games", "plays", "players")}
        tables["tracking"] = [f"{d}/tracking_week_*.csv"]
        if _there(spark, f"{d}/player_play.csv"):
            tables["player_play"] = f"{d}/player_play.csv"
        else:
            print(f"no {d}/player_play.csv: not loaded", file=sys.stderr)
        load_csv_tables(spark, tables, a.out)
    elif a.cmd == "merge":
        from huddle.plans.load import merge_tables
        d = a.parquet_dir.rstrip("/")
        t = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("tracking", "plays", "games", "players")}
        _, report = merge_tables(t["tracking"], t["plays"], t["games"], t["players"], a.out, a.partitions)
        report.write.mode("overwrite").parquet(a.out.rstrip("/") + "_name_fanout")
    else:
        from huddle.layout import TRACKING
        from huddle.plans.report import tendency_report
        merged = spark.read.parquet(a.merged)
        out = tendency_report(spark, merged, TRACKING, a.event, a.before_event, one_frame=a.one_frame)
        for name, df in out.items():
            df.write.mode("overwrite").parquet(f"{a.out.rstrip('/')}/{name}")


if __name__ == "__main__":
    main()
