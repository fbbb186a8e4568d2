"""Ingest stream, CSV load + merge, and the end-to-end report on tracking-shaped data."""

import os

import pytest

from pyspark.sql import functions as F

from huddle.layout import TRACKING
from tests.tracking import TRACKING_SCHEMA, LINE, frame, player


def _season(n_plays=40):
    rows = []
    for p in range(n_plays):
        loc = "INSIDE_LEFT" if p % 2 == 0 else "OUTSIDE_RIGHT"
        team = "KC" if p % 3 else "SF"
        for fr, ev in ((9, None), (10, "ball_snap")):
            for i, (pos, y) in enumerate(LINE + [("TE", 45.0)]):
                rows.append(player(p // 10, p, i, pos, y + (p % 7) * 0.1 + i * 0.01, frame=fr, event=ev, loc=loc,
                                   team=team, yards=float(p % 9), dir_=90.0 + (p % 2) * 20 + i, o=80.0 + p % 5))
    return rows


def test_stream_merge_resumes_without_duplicates(spark, tmp_path):
    from huddle.streaming.ingest import stream_merge
    rows = _season(20)
    full = frame(spark, rows)
    track_cols = ["gameId", "playId", "nflId", "displayName", "frameId", "event", "x", "y", "s", "a", "dis", "o",
                  "dir", "position"]
    tracking = full.select(*track_cols)
    plays = full.select("gameId", "playId", "passResult", "rushLocationType", "absoluteYardlineNumber",
                        "yardsGained", "offenseFormation", "possessionTeam").distinct()
    games = plays.select("gameId").distinct()
    players = tracking.select("nflId", "displayName").distinct()
    src = tmp_path / "weeks"
    out = str(tmp_path / "merged")
    tracking.filter("gameId = 0").write.parquet(str(src / "week1"))
    schema = tracking.schema
    q = stream_merge(spark, str(src / "*"), schema, plays, games, players, out, name=f"m{os.getpid()}",
                     rename={"nflId": "player_nflId"})
    q.awaitTermination()
    n1 = spark.read.parquet(out).count()
    tracking.filter("gameId = 1").write.parquet(str(src / "week2"))
    q = stream_merge(spark, str(src / "*"), schema, plays, games, players, out, name=f"m{os.getpid()}",
                     rename={"nflId": "player_nflId"})
    q.awaitTermination()
    merged = spark.read.parquet(out)
    assert n1 == tracking.filter("gameId = 0").count()
    assert merged.count() == tracking.count()
    assert merged.filter(F.col("possessionTeam").isNull()).count() == 0


def test_load_and_merge(spark, tmp_path):
    from huddle.plans.load import load_csv_tables, merge_tables
    full = frame(spark, _season(6))
    d = tmp_path / "csv"
    full.select("gameId", "playId", "nflId", "displayName", "frameId", "event", "x", "y", "s", "a", "dis", "o",
                "dir").filter("playId < 3").toPandas().to_csv(d.mkdir() or d / "tracking_week_1.csv", index=False)
    full.select("gameId", "playId", "nflId", "displayName", "frameId", "event", "x", "y", "s", "a", "dis", "o",
                "dir").filter("playId >= 3").toPandas().to_csv(d / "tracking_week_2.csv", index=False)
    full.select("gameId", "playId", "passResult", "rushLocationType", "absoluteYardlineNumber", "yardsGained",
                "offenseFormation", "possessionTeam").distinct().toPandas().to_csv(d / "plays.csv", index=False)
    full.selectExpr("gameId", "2021 AS season", "7 AS week").distinct().toPandas().to_csv(d / "games.csv", index=False)
    full.select("nflId", "displayName", "position").distinct().toPandas().to_csv(d / "players.csv", index=False)
    t = load_csv_tables(spark, {"tracking": [str(d / "tracking_week_1.csv"), str(d / "tracking_week_2.csv")],
                                "plays": str(d / "plays.csv"), "games": str(d / "games.csv"),
                                "players": str(d / "players.csv")}, str(tmp_path / "pq"))
    merged, report = merge_tables(t["tracking"], t["plays"], t["games"], t["players"],
                                  out_path=str(tmp_path / "merged.parquet"), num_partitions=3)
    back = spark.read.parquet(str(tmp_path / "merged.parquet"))
    assert back.count() == full.count() and "player_nflId" in back.columns
    assert sorted(r.tracking_week for r in t["tracking"].select("tracking_week").distinct().collect()) == [1, 2]
    assert report.count() == 0
    # NA tokens in passResult came back as null, so the run plays survive
    assert back.filter(F.col("passResult").isNull()).count() == full.count()


def test_csv_numeric_columns_keep_their_type_with_missing_tokens(spark, tmp_path):
    from huddle.sources.readers import read_csv
    (tmp_path / "t.csv").write_text("gameId,nflId,dir,o,note\n1,7,12.5,3,x\n1,NA,NA,NA,NA\n")
    df = read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"gameId": "bigint", "nflId": "bigint", "dir": "double", "o": "double", "note": "string"}
    assert [tuple(r) for r in df.orderBy(F.col("nflId").desc()).collect()] == [(1, 7, 12.5, 3.0, "x"), (1, None, None, None, None)]


def test_report_end_to_end(spark):
    from huddle.plans.report import tendency_report
    merged = frame(spark, _season(40))
    out = tendency_report(spark, merged, TRACKING, min_segment=5, min_player=10, min_position=1)
    assert out["wide_features"].count() == 40
    assert out["accuracy_by_team"].count() == 2
    assert out["leaderboard"].count() == 6
    assert out["player_metrics"].count() == 6
    assert out["position_ols"].count() >= 1
    before = tendency_report(spark, merged, TRACKING, before_event=True, min_segment=5, min_player=10)
    assert before["wide_features"].count() == 40


def test_cli_load_merge_report(spark, tmp_path):
    from huddle.__main__ import main
    full = frame(spark, _season(12))
    d = tmp_path / "csv"
    d.mkdir()
    cols = ["gameId", "playId", "nflId", "displayName", "frameId", "event", "x", "y", "s", "a", "dis", "o", "dir"]
    full.select(*cols).filter("playId < 6").toPandas().to_csv(d / "tracking_week_1.csv", index=False)
    full.select(*cols).filter("playId >= 6").toPandas().to_csv(d / "tracking_week_2.csv", index=False)
    full.select("gameId", "playId", "passResult", "rushLocationType", "absoluteYardlineNumber", "yardsGained",
                "offenseFormation", "possessionTeam").distinct().toPandas().to_csv(d / "plays.csv", index=False)
    full.select("gameId").distinct().toPandas().to_csv(d / "games.csv", index=False)
    full.select("nflId", "displayName", "position").distinct().toPandas().to_csv(d / "players.csv", index=False)
    main(["load", "--csv-dir", str(d), "--out", str(tmp_path / "pq")])
    main(["merge", "--parquet-dir", str(tmp_path / "pq"), "--out", str(tmp_path / "merged")])
    main(["report", "--merged", str(tmp_path / "merged"), "--out", str(tmp_path / "report")])
    wide = spark.read.parquet(str(tmp_path / "report" / "wide_features"))
    assert wide.count() == 12
    assert spark.read.parquet(str(tmp_path / "report" / "leaderboard")).count() == 6


def test_stream_wide_features_equals_batch(spark, tmp_path):
    from huddle.plans.features import snap_features
    from huddle.streaming.ingest import stream_wide_features
    merged = frame(spark, _season(30))
    src = tmp_path / "merged"
    for g in range(3):  # three weekly parts, whole plays each
        merged.filter(f"gameId = {g}").write.parquet(str(src / f"week{g}"))
    out = str(tmp_path / "wide")
    q = stream_wide_features(spark, str(src / "*"), merged.schema, TRACKING, out, name=f"w{os.getpid()}")
    q.awaitTermination()
    got = spark.read.parquet(out).drop("batch")
    want = snap_features(merged, TRACKING)
    cols = sorted(want.columns)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_stream_recomputes_plays_split_over_batches(spark, tmp_path):
    from huddle.plans.features import snap_features
    from huddle.streaming.ingest import read_wide_features, stream_wide_features
    merged = frame(spark, _season(12))
    src = tmp_path / "merged"
    # rows of every play land in three files, one file a micro-batch
    for k, part in enumerate(("pmod(hash(nflId), 3) = 0", "pmod(hash(nflId), 3) = 1", "pmod(hash(nflId), 3) = 2")):
        merged.filter(part).coalesce(1).write.parquet(str(src / f"p{k}"))
    out = str(tmp_path / "wide")
    q = stream_wide_features(spark, str(src / "*"), merged.schema, TRACKING, out, name=f"s{os.getpid()}", max_files_per_trigger=1)
    q.awaitTermination()
    assert spark.read.parquet(out + "_rows").select("batch").distinct().count() == 3
    got, want = read_wide_features(spark, out, TRACKING), snap_features(merged, TRACKING)
    cols = sorted(want.columns)
    assert want.count() > 0
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_load_fails_on_a_missing_table(tmp_path):
    from huddle.__main__ import main
    (tmp_path / "games.csv").write_text("gameId\n1\n")
    with pytest.raises(Exception, match="(?i)path"):
        main(["load", "--csv-dir", str(tmp_path), "--out", str(tmp_path / "out")])


WEEKS = (
    "whole,once,num,text,flag,gap,big,mixed,none,sci\n1,1,1.5,a,True,1,99999999999999999999,1,,1e3\n2,2,2,b,False,,2,2,NA,2\n",
    "whole,once,num,text,flag,gap,big,mixed,none,sci\n3,0.5,3,1,True,4,5,x,,.5\n4,7,4,2,True,5,6,y,,-1.\n",
    "whole,once,num,text,flag,gap,big,mixed,none,sci\n5,8,inf,3,False,6,7,True,,3\n",
)


def test_inferred_types_of_parts_that_disagree_equal_the_frame_reader(spark, tmp_path):
    import pandas as pd
    from pyspark.sql import functions as F

    from huddle.sources.readers import merged_types, normalize_nulls, part_types, read_parts
    paths = []
    for k, body in enumerate(WEEKS):
        (tmp_path / f"tracking_week_{k}.csv").write_text(body)
        paths.append(str(tmp_path / f"tracking_week_{k}.csv"))
    frames = [pd.read_csv(p) for p in paths]
    name = {"int64": "bigint", "float64": "double", "bool": "boolean", "object": "string", "str": "string", "uint64": "double"}
    text = normalize_nulls(spark.read.option("header", True).csv(paths)).withColumn("part", F.input_file_name())
    columns = [c for c in text.columns if c != "part"]
    types = part_types(text, "part", columns)
    by_part = {(r["part"].rsplit("_", 1)[1], r["column"]): r["type"] for r in types.collect()}
    for k, f in enumerate(frames):
        for c in columns:
            if c != "big":  # above 64 bits: pandas keeps objects, here a double
                assert by_part[f"{k}.csv", c] == name[str(f[c].dtype)], (k, c)
    whole = pd.concat(frames, ignore_index=True)
    merged = {r["column"]: r["type"] for r in merged_types(types).collect()}
    assert {c: t for c, t in merged.items() if c != "big"} == {c: name[str(whole[c].dtype)] for c in columns if c != "big"}
    # whole numbers in one week only
    assert merged["once"] == "double" and by_part["2.csv", "once"] == "bigint" and merged["whole"] == "bigint"
    df = read_parts(spark, paths, fmt="csv")
    assert dict(df.dtypes) == merged
    got = {r["whole"]: r for r in df.collect()}
    assert got[4]["once"] == 7.0 and got[2]["gap"] is None and got[3]["sci"] == 0.5 and got[5]["mixed"] == "True"
    assert got[5]["num"] == float("inf") and got[1]["big"] == 1e20
