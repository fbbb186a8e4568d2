"""Builders of small tracking-shaped tables for the micro fixtures."""

from __future__ import annotations

from pyspark.sql import types as T

TRACKING_SCHEMA = T.StructType([
    T.StructField("gameId", T.LongType()),
    T.StructField("playId", T.LongType()),
    T.StructField("nflId", T.LongType()),
    T.StructField("displayName", T.StringType()),
    T.StructField("frameId", T.IntegerType()),
    T.StructField("event", T.StringType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("s", T.DoubleType()),
    T.StructField("a", T.DoubleType()),
    T.StructField("dis", T.DoubleType()),
    T.StructField("o", T.DoubleType()),
    T.StructField("dir", T.DoubleType()),
    T.StructField("position", T.StringType()),
    T.StructField("passResult", T.StringType()),
    T.StructField("rushLocationType", T.StringType()),
    T.StructField("absoluteYardlineNumber", T.DoubleType()),
    T.StructField("yardsGained", T.DoubleType()),
    T.StructField("offenseFormation", T.StringType()),
    T.StructField("possessionTeam", T.StringType()),
])

LINE = [("T", 10.0), ("G", 20.0), ("C", 25.0), ("G", 30.0), ("T", 40.0)]


def player(game, play, nfl, pos, y, frame=10, event="ball_snap", name=None, loc="INSIDE_LEFT", pass_result=None,
           formation="SHOTGUN", team="KC", yards=4.0, dir_=90.0, o=80.0, x=50.0):
    return (game, play, nfl, name or f"P{nfl}", frame, event, x, y, 1.0, 1.0, 0.1, o, dir_, pos, pass_result,
            loc, 45.0, yards, formation, team)


def play(game, play_id, roles=LINE + [("TE", 45.0)], **kw):
    rows = []
    for i, (pos, y) in enumerate(roles):
        rows.append(player(game, play_id, play_id * 100 + i, pos, y, **kw))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, TRACKING_SCHEMA)
