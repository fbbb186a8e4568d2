"""Bucketed tables: no exchange between scan and result, same rows."""

import pytest
from pyspark.sql import functions as F

from huddle.sources import bucketed
from huddle.sources.bucketed import with_play_and_ranks, write_bucketed


def tables(spark, n=400):
    rows = [(k % 60, k % 7, ["T", "G", "TE"][k % 3], k, float((k * 37) % 101)) for k in range(n)]
    t = spark.createDataFrame(rows, "game long, play long, pos string, id long, y double").repartition(5)
    p = spark.range(70).selectExpr("id AS game").join(spark.range(7).selectExpr("id AS play"), how="cross").withColumn(
        "yards", F.col("game") * 10 + F.col("play"))
    return t, p


def test_no_exchange_and_equal_rows(spark):
    t, p = tables(spark)
    args = (["game", "play"], "pos", ["y", "id"], "TE")
    tb, pb = write_bucketed(t, ["game", "play"], 6, ["pos"]), write_bucketed(p, ["game", "play"], 6)
    out = with_play_and_ranks(tb, pb, *args)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 3 and "Window" in plan
    plain = with_play_and_ranks(t, p, *args)
    assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))
    assert out.count() == 400


def test_hot_keys_are_refused(spark, monkeypatch):
    monkeypatch.setattr(bucketed, "LEAST_ROWS", 10)
    t, _ = tables(spark)
    hot = t.withColumn("game", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("game"))).withColumn("play", F.lit(1))
    with pytest.raises(ValueError, match="one row in"):
        write_bucketed(hot, ["game", "play"], 4)
    write_bucketed(t, ["game", "play"], 4)
