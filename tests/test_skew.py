"""A play holding a third of all rows: results stay whole and exact, and the
ranked rows are limited map-side before the shuffle."""

from pyspark.sql import functions as F

from huddle.layout import TRACKING
from huddle.operators.frames import frame_before_event
from huddle.operators.joins import hot_keys, join_on_name, skewed_join
from huddle.plans.features import snap_features
from huddle.plans.study import side_tendencies, study_rows
from tests.tracking import LINE, frame, player


def _rows():
    rows = []
    for p in range(1, 31):
        for i, (pos, y) in enumerate(LINE + [("TE", 45.0)]):
            rows.append(player(1, p, p * 100 + i, pos, y + p * 0.01, dir_=float(i)))
    # hot play 0: 400 tight ends, 300 guards and tackles each, one center
    hot = [player(1, 0, 100000 + k, "TE", 60.0 - k * 0.01) for k in range(400)]
    hot += [player(1, 0, 200000 + k, "G", 20.0 + k * 0.01) for k in range(300)]
    hot += [player(1, 0, 300000 + k, "T", 10.0 + k * 0.01) for k in range(300)]
    hot += [player(1, 0, 400000, "C", 25.0)]
    return rows + hot


def test_hot_play_exact(spark):
    df = frame(spark, _rows()).repartition(8)
    out = {r.playId: r for r in snap_features(df, TRACKING).collect()}
    assert len(out) == 31
    h = out[0]
    assert h.num_TEs == 400
    assert round(h.TE_y, 6) == round((60.0 - 399 * 0.01) - 25.0, 6)
    assert round(h.LG_y, 6) == round(20.0 - 25.0, 6) and round(h.RG_y, 6) == round(20.01 - 25.0, 6)
    assert round(h.LT_y, 6) == round(10.0 - 25.0, 6) and round(h.RT_y, 6) == round(10.01 - 25.0, 6)


def test_hot_play_study_keeps_every_te(spark):
    df = frame(spark, _rows()).repartition(8)
    rows = study_rows(df, TRACKING)
    assert rows.filter((F.col("playId") == 0) & (F.col("true_position") == "TE")).count() == 400
    diff = side_tendencies(rows, TRACKING)
    assert diff.filter(F.col("nflId") >= 100000).count() == 405  # 400 TE + LG, RG + LT, RT + C


def test_hot_play_frame_before_event(spark):
    rows = [player(1, 0, k % 50, "T", 1.0, frame=k // 50, event=("ball_snap" if k // 50 == 90 else None))
            for k in range(5000)]
    rows += [player(1, p, 1, "T", 1.0, frame=f, event="ball_snap" if f == 3 else None)
             for p in range(1, 20) for f in range(5)]
    out = frame_before_event(frame(spark, rows).repartition(8), ["gameId", "playId"], "frameId", "event",
                             "ball_snap")
    got = {r.playId: r.n for r in out.groupBy("playId").agg(F.count("*").alias("n")).collect()}
    assert got[0] == 50 and all(got[p] == 1 for p in range(1, 20))


def _named(spark):
    # one name on a third of the rows, two players of that name, null names
    facts = [(k, "hot" if k % 3 == 0 else None if k % 10 == 1 else f"n{k % 40}") for k in range(6000)]
    facts += facts[:50]
    dim = [("hot", 1), ("hot", 2), (None, 3), ("n1", 4), ("n1", 4), ("n2", 5), ("unused", 6)]
    return (spark.createDataFrame(facts, "play long, name string").repartition(8),
            spark.createDataFrame(dim, "name string, player long"))


def test_skewed_name_join_has_the_rows_of_the_plain_join(spark):
    facts, dim = _named(spark)
    for how in ("left", "inner"):
        want = sorted(map(str, facts.join(dim, ["name"], how).collect()))
        assert sorted(map(str, skewed_join(facts, dim, ["name"], how, shares=20).collect())) == want
        assert sorted(map(str, skewed_join(facts, dim, ["name"], how, ["play"], shares=7).collect())) == want
    want = sorted(map(str, facts.join(dim, ["name"], "left").collect()))
    assert sorted(map(str, join_on_name(facts, dim, "name").collect())) == want
    empty = facts.where("false")
    assert skewed_join(empty, dim, ["name"], "left").count() == 0
    assert skewed_join(facts, dim.where("false"), ["name"], "left").count() == facts.count()


def test_hot_names_are_few_and_their_rows_are_dealt(spark):
    facts, dim = _named(spark)
    hot = {r["name"]: r["salts"] for r in hot_keys(facts, ["name"], 20).collect()}
    assert hot == {"hot": 7}
    for shares in (3, 10, 100, 1000):
        assert hot_keys(facts, ["name"], shares).count() <= shares
    assert hot_keys(facts.where("false"), ["name"]).count() == 0


def test_whole_ranks_are_dealt_over_more_tasks_as_the_table_grows(spark, tmp_path, monkeypatch):
    """Tasks follow from the rows, not from the session; the ranks are the same, null and repeated rows included."""
    from huddle.plans import catalog
    from huddle.sources import standin
    orders = [(k, k % 7 if k % 5 else None, ["1-URGENT", "5-LOW", None][k % 3], "O", 10.0 * k) for k in range(40)]
    lines = [(k % 41 if k % 11 else None, k % 13, k % 6, float(k % 9) if k % 8 else None, 1.0, 0.1, 0.2, "ANR"[k % 3], "FO"[k % 2]) for k in range(600)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_totalprice double").write.parquet(
        f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines + lines[:50], "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_quantity double, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert standin.sort_tasks(spark, str(tmp_path)) is None
    want = sorted(map(str, catalog.q_rank_in_role(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(standin, "TASK_ROWS", 50)
    assert standin.sort_tasks(spark, str(tmp_path)) == 13
    got = catalog.q_rank_in_role(spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == want and len(want) > 300
    assert "hashpartitioning(l_orderkey" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 13), REPARTITION_BY_NUM" in plan
