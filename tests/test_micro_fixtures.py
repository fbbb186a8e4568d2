"""Hand-worked edge cases of FIXTURES.md section 3, on the tracking layout."""

from pyspark.sql import functions as F

from huddle.layout import LINE_SLOTS, TRACKING
from huddle.operators.frames import frame_before_event
from huddle.operators.joins import fanout_report
from huddle.operators.tendencies import leaderboard_total, min_group_size, top_bottom
from huddle.plans.features import line_only_features, snap_features
from huddle.plans.study import side_tendencies, study_rows
from huddle.sources.readers import normalize_nulls
from tests.tracking import LINE, frame, play, player


def wide(spark, rows, **kw):
    return {(r.gameId, r.playId): r for r in snap_features(frame(spark, rows), TRACKING, **kw).collect()}


def test_plain_play(spark):
    out = wide(spark, play(1, 1))
    r = out[(1, 1)]
    assert r.num_TEs == 1 and r.run_dir == "left"
    assert r.C_y == 25.0  # the center keeps its absolute coordinate
    assert (r.LT_y, r.LG_y, r.RG_y, r.RT_y, r.TE_y) == (-15.0, -5.0, 5.0, 15.0, 20.0)
    assert r.possessionTeam == "KC" and r.offenseFormation == "SHOTGUN"


def test_no_te_dropped_with_six_slots_kept_with_five(spark):
    rows = play(1, 2, roles=LINE)
    assert wide(spark, rows) == {}
    five = line_only_features(frame(spark, rows), TRACKING).collect()
    assert len(five) == 1 and five[0].C_y == 25.0


def test_two_tes_counted_lowest_takes_the_slot(spark):
    r = wide(spark, play(1, 3, roles=LINE + [("TE", 50.0), ("TE", 45.0)]))[(1, 3)]
    assert r.num_TEs == 2 and r.TE_y == 20.0


def test_third_tackle_has_no_slot(spark):
    r = wide(spark, play(1, 4, roles=LINE + [("TE", 45.0), ("T", 60.0)]))[(1, 4)]
    assert r.RT_y == 15.0


def test_tie_on_y_broken_by_id_and_stable_under_repartition(spark):
    roles = [("T", 10.0), ("T", 10.0), ("G", 20.0), ("C", 25.0), ("G", 30.0), ("TE", 45.0)]
    rows = play(1, 5, roles=roles, dir_=0.0)
    rows = [r[:12] + (float(r[2]),) + r[13:] for r in rows]  # dir = player id
    a = snap_features(frame(spark, rows), TRACKING).collect()
    b = snap_features(frame(spark, rows).repartition(7), TRACKING).collect()
    assert a == b and a[0].LT_dir == 500.0 and a[0].RT_dir == 501.0


def test_no_center_dropped(spark):
    assert wide(spark, play(1, 6, roles=[r for r in LINE if r[0] != "C"] + [("TE", 45.0)])) == {}


def test_two_centers_one_reference_no_fan_out(spark):
    rows = play(1, 7, roles=LINE + [("TE", 45.0), ("C", 27.0)])
    out = snap_features(frame(spark, rows), TRACKING).collect()
    assert len(out) == 1 and out[0].C_y == 25.0 and out[0].LT_y == -15.0


def test_neither_side_dropped_both_texts_left(spark):
    assert wide(spark, play(1, 8, loc="UP_THE_MIDDLE")) == {}
    assert wide(spark, play(1, 9, loc="LEFT_THEN_RIGHT"))[(1, 9)].run_dir == "left"


def test_pass_wins_over_run(spark):
    assert wide(spark, play(1, 10, pass_result="C")) == {}


def test_null_formation_dropped(spark):
    assert wide(spark, play(1, 11, formation=None)) == {}


def test_nan_measure_normalised_and_dropped(spark):
    rows = play(1, 12)
    rows[0] = rows[0][:12] + (float("nan"),) + rows[0][13:]
    from huddle.operators.frames import event_frame_filter
    # Spark's not-null test keeps NaN; after normalisation the filter drops the row
    assert event_frame_filter(frame(spark, rows), TRACKING).count() == 6
    assert event_frame_filter(normalize_nulls(frame(spark, rows)), TRACKING).count() == 5
    # either way the play has no complete LT slot and leaves the wide table
    assert snap_features(frame(spark, rows), TRACKING).collect() == []
    assert snap_features(normalize_nulls(frame(spark, rows)), TRACKING).collect() == []


def test_na_text_counts_as_run(spark):
    df = normalize_nulls(frame(spark, play(1, 13, pass_result="NA")))
    assert len(snap_features(df, TRACKING).collect()) == 1


def test_null_yards_left_null(spark):
    df = frame(spark, play(1, 14, yards=None)).fillna(0, subset=["x"])
    assert df.filter(F.col("yardsGained").isNull()).count() == 6


def test_event_twice_uses_last_frame(spark):
    rows = (play(1, 15, frame=5, event="ball_snap") + play(1, 15, frame=8, event="ball_snap")
            + play(1, 15, frame=7, event=None))
    out = frame_before_event(frame(spark, rows), ["gameId", "playId"], "frameId", "event", "ball_snap")
    assert {r.frameId for r in out.collect()} == {7}


def test_event_on_first_frame_dropped(spark):
    rows = play(1, 16, frame=1, event="ball_snap")
    out = frame_before_event(frame(spark, rows), ["gameId", "playId"], "frameId", "event", "ball_snap")
    assert out.count() == 0


def test_before_snap_features(spark):
    rows = play(1, 17, frame=9, event=None) + play(1, 17, frame=10, event="ball_snap", x=99.0)
    out = snap_features(frame(spark, rows), TRACKING, before_event=True).collect()
    assert len(out) == 1


def test_same_name_reported(spark):
    players = spark.createDataFrame([(1, "Sam"), (2, "Sam"), (3, "Lee")], "nflId long, displayName string")
    rep = fanout_report(players, "displayName", "nflId").collect()
    assert [(r.displayName, r.n_rows) for r in rep] == [("Sam", 2)]


def test_one_sided_player_last_on_leaderboard(spark):
    roles = LINE + [("TE", 45.0)]
    rows = [player(1, 20, i, p, y, loc="INSIDE_LEFT", dir_=90.0 + i) for i, (p, y) in enumerate(roles)]
    rows += [player(1, 21, i, p, y, loc="INSIDE_RIGHT", dir_=80.0) for i, (p, y) in enumerate(roles)]
    rows += [player(1, 22, 99, "TE", 50.0, loc="INSIDE_LEFT")]  # player 99 only runs left
    rows += [player(1, 22, i, p, y, loc="INSIDE_LEFT") for i, (p, y) in enumerate(LINE)]
    diff = side_tendencies(study_rows(frame(spark, rows), TRACKING), TRACKING)
    board = leaderboard_total(diff, ["nflId", "true_position"], 50).collect()
    assert board[-1].nflId == 99 and board[-1].total_diff is None
    assert all(r.total_diff is not None for r in board[:-1])


def test_small_group_skipped(spark):
    df = spark.range(0, 199).selectExpr("id", "CASE WHEN id < 99 THEN 'a' ELSE 'b' END AS g")
    kept = min_group_size(df, ["g"], 100).select("g").distinct().collect()
    assert [r.g for r in kept] == ["b"]


def test_under_six_segments_repeat(spark):
    acc = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.3), ("d", 0.4)], "team string, accuracy double")
    out = top_bottom(acc, "accuracy", ["team"], 3).collect()
    assert len(out) == 6 and sorted(r.team for r in out) == ["a", "b", "b", "c", "c", "d"]


def test_line_only_schema(spark):
    out = line_only_features(frame(spark, play(1, 30)), TRACKING)
    assert out.columns == ["gameId", "playId", "run_dir"] + [f"{s.name}_{m}" for s in LINE_SLOTS
                                                             for m in ("y", "dir", "o")]


def test_event_twice_one_frame(spark):
    rows = play(1, 40, frame=5, event="ball_snap") + play(1, 40, frame=8, event="ball_snap", dir_=7.0)
    # without one_frame both frames' rows rank together: the tackles of the
    # two frames fill LT and RT (the duplicate-player behaviour)
    both = snap_features(frame(spark, rows), TRACKING).collect()
    assert len(both) == 1 and both[0].num_TEs == 2
    last = snap_features(frame(spark, rows), TRACKING, one_frame=True).collect()
    assert len(last) == 1 and last[0].num_TEs == 1 and last[0].LT_dir == 7.0 and last[0].RT_y == 15.0
