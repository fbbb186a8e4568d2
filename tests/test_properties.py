"""Properties on random plays, checked against brute force in plain Python."""

from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from huddle.layout import FULL_SLOTS, TRACKING
from huddle.operators.evaluate import confusion_matrix
from huddle.plans.features import snap_features
from tests.tracking import frame, player

ROLES = ["T", "G", "C", "TE", "QB"]
LOCS = ["INSIDE_LEFT", "OUTSIDE_RIGHT", "UP_THE_MIDDLE"]

players_st = st.lists(
    st.tuples(st.integers(0, 5), st.sampled_from(ROLES), st.integers(0, 30)),
    min_size=1, max_size=60)
plays_st = st.dictionaries(st.integers(0, 5), st.sampled_from(LOCS), min_size=1, max_size=6)


def brute_wide(rows):
    """Reference semantics with the tie-break rule, in plain Python."""
    by_play = defaultdict(list)
    for r in rows:
        by_play[(r[0], r[1])].append(r)
    out = {}
    for key, rs in by_play.items():
        loc = rs[0][15]
        side = "left" if "LEFT" in loc else "right" if "RIGHT" in loc else None
        ranked = {}
        for role in ("T", "G", "C", "TE"):
            ranked[role] = sorted([r for r in rs if r[13] == role], key=lambda r: (r[7], r[2]))
        cells = {}
        for s in FULL_SLOTS:
            lst = ranked[s.role]
            cells[s.name] = lst[s.index - 1] if len(lst) >= s.index else None
        n_te = len(ranked["TE"])
        if side is None or any(v is None for v in cells.values()):
            continue
        cy = cells["C"][7]
        out[key] = {
            "num_TEs": n_te,
            **{f"{n}_y": (c[7] if n == "C" else c[7] - cy) for n, c in cells.items()},
            **{f"{n}_dir": c[12] for n, c in cells.items()},
        }
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(players=players_st, plays=plays_st)
def test_wide_features_equal_brute_force(spark, players, plays):
    rows = []
    for i, (p, role, y) in enumerate(players):
        if p not in plays:
            continue
        rows.append(player(1, p, i, role, float(y), loc=plays[p], dir_=float(i)))
    if not rows:
        return
    got = {(r.gameId, r.playId): r.asDict() for r in snap_features(frame(spark, rows), TRACKING).collect()}
    want = brute_wide(rows)
    assert set(got) == set(want)
    for k, w in want.items():
        for c, v in w.items():
            assert got[k][c] == v, (k, c)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["left", "right", None]), st.sampled_from(["left", "right"])),
                min_size=1, max_size=80))
def test_confusion_matrix_sums_to_labelled_rows(spark, pairs):
    df = spark.createDataFrame(pairs, "label string, prediction string")
    cm = confusion_matrix(df, ["left", "right"]).collect()
    assert sum(r.pred_left + r.pred_right for r in cm) == sum(1 for a, _ in pairs if a is not None)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(LOCS + ["LEFT_RIGHT", "X"]), min_size=1, max_size=50))
def test_left_right_null_partition_rows(spark, locs):
    from pyspark.sql import functions as F

    from huddle.functions.expressions import direction_label
    df = spark.createDataFrame([(x,) for x in locs], "t string").select(direction_label("t").alias("d"))
    counts = {r.d: r.n for r in df.groupBy("d").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == len(locs)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 40), st.sampled_from(["view", "click", "purchase"])),
                min_size=1, max_size=80, unique_by=lambda t: (t[0], t[1])))
def test_previous_row_before_last_equals_row_number_form(spark, evs):
    from huddle.operators.frames import previous_row_before_last
    rows = [(u, t, i, kind, float(i)) for i, (u, t, kind) in enumerate(evs)]
    df = spark.createDataFrame(rows, "user_id long, ts long, event_id long, event_type string, value double")
    got = {r.user_id: (r.frame_no, r.event_id) for r in
           previous_row_before_last(df, "user_id", ["ts", "event_id"], "event_type", "purchase",
                                    carry=["event_type", "value"]).collect()}
    want = {}
    by_user = defaultdict(list)
    for r in rows:
        by_user[r[0]].append(r)
    for u, rs in by_user.items():
        rs.sort(key=lambda r: (r[1], r[2]))
        last = max((i for i, r in enumerate(rs) if r[3] == "purchase"), default=None)
        if last is not None and last > 0:
            want[u] = (last, rs[last - 1][2])  # 1-based frame of the previous row is `last`
    assert got == want
