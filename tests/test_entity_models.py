"""Players that grow in step have the trees, votes and accuracies of players one by one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from huddle.operators import entity_models as em


def test_votes_in_step_are_those_of_single_players():
    assert em._draws_known(4, 2)
    rng = np.random.default_rng(5)
    n, m = rng.integers(1, 40, 25), rng.integers(1, 9, 25)

    def features(width):
        # ties in all features; the last has, for some, neighbours without a number between them
        near = 1 + np.finfo(float).eps * (1 + rng.integers(0, 2, (25, width)))
        near[5:] = 1.0
        return np.stack([rng.integers(0, 5, (25, width)) / 3, rng.normal(size=(25, width)).round(1), rng.integers(0, 2, (25, width)) / 1, near])

    x, test = features(n.max()), features(m.max())
    y = rng.integers(0, 2, (25, n.max())).astype(float)
    said, odd = em.votes_in_step(x, y, n, test, 12, 5, 42)
    assert odd.any() and not odd.all()
    for k in np.flatnonzero(~odd):
        trees = em.fit_trees(x[:, k, :n[k]].T, y[k, :n[k]], 12, 5, 42)
        assert (em.vote(trees, test[:, k].T) == said[k]).all()


def test_players_in_step_are_not_one_call_a_player(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(i % 11), i, float(a), float(b), float(c) if i % 90 else float("nan"), "right" if a + c > 1 else "left")
            for i, (a, b, c) in enumerate(rng.random((500, 3)).round(2))]
    rows += [(20, 1000 + i, 0.5, 0.5, 0.5, "left") for i in range(5)] + [(None, 2000 + i, 0.5, 0.5, 0.5, "left") for i in range(30)]
    df = spark.createDataFrame(rows + rows[:30], "player long, play long, a double, b double, c double, side string").repartition(7)

    def run(**kw):
        out = em.entity_models(spark, df, "player", ["a", "b", "c"], "side", ["play"], min_rows=20, **kw)
        return {r.entity: (r.n, r.n_test, r.accuracy) for r in out.collect()}

    alone = run(small=0)
    assert len(alone) == 12 and alone[None][2] is None
    # some players of each kind, and batches smaller than a player
    assert run() == run(small=47) == alone
    monkeypatch.setattr(em, "STEP_ROWS", 5)
    assert run() == alone


def test_counted_trees_are_those_of_sorted_rows():
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 6, 900) / 3, rng.normal(size=900), rng.normal(size=900).round(1), np.where(rng.random(900) < 0.1, np.nan, 1.5)], axis=1)
    y = (x[:, 1] + rng.normal(size=900) > 0.3).astype(float)
    draws, again = np.random.default_rng(11), np.random.default_rng(11)
    counted = em._Counted(x, y)
    for _ in range(12):
        idx = draws.integers(0, 900, 900)
        assert (again.integers(0, 900, 900) == idx).all()
        # the shares are those of the same whole numbers
        assert counted.grow(idx, 5, draws, 2) == em._grow(x[idx], y[idx], 0, 5, again, 2)


def test_large_players_are_fitted_on_all_their_rows(spark, monkeypatch):
    """25,000 training rows and more: the fit sees them all, in one task or over all tasks."""
    ids = spark.range(34_000).selectExpr("id % 34 div 33 AS player", "id AS play", "cast(id * 7919 % 1009 AS double) AS a", "cast(id % 13 AS double) AS b")
    df = ids.selectExpr("*", "CASE WHEN a > 500 + 10 * b THEN 'right' ELSE 'left' END AS side")
    seen, fit = [], em.fit_forests

    def kept(rows, *args):
        seen.append({r["model"]: r["n"] for r in rows.where("fit").groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()})
        return fit(rows, *args)

    monkeypatch.setattr(em, "fit_forests", kept)
    split = em.with_split(df, ["play"]).where("split = 'train'")
    n = {r["player"]: r["count"] for r in split.groupBy("player").count().collect()}
    assert n[0] > 20_000 and 500 < n[1] < 1000

    def run(**kw):
        return {r.entity: (r.n, r.n_test, r.accuracy) for r in em.entity_models(spark, df, "player", ["a", "b"], "side", ["play"], **kw).collect()}

    sizes = []
    data = em._one_by_one
    monkeypatch.setattr(em, "_one_by_one", lambda rows, s, *a: sizes.append({r["_entity"]: r["n"] - r["n_test"] for r in s.collect()}) or data(rows, s, *a))
    alone = run()
    assert not seen and sizes == [n] and alone[0][2] > 0.95
    spread = run(max_fit_rows=5000)
    assert seen == [{"0": n[0]}] and sizes[1] == {1: n[1]}
    assert spread[1] == alone[1] and spread[0][:2] == alone[0][:2] and abs(spread[0][2] - alone[0][2]) < 0.03
