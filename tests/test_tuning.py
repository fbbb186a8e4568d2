"""The model-based sampler's densities by hand, and the tuning flow on a small table."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from huddle.layout import DRIVER
from huddle.operators import models
from huddle.operators.tpe import Choice, Integers, ParzenSearch


def test_integer_density_by_hand():
    kind = Integers(1, 9)
    # values 2 and 8 and the prior at 5: the ends are as wide as their gap to 5
    assert kind.kernels([2, 8]) == [(2.0, 3.0), (5.0, 9.0), (8.0, 3.0)]
    got = kind.density([2, 8])
    for v in range(1, 10):
        want = 0.0
        for m, w in ((2, 3), (5, 9), (8, 3)):
            d = NormalDist(m, w)
            want += (d.cdf(v + 0.5) - d.cdf(v - 0.5)) / (d.cdf(9.5) - d.cdf(0.5)) / 3
        assert got[v] == pytest.approx(want, abs=1e-12)
    assert sum(got.values()) == pytest.approx(1) and got[2] == pytest.approx(got[8])
    assert set(Integers(4, 4).density([4, 4])) == {4}


def test_equal_values_keep_a_least_width():
    kind = Integers(50, 300)
    assert min(w for _, w in kind.kernels([60] * 5)) >= 251 / 100
    assert sum(kind.density([60] * 5).values()) == pytest.approx(1)


def test_choice_density_by_hand():
    assert Choice(("a", "b")).density(["a", "a", "b"]) == {"a": 3 / 5, "b": 2 / 5}
    assert Choice(("a", "b")).density([]) == {"a": 1 / 2, "b": 1 / 2}


def test_the_largest_ratio_is_asked():
    search = ParzenSearch({"x": Integers(0, 20), "c": Choice(("u", "v"))}, seed=1, candidates=500)
    history = [({"x": x, "c": "u" if x > 14 else "v"}, float(x)) for x in range(20)]
    assert search.n_good(20) == 2 and search.n_good(400) == 25
    good, rest = [19, 18], list(range(18))
    high, low = Integers(0, 20).density(good), Integers(0, 20).density(rest)
    asked = search.ask(history, 1)[0]
    assert asked == {"x": max(high, key=lambda v: math.log(high[v]) - math.log(low[v])), "c": "u"}


def test_asks_are_repeatable_and_startup_is_random():
    space = models.TUNED_SPACE
    a, b = ParzenSearch(space, 7), ParzenSearch(space, 7)
    first = a.ask([], 10)
    assert first == b.ask([], 10) and first != ParzenSearch(space, 8).ask([], 10)
    scored = [(p, None if k == 3 else p["max_depth"] / 20) for k, p in enumerate(first)]
    assert a.ask(scored, 5) == b.ask(scored, 5)
    for p in a.ask(scored, 5):
        assert all(s.low <= p[n] <= s.high if isinstance(s, Integers) else p[n] in s.options for n, s in space.items())


def test_better_than_random_on_a_known_function():
    space = {"x": Integers(0, 200), "y": Integers(0, 200)}
    score = lambda p: -abs(p["x"] - 160) - abs(p["y"] - 30)
    wins = 0
    for seed in range(10):
        search, history = ParzenSearch(space, seed), []
        while len(history) < 50:
            history += [(p, score(p)) for p in search.ask(history, 10)]
        rng = random.Random(seed)
        blind = max(score({n: s.random(rng) for n, s in space.items()}) for _ in range(50))
        wins += max(s for _, s in history) > blind
    assert wins >= 8


def wide(spark, n=240):
    rnd = random.Random(3)
    rows = []
    for k in range(n):
        a, b, c = rnd.randrange(10), rnd.randrange(10), rnd.randrange(3)
        rows.append((k, k % 7, "right" if a + b + rnd.random() * 4 > 11 else "left", float(a), float(b), float(c), ["p", "q", None][k % 3]))
    return spark.createDataFrame(rows, "o_custkey long, l_orderkey long, run_dir string, a double, b double, c double, seg string")


FEATURES = ["a", "b", "c"]


def test_tuned_forest_on_a_small_table(spark):
    space = {"n_estimators": Integers(2, 4), "max_depth": Integers(1, 4), "min_samples_split": Integers(2, 6),
             "min_samples_leaf": Integers(1, 3), "max_features": Choice(("sqrt", "log2"))}
    out = models.tuned_forest(spark, wide(spark), FEATURES, "run_dir", DRIVER.keys, 12, 10, space=space).collect()
    assert [r["trial"] for r in out] == list(range(12)) and sum(r["best"] for r in out) == 1
    best, = [r for r in out if r["best"]]
    assert best["val_accuracy"] == max(r["val_accuracy"] for r in out) > 0.6
    assert best["test_accuracy"] > 0.6 and all((r["test_accuracy"] is None) != r["best"] for r in out)
    assert [tuple(r)[1:6] for r in out[:10]] == [tuple(p.values()) for p in ParzenSearch(space, models.SEED).ask([], 10)]


def test_boosted_grid_on_a_small_table(spark):
    out = models.boosted_grid_search(spark, wide(spark), FEATURES, "run_dir", DRIVER.keys, rounds=(2, 4), depths=(1, 2), rates=(0.3,)).collect()
    assert [(r["rounds"], r["depth"], r["rate"]) for r in out] == [(2, 1, 0.3), (2, 2, 0.3), (4, 1, 0.3), (4, 2, 0.3)]
    best, = [r for r in out if r["best"]]
    assert best["cv_accuracy"] == max(r["cv_accuracy"] for r in out) > 0.6 and best["accuracy"] > 0.6


def test_segment_forests_leave_out_small_and_null_segments(spark):
    sizes, forests = models.segment_forests(wide(spark), "seg", FEATURES, "run_dir", DRIVER.keys, 10, spec=models.ForestSpec(3, 2))
    assert {r["model"]: r["n"] for r in sizes.collect()} == {"p": 80, "q": 80}
    assert {r["model"] for r in forests.nodes.select("model").distinct().collect()} == {"p", "q"}
    acc = models.segment_models(wide(spark), "seg", FEATURES, "run_dir", DRIVER.keys, 10, ["q"], models.ForestSpec(3, 2)).collect()
    assert [(r["segment_kind"], r["segment"], r["n"]) for r in acc] == [("seg", "q", 80)] and 0 <= acc[0]["accuracy"] <= 1
    one = wide(spark).withColumn("run_dir", F.lit("left"))
    assert models.segment_models(one, "seg", FEATURES, "run_dir", DRIVER.keys, 10, ["q"], models.ForestSpec(2, 2)).first()["accuracy"] is None


def test_forest_grid_grows_in_one_job(spark, monkeypatch):
    """All points and folds are one call of the forests, the refit another; each point's accuracy is that of its own folds."""
    calls, fit = [], models.fit_forests
    monkeypatch.setattr(models, "fit_forests", lambda rows, specs, *a: calls.append(specs) or fit(rows, specs, *a))
    monkeypatch.setattr(models, "grid", lambda *a: [{p: v for p, v in zip((est.numTrees, est.maxDepth), at)} for at in ((3, 1), (5, 4))])
    est = models.family_estimator("RandomForest")
    out, = models.grid_search(spark, wide(spark), FEATURES, "run_dir", DRIVER.keys, ["RandomForest"]).collect()
    assert [len(c) if isinstance(c, dict) else 1 for c in calls] == [6, 1]
    assert calls[0]["1:2"] == models.ForestSpec(5, 4, 2, 1, "sqrt")
    assert out["family"] == "RandomForest" and out["cv_accuracy"] > 0.6 and out["accuracy"] > 0.6
    assert out["best_params"] in ("[('maxDepth', 1), ('numTrees', 3)]", "[('maxDepth', 4), ('numTrees', 5)]")


def test_random_search_grows_in_one_job(spark, monkeypatch):
    calls, fit = [], models.fit_forests
    monkeypatch.setattr(models, "fit_forests", lambda rows, specs, *a: calls.append(specs) or fit(rows, specs, *a))
    out = models.random_search(spark, wide(spark), FEATURES, "run_dir", DRIVER.keys, 4).collect()
    assert [len(c) if isinstance(c, dict) else 1 for c in calls] == [4, 1] and [r["trial"] for r in out] == [0, 1, 2, 3]
    best = max(out, key=lambda r: (r["val_accuracy"], -r["trial"]))
    assert best["val_accuracy"] > 0.6 and best["test_accuracy"] > 0.6
    assert all((r["test_accuracy"] is None) == (r is not best) for r in out)


def test_repeated_rows_are_rows_of_their_own(spark):
    rows, _ = models.single_rows(models.with_split(wide(spark).union(wide(spark)), DRIVER.keys), FEATURES, "run_dir", DRIVER.keys)
    assert rows.select("row").distinct().count() == 480


def test_importances_of_all_features(spark):
    data = wide(spark).withColumn("same", F.lit(1.0))
    got = {r["feature"]: r["importance"] for r in models.forest_importances(data, [*FEATURES, "same"], "run_dir", DRIVER.keys, models.ForestSpec(9, 4)).collect()}
    assert set(got) == {*FEATURES, "same"} and got["same"] == 0.0
    assert sum(got.values()) == pytest.approx(1) and min(got["a"], got["b"]) > got["c"]


def test_gradient_grid_is_that_of_mllib_without_its_jobs(spark, monkeypatch):
    """Same folds, cuts, trees and accuracies as MLlib's fits; one job for all points and folds and one for the refit."""
    rnd = random.Random(9)
    rows = []
    for k in range(300):
        a, b, c = rnd.random(), rnd.random(), float(rnd.randrange(5))
        rows.append((k, k % 7, "right" if a * b + rnd.random() / 5 > 0.35 else "left", a, b, c))
    data = spark.createDataFrame(rows, "o_custkey long, l_orderkey long, run_dir string, a double, b double, c double")
    monkeypatch.setattr(models, "grid", lambda fam, est, n=1: ParamGridBuilder().addGrid(
        est.maxIter, [1, 3]).addGrid(est.stepSize, [0.3]).addGrid(est.maxDepth, [1, 2]).build())
    calls, grow, found = [], models.first_order_accuracies, {}
    monkeypatch.setattr(models, "first_order_accuracies", lambda rows, specs, *a: calls.append(len(specs)) or grow(rows, specs, *a))
    for limit in (models.GRADIENT_ROWS, 0):
        monkeypatch.setattr(models, "GRADIENT_ROWS", limit)
        found[limit], = models.grid_search(spark, data, FEATURES, "run_dir", DRIVER.keys, ["GradientBoosting"]).collect()
    assert calls == [6, 1]
    new, old = found.values()
    assert new == old and new["cv_accuracy"] > 0.7


def test_variance_splits_are_between_values():
    from huddle.operators.boosting import variance_splits
    assert variance_splits(np.array([3.0, 1.0, 1.0, 2.0])).tolist() == [1.5, 2.5]
    assert variance_splits(np.array([4.0, 4.0])).tolist() == []
    many = variance_splits(np.arange(6400.0))
    assert len(many) == 31 and many[0] == 199.5 and many[-1] == 6199.5


def test_registered_searches_are_whole(spark, monkeypatch):
    """The queries pass on no smaller search than the operators' own: all trials, trees and rounds."""
    from huddle.plans import catalog, modeling
    asked = {}
    monkeypatch.setattr(catalog, "_line_model_table", lambda *a: wide(spark))
    monkeypatch.setattr(modeling, "feature_columns", lambda *a, **kw: FEATURES)
    monkeypatch.setattr(modeling, "tuned_forest", lambda s, t, f, l, k, trials=50, per_round=10, seed=42, space=None: asked.update(
        trials=trials, space=space or models.TUNED_SPACE))
    monkeypatch.setattr(modeling, "boosted_grid_search", lambda s, t, f, l, k, rounds=models.XGB_ROUNDS, **kw: asked.update(rounds=tuple(rounds), **kw))
    catalog.QUERIES["tuned_forest"](spark, "")
    assert asked == {"trials": 50, "space": models.TUNED_SPACE} and asked["space"]["n_estimators"] == Integers(50, 300)
    asked.clear()
    catalog.QUERIES["grid_search_xgboost"](spark, "")
    assert asked == {"rounds": (100, 200)}


def test_searches_do_not_repeat_their_rows_by_model(spark, monkeypatch):
    given, fit = [], models.fit_forests
    monkeypatch.setattr(models, "fit_forests", lambda rows, specs, *a: given.append((rows.count(), a[-1])) or fit(rows, specs, *a))
    models.random_search(spark, wide(spark), FEATURES, "run_dir", DRIVER.keys, 3)
    space = {**models.TUNED_SPACE, "n_estimators": Integers(2, 4)}
    models.tuned_forest(spark, wide(spark), FEATURES, "run_dir", DRIVER.keys, 3, 3, space=space)
    assert len(given) == 4 and all(n <= 240 and scores_only is True for n, scores_only in given)
