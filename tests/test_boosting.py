"""Second-order boosting against a brute-force version of the same formulas."""

import math
import random

import pytest
from pyspark.sql import functions as F

from huddle.operators import boosting as bo


def data(n=300, seed=1):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        x = [rnd.randrange(6), rnd.randrange(9) / 2, rnd.randrange(3)]
        y = 1.0 if x[0] + x[1] + rnd.random() * 3 > 5 else 0.0
        rows.append((k, *[float(v) for v in x], y))
    return rows


FEATURES = ["a", "b", "c"]


def brute(rows, thresholds, spec):
    """Per round the nodes (path: feature, threshold, gain / leaf weight)."""
    margin = {r[0]: 0.0 for r in rows}
    rounds = []
    for _ in range(spec.rounds):
        stat = {}
        for r in rows:
            p = 1 / (1 + math.exp(-margin[r[0]]))
            stat[r[0]] = (p - r[4], p * (1 - p))
        nodes = {}

        def grow(part, node, level):
            g, h = (sum(stat[r[0]][i] for r in part) for i in (0, 1))
            best = None
            if level < spec.depth:
                for f in range(3):
                    for t in thresholds[f]:
                        left = [r for r in part if r[1 + f] <= t]
                        gl, hl = (sum(stat[r[0]][i] for r in left) for i in (0, 1))
                        gr, hr = g - gl, h - hl
                        if hl < spec.min_child_weight or hr < spec.min_child_weight:
                            continue
                        lam = spec.reg_lambda
                        gain = (gl ** 2 / (hl + lam) + gr ** 2 / (hr + lam) - g ** 2 / (h + lam)) / 2 - spec.gamma
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-7):
                            best = (gain, f, t)
            if best is None:
                nodes[node] = -spec.rate * g / (h + spec.reg_lambda)
                for r in part:
                    margin[r[0]] += nodes[node]
                return
            nodes[node] = best
            grow([r for r in part if r[1 + best[1]] <= best[2]], 2 * node, level + 1)
            grow([r for r in part if r[1 + best[1]] > best[2]], 2 * node + 1, level + 1)

        grow(rows, 1, 0)
        rounds.append(nodes)
    return rounds, margin


def long_table(spark, rows, specs, fit):
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(3)
    thresholds = bo.candidate_thresholds(df, FEATURES)
    df = df.withColumn("bins", bo.binned(FEATURES, thresholds))
    return thresholds, df.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(len(specs) - 1)))).withColumn("fit", fit)


@pytest.mark.parametrize("spec", [bo.BoostSpec(4, 3, 0.3), bo.BoostSpec(3, 2, 0.5, reg_lambda=2.0, gamma=0.5, min_child_weight=4.0)])
def test_gains_and_weights_equal_brute_force(spark, spec):
    rows = data()
    other = bo.BoostSpec(2, 1, 1.0)
    scored = {}
    thresholds, table = long_table(spark, rows, [spec, other], F.lit(True))
    assert thresholds == [sorted({r[1 + f] for r in rows})[:-1] for f in range(3)]
    models = bo.fit_boosted(table, [spec, other], FEATURES, thresholds, lambda r, s: scored.update({r: s}))
    for k, sp in enumerate((spec, other)):
        want, margin = brute(rows, thresholds, sp)
        assert len(models[k].trees) == sp.rounds
        for nodes, tree in zip(want, models[k].trees):
            for n, v in nodes.items():
                if isinstance(v, tuple):
                    assert (tree.feature[n], thresholds[v[1]][tree.bin[n]]) == (v[1], v[2])
                    assert tree.gain[n] == pytest.approx(v[0], abs=1e-4)
                else:
                    assert tree.feature[n] == -1 and tree.weight[n] == pytest.approx(v, abs=1e-6)
        got = {r["id"]: r["margin"] for r in scored[sp.rounds].where(F.col("model") == k).collect()}
        assert got == pytest.approx(margin, abs=1e-5)
        # the same from the compiled expression over the raw features
        df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
        assert {r["id"]: r["m"] for r in df.select("id", models[k].margin().alias("m")).collect()} == pytest.approx(margin, abs=1e-5)
    shares = models[0].importances()
    assert sum(shares.values()) == pytest.approx(1) and shares["a"] > shares["c"]


def test_rows_not_fit_on_are_routed_but_not_counted(spark):
    rows, spec = data(), bo.BoostSpec(3, 2, 0.3)
    scored = []
    thresholds, table = long_table(spark, rows, [spec], F.col("id") % 3 != 0)
    bo.fit_boosted(table, [spec], FEATURES, thresholds, lambda r, s: scored.append(s))
    _, margin = brute([r for r in rows if r[0] % 3], thresholds, spec)
    got = {r["id"]: r["margin"] for r in scored[0].collect()}
    assert len(got) == len(rows)
    assert {k: v for k, v in got.items() if k % 3} == pytest.approx(margin, abs=1e-5)


def test_one_class_no_rows_and_constant_features(spark):
    for rows in ([(k, 1.0, 2.0, 3.0, 1.0) for k in range(5)], []):
        df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
        thresholds = bo.candidate_thresholds(df, FEATURES)
        assert thresholds == [[], [], []]
        table = df.withColumns({"bins": bo.binned(FEATURES, thresholds), "model": F.lit(0), "fit": F.lit(True)})
        model, = bo.fit_boosted(table, [bo.BoostSpec(2, 2)], FEATURES, thresholds)
        assert df.select(model.margin().alias("m")).where("m > 0").count() == len(rows)


def test_too_many_cells_are_refused(spark):
    with pytest.raises(ValueError):
        bo.fit_boosted(None, [bo.BoostSpec(1, 20)], FEATURES, [[0.0] * 31] * 3)


def test_models_in_one_task_grow_as_levels_do(spark):
    """The same trees and margins at every stop, models without rows included."""
    rows, specs = data(), [bo.BoostSpec(5, 3, 0.3), bo.BoostSpec(2, 1, 1.0), bo.BoostSpec(5, 4, 0.5, gamma=0.5, min_child_weight=4.0), bo.BoostSpec(3, 2)]
    thresholds, table = long_table(spark, rows, specs, F.col("id") % 3 != 0)
    table = table.where("model < 3")

    def grown(local_rows):
        scored = {}
        models = bo.fit_boosted(table, specs, FEATURES, thresholds, lambda r, s: scored.update({r: s}), [4], local_rows)
        return models, {r: {(x["model"], x["id"]): x["margin"] for x in s.collect()} for r, s in scored.items()}

    (want, at), (got, here) = grown(0), grown(len(rows))
    assert sorted(here) == sorted(at) == [2, 3, 4, 5]
    for r in at:
        assert len(here[r]) == 3 * len(rows) and here[r] == pytest.approx(at[r], abs=1e-9)
    for a, b in zip(want, got):
        assert len(a.trees) == len(b.trees)
        for s, t in zip(a.trees, b.trees):
            assert (s.feature == t.feature).all() and (s.bin == t.bin).all() and abs(s.weight - t.weight).max() < 1e-9


def test_no_job_a_level_for_small_models(spark, monkeypatch):
    specs = [bo.BoostSpec(6, 3)] * 2
    thresholds, table = long_table(spark, data(), specs, F.lit(True))
    monkeypatch.setattr(bo, "_histograms", lambda *a: pytest.fail("a job a level"))
    assert [len(m.trees) for m in bo.fit_boosted(table, specs, FEATURES, thresholds, local_rows=300)] == [6, 6]
