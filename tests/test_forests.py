"""The forests of all segments against brute-force trees, and exact folds."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from huddle.operators import forests as fo
from huddle.operators.boosting import binned, candidate_thresholds
from huddle.operators.folds import stratified_folds

FEATURES = ["a", "b", "c", "d"]


def rows(n=260, seed=2):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        x = [rnd.randrange(7), rnd.randrange(5) / 2, rnd.randrange(3), 1]
        y = int(x[0] + 2 * x[1] + rnd.random() * 3 > 6)
        out.append((["s", "t", "hot"][min(k % 5, 2)], k, k % 4 != 0, y, *[float(v) for v in x]))
    return out


def table(spark, data):
    df = spark.createDataFrame(data, "model string, row long, fit boolean, y int, a double, b double, c double, d double").repartition(3)
    thresholds = candidate_thresholds(df, FEATURES)
    return df.withColumn("bins", binned(FEATURES, thresholds)), thresholds


def brute_tree(data, weights, order, thresholds, spec, n_try):
    """node -> (feature, threshold or None, gain, rows, weight, share)."""
    out = {}

    def gini(part):
        n, s = sum(weights[r[1]] for r in part), sum(weights[r[1]] * r[3] for r in part)
        return 2.0 * s * (n - s) / n if n else 0.0

    def grow(part, node, level):
        n, s = sum(weights[r[1]] for r in part), sum(weights[r[1]] * r[3] for r in part)
        best = None
        if len(part) >= spec.min_split and 0 < s < n and level < (spec.depth or 60) and len(part) >= 2 * spec.min_leaf:
            for at in range(0, len(FEATURES), n_try):
                for f in sorted(order(node)[at:at + n_try]):
                    for t in thresholds[f]:
                        left = [r for r in part if r[4 + f] <= t]
                        right = [r for r in part if r[4 + f] > t]
                        # a cut lies at a value of the node
                        if min(len(left), len(right)) < spec.min_leaf or t not in {r[4 + f] for r in left}:
                            continue
                        gain = round(gini(part) - gini(left) - gini(right), 9)
                        if best is None or gain > best[2]:
                            best = (f, t, gain, left, right)
                if best:
                    break
        out[node] = (FEATURES[best[0]] if best else None, best[1] if best else None, best[2] if best else None, len(part), n, s / n)
        if best:
            grow(best[3], 2 * node, level + 1)
            grow(best[4], 2 * node + 1, level + 1)

    part = [r for r in data if r[2] and weights[r[1]]]
    if part:
        grow(part, 1, 0)
    return out


def probability(tree, r):
    node = 1
    while tree[node][0] is not None:
        f = FEATURES.index(tree[node][0])
        node = 2 * node + (r[4 + f] > tree[node][1])
    return tree[node][5]


@pytest.mark.parametrize("spec", [fo.ForestSpec(3, None, 2, 1, "sqrt"), fo.ForestSpec(2, 3, 20, 6, "log2")])
def test_same_trees_as_brute_force(spark, spec):
    data = rows()
    df, thresholds = table(spark, data)
    got = fo.fit_forests(df, spec, FEATURES, thresholds, seed=5)
    base = spark.range(0, len(data)).select(F.col("id").alias("row")).crossJoin(
        spark.range(1, spec.trees + 1).select(F.col("id").cast("int").alias("tree")))
    weight = {(r["tree"], r["row"]): r["w"] for r in base.withColumn("w", fo.poisson_weight("row", 5)).collect()}
    nodes = spark.range(1, 1 << 14).select(F.col("id").alias("node")).crossJoin(
        spark.range(1, spec.trees + 1).select(F.col("id").cast("int").alias("tree")))
    drawn = {(r["tree"], r["node"]): r["o"] for r in nodes.withColumn("o", fo.feature_order(F.col("node"), 4, 5)).collect()}
    fitted = {(r["model"], r["tree"], r["node"]): tuple(r)[3:] for r in got.nodes.collect()}
    trees, want = {}, {}
    for m in ("s", "t", "hot"):
        for t in range(1, spec.trees + 1):
            trees[m, t] = brute_tree([r for r in data if r[0] == m], {r[1]: weight[t, r[1]] for r in data},
                                     lambda node, t=t: drawn[t, node], thresholds, spec, spec.tried(4))
            want |= {(m, t, n): v for n, v in trees[m, t].items()}
    assert set(fitted) == set(want)
    for k, v in want.items():
        assert fitted[k][:2] == v[:2] and fitted[k][3:5] == v[3:5]
        assert fitted[k][2] == (pytest.approx(v[2]) if v[2] is not None else None) and fitted[k][5] == pytest.approx(v[5])
    held = {(r[0], r[1]): sum(probability(trees[r[0], t], r) for t in range(1, spec.trees + 1)) / spec.trees for r in data if not r[2]}
    said = {(r["model"], r["row"]): r for r in got.predictions().collect()}
    assert {k: r["p"] for k, r in said.items()} == pytest.approx(held)
    for r in got.accuracy().collect():
        mine = [x for k, x in said.items() if k[0] == r["model"]]
        assert r["n_test"] == len(mine) and r["accuracy"] == pytest.approx(sum(x["hit"] for x in mine) / len(mine))
    assert sum(r["pred_0"] + r["pred_1"] for r in got.confusion().collect()) == len(held)
    shares = {(r["model"], r["feature"]): r["importance"] for r in got.importances().collect()}
    assert all(f != "d" for _, f in shares)
    for m in ("s", "t", "hot"):
        total = Counter()
        for t in range(1, spec.trees + 1):
            gains = Counter()
            for f, _, g, *_ in trees[m, t].values():
                if f:
                    gains[f] += g
            whole = sum(gains.values())
            for f, g in gains.items():
                total[f] += g / whole / spec.trees
        assert {f: v for (k, f), v in shares.items() if k == m} == pytest.approx(dict(total))


def test_own_settings_per_model(spark):
    data = rows()
    df, thresholds = table(spark, [("x", *r[1:]) for r in data] + [("y", *r[1:]) for r in data])
    got = fo.fit_forests(df, {"x": fo.ForestSpec(4, 1, 2, 1), "y": fo.ForestSpec(2, 5, 2, 1)}, FEATURES, thresholds)
    depth = {r["model"]: (r["t"], r["n"]) for r in got.nodes.groupBy("model").agg(F.max("tree").alias("t"), F.max("node").alias("n")).collect()}
    assert depth["x"][0] == 4 and depth["x"][1] <= 3 and depth["y"][0] == 2 and depth["y"][1] > 3


def test_one_class_and_no_rows(spark):
    df, thresholds = table(spark, [("s", k, k % 2 == 0, 1, 1.0, float(k), 0.0, 0.0) for k in range(40)])
    got = fo.fit_forests(df, fo.ForestSpec(3), FEATURES, thresholds)
    assert {(r["node"], r["feature"], r["share"]) for r in got.nodes.collect()} == {(1, None, 1.0)}
    assert {r["p"] for r in got.predictions().collect()} == {1.0} and got.importances().count() == 0
    none = fo.fit_forests(df.where("false"), fo.ForestSpec(3), FEATURES, thresholds)
    assert none.nodes.count() == 0 and none.accuracy().count() == 0


@pytest.mark.parametrize("bits", [0, 4, 12])
def test_stratified_folds_differ_by_one_at_most(spark, bits):
    data = [(k, "hot" if k % 3 else "rare" if k % 7 else None) for k in range(1000)] + [(5, "hot")] * 20
    df = spark.createDataFrame(data, "play long, side string").repartition(5)
    out = stratified_folds(df, "side", ["play"], 3, bucket_bits=bits)
    assert out.columns == ["play", "side", "fold"] and out.count() == len(data)
    sizes = Counter((r["side"], r["fold"]) for r in out.collect())
    for side in ("hot", "rare", None):
        n = [sizes[side, f] for f in range(3)]
        assert max(n) - min(n) <= 1 and min(n) > 0
    again = stratified_folds(df.repartition(2), "side", ["play"], 3, bucket_bits=12)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_wide_levels_go_on_in_a_long_table(spark, monkeypatch):
    """Few and many nodes a level, dense and sparse counts: the same forests."""
    df, thresholds = table(spark, rows())
    spec = fo.ForestSpec(3, 4, 2, 1, "log2")

    def grown():
        got = fo.fit_forests(df, spec, FEATURES, thresholds)
        return sorted(map(str, got.nodes.collect())), sorted(map(str, got.votes.collect()))

    want = grown()
    for name, value in (("MAX_NODES", 10), ("MAX_NODES", 0), ("MAX_DENSE", 0), ("SLICE", 7)):
        with monkeypatch.context() as m:
            m.setattr(fo, name, value)
            assert grown() == want


def test_rows_are_kept_once_for_all_trees(spark, monkeypatch):
    """What a level writes has a row per row of the table, not one per tree."""
    df, thresholds = table(spark, rows())
    sizes, write = [], fo.cut_lineage

    def counted(out, name, *args):
        out = write(out, name, *args)
        if name == "forest-rows":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(fo, "cut_lineage", counted)
    fo.fit_forests(df, fo.ForestSpec(4, 2, 2, 1, "log2"), FEATURES, thresholds)
    assert sizes and max(sizes) <= df.count()


@pytest.mark.parametrize("spec", [fo.ForestSpec(5, 5, 2, 1, "sqrt"), fo.ForestSpec(4, 3, 6, 3, "log2")])
def test_blocks_of_trees_grow_as_levels_do(spark, monkeypatch, spec):
    """Models that a task can hold, too large ones and both at once: the same forests."""
    df, thresholds = table(spark, rows() + [("hot", *r[1:]) for r in rows(40, 5)] + [("none", k, False, k % 2, 1.0, 0.5, 2.0, 1.0) for k in range(5)])

    def grown():
        got = fo.fit_forests(df.where("model <> 'hot' or row % 3 > 0"), spec, FEATURES, thresholds, 9)
        return sorted(map(str, got.nodes.collect())), sorted(map(str, got.votes.collect())), got.nodes.schema, got.votes.schema

    want = grown()
    assert len(want[0]) > 50 and want[1]
    for changed in ({"BLOCK": 1, "SLICE": 7}, {"LOCAL_ROWS": 60}, {"LOCAL_ROWS": 0, "MAX_NODES": 10}):
        with monkeypatch.context() as m:
            for name, value in changed.items():
                m.setattr(fo, name, value)
            assert grown() == want


def test_no_job_a_level(spark, monkeypatch):
    """Deep forests of small models write their rows, then their blocks; nothing a level."""
    df, thresholds = table(spark, rows())
    written, write = [], fo.cut_lineage
    monkeypatch.setattr(fo, "cut_lineage", lambda out, name, *args: written.append(name) or write(out, name, *args))
    fo.fit_forests(df, fo.ForestSpec(4, None, 2, 1, "sqrt"), FEATURES, thresholds)
    assert written == ["forest-rows", "forest-blocks"]


def test_scores_of_shared_rows_are_those_of_rows_by_model(spark):
    """Rows that all models share, hashed in the tasks (whole numbers, some null) or by Spark (text): the same votes, added up."""
    df, thresholds = table(spark, rows())
    specs = {"x": fo.ForestSpec(5, None, 2, 1, "sqrt"), "y": fo.ForestSpec(3, 4, 6, 2, "log2")}
    whole = F.col("row")
    for row in (F.struct(whole, F.when(whole % 3 > 0, (whole % 7).cast("int")).alias("k")), F.concat(F.lit("r"), whole.cast("string"))):
        base = df.withColumn("row", row)
        by_model = base.drop("model").crossJoin(spark.createDataFrame([("x",), ("y",)], "model string"))
        want = {(r["model"], str(r["row"])): r["p"] for r in fo.fit_forests(by_model, specs, FEATURES, thresholds, 9).predictions().collect()}
        got = fo.fit_forests(base.drop("model"), specs, FEATURES, thresholds, 9, True)
        assert got.nodes is None and {(r["model"], str(r["row"])): r["p"] for r in got.predictions().collect()} == pytest.approx(want)
        assert len(want) == 2 * df.where("not fit").count() and got.said.count() <= 12 * len(want)


def test_weights_of_tasks_are_those_of_spark(spark):
    data = [(k, None if k % 5 == 0 else k % 11) for k in range(500)]
    df = spark.createDataFrame(data, "a long, b int").select(F.struct("a", "b").alias("row")).withColumn("tree", F.lit(7))
    want = [r["w"] for r in df.select("row", fo.poisson_weight("row", 42).alias("w")).orderBy("row.a").collect()]
    b, nulls = np.array([v or 0 for _, v in data]), np.array([v is None for _, v in data])
    assert fo._weights([(np.arange(500), None, True), (b, nulls, False)], 7, 42).tolist() == want and max(want) > 2


def test_cells_by_sorting_are_those_by_counting():
    rng = np.random.default_rng(4)
    code, w = rng.integers(0, 4000, 3000), rng.integers(1, 9, 3000) + float(fo.UNIT)
    for a, b in zip(fo._cells_of(code, w, 2000), fo._cells_of(code, w, 1 << 40)):
        assert (a == b).all()
