"""The whole regression summary against known values and plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from huddle.functions.distributions import betainc, lgamma, t_quantile, t_two_sided
from huddle.operators import regress

# Two-sided 5 % points of Student's t as tables print them.
T_TABLE = {1: 12.706, 2: 4.303, 3: 3.182, 5: 2.571, 10: 2.228, 30: 2.042, 60: 2.000, 120: 1.980, 100_000: 1.960}


def test_t_quantiles_as_printed(spark):
    df = spark.createDataFrame([(v,) for v in T_TABLE], "dof long")
    got = {r["dof"]: r["t"] for r in df.select("dof", t_quantile(0.05, F.col("dof")).alias("t")).collect()}
    assert {k: round(v, 3) for k, v in got.items()} == T_TABLE
    assert spark.range(1).select(t_quantile(0.05, F.lit(0)).alias("t")).first()["t"] is None


def test_both_forms_of_the_quantile_meet(spark):
    df = spark.createDataFrame([(999,), (1000,)], "dof long").select(t_quantile(0.05, F.col("dof")).alias("t"))
    a, b = sorted(r["t"] for r in df.collect())
    assert b - a < 1e-5


def test_p_values_equal_the_closed_forms(spark):
    # 1 degree: 1 - 2 atan(t) / pi; 2 degrees: 1 - t / sqrt(2 + t^2)
    ts = [0.0, 0.01, 0.5, 1.0, 2.0, 10.0, -3.0, 1e6]
    df = spark.createDataFrame([(t,) for t in ts], "t double").select(
        "t", *[t_two_sided(F.col("t"), F.lit(v)).alias(f"p{v}") for v in (1, 2, 7, 5000)])
    for r in df.collect():
        t = abs(r["t"])
        assert r["p1"] == pytest.approx(1 - 2 * math.atan(t) / math.pi if t < 100 else 2 / (math.pi * t), rel=1e-9)
        assert r["p2"] == pytest.approx(1 - t / math.sqrt(2 + t * t) if t < 100 else 1 / t ** 2, rel=1e-8)
        assert r["p7"] == pytest.approx(regress.t_two_sided_p(r["t"], 7), rel=1e-9)
        assert r["p5000"] == pytest.approx(regress.t_two_sided_p(r["t"], 5000), rel=1e-8, abs=1e-300)
    none = spark.range(1).select(t_two_sided(F.lit(None).cast("double"), F.lit(3)).alias("a"), t_two_sided(F.lit(1.0), F.lit(0)).alias("b"),
                                 t_two_sided(F.lit(float("inf")), F.lit(3)).alias("c")).first()
    assert tuple(none) == (None, None, 0.0)


def test_gamma_and_beta(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (2.5,), (10.0,), (400.5,)], "x double").select("x", lgamma(F.col("x")).alias("g"))
    for r in df.collect():
        assert r["g"] == pytest.approx(math.lgamma(r["x"]), rel=1e-12, abs=1e-13)
    # I_x(2, 3) = 6x^2 - 8x^3 + 3x^4
    for x in (0.0, 0.1, 0.45, 0.9, 1.0):
        got = spark.range(1).select(betainc(F.lit(2.0), F.lit(3.0), F.lit(x)).alias("b")).first()["b"]
        assert got == pytest.approx(6 * x ** 2 - 8 * x ** 3 + 3 * x ** 4, abs=1e-13)


def points(n=90, seed=5):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        x = rnd.random() * 4
        out.append((["a", "b"][k % 3 == 0], k // 2, k, x, 1 + 2 * x + rnd.expovariate(1.0)))
    return out


def brute(rows):
    n = len(rows)
    xs, ys = [r[3] for r in rows], [r[4] for r in rows]
    mx, my = sum(xs) / n, sum(ys) / n
    b = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / sum((x - mx) ** 2 for x in xs)
    a = my - b * mx
    e = [y - a - b * x for x, y in zip(xs, ys)]
    sse = sum(v * v for v in e)
    ll = -n / 2 * (math.log(2 * math.pi) + math.log(sse / n) + 1)
    m = [sum(v ** k for v in e) / n for k in (2, 3, 4)]
    s, k = m[1] / m[0] ** 1.5, m[2] / m[0] ** 2
    jb = n / 6 * (s * s + (k - 3) ** 2 / 4)
    tr, det = n + sum(x * x for x in xs), n * sum(x * x for x in xs) - sum(xs) ** 2
    hi = (tr + math.sqrt(tr * tr - 4 * det)) / 2
    return {"df_resid": n - 2, "log_likelihood": ll, "aic": 4 - 2 * ll, "bic": 2 * math.log(n) - 2 * ll, "skew": s, "kurtosis": k,
            "jarque_bera": jb, "prob_jb": math.exp(-jb / 2), "cond_no": math.sqrt(hi / (det / hi)),
            "durbin_watson": sum((p - q) ** 2 for p, q in zip(e[1:], e)) / sse}


@pytest.mark.parametrize("grouped", [True, False])
def test_summary_equals_brute_force(spark, grouped):
    rows = points()
    df = spark.createDataFrame(rows + [("a", 0, 99, None, 1.0)], "g string, o long, t long, x double, y double").repartition(5)
    out = regress.ols_summary(df, "x", "y", ["g"] if grouped else [], order=["o", "t"]).collect()
    assert len(out) == (2 if grouped else 1)
    for r in out:
        mine = brute([p for p in rows if not grouped or p[0] == r["g"]])
        assert {c: r[c] for c in mine} == pytest.approx(mine, rel=1e-8)
        assert 0 < r["prob_omnibus"] < 1 and r["prob_omnibus"] == pytest.approx(math.exp(-r["omnibus"] / 2))
        assert r["low_slope"] < 2 < r["high_slope"] and r["p_f"] == r["p_slope"] < 1e-6
        q = (r["high_slope"] - r["slope"]) / r["se_slope"]
        assert regress.t_two_sided_p(q, r["df_resid"]) == pytest.approx(0.05, rel=1e-9)


def test_omnibus_of_a_known_sample(spark):
    # skewness 0: the first score is that of y = 1 (the tests' convention);
    # recomputed here step by step with plain numbers
    e = [-3.0, -2.0, -1.0, -0.5, 0.5, 1.0, 2.0, 3.0, -1.5, 1.5]
    n = len(e)
    k = (sum(v ** 4 for v in e) / n) / (sum(v * v for v in e) / n) ** 2
    got = spark.range(1).select(regress._kurtosis_z(F.lit(k), F.lit(float(n))).alias("z"), regress._skew_z(F.lit(0.4), F.lit(30.0)).alias("s")).first()
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (k - 3 * (n - 1) / (n + 1)) / math.sqrt(var)
    b = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b * (2 / b + math.sqrt(1 + 4 / b ** 2))
    d = 1 + x * math.sqrt(2 / (a - 4))
    assert got["z"] == pytest.approx((1 - 2 / (9 * a) - math.copysign((abs((1 - 2 / a) / d)) ** (1 / 3), d)) / math.sqrt(2 / (9 * a)))
    y = 0.4 * math.sqrt(31 * 33 / (6 * 28))
    b2 = 3 * (900 + 810 - 70) * 31 * 33 / (28 * 35 * 37 * 39)
    w2 = math.sqrt(2 * (b2 - 1)) - 1
    assert got["s"] == pytest.approx(math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2)))


@pytest.mark.parametrize("chunks", [2, 7, 64])
def test_durbin_watson_over_chunk_borders(spark, chunks):
    rnd = random.Random(1)
    rows = [("hot" if k % 3 else "x", k % 50, k, rnd.gauss(0, 1)) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, o long, t long, e double").repartition(6)
    got = {r["g"]: r["durbin_watson"] for r in regress.durbin_watson(df, "e", ["g"], ["o", "t"], chunks).collect()}
    for g in ("hot", "x"):
        e = [r[3] for r in sorted(rows, key=lambda r: (r[1], r[2])) if r[0] == g]
        assert got[g] == pytest.approx(sum((a - b) ** 2 for a, b in zip(e[1:], e)) / sum(v * v for v in e))


def test_degenerate_groups_give_null(spark):
    rows = [("two", 0, 0, 1.0, 2.0), ("two", 1, 1, 2.0, 5.0), ("flat", 0, 0, 3.0, 1.0), ("flat", 1, 1, 3.0, 4.0), ("flat", 2, 2, 3.0, 9.0)]
    df = spark.createDataFrame(rows, "g string, o long, t long, x double, y double")
    for r in regress.ols_summary(df, "x", "y", ["g"], order=["o"]).collect():
        assert r["p_slope"] is None and r["low_slope"] is None and r["omnibus"] is None
