"""Simple OLS of y on one x, overall or per group.

Coefficients, standard errors, t, R2, adjusted R2 and F come from the
``regr_*`` aggregates (partial aggregates: one pass, skew-safe, any number of
groups in one job).  The Student-t distribution, which SQL lacks, is written
with built-ins (``functions.distributions``); residual tests are aggregates of
the residuals, which follow from the coefficients."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huddle.functions.distributions import t_quantile, t_two_sided


def ols(df: DataFrame, x: str, y: str, group: Sequence[str] = (), min_rows: int = 0) -> DataFrame:
    """Per group: n, intercept, slope, their standard errors and t values,
    r2, adj_r2, f_stat (M16-M19; ``min_rows`` skips small groups)."""
    g = list(group)
    agg = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*g).agg(
        F.regr_count(F.col(y), F.col(x)).alias("n"),
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.regr_sxx(F.col(y), F.col(x)).alias("_sxx"),
        F.regr_syy(F.col(y), F.col(x)).alias("_syy"),
        F.regr_sxy(F.col(y), F.col(x)).alias("_sxy"),
        F.regr_avgx(F.col(y), F.col(x)).alias("_avgx"),
    )
    if min_rows:
        agg = agg.filter(F.col("n") >= min_rows)
    # try_divide: a constant x, a perfect fit or n <= 2 give null, not an
    # ANSI division-by-zero error
    div = F.try_divide
    n = F.col("n").cast("double")
    sxx, syy, sxy, avgx = F.col("_sxx"), F.col("_syy"), F.col("_sxy"), F.col("_avgx")
    sse = syy - div(sxy * sxy, sxx)
    s2 = F.when(n > 2, div(sse, n - 2))
    se_slope = F.sqrt(div(s2, sxx))
    se_int = F.sqrt(s2 * (div(F.lit(1.0), n) + div(avgx * avgx, sxx)))
    r2 = F.when(syy > 0, div(sxy * sxy, sxx * syy))
    return agg.select(
        *g, F.col("n").cast("bigint").alias("n"), "intercept", "slope",
        se_int.alias("se_intercept"), se_slope.alias("se_slope"),
        div(F.col("intercept"), se_int).alias("t_intercept"), div(F.col("slope"), se_slope).alias("t_slope"),
        r2.alias("r2"),
        (1 - div((1 - r2) * (n - 1), n - 2)).alias("adj_r2"),
        (div(r2, 1 - r2) * (n - 2)).alias("f_stat"),
    )


def _betacf(a: float, b: float, x: float) -> float:
    # continued fraction of the incomplete beta function (modified Lentz)
    tiny, eps = 1e-300, 3e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def _betainc(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, dof: float) -> float | None:
    """P(|T| > |t|) for Student's t with ``dof`` degrees of freedom."""
    if t is None or dof is None or dof <= 0 or isinstance(t, float) and math.isnan(t):
        return None
    if math.isinf(t):
        return 0.0
    return _betainc(dof / 2.0, 0.5, dof / (dof + t * t))


def _residuals(df: DataFrame, fit: DataFrame, x: str, y: str, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    from huddle.session import bounded_broadcast
    g = list(group)
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *g, *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    coefs = fit.select(*g, "intercept", "slope")
    joined = points.join(bounded_broadcast(coefs), g) if g else points.join(F.broadcast(coefs))
    return joined.withColumn("_e", F.col("_y") - F.col("intercept") - F.col("slope") * F.col("_x"))


def durbin_watson(rows: DataFrame, residual: str, group: Sequence[str], order: Sequence[str], chunks: int = 64) -> DataFrame:
    """Per group the sum of squared differences of neighbouring residuals over
    the sum of squares (``durbin_watson``).

    A group is not ordered in one task: quantiles of the first order column
    cut it in chunks, neighbours are taken within a chunk, and the last
    residual of each chunk meets the first of the next in a table of one row a
    chunk.  Rows that agree in all of ``order`` follow by the residual."""
    g, first = list(group), order[0]
    shares = [(k + 1) / chunks for k in range(chunks - 1)]
    cuts = rows.groupBy(*g).agg(F.percentile_approx(first, shares, 10_000).alias("_cuts"))
    dealt = (rows.join(cuts, g) if g else rows.join(F.broadcast(cuts))).withColumn(
        "_chunk", F.size(F.filter("_cuts", lambda c: c < F.col(first)))).drop("_cuts")
    by = [*order, residual]
    step = F.col(residual) - F.lag(residual).over(Window.partitionBy(*g, "_chunk").orderBy(*by))
    key = F.struct(*by)
    chunk = dealt.withColumn("_d", step).groupBy(*g, "_chunk").agg(
        F.sum(F.col("_d") * F.col("_d")).alias("_dd"), F.sum(F.col(residual) * F.col(residual)).alias("_ee"),
        F.min_by(residual, key).alias("_first"), F.max_by(residual, key).alias("_last"))
    border = F.col("_first") - F.lag("_last").over(Window.partitionBy(*g).orderBy("_chunk"))
    return chunk.withColumn("_b", border).groupBy(*g).agg(F.try_divide(
        F.coalesce(F.sum("_dd"), F.lit(0.0)) + F.coalesce(F.sum(F.col("_b") * F.col("_b")), F.lit(0.0)), F.sum("_ee")).alias("durbin_watson"))


def _skew_z(s, n):
    """Normal score of the sample skewness (D'Agostino)."""
    y = s * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    u = F.when(y == 0, 1.0).otherwise(y) / F.sqrt(2 / (w2 - 1))
    return F.log(u + F.sqrt(u * u + 1)) / F.sqrt(0.5 * F.log(w2))


def _kurtosis_z(k, n):
    """Normal score of the sample kurtosis (Anscombe and Glynn)."""
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (k - mean) / F.sqrt(var)
    skew = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / skew * (2 / skew + F.sqrt(1 + 4 / (skew * skew)))
    d = 1 + x * F.sqrt(2 / (a - 4))
    root = F.signum(d) * F.pow((1 - 2 / a) / F.abs(d), F.lit(1 / 3))
    return (1 - 2 / (9 * a) - root) / F.sqrt(2 / (9 * a))


#: The skewness and kurtosis tests need so many points.
LEAST_FOR_OMNIBUS = 8


def ols_diagnostics(df: DataFrame, x: str, y: str, order: Sequence[str], group: Sequence[str] = (), min_rows: int = 0,
                    fit: DataFrame | None = None) -> DataFrame:
    """Per group: df_resid, log_likelihood, aic, bic, skew and kurtosis of the
    residuals, omnibus and jarque_bera with their probabilities, durbin_watson
    (residuals in ``order``) and cond_no (M20).  Partial aggregates; null where
    too few points or a perfect fit leave a value undefined."""
    g, div = list(group), F.try_divide
    fit = ols(df, x, y, g, min_rows) if fit is None else fit
    rows = _residuals(df, fit, x, y, g, order)
    e = F.col("_e")
    power = rows.groupBy(*g).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(e).alias("m1"), *[F.avg(F.pow(e, F.lit(k))).alias(f"m{k}") for k in (2, 3, 4)],
        F.avg("_x").alias("x1"), F.avg(F.col("_x") * F.col("_x")).alias("x2"))
    n, m1, m2, m3, m4, x1, x2 = (F.col(c) for c in ("n", "m1", "m2", "m3", "m4", "x1", "x2"))
    c2 = m2 - m1 * m1
    c3 = m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1
    c4 = m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * F.pow(m1, F.lit(4))
    out = power.withColumns({"skew": div(c3, F.pow(c2, F.lit(1.5))), "kurtosis": div(c4, c2 * c2)})
    s, k = F.col("skew"), F.col("kurtosis")
    like = F.when(m2 > 0, -n / 2 * (F.log(2 * F.pi()) + F.log(F.when(m2 > 0, m2)) + 1))
    enough = n >= LEAST_FOR_OMNIBUS
    nn = F.when(enough, n)
    omnibus = F.pow(_skew_z(s, nn), F.lit(2)) + F.pow(_kurtosis_z(k, nn), F.lit(2))
    # eigenvalues of X'X / n of the columns 1 and x
    half, root = (1 + x2) / 2, F.sqrt(F.pow((1 - x2) / 2, F.lit(2)) + x1 * x1)
    small = div(x2 - x1 * x1, half + root)  # the product of both is the determinant
    out = out.select(
        *g, (n - 2).cast("long").alias("df_resid"), like.alias("log_likelihood"), (-2 * like + 4).alias("aic"),
        (-2 * like + 2 * F.log(n)).alias("bic"), "skew", "kurtosis", omnibus.alias("omnibus"), F.exp(-omnibus / 2).alias("prob_omnibus"),
        (n / 6 * (s * s + (k - 3) * (k - 3) / 4)).alias("jarque_bera"),
        F.exp(-n / 12 * (s * s + (k - 3) * (k - 3) / 4)).alias("prob_jb"),
        F.sqrt(div(half + root, F.when(small > 0, small))).alias("cond_no"))
    dw = durbin_watson(rows, "_e", g, [f"_o{i}" for i in range(len(order))])
    return out.join(dw, g, "left") if g else out.join(F.broadcast(dw))


def ols_summary(df: DataFrame, x: str, y: str, group: Sequence[str] = (), min_rows: int = 0,
                order: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """The whole summary of ``ols`` (M20): two-sided p-values and ``level``
    intervals of both coefficients, the F test's p-value (that of the slope,
    with one regressor) and, given the rows' ``order``, ``ols_diagnostics``."""
    out = ols(df, x, y, group, min_rows)
    dof = F.col("n") - 2
    out = out.withColumn("_t", t_quantile(1 - level, dof))
    for c in ("intercept", "slope"):
        out = out.withColumns({
            f"p_{c}": t_two_sided(F.col(f"t_{c}"), dof), f"low_{c}": F.col(c) - F.col("_t") * F.col(f"se_{c}"),
            f"high_{c}": F.col(c) + F.col("_t") * F.col(f"se_{c}")})
    out = out.withColumn("p_f", F.col("p_slope")).drop("_t")
    if not order:
        return out
    more = ols_diagnostics(df, x, y, order, group, min_rows, out)
    return out.join(more, list(group)) if group else out.join(F.broadcast(more))


def fitted_values(points: DataFrame, coefs: DataFrame, x: str, group: Sequence[str] = (),
                  name: str = "fitted") -> DataFrame:
    """``intercept + slope * x`` per point (M21); coefficients are one row per
    group, joined on the group (a broadcast-sized table)."""
    from huddle.session import bounded_broadcast
    c = coefs.select(*group, "intercept", "slope")
    if group:
        j = points.join(bounded_broadcast(c), list(group), "inner")
    else:
        # an ungrouped fit is exactly one row (a global aggregate): read its two
        # numbers and apply them as literals, no join at all
        row = c.first()
        a = row["intercept"] if row else None
        b = row["slope"] if row else None
        j = points.withColumn("intercept", F.lit(a).cast("double")).withColumn("slope", F.lit(b).cast("double"))
    return j.withColumn(name, F.col("intercept") + F.col("slope") * F.col(x)).drop("intercept", "slope")
