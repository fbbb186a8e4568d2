"""Distribution functions as column expressions (built-ins only).

SQL has no gamma, beta or Student-t functions; these are the usual numerical
forms (Lanczos' gamma, the continued fraction of the incomplete beta function)
written with ``aggregate`` over a sequence, so they run in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos' coefficients for g = 7, n = 9.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
            12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
_TINY = 1e-300
#: From so many degrees of freedom on quantiles come from their expansion.
MANY = 1000


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lgamma(x: Column) -> Column:
    """log of the gamma function for x >= 1/2."""
    z = x - 1
    series = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + k)
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(series)


def _apart(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, _TINY).otherwise(x)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function (modified Lentz);
    it converges in about the square root of the larger parameter."""
    steps = (40 + 5 * F.sqrt(F.greatest(a, b))).cast("int")

    def state(c: Column, d: Column, h: Column) -> Column:
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def half(s: Column, term: Column) -> Column:
        d = 1 / _apart(1 + term * s["d"])
        c = _apart(1 + term / s["c"])
        return _let(F.struct(c.alias("c"), d.alias("d")), lambda n: state(n["c"], n["d"], s["h"] * n["c"] * n["d"]))

    def step(s: Column, k: Column) -> Column:
        m = k.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return _let(half(s, even), lambda n: half(n, odd))

    first = 1 / _apart(1 - (a + b) * x / (a + 1))
    return F.aggregate(F.sequence(F.lit(1), steps), state(F.lit(1.0), first, first), step, lambda s: s["h"])


def betainc(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b)."""
    front = F.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * F.log(x) + b * F.log1p(-x))
    direct = x < (a + 1) / (a + b + 2)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(direct, front * _fraction(a, b, x) / a).otherwise(
        1 - front * _fraction(b, a, 1 - x) / b)


def t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| > |t|) of Student's t; null without degrees of freedom."""
    v = dof.cast("double")
    x = F.when(F.abs(t) == float("inf"), 0.0).otherwise(v / (v + t * t))
    return F.when((v > 0) & t.isNotNull() & ~F.isnan(t), _let(x, lambda at: betainc(v / 2, F.lit(0.5), at)))


def t_quantile(share: float, dof: Column) -> Column:
    """The t that |T| exceeds with probability ``share``: bisection in
    v / (v + t^2), from ``MANY`` degrees on the expansion about the normal."""
    from statistics import NormalDist
    v = dof.cast("double")
    z = NormalDist().inv_cdf(1 - share / 2)
    terms = (z, (z ** 3 + z) / 4, (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96, (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384,
             (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160)
    expansion = sum((F.lit(c) / F.pow(v, F.lit(k)) for k, c in enumerate(terms)), F.lit(0.0))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        return _let(mid, lambda m: F.when(
            betainc(v / 2, F.lit(0.5), m) > share, F.struct(s["lo"].alias("lo"), m.alias("hi"))).otherwise(
            F.struct(m.alias("lo"), s["hi"].alias("hi"))))

    bounds = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    exact = F.aggregate(F.sequence(F.lit(1), F.lit(60)), bounds, halve, lambda s: F.sqrt(v * (2 / (s["lo"] + s["hi"]) - 1)))
    return F.when(v >= MANY, expansion).when(v > 0, exact)
