"""Distribution functions and longitude arithmetic as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PANELS = 400


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution: half plus the density times a series of positive terms.

    What the series needs travels in its state, so it is computed once, and
    no outer column stands inside the lambda (there a new alias of the same
    name would win over it).
    """
    start = F.least(F.abs(z), F.lit(12.0))
    state = lambda a, term, total: F.struct(a.alias("a"), term.alias("term"), total.alias("total"))
    step = lambda s, k: s["term"] * s["a"] * s["a"] / (2 * k + 1)
    density = lambda a: F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(300)), state(start, start, start), lambda s, k: state(s["a"], step(s, k), s["total"] + step(s, k)), lambda s: density(s["a"]) * s["total"])
    upper = F.least(F.lit(0.5), series)
    return F.when(z >= 0, 0.5 + upper).otherwise(0.5 - upper)


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal z."""
    return F.greatest(F.lit(0.0), 2 * (1 - norm_cdf(F.abs(z))))


def _simpson(upper: Column, power: Column) -> Column:
    """Integral of cos**power from 0 to upper; both travel in the state, as in norm_cdf."""
    state = lambda u, p, total: F.struct(u.alias("u"), p.alias("p"), total.alias("total"))
    weight = lambda k: F.when((k == 0) | (k == PANELS), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
    point = lambda s, k: weight(k) * F.pow(F.greatest(F.cos(s["u"] * k / PANELS), F.lit(0.0)), s["p"])
    return F.aggregate(F.sequence(F.lit(0), F.lit(PANELS)), state(upper, power, F.lit(0.0)), lambda s, k: state(s["u"], s["p"], s["total"] + point(s, k)), lambda s: s["u"] / (3 * PANELS) * s["total"])


def t_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t for real degrees of freedom; NULL for df <= 0.

    The share of the integral of cos**(df-1) beyond atan(t/sqrt(df)).
    """
    limit = F.least(F.lit(math.pi / 2), 12 / F.sqrt(df))
    theta = F.least(F.atan(F.abs(t) / F.sqrt(df)), limit)
    inside = F.try_divide(_simpson(theta, df - 1), _simpson(limit, df - 1))
    return F.when((df > 0) & t.isNotNull(), F.greatest(F.lit(0.0), 1 - inside))


def one_sided(p: Column, statistic: Column, alternative: str) -> Column:
    """p of an alternative from the two-sided p and the statistic's sign."""
    if alternative == "two-sided":
        return p
    if alternative not in ("less", "greater"):
        raise ValueError(f"alternative must be two-sided, less or greater, not {alternative!r}")
    toward = statistic > 0 if alternative == "greater" else statistic < 0
    return F.when(toward, p / 2).otherwise(1 - p / 2)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson's r of a group; NULL if a column is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def wrap_lon(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon.cast("double") + 180.0, F.lit(360.0)) - 180.0


def avg_rank(over_value: Column, order_window, tie_window) -> Column:
    """Average rank of ties."""
    return F.rank().over(order_window) + (F.count(F.lit(1)).over(tie_window) - 1) / 2.0
