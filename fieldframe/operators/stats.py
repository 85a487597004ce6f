"""Grouped statistics: trends, correlation, Welch masks and least-squares trends."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import avg_rank, one_sided, safe_corr, t_p
from ..schema import Keys, as_keys, require_columns, require_frame, value
from . import kernels

_TREND_TYPE = "slope double, p_value double, trend int, mean_val double, std_val double, tau double, z_score double"


def series_array(along: str, name: str) -> Column:
    """Aggregate: a group's values in order of `along`, missing ones left out."""
    v = value(name)
    pairs = F.collect_list(F.when(v.isNotNull(), F.struct(F.col(along).alias("a"), v.alias("v"))))
    return F.transform(F.array_sort(pairs), lambda s: s["v"])


def _trend_udf(kernel: str, scale: float, alpha: float, lag: int | None):
    if kernel not in ("hamed_rao", "native"):
        raise ValueError(f"unknown kernel {kernel!r}")

    @F.pandas_udf(_TREND_TYPE)
    def run(series: pd.Series) -> pd.DataFrame:
        rows = []
        for x in series:
            x = np.asarray(x if x is not None else [], float)
            rows.append(kernels.hamed_rao(x, scale, alpha, lag) if kernel == "hamed_rao" else kernels.native_mk(x, scale, alpha, lag))
        out = pd.DataFrame(rows, columns=list(kernels.TREND_FIELDS), dtype=object)
        types = {c: "float64" for c in out.columns if c != "trend"} | {"trend": "Int32"}
        return out.astype(types)

    return run


def calc_trends(df: DataFrame, along: str | None = None, *, data_var: str | list[str] | None = None, groupby: Keys = None, scale: float = 1, kernel: str = "hamed_rao", alpha: float = 0.05, lag: int | None = None) -> DataFrame:
    """Trend of each group's series: slope, p_value, trend, mean_val, std_val, tau, z_score.

    Missing values are left out and the gaps closed, so slopes are per
    surviving step. Several variables give columns `{variable}_{statistic}`.
    Fewer than two values give NULL. Without keys the whole frame is one
    series. kernel: hamed_rao (ties and autocorrelated ranks corrected) or
    native (effective sample size). alpha is the level of the trend, lag the
    last autocorrelation that is looked at (all, if not given).
    """
    require_frame(df)
    if along is None:
        raise ValueError("along is needed: rows have no order")
    if not data_var:
        raise ValueError("data_var is needed")
    names = [data_var] if isinstance(data_var, str) else list(data_var)
    keys = as_keys(groupby, along)
    require_columns(df, along, *names, *keys)
    rows = df.na.drop(subset=keys) if keys else df
    arrays = rows.groupBy(*keys).agg(*[series_array(along, n).alias(f"__{n}") for n in names])
    run = _trend_udf(kernel, scale, alpha, lag)
    out = arrays.select(*keys, *[run(F.col(f"__{n}")).alias(f"__{n}") for n in names])
    clean = lambda c, f: F.col(c) if f == "trend" else F.when(~F.isnan(c), F.col(c))
    return out.select(*keys, *[clean(f"__{n}.{f}", f).alias(f if len(names) == 1 else f"{n}_{f}") for n in names for f in kernels.TREND_FIELDS])


def _paired(x: DataFrame, y: DataFrame, x_var: str, y_var: str, on: list[str]) -> DataFrame:
    left = x.select(*on, value(x_var).alias("__x"))
    right = y.select(*on, value(y_var).alias("__y"))
    return left.join(right, on, "inner").na.drop()


def validate_alignment(x: DataFrame, y: DataFrame, keys: list[str]) -> None:
    """Raise ValueError unless both frames have the same key combinations (two jobs)."""
    require_columns(x, *keys)
    require_columns(y, *keys)
    if x.select(*keys).join(y.select(*keys), keys, "left_anti").limit(1).count() or y.select(*keys).join(x.select(*keys), keys, "left_anti").limit(1).count():
        raise ValueError(f"the frames differ in {keys}")


def calc_corr(x: DataFrame, y: DataFrame, *, x_var: str | None = None, y_var: str | None = None, corr_type: str = "pearson", alternative: str = "two-sided", along: str | None = None, groupby: Keys = None, allow_fanout: bool = False, validate: bool = False) -> DataFrame:
    """corr and p_value of two variables in each group.

    The frames are joined on the keys and `along`; without keys and along on
    all columns they share, but for the variables. allow_fanout joins on the
    keys alone, which pairs all rows of a group. Rows with a missing value go.
    """
    require_frame(x), require_frame(y)
    if not x_var or not y_var:
        raise ValueError("x_var and y_var are needed")
    if corr_type not in ("pearson", "spearman", "kendall"):
        raise ValueError(f"unknown corr_type {corr_type!r}")
    if alternative not in ("two-sided", "less", "greater"):
        raise ValueError(f"unknown alternative {alternative!r}")
    keys = as_keys(groupby, along)
    if keys or along:
        on = keys if allow_fanout and keys else keys + ([along] if along else [])
    else:
        on = [c for c in x.columns if c in y.columns and c not in (x_var, y_var)]
    if not on:
        raise ValueError("the frames share no column to join on")
    require_columns(x, x_var, *on)
    require_columns(y, y_var, *on)
    if validate:
        validate_alignment(x, y, on)
    both = _paired(x, y, x_var, y_var, on)
    if corr_type == "kendall":
        return _kendall(both, keys, alternative)
    if corr_type == "spearman":
        for c in ("__x", "__y"):
            order, ties = Window.partitionBy(*keys).orderBy(c), Window.partitionBy(*keys, c)
            both = both.withColumn(f"{c}r", avg_rank(F.col(c), order, ties))
        both = both.withColumns({"__x": F.col("__xr"), "__y": F.col("__yr")})
    stats = both.groupBy(*keys).agg(safe_corr(F.col("__x"), F.col("__y")).alias("r"), F.count(F.lit(1)).alias("n"))
    r, n = F.when(F.col("r").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r")))), F.col("n")
    t = F.try_divide(r * F.sqrt(n - 2.0), F.sqrt(1 - r * r))
    certain = F.abs(r) >= 1 - 1e-15
    p = F.when(n == 2, F.lit(1.0 if corr_type == "pearson" else None).cast("double")).when(certain, F.lit(0.0)).otherwise(t_p(t, n - 2.0))
    p = F.when(n == 2, p).otherwise(one_sided(p, r, alternative))
    return stats.select(*keys, r.alias("corr"), F.when(r.isNotNull(), p).alias("p_value"))


def _kendall(both: DataFrame, keys: list[str], alternative: str) -> DataFrame:
    @F.pandas_udf("corr double, p_value double")
    def run(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        rows = [kernels.kendall(np.asarray(x, float), np.asarray(y, float), alternative) for x, y in zip(xs, ys)]
        return pd.DataFrame(rows, columns=["corr", "p_value"]).astype("float64")

    pairs = both.groupBy(*keys).agg(F.collect_list(F.struct("__x", "__y")).alias("g"))
    found = pairs.select(*keys, run(F.col("g.__x"), F.col("g.__y")).alias("r"))
    return found.select(*keys, *[F.when(~F.isnan(f"r.{c}"), F.col(f"r.{c}")).alias(c) for c in ("corr", "p_value")])


def welch_mask(a: DataFrame, b: DataFrame, along: str, *, data_var: str, groupby: Keys = None, level: float = 0.05) -> DataFrame:
    """Welch's t-test of two frames for each cell.

    p_values is 1 where p < level and NULL elsewhere; t_stats, p_raw and df
    are given too. Cells are paired by key; those of one frame only go.
    """
    if not data_var:
        raise ValueError("data_var is needed")
    keys = as_keys(groupby, along)
    for frame in (a, b):
        require_columns(frame, along, data_var, *keys)
    moments = lambda f, s: f.groupBy(*keys).agg(F.count(value(data_var)).alias(f"n{s}"), F.avg(value(data_var)).alias(f"m{s}"), F.var_samp(value(data_var)).alias(f"v{s}"))
    left, right = moments(a, "a"), moments(b, "b")
    both = left.join(right, keys, "inner") if keys else left.withColumn("__k", F.lit(1)).join(right.withColumn("__k", F.lit(1)), "__k").drop("__k")
    ea, eb = F.try_divide(F.col("va"), F.col("na")), F.try_divide(F.col("vb"), F.col("nb"))
    t = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(ea + eb))
    df = F.try_divide(F.pow(ea + eb, 2), F.try_divide(ea * ea, F.col("na") - 1.0) + F.try_divide(eb * eb, F.col("nb") - 1.0))
    out = both.select(*keys, t.alias("t_stats"), df.alias("df")).withColumn("p_raw", t_p(F.col("t_stats"), F.col("df")))
    return out.select(*keys, F.when(F.col("p_raw") < level, 1.0).alias("p_values"), "t_stats", "p_raw", "df")


def polyfit_trend(df: DataFrame, data_var: str, along: str, *, groupby: Keys = None, scale: float = 1, parity_df: bool = False) -> DataFrame:
    """Least-squares trend over the step number: slope, p_value, mean_val, std_val (ddof 0).

    Steps are numbered before missing values go, so gaps count. parity_df
    counts them in the degrees of freedom too.
    """
    keys = as_keys(groupby, along)
    require_columns(df, data_var, along, *keys)
    step = F.row_number().over(Window.partitionBy(*keys).orderBy(along)).cast("double")
    rows = df.select(*keys, F.col(along), value(data_var).alias("y")).withColumn("x", step)
    x = F.when(F.col("y").isNotNull(), F.col("x"))
    fit = rows.groupBy(*keys).agg(
        F.regr_slope("y", x).alias("slope"), F.regr_sxx("y", x).alias("sxx"), F.regr_syy("y", x).alias("syy"), F.regr_sxy("y", x).alias("sxy"),
        F.count("y").alias("n"), F.count(F.lit(1)).alias("total"), F.avg("y").alias("mean_val"), F.stddev_pop("y").alias("std_val"),
    )
    free = (F.col("total") if parity_df else F.col("n")) - 2.0
    left = F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))
    error = F.when(free > 0, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.try_divide(left, free), F.col("sxx")))))
    t = F.try_divide(F.col("slope"), error)
    return fit.select(*keys, (F.col("slope") * scale).alias("slope"), t_p(t, free).alias("p_value"), "mean_val", "std_val")


def merge_variables(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Variables of several frames side by side, all cells kept; a variable in two of them is an error."""
    seen: set[str] = set()
    for f in frames:
        require_columns(f, *keys)
        twice = seen & (set(f.columns) - set(keys))
        if twice:
            raise ValueError(f"several frames have {sorted(twice)}")
        seen |= set(f.columns) - set(keys)
    return reduce(lambda a, b: a.join(b, keys, "full_outer"), frames)
