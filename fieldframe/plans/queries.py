"""Queries over the sample tables, one an operator, and the same in SQL.

The tables have no coordinates. Nations stand for cells of a 5 by 5 grid, and
users for longitudes; both sides derive them by the same arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mathx import PANELS
from ..operators import grid, kernels, profile, select, stats, tz
from ..schema import GridSpec
from ..sources import io

BBOX = (-20.0, -15.0, 25.0, 15.0)
#: Added before rounding where exact halves of the last digit occur, which two ways of adding up may round differently.
OFF_TIES = 1e-7


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events")


def _lat(c: str):
    return F.floor(F.col(c) / 5).cast("double") * 10.0 - 20.0


def _lon(c: str):
    return (F.col(c) % 5).cast("double") * 15.0 - 30.0


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """time, lat, lon, v: mean order price by month and nation."""
    own = _t(spark, d, "orders").join(_t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    cells = own.groupBy(month.alias("time"), "c_nationkey").agg(F.round(F.avg("o_totalprice"), 3).alias("v"))
    return cells.select("time", _lat("c_nationkey").alias("lat"), _lon("c_nationkey").alias("lon"), "v")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """lat, lon, v: mean balance by nation."""
    own = _t(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 3).alias("v"))
    return own.select(_lat("c_nationkey").alias("lat"), _lon("c_nationkey").alias("lon"), "v")


def user_lons(spark: SparkSession, d: str) -> DataFrame:
    """event_id, time, lat, lon, value: users spread over longitudes 0 to 352.5."""
    lon = F.pmod(F.col("user_id").cast("double") * 7.5, F.lit(360.0))
    return _events(spark, d).select("event_id", F.col("ts").alias("time"), ((F.col("user_id") % 18).cast("double") * 10.0 - 80.0).alias("lat"), lon.alias("lon"), "value")


MONTHLY_SQL = """field AS (
  SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS time, (c_nationkey // 5)::DOUBLE * 10 - 20 AS lat, (c_nationkey % 5)::DOUBLE * 15 - 30 AS lon, round(avg(o_totalprice), 3) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
CELLS_SQL = """cells AS (
  SELECT (c_nationkey // 5)::DOUBLE * 10 - 20 AS lat, (c_nationkey % 5)::DOUBLE * 15 - 30 AS lon, round(avg(c_acctbal), 3) AS v FROM customer GROUP BY c_nationkey)"""
LONS_SQL = """lons AS (
  SELECT event_id, ts AS time, (user_id % 18)::DOUBLE * 10 - 80 AS lat, ((user_id * 7.5::DOUBLE) % 360) AS lon, value FROM events)"""

WRAP = "(((lon + 180) % 360 + 360) % 360 - 180)"
BAND = f"(round_even({WRAP} / 15, 0) * 15 + 0.0::DOUBLE)"
OFFSET = f"round_even({WRAP} * 24 / 360, 0)::INTEGER"


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def _r(expression: str, name: str, digits: int = 6) -> str:
    return f"CASE WHEN isfinite({expression}) THEN round({expression}, {digits}) + 0.0 END AS {name}"


def normal_p_sql(z: str) -> str:
    """Two-sided normal p-value by the same series of positive terms."""
    a = f"least(abs({z}), 12.0)"
    terms = f"list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln({a}) - (k + 1) * ln(2.0) - lgamma(k + 1.5) + 0.5 * ln(pi()))))"
    return f"(CASE WHEN {z} IS NULL THEN NULL WHEN {z} = 0 THEN 1.0 ELSE greatest(0.0, 2 * (0.5 - exp(-{a} * {a} / 2) / sqrt(2 * pi()) * {terms})) END)"


def t_p_sql(t: str, df: str) -> str:
    """Two-sided p-value of Student's t by the same Simpson sums."""

    def simpson(upper: str) -> str:
        weight = f"CASE WHEN k = 0 OR k = {PANELS} THEN 1.0::DOUBLE WHEN k % 2 = 1 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END"
        return f"({upper} / {3 * PANELS} * list_sum(list_transform(range(0, {PANELS + 1}), lambda k: ({weight}) * pow(greatest(cos({upper} * k / {PANELS}), 0.0::DOUBLE), {df} - 1))))"

    limit = f"least(pi() / 2, 12 / sqrt({df}))"
    theta = f"least(atan(abs({t}) / sqrt({df})), {limit})"
    return f"greatest(0.0::DOUBLE, 1 - {simpson(theta)} / {simpson(limit)})"


_PAIRS = """x AS (
  SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
pairs AS (
  SELECT a.user_id, sum(sign(b.v - a.v)) AS s, median((b.v - a.v) / (b.i - a.i)) AS slope FROM x a JOIN x b ON a.user_id = b.user_id AND a.i < b.i GROUP BY a.user_id),
base AS (
  SELECT user_id, count(*)::DOUBLE AS n, avg(v) AS mean_val, stddev_samp(v) AS std_val FROM x GROUP BY user_id)"""


def _mk_tail(source: str, significant: str) -> str:
    p = normal_p_sql("z")
    trend = f"CASE WHEN {significant} THEN sign(z)::INTEGER ELSE 0 END"
    return f""", zed AS (
  SELECT *, CASE WHEN s = 0 THEN 0.0 WHEN var > 0 THEN (s - sign(s)) / sqrt(var) END AS z FROM {source}),
final AS (SELECT *, {p} AS p FROM zed)
SELECT user_id, {_r('slope', 'slope')}, {_r('p', 'p_value')}, coalesce({trend}, 0)::INTEGER AS trend, {_r('mean_val', 'mean_val', 4)}, {_r('std_val', 'std_val')},
       {_r('s / (n * (n - 1) / 2)', 'tau')}, {_r('z', 'z_score')} FROM final"""


def hamed_rao_sql(edge: float = kernels.Z975, lag: int = 1_000_000) -> str:
    return f"""WITH {_PAIRS}, ties AS (
  SELECT user_id, sum(c * (c - 1) * (2 * c + 5)) AS t FROM (SELECT user_id, v, count(*) AS c FROM x GROUP BY ALL) GROUP BY user_id),
d AS (SELECT x.user_id, i, v - slope * i AS d FROM x JOIN pairs USING (user_id)),
ranks AS (
  SELECT user_id, i, rank() OVER (PARTITION BY user_id ORDER BY d) + (count(*) OVER (PARTITION BY user_id, d) - 1) / 2.0::DOUBLE AS r FROM d),
dev AS (SELECT user_id, i, r - avg(r) OVER (PARTITION BY user_id) AS e FROM ranks),
whole AS (SELECT user_id, sum(e * e) AS total FROM dev GROUP BY user_id),
acf AS (
  SELECT a.user_id, b.i - a.i AS k, sum(a.e * b.e) / any_value(total) AS rho FROM dev a JOIN dev b ON a.user_id = b.user_id AND a.i < b.i JOIN whole w ON w.user_id = a.user_id GROUP BY ALL),
extra AS (
  SELECT user_id, sum(CASE WHEN abs(rho) > {edge} / sqrt(n) AND k <= {lag} THEN (n - k) * (n - k - 1) * (n - k - 2) * rho ELSE 0 END) AS extra FROM acf JOIN base USING (user_id) GROUP BY user_id),
v AS (
  SELECT user_id, s, slope, n, mean_val, std_val, (n * (n - 1) * (2 * n + 5) - t) / 18 * (1 + 2 / (n * (n - 1) * (n - 2)) * extra) AS var
  FROM pairs JOIN base USING (user_id) JOIN ties USING (user_id) JOIN extra USING (user_id)){_mk_tail('v', f'abs(z) > {edge}')}"""


def native_sql(alpha: float = 0.05, lag: int = 1_000_000) -> str:
    return f"""WITH {_PAIRS}, dev AS (SELECT user_id, i, v - avg(v) OVER (PARTITION BY user_id) AS e FROM x),
whole AS (SELECT user_id, sum(e * e) AS total FROM dev GROUP BY user_id),
acf AS (
  SELECT a.user_id, b.i - a.i AS k, sum(a.e * b.e) / any_value(total) AS rho FROM dev a JOIN dev b ON a.user_id = b.user_id AND a.i < b.i JOIN whole w ON w.user_id = a.user_id GROUP BY ALL),
eff AS (
  SELECT user_id, greatest(1.0, any_value(n) / (1 + 2 * sum(CASE WHEN k <= {lag} + 1 THEN (1 - k / n) * rho ELSE 0 END))) AS ne FROM acf JOIN base USING (user_id) GROUP BY user_id),
v AS (
  SELECT user_id, s, slope, n, mean_val, std_val,
         CASE WHEN ne > 1 THEN (n * (n - 1) * (2 * n + 5)) / 18 * (n * (n - 1) * (2 * n + 5)) / (ne * (ne - 1) * (2 * ne + 5)) ELSE 'infinity'::DOUBLE END AS var
  FROM pairs JOIN base USING (user_id) JOIN eff USING (user_id)){_mk_tail('v', f'p < {alpha}')}"""


def mk_hamed_rao(spark, d):
    found = stats.calc_trends(_events(spark, d), "ts", data_var="value", groupby="user_id")
    return _rounded(_rounded(found, "slope", "p_value", "std_val", "tau", "z_score"), "mean_val", digits=4)


def mk_native(spark, d):
    found = stats.calc_trends(_events(spark, d), "ts", data_var="value", groupby="user_id", kernel="native")
    return _rounded(_rounded(found, "slope", "p_value", "std_val", "tau", "z_score"), "mean_val", digits=4)


def trends_multi(spark, d):
    rows = _events(spark, d).withColumn("twice", F.col("value") * 2)
    found = stats.calc_trends(rows, "ts", data_var=["value", "twice"], groupby="user_id").select("user_id", "value_slope", "value_tau", "twice_slope", "twice_tau")
    return _rounded(found, "value_slope", "value_tau", "twice_slope", "twice_tau")


def sen_slope(spark, d):
    found = stats.calc_trends(monthly(spark, d), "time", data_var="v", groupby=["lat", "lon"], scale=12).select("lat", "lon", "slope", "tau")
    return _rounded(found, "slope", "tau", digits=4)


def ols_trend(spark, d):
    found = stats.polyfit_trend(_events(spark, d), "value", "ts", groupby="user_id", scale=10)
    return _rounded(found, "slope", "p_value", "mean_val", "std_val")


def mean_std_both_ddof(spark, d):
    v = F.col("value")
    found = _events(spark, d).groupBy("event_type").agg(F.count(v).alias("n"), F.avg(v).alias("mean_val"), F.stddev_samp(v).alias("std1"), F.stddev_pop(v).alias("std0"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    return _rounded(found, "mean_val", "std1", "std0")


def _xy(spark, d):
    e = _events(spark, d)
    return e.select("event_id", "user_id", F.col("value").alias("xv")), e.select("event_id", "user_id", (F.hour("ts") + F.length("event_type")).cast("double").alias("yv"))


def _corr(kind):
    def run(spark, d):
        x, y = _xy(spark, d)
        return _rounded(stats.calc_corr(x, y, x_var="xv", y_var="yv", corr_type=kind, groupby="user_id", along="event_id"), "corr", "p_value")

    return run


def corr_global_natural(spark, d):
    x, y = _xy(spark, d)
    return _rounded(stats.calc_corr(x, y, x_var="xv", y_var="yv"), "corr", "p_value")


_XY_SQL = "xy AS (SELECT user_id, value AS x, (hour(ts) + length(event_type))::DOUBLE AS y FROM events)"
_T_OF_R = "(r * sqrt(n - 2) / sqrt(1 - r * r))"


def _corr_tail(keys: str, source: str, n2: str) -> str:
    by = f"GROUP BY {keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    return f"""s AS (SELECT {k}CASE WHEN isfinite(corr(x, y)) THEN corr(x, y) END AS r, count(*)::DOUBLE AS n FROM {source} {by})
SELECT {k}{_r('r', 'corr')}, CASE WHEN r IS NULL THEN NULL WHEN n = 2 THEN {n2} WHEN abs(r) >= 1 - 1e-15 THEN 0.0 ELSE round({t_p_sql(_T_OF_R, '(n - 2)')}, 6) END AS p_value FROM s"""


PEARSON_SQL = f"WITH {_XY_SQL}, {_corr_tail('user_id', 'xy', '1.0')}"
GLOBAL_SQL = f"WITH {_XY_SQL}, {_corr_tail('', 'xy', '1.0')}"
SPEARMAN_SQL = f"""WITH {_XY_SQL}, ranked AS (
  SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY x) + (count(*) OVER (PARTITION BY user_id, x) - 1) / 2.0::DOUBLE AS x,
         rank() OVER (PARTITION BY user_id ORDER BY y) + (count(*) OVER (PARTITION BY user_id, y) - 1) / 2.0::DOUBLE AS y FROM xy),
{_corr_tail('user_id', 'ranked', 'NULL')}"""
KENDALL_SQL = f"""WITH xy AS (SELECT user_id, event_id, value AS x, (hour(ts) + length(event_type))::DOUBLE AS y FROM events),
p AS (SELECT a.user_id, sum(sign(b.x - a.x) * sign(b.y - a.y)) AS s FROM xy a JOIN xy b ON a.user_id = b.user_id AND a.event_id < b.event_id GROUP BY a.user_id),
n AS (SELECT user_id, count(*)::DOUBLE AS n FROM xy GROUP BY user_id),
t AS (SELECT user_id, sum(c * (c - 1) / 2.0) AS n1, sum(c * (c - 1) * (2 * c + 5)) AS a, sum(c * (c - 1) * (c - 2)) AS b FROM (SELECT user_id, x, count(*)::DOUBLE AS c FROM xy GROUP BY ALL) GROUP BY user_id),
u AS (SELECT user_id, sum(c * (c - 1) / 2.0) AS n2, sum(c * (c - 1) * (2 * c + 5)) AS a2, sum(c * (c - 1) * (c - 2)) AS b2 FROM (SELECT user_id, y, count(*)::DOUBLE AS c FROM xy GROUP BY ALL) GROUP BY user_id),
v AS (
  SELECT *, n * (n - 1) AS m, (n * (n - 1) * (2 * n + 5) - a - a2) / 18 + 2 * n1 * n2 / (n * (n - 1)) + b * b2 / (9 * n * (n - 1) * (n - 2)) AS var
  FROM p JOIN n USING (user_id) JOIN t USING (user_id) JOIN u USING (user_id)),
z AS (SELECT *, s / sqrt(var) AS z FROM v)
SELECT user_id, {_r('s / sqrt((m / 2 - n1) * (m / 2 - n2))', 'corr')}, {_r(normal_p_sql('z'), 'p_value')} FROM z"""


def welch_mask(spark, d):
    field = monthly(spark, d)
    early = F.col("time") < F.lit("1998-07-01").cast("timestamp_ntz")
    found = stats.welch_mask(field.where(early), field.where(~early), "time", data_var="v", groupby=["lat", "lon"])
    return _rounded(found, "t_stats", "p_raw", "df")


WELCH_SQL = f"""WITH {MONTHLY_SQL}, m AS (
  SELECT lat, lon, time < TIMESTAMP '1998-07-01' AS early, count(v)::DOUBLE AS n, avg(v) AS m, var_samp(v) AS v FROM field GROUP BY ALL),
j AS (
  SELECT a.lat, a.lon, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t, pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) AS df
  FROM m a JOIN m b ON a.lat = b.lat AND a.lon = b.lon AND a.early AND NOT b.early),
p AS (SELECT *, {t_p_sql('t', 'df')} AS p FROM j)
SELECT lat, lon, CASE WHEN p < 0.05 THEN 1.0::DOUBLE END AS p_values, {_r('t', 't_stats')}, {_r('p', 'p_raw')}, {_r('df', 'df')} FROM p"""


def utc_offset(spark, d):
    return user_lons(spark, d).select("event_id", "lon", tz.utc_offset_hours(F.col("lon")).alias("hours"))


def solar_time(spark, d):
    return tz.local_solar_time(user_lons(spark, d)).select("event_id", "local_solar_time")


def lon_band(spark, d):
    return tz.split_by_15_deg(user_lons(spark, d)).select("event_id", "lon", "band")


def tz_split(spark, d):
    return tz.split_by_timezones(user_lons(spark, d)).select("event_id", "time", "band", "utc_offset_h", "tz")


def tz_apply_mean(spark, d):
    daily = lambda f: f.groupBy("band", F.hour("time").alias("h")).agg(F.round(F.avg("value"), 6).alias("v"), F.count(F.lit(1)).alias("n"))
    return tz.tz_apply(daily, user_lons(spark, d))


def tz_apply_grouped(spark, d):
    def centre(rows):
        rows = rows.assign(value=rows["value"] - rows["value"].mean())
        return rows[["event_id", "band", "value"]]

    return _rounded(tz.tz_apply_pandas(centre, user_lons(spark, d), "event_id bigint, band double, value double"), "value", digits=4)


def split_dim(spark, d):
    return select.split_by_dims(monthly(spark, d).select("time", "lat", "lon"), "time", 7)


def time_freq(spark, d):
    return profile.time_frequency(_events(spark, d).select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time")))


def extent_info(spark, d):
    return profile.extent(user_lons(spark, d), ["lat", "lon"])


def bbox(spark, d):
    return select.crop(monthly(spark, d), BBOX)


def significant_points(spark, d):
    found = stats.polyfit_trend(_events(spark, d), "value", "ts", groupby="user_id")
    return _rounded(select.significant_points(found, 0.3), "slope", "p_value", "mean_val", "std_val")


def robust_limits(spark, d):
    return _rounded(select.robust_limits(_events(spark, d), "value"), "vmin", "vmax")


def _mask(spark):
    lats, lons = [-25.0 + 4 * k for k in range(13)], [-35.0 + 4 * k for k in range(18)]
    return spark.createDataFrame([(a, b, int(a + b) % 3 != 0, int(a + b) % 3 == 0) for a in lats for b in lons], "lat double, lon double, land boolean, ocean boolean")


def mask_nearest(spark, d):
    return grid.land_sea_mask(cells(spark, d), _mask(spark), "land", ["v"])


def interp_linear(spark, d):
    return _rounded(grid.interp(cells(spark, d), ["v"], 2.5, "linear"), "v")


def interp_nearest(spark, d):
    return _rounded(grid.interp(cells(spark, d), ["v"], 3.0, "nearest"), "v")


def interp_cubic(spark, d):
    found = grid.interp(cells(spark, d), ["v"], 2.5, "cubic")
    return _rounded(found.withColumn("v", F.col("v") + OFF_TIES), "v")


def remap_bilinear(spark, d):
    return _rounded(grid.remap(cells(spark, d), ["v"], BBOX, 5.0, "remapbil"), "v")


def remap_conservative(spark, d):
    return _rounded(grid.remap(cells(spark, d), ["v"], (-15.0, -10.0, 15.0, 10.0), 10.0, "remapcon"), "v")


def remap_distance(spark, d):
    return _rounded(grid.remap(cells(spark, d), ["v"], BBOX, 5.0, "remapdis"), "v")


def regrid_weights(spark, d):
    mesh = monthly(spark, d).select("time", ((F.col("lat") + 20) / 10 * 5 + (F.col("lon") + 30) / 15).cast("int").alias("ncol"), "v")
    spec = GridSpec(5, 5, -25.0, 10.0, -15.0, 7.5)
    w, dst = grid.bilinear_weights(spark, [-20.0, -10.0, 0.0, 10.0, 20.0], [-30.0, -15.0, 0.0, 15.0, 30.0], spec)
    return _rounded(grid.regrid_weights(mesh, w, dst, ["v"]), "v")


def merge_time(spark, d):
    e = _events(spark, d).select("event_id", F.col("ts").alias("time"), "value")
    return io.merge_time([e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), e.where("event_id % 5 = 0")])


def melt(spark, d):
    return io.melt(_t(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_acctbal") * 2).alias("twice")), ["c_custkey"], ["c_acctbal", "twice"])


def _axis_sql(low: float, step: float, n: int, name: str) -> str:
    return f"SELECT {low}::DOUBLE + i * {step}::DOUBLE AS {name} FROM range(0, {n}) r(i)"


def _bilinear_sql(y0: float, x0: float, res: float, ny: int, nx: int, keys: str = "", source: str = "cells", sy: float = 10.0, sx: float = 15.0, resx: float | None = None) -> str:
    """Corner sums on a regular source grid from (-20, -30) with steps sy, sx."""
    k = f"{keys}, " if keys else ""
    low = lambda c, start, s: f"floor(({c} - {start}) / {s} + 1e-9)"
    return f"""ty AS ({_axis_sql(y0, res, ny, 'ty')}), tx AS ({_axis_sql(x0, resx or res, nx, 'tx')}),
wy AS (
  SELECT ty, -20 + {low('ty', -20, sy)} * {sy} AS sy, 1 - ((ty + 20) / {sy} - {low('ty', -20, sy)}) AS w FROM ty
  UNION ALL SELECT ty, -20 + ({low('ty', -20, sy)} + 1) * {sy}, (ty + 20) / {sy} - {low('ty', -20, sy)} FROM ty),
wx AS (
  SELECT tx, -30 + {low('tx', -30, sx)} * {sx} AS sx, 1 - ((tx + 30) / {sx} - {low('tx', -30, sx)}) AS w FROM tx
  UNION ALL SELECT tx, -30 + ({low('tx', -30, sx)} + 1) * {sx}, (tx + 30) / {sx} - {low('tx', -30, sx)} FROM tx),
need AS (SELECT ty, tx, count(*) AS need FROM wy, wx WHERE abs(wy.w) > 1e-9 AND abs(wx.w) > 1e-9 GROUP BY ALL),
met AS (
  SELECT {k}ty, tx, sum(v * wy.w * wx.w) AS v, count(*) AS n FROM {source} JOIN wy ON abs(lat - sy) < 1e-6 JOIN wx ON abs(lon - sx) < 1e-6 WHERE abs(wy.w) > 1e-9 AND abs(wx.w) > 1e-9 GROUP BY ALL)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        mk_hamed_rao, mk_native, trends_multi, sen_slope, ols_trend, mean_std_both_ddof, corr_global_natural, welch_mask, utc_offset, solar_time, lon_band, tz_split, tz_apply_mean, tz_apply_grouped,
        split_dim, time_freq, extent_info, bbox, significant_points, robust_limits, mask_nearest, interp_linear, interp_nearest, interp_cubic, remap_bilinear, remap_conservative, remap_distance, regrid_weights, merge_time, melt,
    )
    return {f.__name__: f for f in own} | {f"corr_{k}": _corr(k) for k in ("pearson", "spearman", "kendall")}


_OLS = """o AS (SELECT user_id, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts)::DOUBLE AS x FROM events),
f AS (SELECT user_id, regr_slope(y, x) AS slope, regr_sxx(y, x) AS sxx, regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x) AS sse, count(*)::DOUBLE AS n, avg(y) AS mean_val, stddev_pop(y) AS std_val FROM o GROUP BY user_id),
g AS (SELECT *, CASE WHEN n > 2 THEN slope / sqrt(greatest(0.0, sse) / (n - 2) / sxx) END AS t FROM f)"""


def oracle_sql() -> dict[str, str]:
    ols_p = t_p_sql("t", "(n - 2)")
    return {
        "mk_hamed_rao": hamed_rao_sql(),
        "mk_native": native_sql(),
        "trends_multi": f"WITH {_PAIRS} SELECT user_id, {_r('slope', 'value_slope')}, {_r('s / (n * (n - 1) / 2)', 'value_tau')}, {_r('slope * 2', 'twice_slope')}, {_r('s / (n * (n - 1) / 2)', 'twice_tau')} FROM base LEFT JOIN pairs USING (user_id)",
        "sen_slope": f"""WITH {MONTHLY_SQL}, x AS (SELECT lat, lon, v, row_number() OVER (PARTITION BY lat, lon ORDER BY time) AS i, count(*) OVER (PARTITION BY lat, lon)::DOUBLE AS n FROM field)
SELECT a.lat, a.lon, {_r('12 * median((b.v - a.v) / (b.i - a.i))', 'slope', 4)}, {_r('sum(sign(b.v - a.v)) / (any_value(a.n) * (any_value(a.n) - 1) / 2)', 'tau', 4)}
FROM x a JOIN x b ON a.lat = b.lat AND a.lon = b.lon AND a.i < b.i GROUP BY a.lat, a.lon""",
        "ols_trend": f"WITH {_OLS} SELECT user_id, {_r('slope * 10', 'slope')}, CASE WHEN n > 2 THEN round({ols_p}, 6) END AS p_value, {_r('mean_val', 'mean_val')}, {_r('std_val', 'std_val')} FROM g",
        "significant_points": f"WITH {_OLS}, p AS (SELECT *, CASE WHEN n > 2 THEN {ols_p} END AS p FROM g) SELECT user_id, {_r('slope', 'slope')}, {_r('p', 'p_value')}, {_r('mean_val', 'mean_val')}, {_r('std_val', 'std_val')} FROM p WHERE p < 0.3",
        "mean_std_both_ddof": f"SELECT event_type, count(value) AS n, {_r('avg(value)', 'mean_val')}, {_r('stddev_samp(value)', 'std1')}, {_r('stddev_pop(value)', 'std0')}, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type",
        "corr_pearson": PEARSON_SQL,
        "corr_spearman": SPEARMAN_SQL,
        "corr_kendall": KENDALL_SQL,
        "corr_global_natural": GLOBAL_SQL,
        "welch_mask": WELCH_SQL,
        "utc_offset": f"WITH {LONS_SQL} SELECT event_id, lon, {OFFSET} AS hours FROM lons",
        "solar_time": f"WITH {LONS_SQL} SELECT event_id, time + to_hours(round_even(lon * 24 / 360, 0)::BIGINT) AS local_solar_time FROM lons",
        "lon_band": f"WITH {LONS_SQL} SELECT event_id, {WRAP} AS lon, {BAND} AS band FROM lons",
        "tz_split": f"WITH {LONS_SQL} SELECT event_id, time + to_hours({OFFSET}::BIGINT) AS time, {BAND} AS band, {OFFSET} AS utc_offset_h, 'UTC' || {OFFSET}::VARCHAR AS tz FROM lons",
        "tz_apply_mean": f"WITH {LONS_SQL} SELECT {BAND} AS band, hour(time + to_hours({OFFSET}::BIGINT))::INTEGER AS h, round(avg(value), 6) AS v, count(*) AS n FROM lons GROUP BY ALL",
        "tz_apply_grouped": f"WITH {LONS_SQL}, b AS (SELECT event_id, {BAND} AS band, value FROM lons) SELECT event_id, band, round(value - avg(value) OVER (PARTITION BY band), 4) + 0.0 AS value FROM b",
        "split_dim": f"WITH {MONTHLY_SQL}, a AS (SELECT time, row_number() OVER (ORDER BY time) AS i, count(*) OVER () AS d FROM (SELECT DISTINCT time FROM field)) SELECT time, lat, lon, ((i * 7 - 1) // d)::INTEGER AS split FROM field JOIN a USING (time)",
        "time_freq": """WITH t AS (SELECT DISTINCT date_trunc('hour', ts)::TIMESTAMP AS t FROM events), s AS (SELECT t, date_diff('second', lag(t) OVER (ORDER BY t), t) AS step FROM t),
m AS (SELECT step FROM s WHERE step IS NOT NULL GROUP BY step ORDER BY count(*) DESC, step LIMIT 1)
SELECT CASE WHEN step < 86400 THEN (step // 3600)::VARCHAR || 'H' ELSE (step // 86400)::VARCHAR || 'D' END AS freq, min(hour(t)) AS hour_min, max(hour(t)) AS hour_max,
       min(month(t)) AS month_min, max(month(t)) AS month_max, min(year(t)) AS year_min, max(year(t)) AS year_max FROM s JOIN m USING (step) GROUP BY step""",
        "extent_info": f"""WITH {LONS_SQL} SELECT 'lat' AS dim, round_even(min(lat), 2) AS low, round_even(max(lat), 2) AS high, round_even((max(lat) - min(lat)) / (count(DISTINCT lat) - 1), 2) AS step FROM lons
UNION ALL SELECT 'lon', round_even(min(lon), 2), round_even(max(lon), 2), round_even((max(lon) - min(lon)) / (count(DISTINCT lon) - 1), 2) FROM lons""",
        "bbox": f"WITH {MONTHLY_SQL} SELECT * FROM field WHERE lon BETWEEN {BBOX[0]} AND {BBOX[2]} AND lat BETWEEN {BBOX[1]} AND {BBOX[3]}",
        "robust_limits": f"SELECT {_r('quantile_cont(value, 0.02)', 'vmin')}, {_r('quantile_cont(value, 0.98)', 'vmax')} FROM events",
        "mask_nearest": f"""WITH {CELLS_SQL}, my AS ({_axis_sql(-25, 4, 13, 'y')}), mx AS ({_axis_sql(-35, 4, 18, 'x')}),
m AS (SELECT lat, lon, v, (SELECT min_by(y, abs(y - lat) * 1000 + y / 1000) FROM my) AS y, (SELECT min_by(x, abs(x - lon) * 1000 + x / 1000) FROM mx) AS x FROM cells)
SELECT lat, lon, CASE WHEN (y + x)::INTEGER % 3 <> 0 THEN v END AS v FROM m""",
        "interp_linear": f"WITH {CELLS_SQL}, {_bilinear_sql(-20, -30, 2.5, 16, 24)} SELECT ty AS lat, tx AS lon, CASE WHEN n = need THEN round(v, 6) + 0.0 END AS v FROM met JOIN need USING (ty, tx)",
        "interp_nearest": f"""WITH {CELLS_SQL}, ty AS ({_axis_sql(-20, 3, 14, 'ty')}), tx AS ({_axis_sql(-30, 3, 20, 'tx')})
SELECT ty AS lat, tx AS lon, round(v, 6) + 0.0 AS v FROM ty, tx, cells WHERE lat = -20 + ceil((ty + 20) / 10 - 0.5) * 10 AND lon = -30 + ceil((tx + 30) / 15 - 0.5) * 15""",
        "remap_bilinear": f"WITH {CELLS_SQL}, {_bilinear_sql(-15, -20, 5, 7, 10)} SELECT ty AS lat, tx AS lon, CASE WHEN n = need THEN round(v, 6) + 0.0 END AS v FROM met JOIN need USING (ty, tx)",
        "regrid_weights": f"WITH {MONTHLY_SQL}, {_bilinear_sql(-15, -25, 7.5, 5, 5, 'time', 'field', resx=10)} SELECT time, ty AS lat, tx AS lon, round(v, 6) + 0.0 AS v FROM met",
        "merge_time": "WITH e AS (SELECT event_id, ts AS time, value FROM events) SELECT * FROM e UNION ALL SELECT * FROM e WHERE event_id % 5 = 0",
        "melt": "SELECT c_custkey, 'c_acctbal' AS variable, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 'twice', c_acctbal * 2 FROM customer",
    }
