"""Further queries over the sample tables, with the same in SQL: options and small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid, kernels, profile, select, stats, tz
from ..schema import GridSpec
from ..streaming import live
from . import queries as base


def mk_alpha_lag(spark, d):
    found = stats.calc_trends(base._events(spark, d), "ts", data_var="value", groupby="user_id", alpha=0.3, lag=3)
    return base._rounded(base._rounded(found, "slope", "p_value", "std_val", "tau", "z_score"), "mean_val", digits=4)


def mk_native_lag(spark, d):
    found = stats.calc_trends(base._events(spark, d), "ts", data_var="value", groupby="user_id", kernel="native", alpha=0.3, lag=3)
    return base._rounded(base._rounded(found, "slope", "p_value", "std_val", "tau", "z_score"), "mean_val", digits=4)


def take_places(spark, d):
    return select.take_index(base.monthly(spark, d), "time", 3, 7)


def take_last(spark, d):
    return select.take_index(base.monthly(spark, d), "time", [0, -1])


def label_lookup(spark, d):
    return select.take_label(base.user_lons(spark, d), "lat", 10.0, -80.0).select("event_id", "lat", "lon")


def masked_cells(spark, d):
    return select.mask_where(base.cells(spark, d), F.col("lat") >= 0, "v")


def named_stats(spark, d):
    stat = base._events(spark, d).groupBy("event_type").agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    return select.rename_stats(select.select_variable(stat, ["event_type"], "hi"), "value", ["hi"])


def merged_variables(spark, d):
    own = base._t(spark, d, "supplier").groupBy("s_nationkey").agg(F.round(F.avg("s_acctbal"), 3).alias("w"))
    other = own.select(base._lat("s_nationkey").alias("lat"), base._lon("s_nationkey").alias("lon"), "w")
    return stats.merge_variables([base.cells(spark, d), other.where("w > 0")], ["lat", "lon"])


def corr_fanout(spark, d):
    x = base._t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("x"))
    y = base._t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("y"))
    both = stats.calc_corr(x, y, x_var="x", y_var="y", groupby="k", allow_fanout=True)
    return both.select("k", F.round("corr", 4) + F.lit(0.0)).toDF("k", "corr").where("corr is not null")


def corr_checked(spark, d):
    x, y = base._xy(spark, d)
    return base._rounded(stats.calc_corr(x, y, x_var="xv", y_var="yv", groupby="user_id", along="event_id", validate=True), "corr", "p_value")


def ols_gaps(spark, d):
    rows = base._events(spark, d).withColumn("value", F.when(F.col("event_id") % 4 != 0, F.col("value")))
    return base._rounded(stats.polyfit_trend(rows, "value", "ts", groupby="user_id", parity_df=True), "slope", "p_value", "mean_val", "std_val")


def tz_centre(spark, d):
    return tz.split_by_timezones(base.user_lons(spark, d), parity_dateline=True).select("event_id", "time", "utc_offset_h")


def solar_no_equator(spark, d):
    rows = base.user_lons(spark, d).withColumn("lat", F.col("lat") + F.lit(80.0))
    return tz.local_solar_time(rows, parity_equator_null=True).select("event_id", "local_solar_time")


def regrid_with_others(spark, d):
    mesh = base.monthly(spark, d).select("time", ((F.col("lat") + 20) / 10 * 5 + (F.col("lon") + 30) / 15).cast("int").alias("ncol"), "v")
    others = base.monthly(spark, d).groupBy("time").agg(F.count(F.lit(1)).alias("cells"))
    w, dst = grid.generate_weights(spark, [-20.0, -10.0, 0.0, 10.0, 20.0], [-30.0, -15.0, 0.0, 15.0, 30.0], GridSpec(5, 5, -25.0, 10.0, -15.0, 7.5))
    return base._rounded(grid.regrid_weights(mesh, w, dst, ["v"], others=others), "v")


def weights_conserve(spark, d):
    w, dst = grid.generate_weights(spark, [-20.0, -10.0, 0.0, 10.0, 20.0], [-30.0, -15.0, 0.0, 15.0, 30.0], GridSpec(4, 4, -45.0, 20.0, -30.0, 15.0), method="conserve", norm_type="fracarea", ignore_unmapped=True)
    return base._rounded(w.join(dst, "row"), "s", digits=9)


def weights_dstarea(spark, d):
    w, _ = grid.generate_weights(spark, [-20.0, -10.0, 0.0, 10.0, 20.0], [-30.0, -15.0, 0.0, 15.0, 30.0], GridSpec(4, 4, -45.0, 20.0, -30.0, 15.0), method="conserve", ignore_unmapped=True)
    return base._rounded(w, "s", digits=9)


def weights_extrapolated(spark, d):
    w, _ = grid.generate_weights(spark, [-20.0, -10.0, 0.0, 10.0, 20.0], [-30.0, -15.0, 0.0, 15.0, 30.0], GridSpec(3, 3, -44.0, 22.0, -26.0, 13.0), extrap_method="nearestidavg", extrap_num_src_pnts=3)
    return base._rounded(w, "s", digits=9)


def map_robust(spark, d):
    return base._rounded(select.map_slice(base.cells(spark, d), "v", base.BBOX, robust=True), "v")


def frames(spark, d):
    return select.sort_cells(select.animation_slices(base.monthly(spark, d), "time"))


def squeezed(spark, d):
    return select.squeeze(base.cells(spark, d).withColumn("level", F.lit(1)), "level", "lat")


def day_moments(spark, d):
    found = live.windowed_moments(base._events(spark, d), "ts", "value", "1 day", "event_type")
    return base._rounded(found.select(F.col("window_start").cast("timestamp_ntz").alias("day"), "event_type", "n", "mean_val", "std_val", (F.col("slope") * 86400).alias("slope")), "mean_val", "std_val", "slope")


def concat_parts(spark, d):
    own = base.cells(spark, d)
    both = tz.concat([own.where("lon < 0"), own.where("lon >= 0")], join="exact")
    return tz.concat([both, own.where("lat = 0").withColumn("lon", F.col("lon") + 90.0)])


def info(spark, d):
    found = profile.spatiotemporal_info(base.monthly(spark, d), ["time", "lat", "lon"])
    row = (found["resolution"]["time"], found["resolution"]["lat"], found["resolution"]["lon"], *map(float, found["lat_bounds"]), *map(float, found["lon_bounds"]), *map(int, found["months_range"]))
    return spark.createDataFrame([row], "freq string, lat_res double, lon_res double, lat_low double, lat_high double, lon_low double, lon_high double, month_min bigint, month_max bigint")


def queries() -> dict:
    own = (
        mk_alpha_lag, mk_native_lag, take_places, take_last, label_lookup, masked_cells, named_stats, merged_variables, corr_fanout, corr_checked, ols_gaps, tz_centre, solar_no_equator, regrid_with_others,
        weights_conserve, weights_dstarea, weights_extrapolated, map_robust, frames, squeezed, day_moments, concat_parts, info,
    )
    return {f.__name__: f for f in own}


_Z = kernels.quantile(0.3)
_CELLS = "grid AS (SELECT (a * 5 + b)::INTEGER AS col, -20 + a * 10.0::DOUBLE AS lat, -30 + b * 15.0::DOUBLE AS lon FROM range(0, 5) r(a), range(0, 5) q(b))"


def _overlap_sql(norm: str) -> str:
    """Overlaps of source cells (10 by 15 degrees) and 4 by 4 target cells (15 by 20)."""
    sin = lambda e: f"sin(radians(least(90.0, greatest(-90.0, {e}))))"
    return f"""y AS (
  SELECT t, s, least({sin('-25 + s * 10 + 10.0')}, {sin('-37.5 + t * 15 + 15.0')}) - greatest({sin('-25.0 + s * 10')}, {sin('-37.5 + t * 15')}) AS o, {sin('-37.5 + t * 15 + 15.0')} - {sin('-37.5 + t * 15')} AS size
  FROM range(0, 4) a(t), range(0, 5) b(s)),
x AS (
  SELECT t, s, least(-37.5 + s * 15 + 15, -55.0 + t * 20 + 20) - greatest(-37.5 + s * 15, -55.0 + t * 20) AS o, 20.0::DOUBLE AS size FROM range(0, 4) a(t), range(0, 5) b(s)),
ny AS (SELECT t, s, o / {'size' if norm == 'dstarea' else 'sum(o) OVER (PARTITION BY t)'} AS w FROM y WHERE o > 1e-12),
nx AS (SELECT t, s, o / {'size' if norm == 'dstarea' else 'sum(o) OVER (PARTITION BY t)'} AS w FROM x WHERE o > 1e-12),
w AS (SELECT (ny.t * 4 + nx.t)::INTEGER AS row, (ny.s * 5 + nx.s)::INTEGER AS col, round(ny.w * nx.w, 9) + 0.0 AS s FROM ny, nx)"""


def near_sql(targets: str, sources: str, k: int, exponent: float) -> str:
    """near: the k nearest sources (lat, lon) of each target (ty, tx) by great circle, with weights w."""
    angle = "round(2 * asin(least(1.0, sqrt(pow(sin(radians(lat - ty) / 2), 2) + cos(radians(lat)) * cos(radians(ty)) * pow(sin(radians(lon - tx) / 2), 2)))), 12)"
    return f"""far AS (SELECT t.*, s.*, {angle} AS angle FROM {targets} t, {sources} s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ty, tx ORDER BY angle, lat, lon) AS k, min(angle) OVER (PARTITION BY ty, tx) AS least FROM far),
kept AS (SELECT *, CASE WHEN least < 1e-11 THEN 1.0 ELSE pow(angle, -{exponent}::DOUBLE) END AS raw FROM ranked WHERE k <= CASE WHEN least < 1e-11 THEN 1 ELSE {k} END),
near AS (SELECT *, raw / sum(raw) OVER (PARTITION BY ty, tx) AS w FROM kept)"""


def spline_sql() -> str:
    """The not-a-knot spline on five equal steps, by axis: its inner bends are v''=d1, (6 d2 - d1 - d3) / 4, d3 over the step squared."""

    def bends(v: str) -> str:
        d = [f"({v}[{i}] - 2 * {v}[{i + 1}] + {v}[{i + 2}])" for i in (1, 2, 3)]
        m1, m2, m3 = d[0], f"((6 * {d[1]} - {d[0]} - {d[2]}) / 4)", d[2]
        return f"[2 * {m1} - {m2}, {m1}, {m2}, {m3}, 2 * {m3} - {m2}]"

    def at(p: str) -> str:  # p in steps from the first knot
        k = f"least(3, floor({p}))::INTEGER"
        u, q = f"({k} + 1 - {p})", f"({p} - {k})"
        return f"({u} * v[{k} + 1] + {q} * v[{k} + 2] + ((pow({u}, 3) - {u}) * m[{k} + 1] + (pow({q}, 3) - {q}) * m[{k} + 2]) / 6)"

    return f"""WITH {base.CELLS_SQL},
cols AS (SELECT lon, list(v ORDER BY lat) AS v FROM cells GROUP BY lon), bent AS (SELECT lon, v, {bends('v')} AS m FROM cols),
ty AS ({base._axis_sql(-20, 2.5, 16, 'ty')}), tx AS ({base._axis_sql(-30, 2.5, 24, 'tx')}),
half AS (SELECT ty, lon, {at('((ty + 20) / 10)')} AS v FROM bent, ty),
rows AS (SELECT ty, list(v ORDER BY lon) AS v FROM half GROUP BY ty), bent2 AS (SELECT ty, v, {bends('v')} AS m FROM rows)
SELECT ty AS lat, tx AS lon, round({at('((tx + 30) / 15)')} + {base.OFF_TIES}, 6) + 0.0 AS v FROM bent2, tx"""


def oracle_sql() -> dict[str, str]:
    r, t_p = base._r, base.t_p_sql("t", "(total - 2)")
    conserve = f"""WITH {base.CELLS_SQL},
ty AS (SELECT -10 + i * 10.0::DOUBLE AS ty FROM range(0, 3) r(i)), tx AS (SELECT -15 + i * 10.0::DOUBLE AS tx FROM range(0, 4) r(i)),
o AS (SELECT ty, tx, v, greatest(0.0, sin(radians(least(lat + 5, ty + 5))) - sin(radians(greatest(lat - 5, ty - 5)))) * greatest(0.0, least(lon + 7.5, tx + 5) - greatest(lon - 7.5, tx - 5)) AS a FROM ty, tx, cells)
SELECT ty AS lat, tx AS lon, round(sum(v * a) / sum(a), 6) + 0.0 AS v FROM o WHERE a > 1e-12 GROUP BY ty, tx"""
    targets = f"targets AS (SELECT ty, tx FROM ({base._axis_sql(-15, 5, 7, 'ty')}), ({base._axis_sql(-20, 5, 10, 'tx')}))"
    outside = f"""targets AS (SELECT (i * 3 + j)::INTEGER AS row, -26 + i * 13.0::DOUBLE AS ty, -44 + j * 22.0::DOUBLE AS tx FROM range(0, 3) a(i), range(0, 3) b(j)),
{_CELLS}, {near_sql('targets', 'grid', 3, 2.0)},
inside AS (
  SELECT row, col, (1 - abs(lat - ty) / 10) * (1 - abs(lon - tx) / 15) AS s FROM targets, grid WHERE abs(ty) <= 20 AND abs(tx) <= 30 AND abs(lat - ty) < 10 AND abs(lon - tx) < 15)"""
    return {
        "mk_alpha_lag": base.hamed_rao_sql(_Z, 3),
        "mk_native_lag": base.native_sql(0.3, 3),
        "interp_cubic": spline_sql(),
        "remap_conservative": conserve,
        "remap_distance": f"WITH {base.CELLS_SQL}, {targets}, {near_sql('targets', 'cells', 4, 1.0)} SELECT ty AS lat, tx AS lon, round(sum(v * w), 6) + 0.0 AS v FROM near GROUP BY ty, tx",
        "take_places": f"WITH {base.MONTHLY_SQL}, a AS (SELECT *, dense_rank() OVER (ORDER BY time) - 1 AS p FROM field) SELECT time, lat, lon, v FROM a WHERE p BETWEEN 3 AND 6",
        "take_last": f"WITH {base.MONTHLY_SQL} SELECT time, lat, lon, v FROM field WHERE time IN ((SELECT min(time) FROM field), (SELECT max(time) FROM field))",
        "label_lookup": f"WITH {base.LONS_SQL} SELECT event_id, lat, lon FROM lons WHERE lat IN (10, -80)",
        "masked_cells": f"WITH {base.CELLS_SQL} SELECT lat, lon, CASE WHEN lat >= 0 THEN v END AS v FROM cells",
        "named_stats": "SELECT event_type, max(value) AS value_hi FROM events GROUP BY event_type",
        "merged_variables": f"""WITH {base.CELLS_SQL}, s AS (
  SELECT (s_nationkey // 5)::DOUBLE * 10 - 20 AS lat, (s_nationkey % 5)::DOUBLE * 15 - 30 AS lon, round(avg(s_acctbal), 3) AS w FROM supplier GROUP BY s_nationkey)
SELECT lat, lon, v, w FROM cells FULL JOIN (SELECT * FROM s WHERE w > 0) USING (lat, lon)""",
        "corr_fanout": """WITH p AS (SELECT c_nationkey AS k, corr(c_acctbal, s_acctbal) AS r FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1)
SELECT k, round(r, 4) + 0.0 AS corr FROM p WHERE isfinite(r)""",
        "corr_checked": base.PEARSON_SQL,
        "ols_gaps": f"""WITH o AS (SELECT user_id, CASE WHEN event_id % 4 <> 0 THEN value END AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts)::DOUBLE AS x FROM events),
f AS (SELECT user_id, regr_slope(y, x) AS slope, regr_sxx(y, x) AS sxx, regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x) AS sse, count(*)::DOUBLE AS total, avg(y) AS mean_val, stddev_pop(y) AS std_val FROM o GROUP BY user_id),
g AS (SELECT *, CASE WHEN total > 2 AND sse > 0 THEN slope / sqrt(sse / (total - 2) / sxx) END AS t FROM f)
SELECT user_id, {r('slope', 'slope')}, CASE WHEN t IS NOT NULL THEN round({t_p}, 6) END AS p_value, {r('mean_val', 'mean_val')}, {r('std_val', 'std_val')} FROM g""",
        "tz_centre": f"WITH {base.LONS_SQL}, b AS (SELECT event_id, time, CASE WHEN {base.BAND} = 180 THEN -12 ELSE ({base.BAND} / 15)::INTEGER END AS h FROM lons) SELECT event_id, time + to_hours(h) AS time, h AS utc_offset_h FROM b",
        "solar_no_equator": f"WITH {base.LONS_SQL} SELECT event_id, CASE WHEN lat + 80 <> 0 THEN time + to_hours(round_even(lon * 24 / 360, 0)::BIGINT) END AS local_solar_time FROM lons",
        "regrid_with_others": f"WITH {base.MONTHLY_SQL}, {base._bilinear_sql(-15, -25, 7.5, 5, 5, 'time', 'field', resx=10)}, n AS (SELECT time, count(*) AS cells FROM field GROUP BY time) SELECT time, ty AS lat, tx AS lon, round(v, 6) + 0.0 AS v, cells FROM met JOIN n USING (time)",
        "weights_conserve": f"WITH {_overlap_sql('fracarea')} SELECT row, col, s, -30.0::DOUBLE + (row // 4) * 15 AS lat, -45.0::DOUBLE + (row % 4) * 20 AS lon FROM w",
        "weights_dstarea": f"WITH {_overlap_sql('dstarea')} SELECT row, col, s FROM w",
        "weights_extrapolated": f"WITH {outside} SELECT row, col, round(s, 9) + 0.0 AS s FROM inside WHERE s > 0 UNION ALL SELECT row, col, round(w, 9) + 0.0 FROM near WHERE row NOT IN (SELECT row FROM inside)",
        "map_robust": f"""WITH {base.CELLS_SQL}, c AS (SELECT * FROM cells WHERE lon BETWEEN {base.BBOX[0]} AND {base.BBOX[2]} AND lat BETWEEN {base.BBOX[1]} AND {base.BBOX[3]}),
q AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM c) SELECT lat, lon, {r('greatest(lo, least(hi, v))', 'v')} FROM c, q""",
        "frames": f"WITH {base.MONTHLY_SQL} SELECT *, (dense_rank() OVER (ORDER BY time) - 1)::BIGINT AS frame FROM field",
        "squeezed": f"WITH {base.CELLS_SQL} SELECT lat, lon, v FROM cells",
        "day_moments": f"""WITH e AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, value AS v, (epoch_us(ts) - epoch_us(date_trunc('day', ts)::TIMESTAMP)) / 86400e6 AS x FROM events)
SELECT day, event_type, count(v) AS n, {r('avg(v)', 'mean_val')}, {r('stddev_samp(v)', 'std_val')}, {r('regr_slope(v, x)', 'slope')} FROM e GROUP BY day, event_type""",
        "concat_parts": f"WITH {base.CELLS_SQL} SELECT lat, lon, v FROM cells UNION ALL SELECT lat, lon + 90, v FROM cells WHERE lat = 0",
        "info": f"""WITH {base.MONTHLY_SQL}, t AS (SELECT DISTINCT time FROM field), s AS (SELECT time, date_diff('second', lag(time) OVER (ORDER BY time), time) AS step FROM t),
m AS (SELECT step FROM s WHERE step IS NOT NULL GROUP BY step ORDER BY count(*) DESC, step LIMIT 1), k AS (SELECT month(time) AS m, step FROM s JOIN m USING (step))
SELECT (any_value(step) // 2419200)::VARCHAR || 'M' AS freq, 10.0::DOUBLE AS lat_res, 15.0::DOUBLE AS lon_res, -20.0::DOUBLE AS lat_low, 20.0::DOUBLE AS lat_high, -30.0::DOUBLE AS lon_low, 30.0::DOUBLE AS lon_high, min(m) AS month_min, max(m) AS month_max FROM k""",
    }
