"""The engine's own operators: SQL twins, hand-made cases, properties and plans."""

import collections
import datetime
import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldframe.functions import mathx
from fieldframe.operators import grid, kernels, ordering, profile, select, stats, tz
from fieldframe import field, session
from fieldframe.plans import more
from fieldframe.plans import queries as plans
from fieldframe.schema import GridSpec
from fieldframe.sources import io
from fieldframe.streaming import live

NOISY = [3.0, 1.5, 4.2, 4.0, 2.2, 6.1, 5.0, 7.3, 6.9, 6.2, 9.0, 8.1]


def plain(v):
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 5) + 0.0
    return str(v)


QUERIES = plans.queries() | more.queries()
ORACLE = plans.oracle_sql() | more.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "orders", "customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    frame = QUERIES[name](spark, sf)
    cols = sorted(frame.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in cols) for r in frame.collect())
    want = collections.Counter(tuple(map(plain, r)) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})").fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def series(spark, groups):
    rows = [(k, i, v) for k, values in groups.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, t int, v double").orderBy(F.rand(3))


def test_trends_by_hand(spark):
    got = {r.k: r for r in stats.calc_trends(series(spark, {"noisy": NOISY, "flat": [2.0] * 6, "one": [1.0], "two": [1.0, 3.0], "gap": [1.0, None, float("nan"), 4.0, 2.0, 5.0]}), "t", data_var="v", groupby="k").collect()}
    pairs = [(NOISY[j] - NOISY[i], j - i) for i, j in itertools.combinations(range(12), 2)]
    s = sum(np.sign(d) for d, _ in pairs)
    assert got["noisy"].slope == pytest.approx(np.median([d / k for d, k in pairs])) and got["noisy"].tau == pytest.approx(s / 66)
    assert got["noisy"].std_val == pytest.approx(np.std(NOISY, ddof=1)) and got["noisy"].trend == 1
    assert (got["flat"].slope, got["flat"].z_score, got["flat"].p_value, got["flat"].trend) == (0, 0, 1, 0)
    assert got["one"].slope is None and got["one"].trend is None
    assert got["two"].slope == 2 and got["two"].p_value is None
    assert got["gap"].mean_val == 3 and got["gap"].slope == pytest.approx(np.median([3, 0.5, 4 / 3, -2, 0.5, 3]))
    with pytest.raises(ValueError):
        stats.calc_trends(series(spark, {"a": [1.0]}), "t")
    with pytest.raises(TypeError):
        stats.calc_trends([1, 2], "t", data_var="v")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-50, 50).map(float), min_size=3, max_size=40))
def test_trend_is_antisymmetric(values):
    x = np.array(values)
    a, b = kernels.hamed_rao(x), kernels.hamed_rao(x[::-1].copy())
    assert a[5] == pytest.approx(-b[5]) and a[0] == pytest.approx(-b[0])
    assert kernels.hamed_rao(x, 3.0)[0] == pytest.approx(3 * a[0])


def test_distribution_functions(spark):
    zs, ts = [0.0, 1.0, 1.96, -2.5, 6.0], [(2.228138851964939, 10.0), (12.706204736432095, 1.0), (1.0, 30.5), (0.0, 4.0), (2.570581835636314, 5.0)]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", mathx.norm_cdf(F.col("z")).alias("p")).collect()
    assert all(r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), abs=1e-14) for r in got)
    got = [r.p for r in spark.createDataFrame(ts, "t double, n double").select(mathx.t_p(F.col("t"), F.col("n")).alias("p")).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-9) and got[1] == pytest.approx(0.05, abs=1e-9) and got[3] == 1 and got[4] == pytest.approx(0.05, abs=1e-8)


def test_kendall_exact_and_normal():
    x = np.arange(5.0)
    y = np.array([1.0, 0.0, 2.0, 4.0, 3.0])
    tau, p = kernels.kendall(x, y)
    s = sum(np.sign((x[j] - x[i]) * (y[j] - y[i])) for i, j in itertools.combinations(range(5), 2))
    all_s = [sum(np.sign(q[j] - q[i]) for i, j in itertools.combinations(range(5), 2)) for q in itertools.permutations(range(5))]
    assert tau == s / 10 and p == pytest.approx(min(1, 2 * np.mean([v >= s for v in all_s])))
    assert kernels.kendall(x, x, "less")[1] == 1 and kernels.kendall(x, np.ones(5)) == (None, None)


def test_correlation_edges(spark):
    x = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(NOISY)] + [("c", i, 1.0) for i in range(4)] + [("n", 0, None), ("n", 1, 2.0)], "k string, t int, x double")
    y = spark.createDataFrame([("a", i, float(i)) for i in range(12)] + [("c", i, float(i)) for i in range(4)] + [("n", 0, 1.0), ("n", 1, 2.0)], "k string, t int, y double")
    for kind in ("pearson", "spearman", "kendall"):
        got = {r.k: r for r in stats.calc_corr(x, y, x_var="x", y_var="y", corr_type=kind, groupby="k", along="t").collect()}
        assert got["a"].corr > 0.6 and got["a"].p_value < 0.01 and got["c"].corr is None and got["n"].corr is None
        more, less = (stats.calc_corr(x, y, x_var="x", y_var="y", corr_type=kind, groupby="k", along="t", alternative=a).where("k = 'a'").first().p_value for a in ("greater", "less"))
        assert more < 0.01 and less > 0.99
    assert got["a"].corr == pytest.approx(kernels.kendall(np.array(NOISY), np.arange(12.0))[0])
    assert stats.calc_corr(x, y, x_var="x", y_var="y").first().corr is not None
    with pytest.raises(ValueError):
        stats.calc_corr(x, y, x_var="x", y_var="y", corr_type="other")
    with pytest.raises(ValueError):
        stats.calc_corr(x, y, x_var="x", y_var=None)
    with pytest.raises(ValueError):
        stats.validate_alignment(x, y.where("k = 'a'"), ["k", "t"])


def test_time_zones(spark):
    lons = [-180.0, -179.9, -172.5, -7.5, -0.4, 0.0, 7.5, 22.5, 172.5, 175.0, 180.0, 187.5, 359.0]
    t = datetime.datetime(2020, 1, 1)
    df = spark.createDataFrame([(t, 0.0, x) for x in lons], "time timestamp_ntz, lat double, lon double")
    wrapped = [(x + 180) % 360 - 180 for x in lons]
    got = tz.split_by_timezones(df.withColumn("was", F.col("lon"))).collect()
    for r in got:
        w = wrapped[lons.index(r.was)]
        assert r.utc_offset_h == round(w * 24 / 360) and r.band == round(w / 15) * 15 and r.time == t + datetime.timedelta(hours=r.utc_offset_h) and r.tz == f"UTC{r.utc_offset_h}"
    parity = {r.was: r.utc_offset_h for r in tz.split_by_timezones(df.withColumn("was", F.col("lon")), parity_dateline=True).collect()}
    assert parity[175.0] == -12 and len(got) == len(lons)
    assert tz.local_solar_time(df, parity_equator_null=True).where("local_solar_time is not null").count() == 0
    assert {r.local_solar_time for r in tz.local_solar_time(df.where("lon = 359")).collect()} == {t + datetime.timedelta(hours=24)}
    with pytest.raises(ValueError):
        tz.tz_apply(lambda f: f, df.drop("lat"))


@pytest.mark.parametrize("d,n", [(7, 3), (30, 22), (5, 5), (9, 1)])
def test_split(spark, d, n):
    got = {r.x: r.split for r in select.split_by_dims(spark.range(d).selectExpr("cast(id as double) * 2 as x", "id as v"), "x", n).collect()}
    bounds = [i * d // n for i in range(n + 1)]
    assert [got[2.0 * i] for i in range(d)] == [k for k in range(n) for _ in range(bounds[k], bounds[k + 1])]
    with pytest.raises(ValueError):
        select.split_by_dims(spark.range(3).withColumnRenamed("id", "x"), "x", 4)


@pytest.mark.parametrize("step,text", [(30, "30S"), (900, "15T"), (21600, "6H"), (86400, "1D"), (604800, "1W"), (31 * 86400, "1M"), (365 * 86400, "1Y"), (290304000, "110Y")])
def test_frequency(spark, step, text):
    times = [datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=step * i) for i in range(5)]
    df = spark.createDataFrame([(x,) for x in [*times[::-1], times[-1] + datetime.timedelta(seconds=2 * step)]], "time timestamp_ntz")
    assert profile.time_frequency(df).first().freq == text
    assert profile.time_frequency(df.limit(1)).first().freq is None


def affine(spark, hole=False):
    rows = [(float(a), float(b), None if hole and (a, b) == (2, 4) else 2.0 * a + 3.0 * b + 1) for a in range(0, 10, 2) for b in range(0, 12, 2)]
    return spark.createDataFrame(rows, "lat double, lon double, v double")


def test_interpolation_keeps_planes(spark):
    for method in ("linear", "cubic"):
        rows = grid.interp(affine(spark), ["v"], 0.5, method).collect()
        assert len(rows) == 16 * 20 and all(r.v == pytest.approx(2 * r.lat + 3 * r.lon + 1) for r in rows)
    rows = {(r.lat, r.lon): r.v for r in grid.interp(affine(spark, True), ["v"], 1.0, "linear").collect()}
    assert rows[(1.0, 3.0)] is None and rows[(0.0, 4.0)] is not None and rows[(3.0, 8.0)] == 31
    got = {(r.lat, r.lon): r.v for r in grid.remap(affine(spark), ["v"], (1.0, 1.0, 5.0, 5.0), 2.0, "remapcon").collect()}
    assert len(got) == 9 and got[(3.0, 3.0)] == pytest.approx(16, abs=0.01)
    near = {(r.lat, r.lon): r.v for r in grid.remap(affine(spark), ["v"], (0.0, 0.0, 4.0, 4.0), 2.0, "remapdis").collect()}
    assert near[(2.0, 4.0)] == 17 and len(near) == 9
    with pytest.raises(ValueError):
        grid.remap(affine(spark), ["v"], None)
    for _, rows in itertools.groupby(grid.conservative_weights([0.0, 1.0, 2.0, 3.0], [0.5, 1.5], True), key=lambda r: r[0]):
        assert sum(r[2] for r in rows) == pytest.approx(1)


def test_mask_and_mesh(spark):
    mask = spark.createDataFrame([(0.0, 0.0, True, False), (0.0, 8.0, False, True), (8.0, 0.0, False, True), (8.0, 8.0, True, False)], "lat double, lon double, land boolean, ocean boolean")
    got = grid.land_sea_mask(affine(spark), mask, "land", ["v"]).collect()
    assert len(got) == 30 and all((r.v is not None) == ((r.lat <= 4) == (r.lon <= 4)) for r in got)
    with pytest.raises(ValueError):
        grid.land_sea_mask(affine(spark), mask, None, ["v"])
    mesh = spark.createDataFrame([(1, i, float(i)) for i in range(4)] + [(2, i, None if i == 3 else 1.0) for i in range(4)], "time int, ncol int, v double")
    w = spark.createDataFrame([(0, 0, 1.0), (1, 1, 0.5), (1, 3, 0.5), (2, 2, 1.0)], "row int, col int, s double")
    dst = spark.createDataFrame([(i, float(i // 2), float(i % 2)) for i in range(4)], "row int, lat double, lon double")
    out = {(r.time, r.lat, r.lon): r.v for r in grid.regrid_weights(mesh, w, dst, ["v"]).collect()}
    assert out[(1, 0.0, 1.0)] == 2 and out[(2, 0.0, 1.0)] is None and (1, 1.0, 1.0) not in out
    assert GridSpec.from_bbox((0, 0, 1.2, 1.0), 0.1).xsize == 13


def test_plans(spark, sf):
    plan = lambda df: df._jdf.queryExecution().toString()
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("value").alias("lon"), F.col("value").alias("lat"))
    assert "PushedFilters: [IsNotNull(value), GreaterThanOrEqual" in plan(select.crop(rows, (0, 0, 9, 9)))
    for name in ("mask_nearest", "interp_linear", "regrid_weights"):
        assert "NestedLoop" not in plan(plans.queries()[name](spark, sf)) and "Cartesian" not in plan(plans.queries()[name](spark, sf))


def test_io_and_views(spark, tmp_path):
    df = affine(spark)
    df.where("lat < 4").write.parquet(str(tmp_path / "a.parquet"))
    df.where("lat >= 4").write.parquet(str(tmp_path / "b.parquet"))
    out = io.merge_time_files(spark, [str(tmp_path / "b.parquet"), str(tmp_path / "a.parquet")], str(tmp_path / "c"), time="lat")
    assert spark.read.parquet(out).count() == 30
    assert select.map_slice(df, "v", (0, 0, 4, 4)).count() == 9 and select.take_index(df, "lat", 1, 3).count() == 12
    assert select.animation_slices(df, "lat").where("frame = 4").count() == 6
    with pytest.raises(ValueError):
        select.map_slice(df.withColumn("time", F.lit(1)), "v")
    info = profile.spatiotemporal_info(df.withColumn("time", F.make_date(F.lit(2020), F.lit(1), F.col("lat").cast("int") + 1).cast("timestamp_ntz")))
    assert info["resolution"] == {"time": "2D", "lat": 2.0, "lon": 2.0} and info["lat_bounds"] == (0, 8) and info["years_range"] == (2020, 2020) and "time_bounds" not in info
    info = profile.spatiotemporal_info(df.select(F.make_date(F.lit(2020), F.lit(1), F.col("lat").cast("int") + 1).cast("timestamp").alias("when"), "lon"), ["when", "lon"])
    assert info["resolution"]["when"] == "2D" and info["when_bounds"][0].day == 1
    with pytest.raises(ValueError):
        io.merge_time_files(spark, [str(tmp_path / "a.parquet")], str(tmp_path / "a.parquet"), time="lat")
    again = io.merge_time_files(spark, [str(tmp_path / "b.parquet"), str(tmp_path / "a.parquet")], str(tmp_path / "e"), time="lat", delete_input=True)
    assert spark.read.parquet(again).count() == 30 and not (tmp_path / "a.parquet").exists()
    (tmp_path / "x.nc").write_bytes(b"CDF\x01 and so on")
    assert io.file_type(str(tmp_path / "x.nc")) == "netcdf" and io.file_type("y.csv") == "csv"
    spark.createDataFrame([(1, 2, 0.5)], "row int, col int, s double").withColumn("more", F.lit(1)).write.parquet(str(tmp_path / "w"))
    assert io.read_weights(spark, str(tmp_path / "w")).collect() == [(1, 2, 0.5)]
    assert io.temp_path(spark, f"file://{tmp_path}") != io.temp_path(spark, f"file://{tmp_path}")


def test_streaming(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.select("ts", "event_type", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, event_type string, value double").parquet(str(tmp_path / "in"))
    query = live.windowed_moments(stream, "ts", "value", "1 day", "event_type").writeStream.format("memory").queryName("moments").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("moments").agg(F.sum("n")).first()[0] == events.count()


def test_entry(spark):
    import __spark_entry__ as own

    assert own.entry(spark).count() == 5
    assert set(own.oracle_sql()) <= set(own.queries())


def test_long_series_kernels_agree_with_pairs():
    rng = np.random.default_rng(1)
    for n in (2, 3, 5, 17, 64, 200):
        for x in (rng.integers(0, 5, n).astype(float), rng.normal(size=n)):
            pairs = list(itertools.combinations(range(n), 2))
            assert kernels.inversions(x) == sum(x[i] > x[j] for i, j in pairs)
            assert kernels.sign_sum(x) == sum(np.sign(x[j] - x[i]) for i, j in pairs)
            assert kernels.median_slope(x, 0) == pytest.approx(np.median([(x[j] - x[i]) / (j - i) for i, j in pairs]), abs=1e-9)
    x = rng.normal(size=4_000).cumsum()
    d = x - x.mean()
    rho = kernels.autocorrelation(x, 3_999)
    assert all(rho[k - 1] == pytest.approx(d[:-k] @ d[k:] / (d @ d)) for k in (1, 7, 3_000)) and len(rho) == 3_999
    z = kernels.hamed_rao(x[:50], alpha=0.05)[6]
    assert kernels.hamed_rao(np.array([3.0, 1, 4, 1, 5, 9, 2, 6]), alpha=0.5)[2] == 1 and kernels.hamed_rao(np.array([3.0, 1, 4, 1, 5, 9, 2, 6]))[2] == 0 and z


@pytest.mark.parametrize("small", [10_000, 0])
def test_places_of_large_axes(spark, monkeypatch, small):
    monkeypatch.setattr(ordering, "SMALL", small)
    monkeypatch.setattr(ordering, "BUCKETS", 7)
    rows = spark.range(3_000).selectExpr("(id * 7919) % 1009 as k", "cast((id * 7919) % 1009 as string) as s", "timestamp_seconds((id * 7919) % 1009 * 60) as t", "cast((id * 31) % 977 as double) / 3 as v")
    for c, keys in (("k", range(1009)), ("s", sorted(map(str, range(1009)))), ("t", range(1009))):
        got = sorted((r[1], r[0]) for r in ordering.places(rows, c).collect())
        assert [p for p, _ in got] == list(range(1009))
        assert c == "t" or [v for _, v in got] == list(keys)
    values = np.array([r.v for r in rows.select("v").collect()])
    q = ordering.percentiles(rows, "v", [0.0, 0.02, 0.5, 0.981, 1.0]).first()
    assert list(q) == pytest.approx(np.quantile(values, [0.0, 0.02, 0.5, 0.981, 1.0]))
    assert list(ordering.percentiles(rows.where("v < 0"), "v", [0.5]).first()) == [None]
    assert profile.time_frequency(rows, "t").first().freq == "1T"
    assert select.split_by_dims(rows, "k", 3).groupBy("split").agg(F.count_distinct("k").alias("n")).where("n between 336 and 337").count() == 3
    assert {r.k for r in select.take_index(rows, "k", -2, 1009).collect()} == {1007, 1008}


def test_pandas_groups_are_bounded(spark):
    df = affine(spark).withColumn("time", F.make_date(F.lit(2020), F.lit(1), F.lit(1)).cast("timestamp_ntz"))
    count = lambda rows: rows[["lat"]].iloc[:1].assign(n=len(rows))
    assert {r.n for r in tz.tz_apply_pandas(count, df, "lat double, n bigint", by=["lat"]).collect()} == {4, 2}  # bands of 0 and 15
    with pytest.raises(ValueError):
        tz.tz_apply_pandas(count, df, "lat double, n bigint", max_rows=10)


def test_concat_of_parts(spark):
    df = affine(spark)
    assert tz.concat([df.where("lon < 4"), df.where("lon >= 4")], join="exact").count() == 30
    with pytest.raises(ValueError):
        tz.concat([df.where("lon < 4"), df.where("lon >= 4 and lat > 0")], join="exact")
    assert tz.concat([df.where("lon < 4"), df.where("lon >= 4 and lat > 0")]).count() == 26
    with pytest.raises(ValueError):
        tz.concat([], join="exact")


def test_squeeze_and_merge(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, None), (1, 3.0, 3.0, None)], "a int, b double, c double, e int")
    assert select.squeeze(df, "a", "b", "c", "e").columns == ["b"] and select.squeeze(df).columns == df.columns
    with pytest.raises(ValueError):
        stats.merge_variables([df, df], ["a"])


def test_weight_options(spark):
    for bad in ({"methd": "bilinear"}, {"source": "x.nc"}, {"method": "patch"}, {"norm_type": "none"}):
        with pytest.raises(ValueError):
            grid.weight_options(**bad)
    assert grid.weight_options(m="conserve", i=True)["method"] == "conserve"
    axis, spec = [0.0, 10.0, 20.0], GridSpec(4, 4, -5.0, 10.0, -5.0, 10.0)
    with pytest.raises(ValueError):
        grid.generate_weights(spark, axis, axis, spec)
    for options in ({"extrap_method": "neareststod"}, {"extrap_method": "nearestidavg"}, {"method": "distance"}, {"method": "neareststod"}):
        w, dst = grid.generate_weights(spark, axis, axis, spec, **options)
        sums = {r.row: r.s for r in w.groupBy("row").agg(F.sum("s").alias("s")).collect()}
        assert set(sums) == set(range(16)) and all(v == pytest.approx(1) for v in sums.values()) and dst.count() == 16


def test_cubic_weights_of_long_axes():
    src = [float(i) for i in range(120)]
    values = np.sin(np.array(src) / 7)
    second = (grid._spline(np.array(src)) * values).sum(axis=1)
    inner = (second[:-2] + 4 * second[1:-1] + second[2:]) / 6
    assert inner == pytest.approx(np.diff(values, 2)) and np.diff(second)[[0, -1]] == pytest.approx(np.diff(second)[[1, -2]])
    got = {}
    for t, s, w in grid.cubic_weights(src, [0.25, 60.5, 118.9]):
        got[t] = got.get(t, 0.0) + w * values[int(s)]
    for t, v in got.items():
        k = int(t)
        u, q = k + 1 - t, t - k
        assert v == pytest.approx(u * values[k] + q * values[k + 1] + ((u**3 - u) * second[k] + (q**3 - q) * second[k + 1]) / 6, abs=1e-12)


def test_nearest_cells_by_brute_force():
    lats, lons = np.arange(-85, 90, 10.0), np.arange(0, 360, 15.0)
    for y, x in ((3, 7), (89, 100), (-89.9, 0), (12, 359), (0, 0), (5, 7.5)):
        a, b = np.meshgrid(lats, lons, indexing="ij")
        half = np.sin(np.radians(a - y) / 2) ** 2 + np.cos(np.radians(a)) * np.cos(np.radians(y)) * np.sin(np.radians(b - x) / 2) ** 2
        want = sorted((round(float(2 * np.arcsin(np.minimum(1, np.sqrt(half[i, j])))), 12), i, j) for i in range(len(lats)) for j in range(len(lons)))[:4]
        assert grid._nearest_cells(lats, lons, y, x, 4) == want


def test_named_masks(spark, tmp_path):
    with pytest.raises(ValueError):
        grid.read_mask(spark, "moon", str(tmp_path))
    spark.createDataFrame([(0.0, 0.0, True)], "lat double, lon double, land boolean").write.parquet(str(tmp_path / "era5_0.25_mask.parquet"))
    assert grid.read_mask(spark, "era5", str(tmp_path)).count() == 1


def test_field_and_helpers(spark, tmp_path, capsys):
    own = field.Field(affine(spark))
    assert own.crop((0, 0, 4, 4)).squeeze("lat").df.count() == 9 and own.info(["lat"])["lat_bounds"] == (0, 8)
    with pytest.raises(AttributeError):
        own.nothing
    with pytest.raises(TypeError):
        own.crop((0, 0, 1, 1), colour="red")
    assert session.timeit(lambda: 3)() == 3
    session.log("a", 1, level="INFO")
    session.line_break("-", 5)
    said = capsys.readouterr().out
    assert "finished in" in said and "[INFO] a 1" in said and "-----" in said
    try:
        1 / 0
    except ZeroDivisionError:
        session.log("oh", level="ERROR", out=tmp_path / "log.txt")
    assert "ZeroDivisionError" in (tmp_path / "log.txt").read_text()
    with pytest.raises(ValueError):
        session.log("x", level="LOUD")
    assert session.signature(lambda a, b=2: a) == {"a": None, "b": 2}
    assert session.get_spark().conf.get("spark.sql.session.timeZone") == "UTC"
