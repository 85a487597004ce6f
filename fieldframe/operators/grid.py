"""Interpolation, remapping, masks and sparse-weight regridding.

Axes are small and live on the driver, and so do weights along one axis; those
of cells are made by the executors. Weights are tables of coordinates in
micro-degrees. Cells find their weights by equi-joins on integers, so no range
join is needed.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import GridSpec, degrees_key, require_columns, value
from .select import BBox, crop

#: Most values of an axis; larger ones are no grid.
MAX_AXIS = 200_000


def axis(df: DataFrame, name: str) -> list[float]:
    """Distinct values of a coordinate, ascending."""
    rows = df.select(F.col(name).cast("double").alias("v")).where("v is not null").distinct().limit(MAX_AXIS + 1).collect()
    if len(rows) > MAX_AXIS:
        raise ValueError(f"{name} has over {MAX_AXIS} values")
    return sorted(r[0] for r in rows)


def target_axis(low: float, high: float, step: float) -> list[float]:
    """low, low+step, ... without the upper bound."""
    return [low + k * step for k in range(max(0, math.ceil((high - low) / step - 1e-9)))]


def linear_weights(src: list[float], dst: list[float]) -> list[tuple[float, float, float]]:
    """(target, source, weight); nothing for targets outside the sources."""
    out, s = [], np.array(src)
    for x in dst:
        k = int(np.searchsorted(s, x - 1e-9))
        if k < len(s) and abs(s[k] - x) <= 1e-9:
            out.append((x, src[k], 1.0))
        elif 0 < k < len(s):
            w = (s[k] - x) / (s[k] - s[k - 1])
            out += [(x, src[k - 1], float(w)), (x, src[k], float(1 - w))]
    return out


def nearest_weights(src: list[float], dst: list[float], inside: bool = True) -> list[tuple[float, float, float]]:
    """The nearest source, the lower one of two; inside: targets outside the sources get none."""
    s, out = np.array(src), []
    for x in dst:
        if not len(s) or inside and not s[0] - 1e-9 <= x <= s[-1] + 1e-9:
            continue
        at = int(np.searchsorted(s, x))
        near = range(max(0, at - 2), min(len(s), at + 2))
        out.append((x, src[min(near, key=lambda k: round(abs(s[k] - x), 9))], 1.0))
    return out


#: Knots on each side of an interval that its spline weights reach; those farther away weigh less than 1e-20.
REACH = 40


def _spline(x: np.ndarray) -> np.ndarray:
    """Second derivatives of the not-a-knot cubic spline at the knots, as a matrix on the values.

    The outer ones follow from their neighbours (the third derivative goes on
    over the second knot); the inner ones solve a tridiagonal system.
    """
    n, h = len(x), np.diff(x)
    inner = np.arange(1, n - 1)
    right = np.zeros((n - 2, n))
    right[inner - 1, inner - 1], right[inner - 1, inner], right[inner - 1, inner + 1] = 1 / h[:-1], -1 / h[:-1] - 1 / h[1:], 1 / h[1:]
    low, middle, high = h[:-1] / 6, (h[:-1] + h[1:]) / 3, h[1:] / 6
    first, last = h[0] / h[1], h[-1] / h[-2]
    middle[0] += low[0] * (1 + first)
    high[0] -= low[0] * first
    middle[-1] += high[-1] * (1 + last)
    low[-1] -= high[-1] * last
    for i in range(1, n - 2):
        share = low[i] / middle[i - 1]
        middle[i] -= share * high[i - 1]
        right[i] -= share * right[i - 1]
    bend = np.zeros((n, n))
    bend[n - 2] = right[-1] / middle[-1]
    for i in range(n - 3, 0, -1):
        bend[i] = (right[i - 1] - high[i - 1] * bend[i + 1]) / middle[i - 1]
    bend[0] = (1 + first) * bend[1] - first * bend[2]
    bend[-1] = (1 + last) * bend[-2] - last * bend[-3]
    return bend


def cubic_weights(src: list[float], dst: list[float]) -> list[tuple[float, float, float]]:
    """Weights of the not-a-knot cubic spline through the sources."""
    x, n = np.array(src), len(src)
    if n < 4:
        raise ValueError("cubic interpolation needs four points an axis")
    out, known = [], (-1, -1, None)
    for t in dst:
        if not x[0] - 1e-9 <= t <= x[-1] + 1e-9:
            continue
        k = min(max(int(np.searchsorted(x, t)) - 1, 0), n - 2)
        low, high = max(0, k + 1 - REACH), min(n, k + 1 + REACH)
        if (low, high) != known[:2]:
            known = (low, high, _spline(x[low:high]))
        bend, j, h, eye = known[2], k - low, x[k + 1] - x[k], np.eye(high - low)
        u, v = (x[k + 1] - t) / h, (t - x[k]) / h
        w = u * eye[j] + v * eye[j + 1] + ((u**3 - u) * bend[j] + (v**3 - v) * bend[j + 1]) * h**2 / 6
        out += [(t, src[low + i], float(w[i])) for i in range(high - low) if abs(w[i]) > 1e-17 or i in (j, j + 1) and w[i]]
    return out


def _edges(points: list[float]) -> np.ndarray:
    p = np.array(points)
    middle = (p[1:] + p[:-1]) / 2
    return np.concatenate(([p[0] - (middle[0] - p[0])], middle, [p[-1] + (p[-1] - middle[-1])])) if len(p) > 1 else np.array([p[0] - 0.5, p[0] + 0.5])


def conservative_weights(src: list[float], dst: list[float], latitude: bool, norm: str | None = None) -> list[tuple[float, float, float]]:
    """Shares of each target cell that source cells cover (areas on the sphere for latitudes).

    norm: None gives targets that are wholly covered only; dstarea divides by
    the target's size, fracarea by the part of it that is covered.
    """
    size = (lambda e: np.sin(np.radians(np.clip(e, -90, 90)))) if latitude else (lambda e: e)
    s, d, out = size(_edges(src)), size(_edges(dst)), []
    for i, t in enumerate(dst):
        first, last = max(0, int(np.searchsorted(s, d[i], side="right")) - 1), min(len(src), int(np.searchsorted(s, d[i + 1])))
        over = np.minimum(s[first + 1 : last + 1], d[i + 1]) - np.maximum(s[first:last], d[i])
        over[over < 1e-15] = 0
        total, whole = over.sum(), d[i + 1] - d[i]
        if total > 0 and (norm or total >= whole * (1 - 1e-9)):
            out += [(t, src[first + j], float(over[j] / (whole if norm == "dstarea" else total))) for j in np.flatnonzero(over)]
    return out


def _nearest_cells(lats: np.ndarray, lons: np.ndarray, y: float, x: float, k: int) -> list[tuple[float, int, int]]:
    """(angle, place of lat, place of lon) of the k nearest cells of a grid by great circle; ties in order of lat, then lon.

    On one latitude the distance grows with the difference of longitude, and
    it is never less than that of latitude: rows are gone through outwards
    until none can be nearer, and only the nearest longitudes of each count.
    """
    turn = np.abs((lons - x + 180.0) % 360.0 - 180.0)
    columns = np.sort(np.argsort(turn, kind="stable")[: k + 1])
    half = np.radians(turn[columns]) / 2
    found: list[tuple[float, int, int]] = []
    rows = np.argsort(np.abs(lats - y), kind="stable")
    for at in range(0, len(rows), 8):
        some = rows[at : at + 8]
        if len(found) >= k and math.radians(abs(lats[some[0]] - y)) > found[k - 1][0] + 1e-12:
            break
        p, q = np.radians(lats[some])[:, None], math.radians(y)
        angle = 2 * np.arcsin(np.minimum(1, np.sqrt(np.sin((p - q) / 2) ** 2 + np.cos(p) * math.cos(q) * np.sin(half)[None, :] ** 2)))
        found += [(round(float(a), 12), int(some[i]), int(columns[j])) for (i, j), a in np.ndenumerate(angle)]
        found = sorted(found)[: k + 1]
    return found[:k]


def distance_table(spark: SparkSession, lats: list[float], lons: list[float], spec: GridSpec, k: int = 4, exponent: float = 1.0) -> DataFrame:
    """ty, tx, sy, sx, w: the k nearest sources of each target by great circle, by inverse distance; made by the executors."""
    la, lo, xs, y0, dy, x0, dx = np.array(lats), np.array(lons), spec.xsize, spec.yfirst, spec.yinc, spec.xfirst, spec.xinc

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for cell in frame["id"].tolist():
                y, x = y0 + cell // xs * dy, x0 + cell % xs * dx
                near = _nearest_cells(la, lo, y, x, k)
                if near[0][0] < 1e-11:
                    near, w = near[:1], np.ones(1)
                else:
                    w = np.array([a for a, _, _ in near]) ** -exponent
                out += [(y, x, la[i], lo[j], v) for (_, i, j), v in zip(near, (w / w.sum()).tolist())]
            yield pd.DataFrame(out, columns=["ty", "tx", "sy", "sx", "w"])

    if not lats or not lons:
        raise ValueError("no cells to take weights from")
    return spark.range(spec.xsize * spec.ysize).mapInPandas(run, "ty double, tx double, sy double, sx double, w double")


def _table(spark: SparkSession, rows: list[tuple], fields: str) -> DataFrame:
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], fields)


def _whole(v: Column, w: Column) -> Column:
    """Weighted sum; NULL if any value is missing."""
    return F.when(F.count(v) == F.count(F.lit(1)), F.sum(v * w))


def separable(df: DataFrame, lat_rows: list[tuple], lon_rows: list[tuple], names: list[str], keys: list[str], x: str = "lon", y: str = "lat") -> DataFrame:
    """Apply weights of both axes: keys, y, x and the variables on the target grid.

    A target needs all its corners: if one is absent or missing, it is NULL or absent.
    """
    spark = df.sparkSession
    wy = _table(spark, lat_rows, "ty double, sy double, wy double").withColumn("ky", degrees_key(F.col("sy"))).withColumn("ny", F.count(F.lit(1)).over(_by("ty")))
    wx = _table(spark, lon_rows, "tx double, sx double, wx double").withColumn("kx", degrees_key(F.col("sx"))).withColumn("nx", F.count(F.lit(1)).over(_by("tx")))
    cells = df.select(*keys, degrees_key(F.col(y)).alias("ky"), degrees_key(F.col(x)).alias("kx"), *[value(n).alias(n) for n in names])
    met = cells.join(wy.drop("sy"), "ky").join(wx.drop("sx"), "kx")
    w = F.col("wy") * F.col("wx")
    whole = F.count(F.lit(1)) == F.max("ny") * F.max("nx")
    out = met.groupBy(*keys, "ty", "tx").agg(*[F.when(whole, _whole(F.col(n), w)).alias(n) for n in names])
    return out.withColumnsRenamed({"ty": y, "tx": x})


def _by(name: str):
    from pyspark.sql import Window

    return Window.partitionBy(name)


def interp(df: DataFrame, names: list[str], resolution: float = 0.25, method: str = "linear", bbox: BBox | None = None, keys: list[str] | None = None, x: str = "lon", y: str = "lat") -> DataFrame:
    """Onto a regular grid from the lower bounds (of bbox or data), upper bounds excluded.

    method: linear, nearest or cubic, by axis. keys: further dimensions, such as time.
    """
    require_columns(df, x, y, *names)
    keys = [c for c in df.columns if c not in (x, y, *names)] if keys is None else keys
    build = {"linear": linear_weights, "nearest": nearest_weights, "cubic": cubic_weights}.get(method)
    if build is None:
        raise ValueError(f"unknown method {method!r}")
    if bbox:
        df = crop(df, bbox, x, y)
    lats, lons = axis(df, y), axis(df, x)
    if not lats or not lons:
        raise ValueError("no cells to interpolate")
    x0, y0, x1, y1 = bbox or (lons[0], lats[0], lons[-1], lats[-1])
    return separable(df, build(lats, target_axis(y0, y1, resolution)), build(lons, target_axis(x0, x1, resolution)), names, keys, x, y)


def remap(df: DataFrame, names: list[str], bbox: BBox | None, resolution: float = 0.25, method: str = "remapdis", keys: list[str] | None = None, x: str = "lon", y: str = "lat") -> DataFrame:
    """Onto a grid with both bounds: remapbil (bilinear), remapcon (conservative), remapnn or remapdis (four nearest)."""
    if bbox is None:
        raise ValueError("bbox is needed")
    require_columns(df, x, y, *names)
    keys = [c for c in df.columns if c not in (x, y, *names)] if keys is None else keys
    spec, lats, lons = GridSpec.from_bbox(bbox, resolution), axis(df, y), axis(df, x)
    if method == "remapbil":
        return separable(df, linear_weights(lats, spec.lats), linear_weights(lons, spec.lons), names, keys, x, y)
    if method == "remapnn":
        return separable(df, nearest_weights(lats, spec.lats, False), nearest_weights(lons, spec.lons, False), names, keys, x, y)
    if method == "remapcon":
        return separable(df, conservative_weights(lats, spec.lats, True), conservative_weights(lons, spec.lons, False), names, keys, x, y)
    if method != "remapdis":
        raise ValueError(f"unknown method {method!r}")
    w = distance_table(df.sparkSession, lats, lons, spec).select("ty", "tx", degrees_key(F.col("sy")).alias("ky"), degrees_key(F.col("sx")).alias("kx"), "w")
    cells = df.select(*keys, degrees_key(F.col(y)).alias("ky"), degrees_key(F.col(x)).alias("kx"), *[value(n).alias(n) for n in names])
    out = cells.join(w, ["ky", "kx"]).groupBy(*keys, "ty", "tx").agg(*[_whole(F.col(n), F.col("w")).alias(n) for n in names])
    return out.withColumnsRenamed({"ty": y, "tx": x})


# Names of masks and of their files.
MASKS = {"cartopy": "cartopy_0.1.mask", "era5": "era5_0.25_mask"}


def read_mask(spark: SparkSession, name: str = "era5", folder: str = "data") -> DataFrame:
    """The named mask (lat, lon and a boolean a feature) from its Parquet file in a folder."""
    if name not in MASKS:
        raise ValueError(f"unknown mask {name!r}; there are {sorted(MASKS)}")
    mask = spark.read.parquet(f"{folder.rstrip('/')}/{MASKS[name]}.parquet")
    require_columns(mask, "lat", "lon")
    return mask


def land_sea_mask(df: DataFrame, mask: DataFrame, keep: str | None, names: list[str], x: str = "lon", y: str = "lat") -> DataFrame:
    """Keep variables where the nearest mask cell has the feature `keep` (land, ocean); NULL elsewhere."""
    require_columns(df, x, y, *names)
    if not keep or keep not in mask.columns:
        raise ValueError(f"keep must name a feature of the mask: {[c for c in mask.columns if c not in ('lat', 'lon')]}")
    spark = df.sparkSession
    near = {}
    for data, own in ((y, "lat"), (x, "lon")):
        rows = [(t, s) for t, s, _ in nearest_weights(axis(mask, own), axis(df, data), inside=False)]
        near[data] = _table(spark, rows, "t double, s double").select(degrees_key(F.col("t")).alias(f"__k{own}"), degrees_key(F.col("s")).alias(f"__m{own}"))
    features = mask.select(degrees_key(F.col("lat")).alias("__mlat"), degrees_key(F.col("lon")).alias("__mlon"), F.col(keep).cast("boolean").alias("__keep"))
    cells = df.withColumns({"__klat": degrees_key(F.col(y)), "__klon": degrees_key(F.col(x))})
    met = cells.join(near[y], "__klat", "left").join(near[x], "__klon", "left").join(features, ["__mlat", "__mlon"], "left")
    return met.select(*[F.when(F.col("__keep"), F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


def regrid_weights(df: DataFrame, weights: DataFrame, dst_grid: DataFrame, names: list[str], keys: list[str] | None = None, col: str = "ncol", others: DataFrame | None = None) -> DataFrame:
    """Sparse weights (row, col, s) times an unstructured field: keys, lat, lon and the variables.

    A missing source makes its targets NULL; targets without weights are
    absent. others: variables without the mesh dimension, joined on the keys.
    """
    require_columns(df, col, *names)
    require_columns(weights, "row", "col", "s")
    require_columns(dst_grid, "row", "lat", "lon")
    keys = [c for c in df.columns if c not in (col, *names)] if keys is None else keys
    cells = df.select(*keys, F.col(col).alias("col"), *[value(n).alias(n) for n in names])
    out = cells.join(weights, "col").groupBy(*keys, "row").agg(*[_whole(F.col(n), F.col("s")).alias(n) for n in names])
    out = out.join(dst_grid, "row").select(*keys, "lat", "lon", *names)
    return out.join(others, keys, "left") if others is not None and keys else out


# Options of weight generation. The first are understood here; the others speak of files and of the tool's runs.
METHODS = ("bilinear", "conserve", "neareststod", "distance")
OPTIONS = ("method", "m", "norm_type", "extrap_method", "extrap_num_src_pnts", "extrap_dist_exponent", "ignore_unmapped", "i")
FILE_OPTIONS = (
    "source", "s", "destination", "d", "weight", "w", "pole", "p", "line_type", "l", "extrap_num_levels", "ignore_degenerate", "src_type", "dst_type", "t", "r", "src_regional", "dst_regional", "64bit_offset",
    "netcdf4", "weight_only", "src_missingvalue", "dst_missingvalue", "src_coordinates", "dst_coordinates", "user_areas", "src_loc", "dst_loc", "tilefile_path", "no_log", "check", "checkFlag", "help", "h", "version", "V",
)


def weight_options(**given) -> dict:
    """Checked options of generate_weights; unknown ones raise with near names, those about files raise too."""
    short = {"m": "method", "i": "ignore_unmapped"}
    out = {"method": "bilinear", "norm_type": "dstarea", "extrap_method": "none", "extrap_num_src_pnts": 8, "extrap_dist_exponent": 2.0, "ignore_unmapped": False}
    allowed = {"method": METHODS, "norm_type": ("dstarea", "fracarea"), "extrap_method": ("none", "neareststod", "nearestidavg")}
    for name, v in given.items():
        if name in FILE_OPTIONS:
            raise ValueError(f"{name} has no meaning here: grids are axes, weights are a frame")
        if name not in OPTIONS:
            near = difflib.get_close_matches(name, OPTIONS + FILE_OPTIONS, n=5)
            raise ValueError(f"unknown option {name}" + (f"; did you mean one of {near}?" if near else ""))
        name = short.get(name, name)
        if name in allowed and v not in allowed[name]:
            raise ValueError(f"{name} must be one of {allowed[name]}, not {v!r}")
        out[name] = v
    return out


def _numbered(spark: SparkSession, values: list[float], rows: list[tuple[float, float, float]], targets: list[float]) -> DataFrame:
    """t, s, w with places in place of coordinates."""
    ps, pt = {v: i for i, v in enumerate(values)}, {v: i for i, v in enumerate(targets)}
    return spark.createDataFrame([(pt[a], ps[b], float(w)) for a, b, w in rows], "t bigint, s bigint, w double")


def generate_weights(spark: SparkSession, src_lats: list[float], src_lons: list[float], spec: GridSpec, **options) -> tuple[DataFrame, DataFrame]:
    """weights (row, col, s) and dst_grid (row, lat, lon) between regular grids, numbered by latitude, then longitude.

    method: bilinear, conserve (norm_type dstarea or fracarea), neareststod or
    distance (four nearest). Targets that the method gives nothing have no
    weights (an error unless ignore_unmapped or extrap_method says otherwise):
    neareststod takes the nearest source, nearestidavg the
    extrap_num_src_pnts nearest by inverse distance to extrap_dist_exponent.
    Weights along an axis are joined by places; no weight is made on the driver.
    """
    o = weight_options(**options)
    nx, cells = len(src_lons), spark.range(spec.xsize * spec.ysize)
    places = cells.select(F.col("id").alias("row"), F.expr(f"id div {spec.xsize}").alias("ty"), (F.col("id") % spec.xsize).alias("tx"))
    grid = places.select(F.col("row").cast("int"), (spec.yfirst + F.col("ty") * spec.yinc).alias("lat"), (spec.xfirst + F.col("tx") * spec.xinc).alias("lon"))

    def by_distance(k: int, exponent: float) -> DataFrame:
        table = distance_table(spark, src_lats, src_lons, spec, k, exponent)
        names = lambda v, a, b: spark.createDataFrame([(round(x * 1e6), i) for i, x in enumerate(v)], f"{a} bigint, {b} bigint")
        for c, v, key, to in (("sy", src_lats, "ky", "py"), ("sx", src_lons, "kx", "px")):
            table = table.withColumn(key, degrees_key(F.col(c))).join(F.broadcast(names(v, key, to)), key)  # an axis
        row = F.round((F.col("ty") - spec.yfirst) / spec.yinc) * spec.xsize + F.round((F.col("tx") - spec.xfirst) / spec.xinc)
        return table.select(row.cast("int").alias("row"), (F.col("py") * nx + F.col("px")).cast("int").alias("col"), F.col("w").alias("s"))

    if o["method"] == "distance":
        return by_distance(4, 1.0), grid
    if o["method"] == "conserve":
        wy, wx = conservative_weights(src_lats, spec.lats, True, o["norm_type"]), conservative_weights(src_lons, spec.lons, False, o["norm_type"])
    else:
        build = linear_weights if o["method"] == "bilinear" else lambda a, b: nearest_weights(a, b, False)
        wy, wx = build(src_lats, spec.lats), build(src_lons, spec.lons)
    y, x = _numbered(spark, src_lats, wy, spec.lats), _numbered(spark, src_lons, wx, spec.lons)
    y = F.broadcast(y.select(F.col("t").alias("ty"), F.col("s").alias("py"), F.col("w").alias("wy")))  # both are axes
    x = F.broadcast(x.select(F.col("t").alias("tx"), F.col("s").alias("px"), F.col("w").alias("wx")))
    met = places.join(y, "ty").join(x, "tx")
    weights = met.select(F.col("row").cast("int"), (F.col("py") * nx + F.col("px")).cast("int").alias("col"), (F.col("wy") * F.col("wx")).alias("s"))
    mapped = len({t for t, _, _ in wy}) * len({t for t, _, _ in wx}) == spec.xsize * spec.ysize
    if mapped:
        return weights, grid
    if o["extrap_method"] == "none":
        if not o["ignore_unmapped"]:
            raise ValueError("targets without a source; set ignore_unmapped or extrap_method")
        return weights, grid
    far = by_distance(*((1, 1.0) if o["extrap_method"] == "neareststod" else (int(o["extrap_num_src_pnts"]), float(o["extrap_dist_exponent"]))))
    return weights.unionByName(far.join(weights.select("row").distinct(), "row", "left_anti")), grid


def bilinear_weights(spark: SparkSession, src_lats: list[float], src_lons: list[float], spec: GridSpec, method: str = "linear") -> tuple[DataFrame, DataFrame]:
    """weights and dst_grid between regular grids by linear or nearest; targets outside the sources have none."""
    return generate_weights(spark, src_lats, src_lons, spec, method={"linear": "bilinear", "nearest": "neareststod"}[method], ignore_unmapped=True)
