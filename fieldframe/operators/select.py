"""Selection, splitting and data preparation for maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import require_columns, value
from .ordering import percentiles, places

BBox = tuple[float, float, float, float]


def select_variable(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Keys and one variable."""
    require_columns(df, *keys, name)
    return df.select(*keys, name)


def crop(df: DataFrame, bbox: BBox, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows inside (lon_min, lat_min, lon_max, lat_max), bounds included; reaches the scan as a pushed filter."""
    require_columns(df, lon, lat)
    x0, y0, x1, y1 = bbox
    return df.where(F.col(lon).between(x0, x1) & F.col(lat).between(y0, y1))


def mask_where(df: DataFrame, condition, *names: str) -> DataFrame:
    """Keep all rows; variables are NULL where the condition does not hold."""
    require_columns(df, *names)
    return df.withColumns({n: F.when(condition, F.col(n)) for n in names})


def rename_stats(df: DataFrame, variable: str, stats: list[str]) -> DataFrame:
    """Columns stat as {variable}_{stat}."""
    return df.withColumnsRenamed({s: f"{variable}_{s}" for s in stats})


def take_label(df: DataFrame, dim: str, *labels) -> DataFrame:
    """Rows whose dim has one of the values; reaches the scan as a pushed filter."""
    require_columns(df, dim)
    return df.where(F.col(dim).isin(*labels))


def take_index(df: DataFrame, dim: str, start: int | list[int], stop: int | None = None) -> DataFrame:
    """Rows whose dim value has a place in [start, stop) among its sorted different values, or one of several places.

    Places below 0 count from the end.
    """
    found = places(df, dim)
    wanted = list(start) if isinstance(start, (list, tuple)) else None
    if min(wanted or [0 if wanted is not None else start]) < 0 or (stop is not None and stop < 0):
        size = found.count()
        turn = lambda k: k + size if k is not None and k < 0 else k
        wanted, start, stop = ([turn(k) for k in wanted], start, stop) if wanted is not None else (None, turn(start), turn(stop))
    if wanted is not None:
        kept = found.where(F.col("place").isin(*wanted))
    else:
        kept = found.where((F.col("place") >= start) & (F.col("place") < (start + 1 if stop is None else stop)))
    return df.join(kept.drop("place"), dim, "left_semi")


def squeeze(df: DataFrame, *dims: str) -> DataFrame:
    """Without the dimensions that have one value only (one pass for all)."""
    require_columns(df, *dims)
    if not dims:
        return df
    ends = df.agg(*[x for d in dims for x in (F.min(d), F.max(d))]).first()
    return df.drop(*[d for i, d in enumerate(dims) if ends[2 * i] == ends[2 * i + 1]])


def sort_cells(df: DataFrame, *dims: str) -> DataFrame:
    """Rows in ascending order of the dimensions (lat and lon, if none are named): range-partitioned and sorted."""
    dims = dims or tuple(c for c in ("lat", "lon") if c in df.columns)
    require_columns(df, *dims)
    return df.orderBy(*dims)


def split_by_dims(df: DataFrame, dim: str, n: int) -> DataFrame:
    """Adds split (0 to n-1): n contiguous parts of a dimension, sizes one apart at most."""
    found = places(df, dim)
    size = found.count()
    if not 1 <= n <= size:
        raise ValueError(f"n must be from 1 to {size}, the size of {dim}, not {n}")
    parts = found.select(F.col(dim), F.floor(((F.col("place") + 1) * n - 1) / F.lit(size)).cast("int").alias("split"))
    return df.join(parts, dim, "inner")


def significant_points(df: DataFrame, level: float = 0.05, p: str = "p_value") -> DataFrame:
    """Rows with p below the level and nothing missing."""
    require_columns(df, p)
    return df.where(value(p) < level).na.drop()


def robust_limits(df: DataFrame, name: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """vmin, vmax: exact percentiles of a variable."""
    return percentiles(df, name, [low, high]).select(F.col("q0").alias("vmin"), F.col("q1").alias("vmax"))


def map_slice(df: DataFrame, name: str, bbox: BBox | None = None, robust: bool = False, lon: str | None = None, lat: str | None = None) -> DataFrame:
    """lat, lon and one variable of a two-dimensional field, cropped; robust clips to the 2 and 98 percentiles."""
    lon = lon or next((c for c in ("lon", "longitude") if c in df.columns), None)
    lat = lat or next((c for c in ("lat", "latitude") if c in df.columns), None)
    if lon is None or lat is None:
        raise ValueError("latitude and longitude columns are needed")
    require_columns(df, name)
    others = [c for c in df.columns if c not in (lon, lat, name)]
    if others:
        raise ValueError(f"a map has two dimensions; {others} are more")
    out = crop(df, bbox, lon, lat) if bbox else df
    if robust:
        q = robust_limits(out, name).first()
        out = out.withColumn(name, F.greatest(F.lit(q.vmin), F.least(F.lit(q.vmax), value(name))))
    return out


def animation_slices(df: DataFrame, dim: str) -> DataFrame:
    """Adds frame: the place of each row's dim value."""
    return df.join(places(df, dim).withColumnRenamed("place", "frame"), dim)
