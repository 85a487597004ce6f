"""Longitude bands, UTC offsets and local solar time, as row-wise expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import wrap_lon
from ..schema import require_columns


def _hours(h: Column) -> Column:
    return F.make_dt_interval(F.lit(0), h.cast("int"))


def utc_offset_hours(lon: Column) -> Column:
    """Whole hours from UTC of a longitude, half hours to the even side."""
    return F.rint(wrap_lon(lon) * 24.0 / 360.0).cast("int")


def utc_offset(lon: Column) -> Column:
    """The offset as a day-time interval."""
    return _hours(utc_offset_hours(lon))


def lon_band(lon: Column) -> Column:
    """Centre of the 15-degree band; -180 and 180 are two bands."""
    return F.rint(wrap_lon(lon) / 15.0) * 15.0 + 0.0


def local_solar_time(df: DataFrame, time: str = "time", lon: str = "lon", lat: str = "lat", parity_equator_null: bool = False) -> DataFrame:
    """Adds local_solar_time; longitudes are not wrapped, so 0..360 gives 0 to +24 hours."""
    require_columns(df, time, lon)
    out = F.col(time) + _hours(F.rint(F.col(lon).cast("double") * 24.0 / 360.0))
    if parity_equator_null:
        require_columns(df, lat)
        out = F.when(F.col(lat) != 0, out)
    return df.withColumn("local_solar_time", out)


def split_by_15_deg(df: DataFrame, name: str = "lon") -> DataFrame:
    """Adds band; the longitude is wrapped. One frame with a band column, not a frame a band."""
    require_columns(df, name)
    return df.withColumn(name, wrap_lon(F.col(name))).withColumn("band", lon_band(F.col(name)))


def split_by_timezones(df: DataFrame, time: str = "time", name: str = "lon", parity_dateline: bool = False) -> DataFrame:
    """Adds band, utc_offset_h and tz, and shifts time to local time.

    The offset is the longitude's: +12 in the band of 180. parity_dateline
    takes it from the band's centre: -12 there.
    """
    require_columns(df, time, name)
    banded = split_by_15_deg(df, name)
    hours = utc_offset_hours(F.col("band") if parity_dateline else F.col(name))
    banded = banded.withColumn("utc_offset_h", hours)
    return banded.withColumn("tz", F.concat(F.lit("UTC"), F.col("utc_offset_h").cast("string"))).withColumn(time, F.col(time) + _hours(F.col("utc_offset_h")))


def tz_apply(func: Callable[[DataFrame], DataFrame], df: DataFrame, time: str = "time", lat: str = "lat", lon: str = "lon", parity_dateline: bool = False, **kwargs) -> DataFrame:
    """Apply func once to the frame in local time; func groups by `band` where it needs to."""
    require_columns(df, time, lat, lon)
    return func(split_by_timezones(df, time, lon, parity_dateline), **kwargs)


def concat(frames: list[DataFrame], along: str = "lon", dims: list[str] | None = None, join: str = "outer") -> DataFrame:
    """Rows of frames that are parts along one dimension.

    outer: cells that a part has not are absent. exact: ValueError unless all
    parts have the same values of the other dimensions (time and lat, if not
    given).
    """
    if not frames:
        raise ValueError("nothing to put together")
    if join not in ("outer", "exact"):
        raise ValueError(f"join must be outer or exact, not {join!r}")
    dims = [d for d in ("time", "lat") if d in frames[0].columns] if dims is None else dims
    for f in frames:
        require_columns(f, along, *dims)
    if join == "exact" and dims:
        first = frames[0].select(*dims).distinct()
        for f in frames[1:]:
            own = f.select(*dims).distinct()
            if first.join(own, dims, "left_anti").limit(1).count() or own.join(first, dims, "left_anti").limit(1).count():
                raise ValueError(f"the parts differ in {dims}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=join == "outer"), frames)


#: Most rows that a group of tz_apply_pandas may have: it is one pandas frame.
MAX_GROUP = 20_000_000


def tz_apply_pandas(
    func: Callable, df: DataFrame, schema: str, time: str = "time", lat: str = "lat", lon: str = "lon", blocks: int = 1, parity_dateline: bool = False, by: list[str] | None = None, max_rows: int = MAX_GROUP
) -> DataFrame:
    """Apply a pandas function to the rows of each band, in local time.

    There are 25 bands at most. A function that works by cell takes smaller
    groups: by names further keys (such as lat and lon), blocks > 1 parts a
    band by a hash of the latitude. Groups over max_rows are an error, found
    by a count before; what Spark's own functions can say has no such bound
    in tz_apply.
    """
    require_columns(df, time, lat, lon, *(by or []))
    banded = split_by_timezones(df, time, lon, parity_dateline)
    keys = ["band", *(by or [])] + [F.pmod(F.xxhash64(lat), F.lit(blocks)).alias("block")] * (blocks > 1)
    largest = banded.groupBy(*keys).count().agg(F.max("count")).first()[0]
    if largest and largest > max_rows:
        raise ValueError(f"a group of {largest} rows is over {max_rows}; name further keys (by), or use tz_apply")
    return banded.groupBy(*keys).applyInPandas(func, schema)
