"""Profiles of time axes and extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import require_columns
from .ordering import places

# Seconds under which a step is counted in the unit, and the unit's seconds.
LADDER = ((60, 1, "S"), (3600, 60, "T"), (86400, 3600, "H"), (604800, 86400, "D"), (2419200, 604800, "W"), (29030400, 2419200, "M"), (290304000, 29030400, "Y"))
LAST = (290304000, "10Y")


def frequency_text(seconds: Column) -> Column:
    """A step in seconds as text: 30S, 15T, 6H, 1D, 1W, 1M (28 days), 1Y (336 days)."""
    whole = lambda unit: F.floor(seconds / unit).cast("bigint").cast("string")
    out = None
    for under, unit, name in LADDER:
        text = F.concat(whole(unit), F.lit(name))
        out = F.when(seconds < under, text) if out is None else out.when(seconds < under, text)
    return out.otherwise(F.concat(whole(LAST[0]), F.lit(LAST[1])))


def time_steps(df: DataFrame, time: str) -> DataFrame:
    """Distinct times, ascending, and their distance to the one before in seconds (none for the first)."""
    found = places(df.select(F.col(time).alias("t")), "t")
    before = found.select(F.col("t").alias("was"), (F.col("place") + 1).alias("place"))
    return found.join(before, "place").select("t", F.timestamp_diff("SECOND", F.col("was"), F.col("t")).alias("step"))


def time_frequency(df: DataFrame, time: str = "time") -> DataFrame:
    """One row: freq and the ranges of hour, month and year among rows with the modal step.

    Ties go to the smallest step. A single time has no step: NULLs.
    """
    steps = time_steps(df, time)
    modal = steps.agg(F.mode("step", True).alias("m"))
    kept = steps.join(modal, steps["step"] == modal["m"])
    parts = [(f, F.expr(f"{f}(t)").cast("bigint")) for f in ("hour", "month", "year")]
    out = kept.agg(F.max("m").alias("m"), *[g(c).alias(f"{n}_{s}") for n, c in parts for s, g in (("min", F.min), ("max", F.max))])
    return out.select(F.when(F.col("m").isNotNull(), frequency_text(F.col("m"))).alias("freq"), *[f"{n}_{s}" for n, _ in parts for s in ("min", "max")])


def extent(df: DataFrame, dims: list[str]) -> DataFrame:
    """dim, low, high, step (mean distance of neighbours, two digits half to even) for numeric dimensions."""
    require_columns(df, *dims)
    out = None
    for dim in dims:
        v = F.col(dim).cast("double")
        n = F.count_distinct(v)
        step = F.try_divide(F.max(v) - F.min(v), (n - 1).cast("double"))
        row = df.agg(F.lit(dim).alias("dim"), F.bround(F.min(v), 2).alias("low"), F.bround(F.max(v), 2).alias("high"), F.bround(step, 2).alias("step"))
        out = row if out is None else out.unionByName(row)
    return out


def spatiotemporal_info(df: DataFrame, dims: list[str] | None = None) -> dict:
    """resolution (by dimension: a step, or a frequency for times), ranges of hours, months and years, and {dim}_bounds.

    dims: the dimensions (those of time, lat, lon and their long names that
    there are, if not given). Entries without a value are left out. A
    dimension of times has bounds too, unless it is named time; the ranges
    are those of the last one.
    """
    dims = [d for d in ("time", "lat", "lon", "latitude", "longitude") if d in df.columns] if dims is None else list(dims)
    require_columns(df, *dims)
    times = [d for d in dims if df.schema[d].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")]
    resolution: dict = {}
    info: dict = {"resolution": resolution}
    for d in times:
        r = time_frequency(df.select(F.col(d).cast("timestamp_ntz").alias("time"))).first()
        resolution[d] = r.freq
        info |= {f"{n}s_range": (r[f"{n}_min"], r[f"{n}_max"]) for n in ("hour", "month", "year") if r[f"{n}_min"] is not None}
    numbers = [d for d in dims if d not in times]
    for r in extent(df, numbers).collect() if numbers else []:
        resolution[r.dim], info[f"{r.dim}_bounds"] = r.step, (r.low, r.high)
    for d in times:
        if d != "time":
            info[f"{d}_bounds"] = tuple(df.agg(F.min(d), F.max(d)).first())
    info["resolution"] = {d: resolution[d] for d in dims if resolution.get(d) is not None}
    return {k: v for k, v in info.items() if v is not None and v != (None, None)}
