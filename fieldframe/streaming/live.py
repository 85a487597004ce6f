"""Streaming forms of the stateless operators and of moment sums.

Bands, offsets, crops and masks are row-wise and take a streaming frame as
they are. Least-squares slopes and means are sums, kept by event-time window
with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tz import split_by_timezones
from ..schema import as_keys, require_columns, value


def windowed_moments(df: DataFrame, time: str, data_var: str, width: str, groupby=None, late: str = "10 minutes") -> DataFrame:
    """n, mean_val, std_val and slope per second of each key and window; late rows beyond `late` are dropped."""
    keys = as_keys(groupby, time)
    require_columns(df, time, data_var, *keys)
    own = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    seconds = F.unix_micros(F.col(time)) / 1e6 - F.unix_micros(F.window(time, width).start) / 1e6
    rows = own.withColumn("__s", seconds).withColumn("__v", value(data_var))
    out = rows.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("__v").alias("n"), F.avg("__v").alias("mean_val"), F.stddev_samp("__v").alias("std_val"), F.regr_slope("__v", "__s").alias("slope"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "mean_val", "std_val", "slope")


def local_time_stream(df: DataFrame, time: str = "time", lon: str = "lon") -> DataFrame:
    """Adds band, offset and time zone to a stream and shifts its time."""
    return split_by_timezones(df, time, lon)
