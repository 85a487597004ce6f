"""A frame with the engine's operators as methods."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .operators import grid, profile, select, stats, tz
from .session import signature

# What a method's name stands for; the frame is the function's first argument.
METHODS = {
    "trends": stats.calc_trends, "polyfit": stats.polyfit_trend, "crop": select.crop, "take": select.take_index, "label": select.take_label, "split": select.split_by_dims, "squeeze": select.squeeze,
    "sort": select.sort_cells, "significant": select.significant_points, "limits": select.robust_limits, "map": select.map_slice, "frames": select.animation_slices, "interp": grid.interp, "remap": grid.remap,
    "mask": grid.land_sea_mask, "solar_time": tz.local_solar_time, "timezones": tz.split_by_timezones, "bands": tz.split_by_15_deg, "frequency": profile.time_frequency, "extent": profile.extent, "info": profile.spatiotemporal_info,
}


class Field:
    """Field(df).crop(bbox).trends("time", data_var="v").df: operators that give a frame give a Field."""

    def __init__(self, df: DataFrame):
        self.df = df

    def __getattr__(self, name: str):
        if name not in METHODS:
            raise AttributeError(f"Field has no {name!r}; it has {sorted(METHODS)}")

        def call(*args, **kwargs):
            unknown = set(kwargs) - set(signature(METHODS[name]))
            if unknown:
                raise TypeError(f"{name} takes {list(signature(METHODS[name]))[1:]}, not {sorted(unknown)}")
            out = METHODS[name](self.df, *args, **kwargs)
            return Field(out) if isinstance(out, DataFrame) else out

        return call
