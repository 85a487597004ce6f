"""Column checks and normalisation of missing values. The engine is NULL inside; NaN becomes NULL at the door."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = str | Iterable[str] | None


def require_frame(df: object) -> DataFrame:
    if not hasattr(df, "schema") or not hasattr(df, "select"):
        raise TypeError(f"a DataFrame is needed, not {type(df).__name__}")
    return df  # type: ignore[return-value]


def require_columns(df: DataFrame, *names: str) -> None:
    require_frame(df)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def as_keys(keys: Keys, without: str | None = None) -> list[str]:
    """A list of key names, without the series' own dimension; the caller's list is not changed."""
    found = [] if keys is None else [keys] if isinstance(keys, str) else list(keys)
    return [k for k in found if k != without]


def value(name: str) -> Column:
    """A column as DOUBLE, NaN as NULL."""
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c), c)


def degrees_key(c: Column) -> Column:
    """Coordinates as whole micro-degrees, so that joins are on integers."""
    return F.round(c * 1e6).cast("bigint")


@dataclass(frozen=True)
class GridSpec:
    """A regular latitude/longitude grid."""

    xsize: int
    ysize: int
    xfirst: float
    xinc: float
    yfirst: float
    yinc: float
    gridtype: str = "lonlat"

    @classmethod
    def from_bbox(cls, bbox: tuple[float, float, float, float], resolution: float) -> "GridSpec":
        """Both bounds of bbox (lon_min, lat_min, lon_max, lat_max) are on the grid where the step allows."""
        x0, y0, x1, y1 = bbox
        return cls(int((x1 - x0) / resolution + 1e-9) + 1, int((y1 - y0) / resolution + 1e-9) + 1, x0, resolution, y0, resolution)

    @property
    def lons(self) -> list[float]:
        return [self.xfirst + k * self.xinc for k in range(self.xsize)]

    @property
    def lats(self) -> list[float]:
        return [self.yfirst + k * self.yinc for k in range(self.ysize)]
