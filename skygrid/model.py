"""Catalogue of grids and the wrapper of a grid's rows with its metadata."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygrid.functions.calendar import total_days


@dataclasses.dataclass(frozen=True)
class GridSpec:
    """A fixed grid: first coordinate, step and number of each axis."""

    lat0: float
    n_lat: int
    lon0: float
    n_lon: int
    step: float

    def lat(self, i: int) -> float:
        return self.lat0 + self.step * i

    def lon(self, i: int) -> float:
        return self.lon0 + self.step * i

    @property
    def cells(self) -> int:
        return self.n_lat * self.n_lon

    def nearest(self, lat: float, lon: float) -> tuple[int, int]:
        """(lat_i, lon_i) of the nearest cell; a tie goes to the lower index; outside the axes raises."""
        out = []
        for x, x0, n in ((lat, self.lat0, self.n_lat), (lon, self.lon0, self.n_lon)):
            if not x0 <= x <= x0 + self.step * (n - 1):
                raise ValueError("the point lies outside the grid")
            out.append(min(range(n), key=lambda i: (abs(x0 + self.step * i - x), i)))
        return out[0], out[1]


#: The grids by feed and kind.
ARCHIVE = {"rain": GridSpec(6.5, 129, 66.5, 135, 0.25), "tmin": GridSpec(7.5, 31, 67.5, 31, 1.0), "tmax": GridSpec(7.5, 31, 67.5, 31, 1.0)}
REALTIME = {"rain": GridSpec(6.5, 129, 66.5, 135, 0.25), "tmin": GridSpec(7.5, 61, 67.5, 61, 0.5), "tmax": GridSpec(7.5, 61, 67.5, 61, 0.5), "rain_gpm": GridSpec(-30.0, 281, 50.0, 241, 0.25)}

#: Units and long names.
RAW_VARIABLES = {"rain": ("mm/day", "rainfall"), "rain_gpm": ("mm/day", "merged satellite and gauge rainfall"), "tmax": ("C", "maximum temperature"), "tmin": ("C", "minimum temperature")}
METHODS = {
    "cdd": "longest dry spell", "cwd": "longest wet spell", "dr": "rainy days", "d64": "heavy rain days", "dtr": "daily temperature range", "mmk_hr": "modified Mann-Kendall statistic", "mnadt": "lowest minimum temperature",
    "mxadt": "highest maximum temperature", "pci": "precipitation concentration", "rtwd": "rain of rainy days", "rx5d": "largest five-day rain", "rxa": "largest daily rain", "sdii": "simple daily intensity",
    "spr": "Spearman rank statistic", "sse": "Sen slope", "sstr": "Sen slope as percentage", "spi": "standardised precipitation index", "spei": "standardised precipitation evapotranspiration index",
}


@dataclasses.dataclass(frozen=True)
class Meta:
    cat: str
    start: dt.date
    end: dt.date
    spec: GridSpec | None = None
    scale: str = "raw"
    method: str | None = None

    @property
    def days(self) -> int:
        return total_days(self.start, self.end)

    @property
    def years(self) -> int:
        return self.end.year - self.start.year + 1


class GridFrame:
    """Immutable: rows (lon_i, lat_i, lon, lat, pos, is_land, value; further variables as further columns) with metadata."""

    registry: dict[tuple[str, str], Callable[..., DataFrame]] = {}

    def __init__(self, df: DataFrame, meta: Meta):
        self.df, self.meta = df, meta

    @property
    def shape(self) -> tuple[int, int | None, int | None]:
        s = self.meta.spec
        return self.meta.days, s.n_lon if s else None, s.n_lat if s else None

    def copy(self) -> GridFrame:
        return GridFrame(self.df, dataclasses.replace(self.meta))

    def with_date(self) -> DataFrame:
        return self.df.withColumn("date", F.date_add(F.lit(self.meta.start.isoformat()).cast("date"), F.col("pos")))

    @classmethod
    def register(cls, method: str, scale: str, build: Callable[..., DataFrame]) -> None:
        """Add an index: build(grid, **options) gives its rows."""
        cls.registry[method, scale] = build

    def compute(self, method: str, scale: str = "A", **options) -> GridFrame:
        """An annual ("A") or monthly ("M") index by name, lazily."""
        if self.meta.scale != "raw":
            raise ValueError("indices are computed from raw daily data")
        build = self.registry.get((method, scale))
        if build is None:
            raise ValueError(f"no index {method!r} of scale {scale!r}")
        return GridFrame(build(self, **options), dataclasses.replace(self.meta, scale=scale, method=method))

    def require(self, *cats: str) -> None:
        if self.meta.cat not in cats:
            raise ValueError(f"needs {' or '.join(cats)}, not {self.meta.cat}")


def on_land(expr: Column) -> Column:
    """An aggregate that is NULL outside land."""
    return F.when(F.max("is_land"), expr)


def poison(expr: Column, value: str = "value") -> Column:
    """An aggregate that any missing value of the group makes NULL."""
    return F.when(F.count(value) == F.count(F.lit(1)), expr)


CELL = ["lon_i", "lat_i"]
