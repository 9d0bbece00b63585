"""Raster files as a Spark data source: headerless float32 in [day][lat][lon] order.

    spark.dataSource.register(GrdDataSource)
    spark.read.format("grd").option("cat", "rain").option("start", "2018").option("path", folder).load()

Options: path, cat, start, end (year or ISO date), layout (yearly or daily), style
(yearwise or classic), byteorder (little or big), sentinel. One
partition per yearly file, or per chunk of daily files; only the files and days of
the range are read, narrowed further by pushed filters on date. Missing is NULL. A
file of another length than its grid and days raises.

What stands for missing is -999 in rain and, in temperature, whatever the file holds
in its first cell on its first day, which is sea on every catalogued grid; the option
sentinel (a number, or "corner" for that cell) says otherwise. NaN is always missing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.datasource import EqualTo

from skygrid.functions.calendar import parse_range, total_days
from skygrid.model import ARCHIVE, REALTIME, GridFrame, GridSpec, Meta
from skygrid.operators.monthly import land_mask
from skygrid.sources.naming import daily_path, yearly_path

SCHEMA = "lon_i int, lat_i int, lon double, lat double, pos int, date date, value double"
DAILY_CHUNK = 32


def grid_of(cat: str, layout: str) -> GridSpec:
    table = REALTIME if layout == "daily" else ARCHIVE
    if cat not in table:
        raise ValueError(f"no {layout} grid of {cat}")
    return table[cat]


def decode(raw: bytes, spec: GridSpec, days: int, byteorder: str = "little") -> np.ndarray:
    """(day, lat, lon) values; raises if the length is not exactly that of the days."""
    if len(raw) != days * spec.cells * 4:
        raise ValueError(f"{len(raw)} bytes where {days * spec.cells * 4} are expected")
    return np.frombuffer(raw, ">f4" if byteorder == "big" else "<f4").reshape(days, spec.n_lat, spec.n_lon)


class FilePartition(InputPartition):
    def __init__(self, files: list[tuple[str, str, int]]):
        #: path, first day, days in the file
        self.files = files


class GrdReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.cat, self.layout = options["cat"], options.get("layout", "yearly")
        self.spec = grid_of(self.cat, self.layout)
        as_day = lambda x: int(x) if x is not None and x.isdigit() and len(x) == 4 else x
        self.start, self.end = parse_range(as_day(options["start"]), as_day(options.get("end")))
        self.low, self.high = self.start, self.end
        self.folder, self.style = options["path"], options.get("style", "yearwise")
        self.byteorder = options.get("byteorder", "little")
        asked = options.get("sentinel") or ("corner" if self.cat in ("tmax", "tmin") else "-999")
        self.sentinel = None if asked == "corner" else float(asked)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on date narrow the files and days; all filters are also left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("date",) and isinstance(f.value, dt.date):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        if self.low > self.high:
            return [FilePartition([])]
        if self.layout == "daily":
            days = [self.low + dt.timedelta(k) for k in range(total_days(self.low, self.high))]
            files = [(daily_path(x, self.cat, self.folder), x.isoformat(), 1) for x in days]
            return [FilePartition(files[i : i + DAILY_CHUNK]) for i in range(0, len(files), DAILY_CHUNK)]
        years = range(self.low.year, self.high.year + 1)
        return [FilePartition([(yearly_path(y, self.cat, self.style, self.folder), f"{y}-01-01", total_days(dt.date(y, 1, 1), dt.date(y, 12, 31)))]) for y in years]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        spec = self.spec
        lat_i, lon_i = np.repeat(np.arange(spec.n_lat, dtype=np.int32), spec.n_lon), np.tile(np.arange(spec.n_lon, dtype=np.int32), spec.n_lat)
        lat, lon = spec.lat0 + spec.step * lat_i, spec.lon0 + spec.step * lon_i
        for path, first, days in partition.files:
            store, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            with store.open_input_file(where) as f:
                values = decode(f.read(), spec, days, self.byteorder)
            missing = float(values[0, 0, 0]) if self.sentinel is None else self.sentinel
            for k in range(days):
                day = dt.date.fromisoformat(first) + dt.timedelta(k)
                if not self.low <= day <= self.high:
                    continue
                v = values[k].ravel().astype(np.float64)
                n = v.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lon_i), pa.array(lat_i), pa.array(lon), pa.array(lat), pa.array(np.full(n, (day - self.start).days, np.int32)), pa.array(np.full(n, (day - dt.date(1970, 1, 1)).days, np.int32)).cast(pa.date32()), pa.array(v, mask=(v == missing) | np.isnan(v))],
                    names=["lon_i", "lat_i", "lon", "lat", "pos", "date", "value"],
                )


class GrdDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "grd"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GrdReader:
        return GrdReader(self.options)


def _load(spark: SparkSession, cat: str, start, end, layout: str, folder: str, **options: str) -> tuple[DataFrame, Meta]:
    a, b = parse_range(start, end)
    spark.dataSource.register(GrdDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = spark.read.format("grd").option("cat", cat).option("layout", layout).option("start", a.isoformat()).option("end", b.isoformat()).option("path", folder)
    for k, v in options.items():
        read = read.option(k, v)
    return read.load(), Meta(cat, a, b, grid_of(cat, layout))


def _asked(sentinel: float | str | None) -> dict[str, str]:
    return {} if sentinel is None else {"sentinel": str(sentinel)}


def open_data(spark: SparkSession, cat: str, start, end=None, style: str = "yearwise", folder: str = ".", sentinel: float | str | None = None) -> GridFrame:
    """Yearly files of the range, cut to its days, with the land mask derived from the data. sentinel: as the option of the data source.

    The mask is one row per cell of a catalogued grid (17,415 at most), hence sent to every task.
    """
    df, meta = _load(spark, cat, start, end, "yearly", folder, style=style, **_asked(sentinel))
    mask = land_mask(df, cat, meta.days)
    return GridFrame(df.join(F.broadcast(mask), ["lon_i", "lat_i"]), meta)


def open_real_data(spark: SparkSession, cat: str, start, end=None, folder: str = ".", sentinel: float | str | None = None) -> GridFrame:
    """Daily files of the range; no land mask: every cell counts."""
    df, meta = _load(spark, cat, start, end, "daily", folder, **_asked(sentinel))
    return GridFrame(df.withColumn("is_land", F.lit(True)), meta)
