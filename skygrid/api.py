"""One object per data set, as a user of a gridded-data library expects; every method returns a new, lazy object.

    grid = open_data(spark, "rain", 1991, 2020, folder="...")
    grid.compute("cwd", threshold=2.5).df
    grid.climatology().df
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrid.model import CELL, GridFrame, Meta
from skygrid.operators import drought, extreme, indices, monthly, raster, trend  # noqa: F401  (they register their indices)
from skygrid.sources import download, grd, shapefile, sinks


class Grid(GridFrame):
    """A GridFrame with its operators as methods. meta.scale: raw, A, M, climatology, anomaly or daily."""

    @classmethod
    def of(cls, g: GridFrame) -> Grid:
        return cls(g.df, g.meta)

    def _new(self, df: DataFrame, **meta: object) -> Grid:
        return Grid(df, dataclasses.replace(self.meta, **meta))

    def copy(self) -> Grid:
        return Grid.of(super().copy())

    def compute(self, method: str, scale: str = "A", **options) -> Grid:
        return Grid.of(super().compute(method, scale, **options))

    def climatology(self) -> Grid:
        return self._new(monthly.climatology(self), scale="climatology")

    def anomaly(self, baseline: Grid | None = None) -> Grid:
        if baseline is not None and baseline.meta.scale != "climatology":
            raise ValueError("the baseline must be a climatology")
        return self._new(monthly.anomaly(self, baseline.df if baseline else None, baseline.meta.cat if baseline else None, baseline.meta.spec if baseline else None), scale="anomaly")

    def spatial_mean(self, weighted: bool = True) -> DataFrame:
        """One value per time step (see time_column) over land; works on raw data and on results."""
        time, value = self.time_column, self.value_column
        df = self.df
        if self.meta.scale != "raw":
            spec = self.meta.spec
            if spec is None:
                raise ValueError("the grid's coordinates are not known")
            # results are NULL outside land, so every remaining cell counts
            df = df.select(time, F.lit(True).alias("is_land"), (F.lit(spec.lat0) + F.col("lat_i") * F.lit(spec.step)).alias("lat"), F.col(value).alias("value"))
        return monthly.spatial_mean(df, time, weighted)

    @property
    def time_column(self) -> str:
        return {"raw": "pos", "daily": "pos", "A": "year", "M": "m", "anomaly": "m", "climatology": "month"}[self.meta.scale]

    @property
    def value_column(self) -> str:
        return self.meta.method if self.meta.scale in ("A", "M") and self.meta.method in self.df.columns else "class" if self.meta.scale == "daily" else "n" if "n" in self.df.columns else "value"

    def timed(self) -> DataFrame:
        """Rows with the date that stands for their time step: the day, the end of the year or month, or of a month of 2000."""
        t = F.col(self.time_column) if self.time_column in self.df.columns else None
        start = F.lit(f"{self.meta.start.year}-01-01").cast("date")
        if self.meta.scale in ("raw", "daily"):
            return self.with_date().withColumnRenamed("date", "time") if "date" not in self.df.columns else self.df.withColumnRenamed("date", "time")
        if self.meta.scale == "A":
            return self.df.withColumn("time", F.make_date(t, F.lit(12), F.lit(31)) if t is not None else F.lit(f"{self.meta.start.year}-12-31").cast("date"))
        if self.meta.scale == "climatology":
            return self.df.withColumn("time", F.last_day(F.make_date(F.lit(2000), t, F.lit(1))))
        return self.df.withColumn("time", F.last_day(F.add_months(start, t)))

    def _wave(self, build, kind: str, regions: DataFrame, output: str, count: str, norm_start: int | None, norm_end: int | None, normals_from: GridFrame | None) -> Grid:
        names = {"total": "total", kind: "wave", "severe": "severe"}
        if self.meta.scale != "raw" or output not in ("daily", "annual") or count not in names:
            raise ValueError(f"needs raw data, output daily or annual, and count among {', '.join(names)}")
        classes = build(self, regions, norm_start, norm_end, normals_from)
        if output == "daily":
            return self._new(classes, scale="daily", method=kind)
        return self._new(extreme.annual_events(classes, self.meta.start.year, names[count]), scale="A", method=kind)

    def heatwave(self, regions: DataFrame, output: str = "daily", count: str = "total", norm_start: int | None = None, norm_end: int | None = None, normals_from: GridFrame | None = None) -> Grid:
        return self._wave(extreme.heatwave, "hw", regions, output, count, norm_start, norm_end, normals_from)

    def coldwave(self, regions: DataFrame, output: str = "daily", count: str = "total", norm_start: int | None = None, norm_end: int | None = None, normals_from: GridFrame | None = None) -> Grid:
        return self._wave(extreme.coldwave, "cw", regions, output, count, norm_start, norm_end, normals_from)

    def fill_na(self) -> Grid:
        rain = self.meta.cat in ("rain", "rain_gpm")
        skip = None if rain or self.meta.spec is None or self.meta.spec.n_lon != 31 else raster.temperature_skips()
        return self._new(raster.fill_na(self.df, skip))

    def remap(self, step: float) -> Grid:
        s = self.meta.spec
        lons, lats = [s.lon(i) for i in range(s.n_lon)], [s.lat(i) for i in range(s.n_lat)]
        spec = dataclasses.replace(s, n_lon=len(raster.new_axis(lons, step)), n_lat=len(raster.new_axis(lats, step)), step=step)
        # the mask of the new cells is what has a value on the first day, one row per cell of a catalogued grid
        first = self.df.groupBy(*CELL).agg(F.min_by(F.col("value").isNotNull(), "pos").alias("is_land"))
        return self._new(raster.remap(self.df.drop("is_land").join(F.broadcast(first), CELL), lons, lats, step), spec=spec)

    def clip(self, outline: str | list[list[tuple[float, float]]]) -> Grid:
        """By the union of a shapefile's polygons, or by the rings of (lon, lat) of one polygon."""
        shapes = shapefile.read_shapes(outline) if isinstance(outline, str) else [outline]
        return self._new(raster.clip(self.df, self.df.select(*CELL, "lon", "lat").distinct(), shapes))

    def to_arrays(self, folder: str) -> DataFrame:
        """Dense (lat, lon) arrays, one per time step, with the dimensions and CF attributes of the data set; see sinks.to_arrays."""
        return sinks.to_arrays(self.timed(), "time", self.meta, folder, value=self.value_column)

    def at(self, lat: float, lon: float) -> DataFrame:
        """The rows of the nearest cell."""
        j, i = self.meta.spec.nearest(lat, lon)
        return self.df.where((F.col("lon_i") == i) & (F.col("lat_i") == j))

    def to_csv(self, out_dir: str, name: str = "grid", lat: float | None = None, lon: float | None = None) -> str:
        return sinks.to_csv(self, out_dir, name, lat, lon)

    def to_grd(self, folder: str, layout: str = "yearly") -> DataFrame:
        return sinks.to_grd(self, folder, layout)

    def to_netcdf(self, path: str) -> int:
        return sinks.to_netcdf(self.timed(), "time", self.meta.spec, path, self.meta.method or self.meta.cat, value=self.value_column)

    def to_geotiff(self, path: str) -> int:
        return sinks.to_geotiff(self.timed(), "time", self.meta.spec, path, value=self.value_column)


def open_data(*args, **options) -> Grid:
    return Grid.of(grd.open_data(*args, **options))


def open_real_data(*args, **options) -> Grid:
    return Grid.of(grd.open_real_data(*args, **options))


def get_data(*args, **options) -> Grid:
    return Grid.of(download.get_data(*args, **options))


def get_real_data(*args, **options) -> Grid:
    return Grid.of(download.get_real_data(*args, **options))


__all__ = ["Grid", "Meta", "get_data", "get_real_data", "open_data", "open_real_data"]
