"""Monthly totals or means, climatology, anomaly, spatial mean and land mask."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skygrid.functions.calendar import month_bucket, year_bucket
from skygrid.model import CELL, GridFrame, GridSpec, on_land, poison


def monthly(g: GridFrame, land_only: bool = True) -> DataFrame:
    """lon_i, lat_i, m (months since the first January), value: rain adds up, temperature is averaged; missing days are skipped, none at all gives NULL."""
    agg = F.sum("value") if g.meta.cat in ("rain", "rain_gpm") else F.avg("value")
    return g.df.groupBy(*CELL, month_bucket(F.col("pos"), g.meta.start.year).alias("m")).agg((on_land(agg) if land_only else agg).alias("value"))


def climatology(g: GridFrame) -> DataFrame:
    """lon_i, lat_i, month (1 to 12), value: mean over the years of the monthly values."""
    if g.meta.scale != "raw" or g.meta.days < 365:
        raise ValueError("a climatology needs raw data of at least 365 days")
    return monthly(g).groupBy(*CELL, (F.col("m") % 12 + 1).alias("month")).agg(F.avg("value").alias("value"))


def anomaly(g: GridFrame, baseline: DataFrame | None = None, baseline_cat: str | None = None, baseline_spec: GridSpec | None = None) -> DataFrame:
    """Monthly values less the climatology: their own, or that of another period on the same grid, which must hold exactly the twelve months."""
    if g.meta.scale != "raw" or g.meta.days < 365:
        raise ValueError("an anomaly needs raw data of at least 365 days")
    m = monthly(g).withColumn("month", F.col("m") % 12 + 1)
    if baseline is None:
        own = F.avg("value").over(Window.partitionBy(*CELL, "month"))
        return m.select(*CELL, "m", (F.col("value") - own).alias("value"))
    if baseline_cat not in (None, g.meta.cat):
        raise ValueError("the climatology is of another variable")
    if baseline_spec is not None and g.meta.spec is not None and baseline_spec != g.meta.spec:
        raise ValueError("the climatology is of another grid")
    months = baseline.agg(F.array_sort(F.collect_set(F.col("month").cast("int")))).first()[0]
    if months != list(range(1, 13)):
        raise ValueError("a climatology has the months 1 to 12")
    return m.join(baseline.select(*CELL, "month", F.col("value").alias("base")), [*CELL, "month"], "left").select(*CELL, "m", (F.col("value") - F.col("base")).alias("value"))


def spatial_mean(df: DataFrame, time: str, weighted: bool = True) -> DataFrame:
    """One value per time step: the mean over valid land cells, weighted by the cosine of latitude unless told not to; NULL without one."""
    w = F.cos(F.radians("lat")) if weighted else F.lit(1.0)
    valid = F.when(F.col("is_land") & F.col("value").isNotNull(), w)
    return df.groupBy(time).agg(F.try_divide(F.sum(valid * F.col("value")), F.sum(valid)).alias("value"))


def temporal_mean(df: DataFrame) -> DataFrame:
    """Mean of each cell over all its time steps, missing ones skipped."""
    return df.groupBy(*CELL).agg(F.avg("value").alias("value"))


def land_mask(df: DataFrame, cat: str, days: int) -> DataFrame:
    """is_land per cell: a value on the first day and, for rain of at least a year, not zero throughout."""
    first = F.min_by(F.col("value").isNotNull(), "pos")
    if cat in ("rain", "rain_gpm") and days >= 365:
        return df.groupBy(*CELL).agg((first & ~F.coalesce(F.bool_and(F.coalesce(F.col("value"), F.lit(-1.0)) == 0.0), F.lit(False))).alias("is_land"))
    return df.groupBy(*CELL).agg(first.alias("is_land"))


def annual_series(g: GridFrame) -> DataFrame:
    """lon_i, lat_i, t (years since the first), x: rain adds up, anything else is averaged; any missing day makes the year NULL."""
    agg = F.sum("value") if g.meta.cat == "rain" else F.avg("value")
    return g.df.groupBy(*CELL, year_bucket(F.col("pos"), g.meta.start.year).alias("t")).agg(on_land(poison(agg)).alias("x"))
