"""Annual indices. Rows: lon_i, lat_i, year, and the index under its name; NULL outside land and where missing values decide.

Years are cut by position (see functions.calendar). Counts and sums of threshold
days treat missing as not reaching the threshold; extremes and means are NULL when
any day of the year is missing. A year bucket that holds no day has no row here;
``complete`` adds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygrid.functions.calendar import month_bucket, year_bucket
from skygrid.model import CELL, GridFrame, on_land, poison


def _annual(g: GridFrame, df: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    y0 = g.meta.start.year
    rows = (g.df if df is None else df).withColumn("year", year_bucket(F.col("pos"), y0) + F.lit(y0))
    return rows, [*CELL, "year"]


def _one(g: GridFrame, name: str, expr: Column) -> DataFrame:
    rows, key = _annual(g)
    return rows.groupBy(*key).agg(on_land(expr).alias(name))


def dr(g: GridFrame, threshold: float = 2.5) -> DataFrame:
    """Days of at least the threshold."""
    g.require("rain")
    return _one(g, "dr", F.count_if(F.col("value") >= threshold))


def d64(g: GridFrame, threshold: float = 64.5) -> DataFrame:
    """Days of heavy rain."""
    g.require("rain")
    return _one(g, "d64", F.count_if(F.col("value") >= threshold))


def rtwd(g: GridFrame, threshold: float = 2.5) -> DataFrame:
    """Rain of the days of at least the threshold."""
    g.require("rain")
    return _one(g, "rtwd", F.sum(F.when(F.col("value") >= threshold, F.col("value")).otherwise(0.0)))


def sdii(g: GridFrame) -> DataFrame:
    """Mean rain of the days of at least 2.5; NULL without one."""
    g.require("rain")
    wet = F.when(F.col("value") >= 2.5, F.col("value"))
    return _one(g, "sdii", F.avg(wet))


def rxa(g: GridFrame) -> DataFrame:
    g.require("rain")
    return _one(g, "rxa", poison(F.max("value")))


def mxadt(g: GridFrame) -> DataFrame:
    g.require("tmax")
    return _one(g, "mxadt", poison(F.max("value")))


def mnadt(g: GridFrame) -> DataFrame:
    g.require("tmin")
    return _one(g, "mnadt", poison(F.min("value")))


def dtr(g: GridFrame, tmin: GridFrame | None = None) -> DataFrame:
    """Mean of daily maximum less minimum; both grids must cover the same days."""
    g.require("tmax")
    if tmin is None:
        raise ValueError("tmin is needed")
    tmin.require("tmin")
    if (g.meta.start, g.meta.end) != (tmin.meta.start, tmin.meta.end):
        raise ValueError("tmax and tmin must cover the same days")
    other = tmin.df.select(*CELL, "pos", F.col("value").alias("low"))
    both = g.df.join(other, [*CELL, "pos"]).withColumn("value", F.col("value") - F.col("low"))
    rows, key = _annual(g, both)
    return rows.groupBy(*key).agg(on_land(poison(F.avg("value"))).alias("dtr"))


def pci(g: GridFrame) -> DataFrame:
    """100 times the sum of squared monthly rain over the squared sum; NULL without rain."""
    g.require("rain")
    rows, key = _annual(g)
    monthly = rows.groupBy(*key, month_bucket(F.col("pos"), g.meta.start.year).alias("m")).agg(poison(F.sum("value")).alias("value"), F.max("is_land").alias("is_land"))
    total = F.sum("value")
    return monthly.groupBy(*key).agg(on_land(poison(F.try_divide(100.0 * F.sum(F.col("value") * F.col("value")), total * total))).alias("pci"))


def rx5d(g: GridFrame) -> DataFrame:
    """Largest sum of five successive days of a year; of fewer days, their sum."""
    g.require("rain")
    rows, key = _annual(g)
    frame = Window.partitionBy(*key).orderBy("pos").rowsBetween(-4, 0)
    s = rows.withColumn("s5", F.when(F.count(F.lit(1)).over(frame) == 5, F.sum("value").over(frame)))
    return s.groupBy(*key).agg(on_land(poison(F.when(F.count(F.lit(1)) >= 5, F.max("s5")).otherwise(F.sum("value")))).alias("rx5d"))


def _spell(g: GridFrame, name: str, hit: Column) -> DataFrame:
    rows, key = _annual(g)
    # within a run of hits, position less the number of hits so far does not change
    flag = F.coalesce(hit, F.lit(False))
    run = rows.withColumn("hit", flag).withColumn("run", F.col("pos") - F.sum(F.col("hit").cast("int")).over(Window.partitionBy(*key).orderBy("pos")))
    n = run.groupBy(*key, "run").agg(F.count_if("hit").alias("n"), F.max("is_land").alias("is_land"))
    return n.groupBy(*key).agg(on_land(F.max("n")).alias(name))


def cwd(g: GridFrame, threshold: float = 2.5) -> DataFrame:
    """Longest run of days of at least the threshold within a year, 0 without one; missing ends a run."""
    g.require("rain")
    return _spell(g, "cwd", F.col("value") >= threshold)


def cdd(g: GridFrame, threshold: float = 1.0) -> DataFrame:
    """Longest run of days below the threshold within a year."""
    g.require("rain")
    return _spell(g, "cdd", F.col("value") < threshold)


def complete(index: DataFrame, g: GridFrame, fill: dict[str, float] | None = None) -> DataFrame:
    """Every cell with all calendar years of the grid's range; years without a day take fill, else NULL."""
    cells = index.select(*CELL).distinct()
    y = g.meta.start.year
    spine = cells.withColumn("year", F.explode(F.sequence(F.lit(y), F.lit(y + g.meta.years - 1))))
    out = spine.join(index.withColumn("has", F.lit(True)), [*CELL, "year"], "left")
    for c, v in (fill or {}).items():
        out = out.withColumn(c, F.when(F.col("has"), F.col(c)).otherwise(F.lit(v)))
    return out.drop("has")


for _f in (dr, d64, rtwd, sdii, rxa, mxadt, mnadt, dtr, pci, rx5d, cwd, cdd):
    GridFrame.register(_f.__name__, "A", _f)
