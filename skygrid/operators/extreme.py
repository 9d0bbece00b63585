"""Daily normals and terrain-aware heat- and cold-wave classes.

Departures are compared after rounding to six decimals, so that a one-decimal
reading just on a limit is on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygrid.functions.calendar import year_bucket
from skygrid.model import CELL, GridFrame

#: First gate by region (plains 0, hilly 1, coastal 2).
HEAT_GATE = {0: 40.0, 1: 30.0, 2: 37.0}
COLD_GATE = {0: 10.0, 1: 0.0, 2: 15.0}
DEPARTURE, SEVERE = 4.5, 6.4


def daily_normals(g: GridFrame, first_year: int, last_year: int, window: int = 15) -> DataFrame:
    """lon_i, lat_i, doy (1 to 366), normal: mean per day of the year over the reference years, smoothed over `window` days around the year's end; missing skipped."""
    d = g.with_date().where(F.year("date").between(first_year, last_year))
    raw = d.groupBy(*CELL, F.dayofyear("date").alias("doy")).agg(F.avg("value").alias("v"))
    # without any leap year, day 366 is the mean of its neighbours
    whole = raw.groupBy(*CELL).agg(F.max(F.when(F.col("doy") == 366, F.col("v"))).alias("v366"), F.avg(F.when(F.col("doy").isin(1, 365), F.col("v"))).alias("near"))
    days = raw.where("doy < 366").unionByName(whole.select(*CELL, F.lit(366).alias("doy"), F.coalesce("v366", "near").alias("v")))
    half = window // 2
    # the ends of the year next to each other
    ring = days.withColumn("doy", F.explode(F.array(F.col("doy"), F.col("doy") - 366, F.col("doy") + 366))).where(F.col("doy").between(1 - half, 366 + half))
    w = Window.partitionBy(*CELL).orderBy("doy").rangeBetween(-half, half)
    return ring.withColumn("normal", F.avg("v").over(w)).where(F.col("doy").between(1, 366)).select(*CELL, "doy", "normal")


def norm_period(g: GridFrame, norm_start: int | None, norm_end: int | None, normals_from: GridFrame | None = None) -> tuple[int, int]:
    """The reference years: given as a pair of at least ten that the data (or normals_from) cover, else all of at least thirty."""
    if norm_start is not None and norm_end is not None:
        if norm_end - norm_start + 1 < 10:
            raise ValueError("the normal period needs at least 10 years")
        have = (normals_from or g).meta
        if norm_start < have.start.year or norm_end > have.end.year:
            raise ValueError(f"the normal period {norm_start} to {norm_end} lies outside the data of {have.start.year} to {have.end.year}: give normals_from")
        return norm_start, norm_end
    if g.meta.years < 30:
        raise ValueError("at least 30 years of data, or a normal period, are needed")
    return g.meta.start.year, g.meta.end.year


def _normals(g: GridFrame, norm_start: int | None, norm_end: int | None, normals_from: GridFrame | None) -> DataFrame:
    """Daily normals of g's cells: of its own years, or of those of another grid of the same kind and cells."""
    if normals_from is not None and (normals_from.meta.cat != g.meta.cat or normals_from.meta.spec != g.meta.spec):
        raise ValueError("normals_from is of another variable or grid")
    years = norm_period(g, norm_start, norm_end, normals_from)
    return daily_normals(normals_from or g, *years)


def _gate(limits: dict[int, float]) -> Column:
    out = F.when(F.col("region") == 0, limits[0])
    for r in (1, 2):
        out = out.when(F.col("region") == r, limits[r])
    return out


def _classify(g: GridFrame, regions: DataFrame, normals: DataFrame, label: Column) -> DataFrame:
    d = g.with_date().withColumn("doy", F.dayofyear("date"))
    # the grid's cells (at most those of the catalogue) and 366 normals of each
    cells = regions.select(*CELL, F.col("region").cast("int").alias("region"))
    rows = d.join(F.broadcast(cells), CELL, "left").join(normals, [*CELL, "doy"], "left").withColumn("dep", F.round(F.col("value") - F.col("normal"), 6))
    land = F.col("region").isNotNull() & (F.col("region") >= 0) & F.col("is_land")
    return rows.select(*CELL, "pos", "date", F.when(land, F.coalesce(label, F.lit(0.0))).alias("class"))


def heatwave(g: GridFrame, regions: DataFrame, norm_start: int | None = None, norm_end: int | None = None, normals_from: GridFrame | None = None) -> DataFrame:
    """lon_i, lat_i, pos, date, class: 0 none, 1 heat wave, 2 severe; NULL at sea. A missing day is 0.

    The normal years must lie in the data; those of other years come from normals_from,
    a grid of the same variable and cells.
    """
    g.require("tmax")
    t, dep, inland = F.col("value"), F.col("dep"), F.col("region").isin(0, 1)
    gate = t >= _gate(HEAT_GATE)
    severe = (dep > SEVERE) | (inland & (t >= 47.0))
    event = dep.between(DEPARTURE, SEVERE) | (inland & (t >= 45.0) & (t < 47.0))
    label = F.when(gate & severe, 2.0).when(gate & event, 1.0)
    return _classify(g, regions, _normals(g, norm_start, norm_end, normals_from), label)


def coldwave(g: GridFrame, regions: DataFrame, norm_start: int | None = None, norm_end: int | None = None, normals_from: GridFrame | None = None) -> DataFrame:
    """As heatwave, for minimum temperature: 1 cold wave, 2 severe."""
    g.require("tmin")
    t, dep, plains = F.col("value"), F.col("dep"), F.col("region") == 0
    gate = t <= _gate(COLD_GATE)
    severe = (dep <= -SEVERE) | (plains & (t <= 2.0))
    event = ((dep > -SEVERE) & (dep <= -DEPARTURE)) | (plains & (t > 2.0) & (t <= 4.0))
    label = F.when(gate & severe, 2.0).when(gate & event, 1.0)
    return _classify(g, regions, _normals(g, norm_start, norm_end, normals_from), label)


def annual_events(classes: DataFrame, year0: int, count: str = "total") -> DataFrame:
    """lon_i, lat_i, year, n: days of class 1 and 2 (total), of class 1 (wave) or of class 2 (severe); NULL at sea."""
    hit = {"total": F.col("class") >= 1, "wave": F.col("class") == 1, "severe": F.col("class") == 2}.get(count)
    if hit is None:
        raise ValueError("count is total, wave or severe")
    return classes.groupBy(*CELL, (year_bucket(F.col("pos"), year0) + F.lit(year0)).alias("year")).agg(F.when(F.count("class") > 0, F.count_if(hit)).alias("n"))
