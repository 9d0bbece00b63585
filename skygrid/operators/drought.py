"""Standardised drought indices by month.

SPI: rolling monthly rain, a gamma law fitted per cell and calendar month over the
calibration years (Thom's estimate), the mixed probability turned into a standard
normal quantile. SPEI: rain less potential evapotranspiration (Hargreaves), a
generalised logistic law by probability-weighted moments. Probabilities are kept
within 0.001 and 0.999. All fits are hash aggregates and expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygrid.functions.special import gamma_cdf, normal_ppf
from skygrid.model import CELL, GridFrame, GridSpec
from skygrid.operators.monthly import monthly
from skygrid.operators.raster import remap

#: Middle day of the year and length of each month, February without leap day.
MID_DAY = (15, 46, 74, 105, 135, 166, 196, 227, 258, 288, 319, 349)
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
LOW, HIGH = 0.001, 0.999
LEAST = 10


def rolling_sum(months: DataFrame, k: int) -> DataFrame:
    """Sum of the k months up to each; NULL for the first k - 1 and where all k are missing. Rows: cell, m, value."""
    w = Window.partitionBy(*CELL).orderBy("m").rowsBetween(-(k - 1), 0)
    return months.withColumn("value", F.when(F.col("m") >= k - 1, F.sum("value").over(w)))


def _period(g: GridFrame, cal_start: int | None, cal_end: int | None, k: int) -> Column:
    if k < 1:
        raise ValueError("the time scale is at least one month")
    a, b = cal_start or g.meta.start.year, cal_end or g.meta.end.year
    if g.meta.years < 10 or b - a + 1 < 10:
        raise ValueError("data and calibration need at least 10 years")
    m0 = g.meta.start.year
    return (F.col("m") >= (a - m0) * 12) & (F.col("m") < (b - m0 + 1) * 12) & (F.col("m") >= k - 1)


def _quantile(p: str) -> Column:
    return normal_ppf(p)


def spi(g: GridFrame, timescale: int = 3, cal_start: int | None = None, cal_end: int | None = None) -> DataFrame:
    """lon_i, lat_i, m, spi; NULL for the first months, at sea, and where the calibration has fewer than 10 values or 10 above zero."""
    g.require("rain", "rain_gpm")
    inside = _period(g, cal_start, cal_end, timescale)
    x = rolling_sum(monthly(g), timescale).withColumn("month", F.col("m") % 12)
    used = F.when(inside, F.col("value"))
    wet = F.when(used > 0, used)
    fit = x.groupBy(*CELL, "month").agg(F.count(used).alias("n"), F.count(wet).alias("wet"), F.avg(wet).alias("mean"), F.avg(F.log(wet)).alias("mean_log"))
    fit = fit.withColumn("a", F.log("mean") - F.col("mean_log")).where((F.col("n") >= LEAST) & (F.col("wet") >= LEAST) & (F.col("a") > 0))
    fit = fit.withColumn("shape", (1.0 + F.sqrt(1.0 + 4.0 * F.col("a") / 3.0)) / (4.0 * F.col("a"))).select(*CELL, "month", "shape", (F.col("mean") / F.col("shape")).alias("scale"), (1.0 - F.col("wet") / F.col("n")).alias("q"))
    y = x.join(fit, [*CELL, "month"], "left")
    h = F.when(F.col("value") > 0, F.col("q") + (1.0 - F.col("q")) * gamma_cdf(F.col("value"), F.col("shape"), F.col("scale"))).otherwise(F.col("q"))
    y = y.withColumn("h", F.when(F.col("value").isNotNull() & F.col("shape").isNotNull(), F.least(F.greatest(h, F.lit(LOW)), F.lit(HIGH))))
    return y.select(*CELL, "m", _quantile("h").alias("spi"))


def hargreaves(tmax: Column, tmin: Column, lat: Column, month: Column) -> Column:
    """Monthly potential evapotranspiration in mm; month 0 to 11; NULL if a temperature is missing."""
    phi = F.radians(lat)
    j = F.element_at(F.array(*[F.lit(float(x)) for x in MID_DAY]), month + 1)
    days = F.element_at(F.array(*[F.lit(float(x)) for x in MONTH_DAYS]), month + 1)
    delta = 0.409 * F.sin(2.0 * math.pi * j / 365.0 - 1.39)
    distance = 1.0 + 0.033 * F.cos(2.0 * math.pi * j / 365.0)
    omega = F.acos(F.least(F.greatest(-F.tan(phi) * F.tan(delta), F.lit(-1.0)), F.lit(1.0)))
    ra = F.greatest(F.lit(0.0), 24.0 * 60.0 / math.pi * 0.0820 * distance * (omega * F.sin(phi) * F.sin(delta) + F.cos(phi) * F.cos(delta) * F.sin(omega)))
    eto = 0.0023 * ra * ((tmax + tmin) / 2.0 + 17.8) * F.sqrt(F.greatest(F.lit(0.0), tmax - tmin)) * 0.408
    return F.when(tmax.isNotNull() & tmin.isNotNull(), eto * days)


def pet(tmax: GridFrame, tmin: GridFrame) -> DataFrame:
    """lon_i, lat_i, m, value: Hargreaves potential evapotranspiration of each month."""
    tmax.require("tmax")
    tmin.require("tmin")
    if (tmax.meta.start, tmax.meta.end) != (tmin.meta.start, tmin.meta.end):
        raise ValueError("tmax and tmin must cover the same days")
    if tmax.meta.spec != tmin.meta.spec:
        raise ValueError("tmax and tmin must lie on the same grid")
    lat = tmax.df.groupBy(*CELL).agg(F.first("lat").alias("lat"))
    both = monthly(tmax).withColumnRenamed("value", "hi").join(monthly(tmin).withColumnRenamed("value", "lo"), [*CELL, "m"]).join(lat, CELL)
    return both.select(*CELL, "m", hargreaves(F.col("hi"), F.col("lo"), F.col("lat"), F.col("m") % 12).alias("value"))


def on_rain_grid(pet_rows: DataFrame, own: GridSpec | None, rain: GridSpec | None) -> DataFrame:
    """Rows of evapotranspiration under the cell numbers of the rain's grid.

    The rows are regridded to the rain's step (nearest cell) and laid where their first
    cell is nearest; what lies beyond the rain's grid meets no cell. Grids of which
    only one is known cannot be matched.
    """
    if own == rain:
        return pet_rows
    if own is None or rain is None:
        raise ValueError("the grids differ and the coordinates of one are not known")
    lons, lats = [own.lon(i) for i in range(own.n_lon)], [own.lat(i) for i in range(own.n_lat)]
    fine = remap(pet_rows.withColumns({"lon": F.lit(0.0), "lat": F.lit(0.0)}), lons, lats, rain.step)
    first = lambda x0, n, x: min(range(n), key=lambda i: (abs(x0 + rain.step * i - x), i))
    i0, j0 = first(rain.lon0, rain.n_lon, lons[0]), first(rain.lat0, rain.n_lat, lats[0])
    return fine.select((F.col("lon_i") + i0).alias("lon_i"), (F.col("lat_i") + j0).alias("lat_i"), "m", "value")


def water_balance(rain: GridFrame, pet_rows: DataFrame, pet_spec: GridSpec | None = None) -> DataFrame:
    """Monthly rain less evapotranspiration, the latter brought from its own grid (None: the rain's) to that of the rain; cells beyond it are NULL."""
    p = on_rain_grid(pet_rows, pet_spec or rain.meta.spec, rain.meta.spec).select(*CELL, "m", F.col("value").alias("pet"))
    return monthly(rain).join(p, [*CELL, "m"], "left").select(*CELL, "m", (F.col("value") - F.col("pet")).alias("value"))


def logistic_fit(x: DataFrame, keys: list[str]) -> DataFrame:
    """keys, xi, alpha, k of the generalised logistic law by probability-weighted moments of value; groups that cannot be fitted are left out."""
    r = x.where(F.col("value").isNotNull()).withColumn("i", (F.row_number().over(Window.partitionBy(*keys).orderBy("value")) - 1).cast("double"))
    i, v, n = F.col("i"), F.col("value"), F.count(F.lit(1)).cast("double")
    s = r.groupBy(*keys).agg(n.alias("n"), F.avg(v).alias("w0"), F.sum(i * v).alias("s1"), F.sum(i * (i - 1.0) * v).alias("s2")).where(F.col("n") >= LEAST)
    n = F.col("n")
    s = s.withColumn("w1", F.col("s1") / (n * (n - 1.0))).withColumn("w2", F.col("s2") / (n * (n - 1.0) * (n - 2.0)))
    s = s.withColumn("l2", 2.0 * F.col("w1") - F.col("w0")).where(F.abs("l2") >= 1e-10)
    s = s.withColumn("k", -(6.0 * F.col("w2") - 6.0 * F.col("w1") + F.col("w0")) / F.col("l2")).where(F.abs("k") < 1.0)
    k, flat = F.col("k"), F.abs("k") < 1e-6
    kk = F.when(flat, F.lit(1.0)).otherwise(k)
    s = s.withColumn("alpha", F.when(flat, F.col("l2")).otherwise(F.col("l2") * F.sin(kk * math.pi) / (kk * math.pi))).where("alpha > 0")
    return s.select(*keys, F.when(flat, F.col("w0")).otherwise(F.col("w0") - F.col("alpha") * (1.0 / kk - math.pi / F.sin(kk * math.pi))).alias("xi"), "alpha", "k")


def logistic_cdf(value: Column, xi: Column, alpha: Column, k: Column) -> Column:
    """Distribution function; beyond the support 0.999 for k > 0, else 0.001."""
    z = (value - xi) / alpha
    inner = 1.0 - k * z
    safe = F.when(inner > 0, inner).otherwise(F.lit(1.0))
    y = F.when(F.abs(k) < 1e-6, z).otherwise(-F.log(safe) / F.when(F.abs(k) < 1e-6, F.lit(1.0)).otherwise(k))
    return F.when((F.abs(k) >= 1e-6) & (inner <= 0), F.when(k > 0, F.lit(HIGH)).otherwise(F.lit(LOW))).otherwise(1.0 / (1.0 + F.exp(-y)))


def spei(g: GridFrame, tmax: GridFrame | None = None, tmin: GridFrame | None = None, timescale: int = 3, cal_start: int | None = None, cal_end: int | None = None) -> DataFrame:
    """lon_i, lat_i, m, spei; NULL for the first months, at sea, beyond the temperature's grid and where no law could be fitted.

    Temperature may lie on another grid: evapotranspiration is computed there and
    regridded to the rain by the coordinates of both.
    """
    g.require("rain", "rain_gpm")
    if tmax is None or tmin is None:
        raise ValueError("tmax and tmin are needed")
    if (g.meta.start, g.meta.end) != (tmax.meta.start, tmax.meta.end):
        raise ValueError("rain and temperature must cover the same days")
    if (g.meta.spec is None) != (tmax.meta.spec is None):
        raise ValueError("the grids differ and the coordinates of one are not known")
    inside = _period(g, cal_start, cal_end, timescale)
    x = rolling_sum(water_balance(g, pet(tmax, tmin), tmax.meta.spec), timescale).withColumn("month", F.col("m") % 12)
    fit = logistic_fit(x.where(inside), [*CELL, "month"])
    y = x.join(fit, [*CELL, "month"], "left")
    h = logistic_cdf(F.col("value"), F.col("xi"), F.col("alpha"), F.col("k"))
    y = y.withColumn("h", F.when(F.col("value").isNotNull() & F.col("xi").isNotNull(), F.least(F.greatest(h, F.lit(LOW)), F.lit(HIGH))))
    return y.select(*CELL, "m", _quantile("h").alias("spei"))


def drought_class(index: Column) -> Column:
    """extreme, severe, moderate, normal or extremely wet; NULL where the documented bands are silent (between 1 and 2)."""
    return F.when(index <= -2, "extreme").when(index <= -1.5, "severe").when(index < -1, "moderate").when(index <= 1, "normal").when(index >= 2, "extremely wet")


GridFrame.register("spi", "M", spi)
GridFrame.register("spei", "M", spei)
