"""Queries of the climate operators over the thirty-year fixture, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrid.operators import drought, extreme, indices, monthly, raster, trend
from skygrid.model import ARCHIVE, GridFrame, Meta
from skygrid.plans.fixture import END, FX, SPEC, START, fine_rain, grid, regions, rows
from skygrid.sources.grd import open_data
from skygrid.sources.sinks import to_grd
from skygrid.session import fresh_dir, remove, settle, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Rounded, and never minus zero."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


def _add(name: str, query: Query, sql: str | None, digits: int | None = None, columns: tuple[str, ...] | None = None) -> None:
    cols = columns or (name,)
    QUERIES[name] = query if digits is None else lambda s, d: _rounded(query(s, d), digits, *cols)
    if sql is not None:
        SQL[name] = sql


def _annual(name: str, cat: str, sql: str, digits: int | None = None, **options) -> None:
    build = getattr(indices, name)
    value = f"CASE WHEN bool_or(is_land) THEN {sql} END"
    if digits is not None:
        value = f"round({value}, {digits}) + 0.0"
    _add(name, lambda s, d: build(grid(s, d, cat), **options), f"WITH {FX} SELECT lon_i, lat_i, yr AS year, {value} AS {name} FROM fx GROUP BY lon_i, lat_i, yr", digits)


_annual("dr", "rain", "count(*) FILTER (WHERE rain >= 2.5)")
_annual("d64", "rain", "count(*) FILTER (WHERE rain >= 64.5)")
_annual("rtwd", "rain", "coalesce(sum(rain) FILTER (WHERE rain >= 2.5), 0.0)", 6)
_annual("sdii", "rain", "avg(rain) FILTER (WHERE rain >= 2.5)", 6)
_annual("rxa", "rain", "CASE WHEN count(rain) = count(*) THEN max(rain) END", 6)
_annual("mxadt", "tmax", "CASE WHEN count(tmax) = count(*) THEN max(tmax) END", 6)
_annual("mnadt", "tmin", "CASE WHEN count(tmin) = count(*) THEN min(tmin) END", 6)
_add("dtr", lambda s, d: indices.dtr(grid(s, d, "tmax"), grid(s, d, "tmin")), f"WITH {FX} SELECT lon_i, lat_i, yr AS year, round(CASE WHEN count(tmax) = count(*) THEN avg(tmax - tmin) END, 6) + 0.0 AS dtr FROM fx GROUP BY lon_i, lat_i, yr", 6)
_add(
    "pci",
    lambda s, d: indices.pci(grid(s, d, "rain")),
    f"WITH {FX}, mo AS (SELECT lon_i, lat_i, yr, m, sum(rain) AS v FROM fx WHERE is_land GROUP BY lon_i, lat_i, yr, m), c AS (SELECT DISTINCT lon_i, lat_i, yr FROM fx), "
    "p AS (SELECT lon_i, lat_i, yr, CASE WHEN sum(v) <> 0 THEN 100.0 * sum(v * v) / (sum(v) * sum(v)) END AS pci FROM mo GROUP BY lon_i, lat_i, yr "
    "UNION ALL SELECT lon_i, lat_i, yr, NULL FROM c WHERE lon_i = 3 AND lat_i = 2) "
    "SELECT lon_i, lat_i, yr AS year, round(pci, 6) + 0.0 AS pci FROM p",
    6,
)
_add(
    "rx5d",
    lambda s, d: indices.rx5d(grid(s, d, "rain")),
    f"WITH {FX}, w AS (SELECT *, sum(rain) OVER f AS s5, count(*) OVER f AS n5 FROM fx WINDOW f AS (PARTITION BY lon_i, lat_i, yr ORDER BY pos ROWS 4 PRECEDING)) "
    "SELECT lon_i, lat_i, yr AS year, round(CASE WHEN bool_or(is_land) THEN max(s5) FILTER (WHERE n5 = 5) END, 6) + 0.0 AS rx5d FROM w GROUP BY lon_i, lat_i, yr",
    6,
)


def _spell_sql(name: str, hit: str) -> str:
    return (
        f"WITH {FX}, h AS (SELECT *, coalesce({hit}, false) AS hit FROM fx), "
        "r AS (SELECT *, pos - row_number() OVER (PARTITION BY lon_i, lat_i, yr, hit ORDER BY pos) AS run FROM h), "
        "n AS (SELECT lon_i, lat_i, yr, bool_or(is_land) AS land, CASE WHEN hit THEN count(*) ELSE 0 END AS n FROM r GROUP BY lon_i, lat_i, yr, hit, run) "
        f"SELECT lon_i, lat_i, yr AS year, CASE WHEN bool_or(land) THEN CAST(max(n) AS BIGINT) END AS {name} FROM n GROUP BY lon_i, lat_i, yr"
    )


_add("cwd", lambda s, d: indices.cwd(grid(s, d, "rain")), _spell_sql("cwd", "rain >= 2.5"))
_add("cdd", lambda s, d: indices.cdd(grid(s, d, "rain")), _spell_sql("cdd", "rain < 1.0"))

# months, climatology, spatial means
MONTHLY = "mo AS (SELECT lon_i, lat_i, m, {agg}({col}) AS value FROM fx GROUP BY lon_i, lat_i, m)"
_RAIN_M, _TMAX_M = MONTHLY.format(agg="sum", col="rain"), MONTHLY.format(agg="avg", col="tmax")
_add("monthly_sum", lambda s, d: monthly.monthly(grid(s, d, "rain")), f"WITH {FX}, {_RAIN_M} SELECT lon_i, lat_i, m, round(value, 6) + 0.0 AS value FROM mo", 6, ("value",))
_add("monthly_mean", lambda s, d: monthly.monthly(grid(s, d, "tmax")), f"WITH {FX}, {_TMAX_M} SELECT lon_i, lat_i, m, round(value, 6) + 0.0 AS value FROM mo", 6, ("value",))
_add("climatology", lambda s, d: monthly.climatology(grid(s, d, "rain")), f"WITH {FX}, {_RAIN_M} SELECT lon_i, lat_i, m % 12 + 1 AS month, round(avg(value), 6) + 0.0 AS value FROM mo GROUP BY lon_i, lat_i, m % 12", 6, ("value",))
_add("anomaly", lambda s, d: monthly.anomaly(grid(s, d, "tmax")), f"WITH {FX}, {_TMAX_M} SELECT lon_i, lat_i, m, round(value - avg(value) OVER (PARTITION BY lon_i, lat_i, m % 12), 6) + 0.0 AS value FROM mo", 6, ("value",))


def _anomaly_external(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d, "rain")
    base = monthly.monthly(g).where("m < 120").groupBy("lon_i", "lat_i", (F.col("m") % 12 + 1).alias("month")).agg(F.avg("value").alias("value"))
    return monthly.anomaly(g, base, "rain")


_add(
    "anomaly_external",
    _anomaly_external,
    f"WITH {FX}, {_RAIN_M}, b AS (SELECT lon_i, lat_i, m % 12 AS month, avg(value) AS base FROM mo WHERE m < 120 GROUP BY lon_i, lat_i, m % 12) "
    "SELECT mo.lon_i, mo.lat_i, mo.m, round(value - base, 6) + 0.0 AS value FROM mo JOIN b ON b.lon_i = mo.lon_i AND b.lat_i = mo.lat_i AND b.month = mo.m % 12",
    6,
    ("value",),
)
_add(
    "spatial_mean",
    lambda s, d: monthly.spatial_mean(grid(s, d, "tmax").df, "pos"),
    f"WITH {FX} SELECT pos, round(sum(tmax * cos(radians(lat))) FILTER (WHERE is_land) / sum(cos(radians(lat))) FILTER (WHERE is_land AND tmax IS NOT NULL), 6) + 0.0 AS value FROM fx GROUP BY pos",
    6,
    ("value",),
)
_add("spatial_mean_unweighted", lambda s, d: monthly.spatial_mean(grid(s, d, "rain").df, "pos", weighted=False), f"WITH {FX} SELECT pos, round(avg(rain) FILTER (WHERE is_land), 6) + 0.0 AS value FROM fx GROUP BY pos", 6, ("value",))
_add("temporal_mean", lambda s, d: monthly.temporal_mean(grid(s, d, "tmin").df), f"WITH {FX} SELECT lon_i, lat_i, round(avg(tmin), 6) + 0.0 AS value FROM fx GROUP BY lon_i, lat_i", 6, ("value",))
_add("land_mask", lambda s, d: monthly.land_mask(grid(s, d, "rain").df, "rain", 10958), f"WITH {FX} SELECT lon_i, lat_i, arg_min(rain IS NOT NULL, pos) AND NOT coalesce(bool_and(coalesce(rain, -1) = 0), false) AS is_land FROM fx GROUP BY lon_i, lat_i")
_add(
    "date_slice",
    lambda s, d: grid(s, d, "rain").with_date().where("date between '2004-06-01' and '2004-09-30'").select("lon_i", "lat_i", "date", "value"),
    f"WITH {FX} SELECT lon_i, lat_i, date, rain AS value FROM fx WHERE date BETWEEN DATE '2004-06-01' AND DATE '2004-09-30'",
)

# trends
_YEARS = "yy AS (SELECT lon_i, lat_i, yr - 1991 AS t, sum(rain) AS x FROM fx WHERE is_land GROUP BY lon_i, lat_i, yr)"
_SLOPE = "sl AS (SELECT a.lon_i, a.lat_i, median((b.x - a.x) / (b.t - a.t)) AS slope FROM yy a JOIN yy b ON a.lon_i = b.lon_i AND a.lat_i = b.lat_i AND b.t > a.t GROUP BY a.lon_i, a.lat_i)"
_add("sse", lambda s, d: trend.sse(grid(s, d, "rain")), f"WITH {FX}, {_YEARS}, {_SLOPE} SELECT lon_i, lat_i, round(slope, 6) + 0.0 AS sse FROM sl", 6)
_add(
    "sstr",
    lambda s, d: trend.sstr(grid(s, d, "rain")),
    f"WITH {FX}, {_YEARS}, {_SLOPE}, me AS (SELECT lon_i, lat_i, avg(x) AS mean, count(*) AS n FROM yy GROUP BY lon_i, lat_i) "
    "SELECT sl.lon_i, sl.lat_i, round(slope * 100.0 * n / mean, 6) + 0.0 AS sstr FROM sl JOIN me ON me.lon_i = sl.lon_i AND me.lat_i = sl.lat_i",
    6,
)
_add(
    "spr",
    lambda s, d: trend.spr(grid(s, d, "rain")),
    f"WITH {FX}, {_YEARS}, r AS (SELECT lon_i, lat_i, t + 1 AS t, rank() OVER (PARTITION BY lon_i, lat_i ORDER BY x) + (count(*) OVER (PARTITION BY lon_i, lat_i, x) - 1) / 2.0 AS r FROM yy), "
    "p AS (SELECT lon_i, lat_i, CAST(count(*) AS DOUBLE) AS n, sum((r - t) * (r - t)) AS d2 FROM r GROUP BY lon_i, lat_i), "
    "q AS (SELECT *, 1.0 - 6.0 * d2 / (n * (n * n - 1.0)) AS rho FROM p) SELECT lon_i, lat_i, round(rho * sqrt((n - 2.0) / (1.0 - rho * rho)), 6) + 0.0 AS spr FROM q",
    6,
)
_add(
    "mmk_hr",
    lambda s, d: trend.mmk_hr(grid(s, d, "rain")),
    f"""WITH {FX}, {_YEARS}, {_SLOPE},
g AS (SELECT a.lon_i, a.lat_i, sum(sign(b.x - a.x)) AS s FROM yy a JOIN yy b ON a.lon_i = b.lon_i AND a.lat_i = b.lat_i AND b.t > a.t GROUP BY a.lon_i, a.lat_i),
ti AS (SELECT lon_i, lat_i, CAST(sum(c) AS DOUBLE) AS n, sum(c * (c - 1.0) * (2.0 * c + 5.0)) AS ties FROM (SELECT lon_i, lat_i, x, CAST(count(*) AS DOUBLE) AS c FROM yy GROUP BY lon_i, lat_i, x) GROUP BY lon_i, lat_i),
fl AS (SELECT yy.lon_i, yy.lat_i, yy.t, yy.x - (yy.t + 1) * slope AS f FROM yy JOIN sl ON sl.lon_i = yy.lon_i AND sl.lat_i = yy.lat_i),
rk AS (SELECT lon_i, lat_i, t, rank() OVER (PARTITION BY lon_i, lat_i ORDER BY f) + (count(*) OVER (PARTITION BY lon_i, lat_i, f) - 1) / 2.0 AS r FROM fl),
ce AS (SELECT lon_i, lat_i, t, r - avg(r) OVER (PARTITION BY lon_i, lat_i) AS c FROM rk),
z0 AS (SELECT lon_i, lat_i, sum(c * c) AS z FROM ce GROUP BY lon_i, lat_i),
ac AS (SELECT a.lon_i, a.lat_i, b.t - a.t AS k, sum(a.c * b.c) AS cov FROM ce a JOIN ce b ON a.lon_i = b.lon_i AND a.lat_i = b.lat_i AND b.t > a.t GROUP BY a.lon_i, a.lat_i, b.t - a.t),
co AS (SELECT ac.lon_i, ac.lat_i, sum(CASE WHEN abs(cov / z) > 1.959963984540054 / sqrt(n) THEN (n - k) * (n - k - 1) * (n - k - 2) * cov / z ELSE 0 END) AS lags
       FROM ac JOIN z0 ON z0.lon_i = ac.lon_i AND z0.lat_i = ac.lat_i JOIN ti ON ti.lon_i = ac.lon_i AND ti.lat_i = ac.lat_i GROUP BY ac.lon_i, ac.lat_i),
va AS (SELECT g.lon_i, g.lat_i, g.s, (n * (n - 1) * (2 * n + 5) - ties) / 18.0 * (1 + 2 / (n * (n - 1) * (n - 2)) * lags) AS v
       FROM g JOIN ti ON ti.lon_i = g.lon_i AND ti.lat_i = g.lat_i JOIN co ON co.lon_i = g.lon_i AND co.lat_i = g.lat_i)
SELECT lon_i, lat_i, round(CASE WHEN s = 0 THEN 0 WHEN v > 0 THEN (s - sign(s)) / sqrt(v) END, 6) + 0.0 AS mmk_hr FROM va""",
    6,
)

# waves
_NORMALS = """nd AS (SELECT lon_i, lat_i, CAST(dayofyear(date) AS INT) AS doy, avg({t}) AS v FROM fx GROUP BY lon_i, lat_i, dayofyear(date)),
ring AS (SELECT lon_i, lat_i, doy, v FROM nd UNION ALL SELECT lon_i, lat_i, doy - 366, v FROM nd WHERE doy > 359 UNION ALL SELECT lon_i, lat_i, doy + 366, v FROM nd WHERE doy < 8),
nm AS (SELECT lon_i, lat_i, doy, avg(v) OVER (PARTITION BY lon_i, lat_i ORDER BY doy RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS normal FROM ring),
dp AS (SELECT fx.*, round(fx.{t} - normal, 6) AS dep FROM fx JOIN nm ON nm.lon_i = fx.lon_i AND nm.lat_i = fx.lat_i AND nm.doy = dayofyear(fx.date))"""
_add("daily_normals", lambda s, d: extreme.daily_normals(grid(s, d, "tmax"), 1991, 2020), f"WITH {FX}, {_NORMALS.format(t='tmax')} SELECT lon_i, lat_i, doy, round(normal, 6) + 0.0 AS normal FROM nm WHERE doy BETWEEN 1 AND 366", 6, ("normal",))
_HEAT = f"""WITH {FX}, {_NORMALS.format(t="tmax")},
cl AS (SELECT lon_i, lat_i, pos, date, yr, CASE WHEN region < 0 THEN NULL
  WHEN tmax >= CASE region WHEN 0 THEN 40 WHEN 1 THEN 30 ELSE 37 END AND (dep > 6.4 OR (region IN (0, 1) AND tmax >= 47)) THEN 2.0
  WHEN tmax >= CASE region WHEN 0 THEN 40 WHEN 1 THEN 30 ELSE 37 END AND (dep BETWEEN 4.5 AND 6.4 OR (region IN (0, 1) AND tmax >= 45 AND tmax < 47)) THEN 1.0 ELSE 0.0 END AS class FROM dp)"""
_COLD = f"""WITH {FX}, {_NORMALS.format(t="tmin")},
cl AS (SELECT lon_i, lat_i, pos, date, yr, CASE WHEN region < 0 THEN NULL
  WHEN tmin <= CASE region WHEN 0 THEN 10 WHEN 1 THEN 0 ELSE 15 END AND (dep <= -6.4 OR (region = 0 AND tmin <= 2)) THEN 2.0
  WHEN tmin <= CASE region WHEN 0 THEN 10 WHEN 1 THEN 0 ELSE 15 END AND ((dep > -6.4 AND dep <= -4.5) OR (region = 0 AND tmin > 2 AND tmin <= 4)) THEN 1.0 ELSE 0.0 END AS class FROM dp)"""
_WAVES = {"heatwave": ("tmax", extreme.heatwave, _HEAT, "hw"), "coldwave": ("tmin", extreme.coldwave, _COLD, "cw")}
for _name, (_cat, _build, _cte, _short) in _WAVES.items():
    _add(f"{_name}_daily", lambda s, d, b=_build, c=_cat: b(grid(s, d, c), regions(s, d)), f"{_cte} SELECT lon_i, lat_i, pos, date, CAST(class AS DOUBLE) AS class FROM cl")
    for _label, _count, _hit in (("total", "total", "class >= 1"), (_short, "wave", "class = 1"), ("severe", "severe", "class = 2")):
        _add(
            f"{_name}_annual_{_label}",
            lambda s, d, b=_build, c=_cat, n=_count: extreme.annual_events(b(grid(s, d, c), regions(s, d)), 1991, n),
            f"{_cte} SELECT lon_i, lat_i, yr AS year, CASE WHEN count(class) > 0 THEN count(*) FILTER (WHERE {_hit}) END AS n FROM cl GROUP BY lon_i, lat_i, yr",
        )



def _split(spark: SparkSession, d: str, cat: str) -> tuple[GridFrame, GridFrame]:
    """The fixture from 2011 on, and its years before."""
    import datetime as dt

    g, cut = grid(spark, d, cat), (dt.date(2011, 1, 1) - START).days
    late = GridFrame(g.df.where(F.col("pos") >= cut).withColumn("pos", F.col("pos") - cut), Meta(cat, dt.date(2011, 1, 1), END, SPEC))
    return late, GridFrame(g.df.where(F.col("pos") < cut), Meta(cat, START, dt.date(2010, 12, 31), SPEC))


def _external(spark: SparkSession, d: str) -> DataFrame:
    late, early = _split(spark, d, "tmax")
    return extreme.heatwave(late, regions(spark, d), 1991, 2010, early)


_add(
    "heatwave_external_normals",
    _external,
    _HEAT.replace("dayofyear(date) AS INT) AS doy, avg(tmax) AS v FROM fx GROUP BY", "dayofyear(date) AS INT) AS doy, avg(tmax) AS v FROM fx WHERE yr <= 2010 GROUP BY")
    + " SELECT lon_i, lat_i, pos - 7305 AS pos, date, CAST(class AS DOUBLE) AS class FROM cl WHERE yr >= 2011",
)

# drought
# the normal quantile by Newton steps from 0 (they rise or fall to the root) on the power series of the distribution function, so nothing of it is shared with the code under test
_SERIES = "list_sum(list_transform(range(60), lambda n: x * pow(x * x, n) * exp(n * ln(2.0) + lgamma(n + 1.0) - lgamma(2.0 * n + 2.0))))"


def _quantile(p: str) -> str:
    step = f"x - (0.5 + exp(-x * x / 2) / sqrt(2 * pi()) * {_SERIES} - {p}) * sqrt(2 * pi()) * exp(x * x / 2)"
    return f"CASE WHEN {p} IS NOT NULL THEN list_reduce([0.0{", 0.0" * 16}], lambda x, i: {step}) END"


_PET = f"""{MONTHLY.format(agg="avg", col="tmax").replace("mo AS", "mx AS")}, {MONTHLY.format(agg="avg", col="tmin").replace("mo AS", "mn AS")},
pm AS (SELECT mx.lon_i, mx.lat_i, mx.m, mx.value AS hi, mn.value AS lo, radians(7.5 + 10.0 * mx.lat_i) AS phi,
       CAST([15,46,74,105,135,166,196,227,258,288,319,349][mx.m % 12 + 1] AS DOUBLE) AS j, CAST([31,28,31,30,31,30,31,31,30,31,30,31][mx.m % 12 + 1] AS DOUBLE) AS nd
       FROM mx JOIN mn ON mn.lon_i = mx.lon_i AND mn.lat_i = mx.lat_i AND mn.m = mx.m),
p1 AS (SELECT *, 0.409 * sin(2 * pi() * j / 365.0 - 1.39) AS de, 1.0 + 0.033 * cos(2 * pi() * j / 365.0) AS dr FROM pm),
p2 AS (SELECT *, acos(least(greatest(-tan(phi) * tan(de), -1.0), 1.0)) AS om FROM p1),
p3 AS (SELECT *, greatest(0.0, 24.0 * 60.0 / pi() * 0.0820 * dr * (om * sin(phi) * sin(de) + cos(phi) * cos(de) * sin(om))) AS ra FROM p2),
pe AS (SELECT lon_i, lat_i, m, CASE WHEN hi IS NOT NULL AND lo IS NOT NULL THEN 0.0023 * ra * ((hi + lo) / 2 + 17.8) * sqrt(greatest(0.0, hi - lo)) * 0.408 * nd END AS value FROM p3)"""
_BALANCE = f"{_RAIN_M}, {_PET}, ba AS (SELECT mo.lon_i, mo.lat_i, mo.m, mo.value - pe.value AS value FROM mo JOIN pe ON pe.lon_i = mo.lon_i AND pe.lat_i = mo.lat_i AND pe.m = mo.m)"
_ROLL = "ro AS (SELECT lon_i, lat_i, m, CASE WHEN m >= 2 THEN sum(value) OVER (PARTITION BY lon_i, lat_i ORDER BY m ROWS 2 PRECEDING) END AS value FROM {src})"
_add("hargreaves_pet", lambda s, d: drought.pet(grid(s, d, "tmax"), grid(s, d, "tmin")), f"WITH {FX}, {_PET} SELECT lon_i, lat_i, m, round(value, 4) + 0.0 AS value FROM pe", 4, ("value",))
_add("water_balance", lambda s, d: drought.water_balance(grid(s, d, "rain"), drought.pet(grid(s, d, "tmax"), grid(s, d, "tmin"))), f"WITH {FX}, {_BALANCE} SELECT lon_i, lat_i, m, round(value, 4) + 0.0 AS value FROM ba", 4, ("value",))
_add("rolling_months", lambda s, d: drought.rolling_sum(monthly.monthly(grid(s, d, "rain")), 3), f"WITH {FX}, {_RAIN_M}, {_ROLL.format(src='mo')} SELECT lon_i, lat_i, m, round(value, 6) + 0.0 AS value FROM ro", 6, ("value",))
_SPEI_TAIL = f"""rn AS (SELECT lon_i, lat_i, m % 12 AS month, value, CAST(row_number() OVER (PARTITION BY lon_i, lat_i, m % 12 ORDER BY value) - 1 AS DOUBLE) AS i FROM ro WHERE value IS NOT NULL),
pw AS (SELECT lon_i, lat_i, month, CAST(count(*) AS DOUBLE) AS n, avg(value) AS w0, sum(i * value) AS s1, sum(i * (i - 1) * value) AS s2 FROM rn GROUP BY lon_i, lat_i, month),
l AS (SELECT lon_i, lat_i, month, w0, s1 / (n * (n - 1)) AS w1, s2 / (n * (n - 1) * (n - 2)) AS w2 FROM pw WHERE n >= 10),
k0 AS (SELECT *, 2 * w1 - w0 AS l2, -(6 * w2 - 6 * w1 + w0) / (2 * w1 - w0) AS k FROM l WHERE abs(2 * w1 - w0) >= 1e-10),
k1 AS (SELECT *, CASE WHEN abs(k) < 1e-6 THEN l2 ELSE l2 * sin(k * pi()) / (k * pi()) END AS al FROM k0 WHERE abs(k) < 1),
k2 AS (SELECT *, CASE WHEN abs(k) < 1e-6 THEN w0 ELSE w0 - al * (1 / k - pi() / sin(k * pi())) END AS xi FROM k1 WHERE al > 0),
j AS (SELECT ro.lon_i, ro.lat_i, ro.m, (ro.value - xi) / al AS z, k FROM ro LEFT JOIN k2 ON k2.lon_i = ro.lon_i AND k2.lat_i = ro.lat_i AND k2.month = ro.m % 12),
h AS (SELECT lon_i, lat_i, m, CASE WHEN z IS NOT NULL THEN least(greatest(CASE WHEN abs(k) >= 1e-6 AND 1 - k * z <= 0 THEN CASE WHEN k > 0 THEN 0.999 ELSE 0.001 END
  ELSE 1 / (1 + exp(-CASE WHEN abs(k) < 1e-6 THEN z ELSE -ln(1 - k * z) / k END)) END, 0.001), 0.999) END AS h FROM j)
SELECT lon_i, lat_i, m, round({_quantile("h")}, 4) + 0.0 AS spei FROM h"""
_add(
    "spi",
    lambda s, d: drought.spi(grid(s, d, "rain")),
    f"""WITH {FX}, {_RAIN_M}, {_ROLL.format(src="mo")},
f0 AS (SELECT lon_i, lat_i, m % 12 AS month, count(value) AS n, count(*) FILTER (WHERE value > 0) AS wet, avg(value) FILTER (WHERE value > 0) AS mean, avg(ln(value)) FILTER (WHERE value > 0) AS ml FROM ro GROUP BY lon_i, lat_i, m % 12),
f1 AS (SELECT *, ln(mean) - ml AS a FROM f0 WHERE n >= 10 AND wet >= 10),
f2 AS (SELECT lon_i, lat_i, month, (1 + sqrt(1 + 4 * a / 3)) / (4 * a) AS sh, mean / ((1 + sqrt(1 + 4 * a / 3)) / (4 * a)) AS sc, 1.0 - wet / CAST(n AS DOUBLE) AS q FROM f1 WHERE a > 0),
hh AS (SELECT ro.lon_i, ro.lat_i, ro.m, value / sc AS z, sh, q, value FROM ro LEFT JOIN f2 ON f2.lon_i = ro.lon_i AND f2.lat_i = ro.lat_i AND f2.month = ro.m % 12),
h AS (SELECT lon_i, lat_i, m, CASE WHEN value IS NOT NULL AND sh IS NOT NULL THEN least(greatest(CASE WHEN value > 0 THEN
  q + (1 - q) * least(1.0, list_sum(list_transform(range(300), lambda n: exp(-z + (sh + n) * ln(z) - lgamma(sh + n + 1))))) ELSE q END, 0.001), 0.999) END AS h FROM hh)
SELECT lon_i, lat_i, m, round({_quantile("h")}, 4) + 0.0 AS spi FROM h""",
    4,
)
_add(
    "spei",
    lambda s, d: drought.spei(grid(s, d, "rain"), grid(s, d, "tmax"), grid(s, d, "tmin")),
    f"""WITH {FX}, {_BALANCE}, {_ROLL.format(src="ba")},
{_SPEI_TAIL}""",
    4,
)
_add(
    "drought_class",
    lambda s, d: drought.spi(grid(s, d, "rain")).withColumn("spi", F.round("spi", 4)).withColumn("class", drought.drought_class(F.col("spi"))).groupBy("class").agg(F.count(F.lit(1)).alias("n")),
    "SELECT CASE WHEN spi <= -2 THEN 'extreme' WHEN spi <= -1.5 THEN 'severe' WHEN spi < -1 THEN 'moderate' WHEN spi <= 1 THEN 'normal' WHEN spi >= 2 THEN 'extremely wet' END AS class, count(*) AS n FROM ("
    + SQL["spi"]
    + ") GROUP BY 1",
)

# rain on a grid of a quarter of the temperature's step that starts elsewhere
_TWO = f"""WITH {FX}, {_PET},
r2 AS (SELECT x.i AS lon_i, y.j AS lat_i, fx.m, sum(CASE WHEN fx.rain IS NULL THEN NULL ELSE fx.rain + (fx.pos * 13 + x.i * 7 + y.j * 3) % 5 END) AS value
       FROM fx JOIN (SELECT CAST(range AS INT) AS i FROM range(8)) x ON x.i % 4 = fx.lon_i JOIN (SELECT CAST(range AS INT) AS j FROM range(5)) y ON y.j % 3 = fx.lat_i GROUP BY x.i, y.j, fx.m),
b2 AS (SELECT r2.lon_i, r2.lat_i, r2.m, r2.value - pe.value AS value FROM r2
       LEFT JOIN pe ON r2.lon_i >= 2 AND r2.lat_i >= 1 AND pe.lon_i = CAST(ceil((r2.lon_i - 2) / 4.0 - 0.5) AS INT) AND pe.lat_i = CAST(ceil((r2.lat_i - 1) / 4.0 - 0.5) AS INT) AND pe.m = r2.m)"""


def _two_grids(spark: SparkSession, d: str) -> tuple[GridFrame, GridFrame, GridFrame]:
    return fine_rain(spark, d), grid(spark, d, "tmax"), grid(spark, d, "tmin")


def _balance_two(spark: SparkSession, d: str) -> DataFrame:
    rain, tmax, tmin = _two_grids(spark, d)
    return drought.water_balance(rain, drought.pet(tmax, tmin), tmax.meta.spec)


_add("water_balance_two_grids", _balance_two, f"{_TWO} SELECT lon_i, lat_i, m, round(value, 4) + 0.0 AS value FROM b2", 4, ("value",))
_add("spei_two_grids", lambda s, d: drought.spei(*_two_grids(s, d)), f"{_TWO}, {_ROLL.format(src='b2')}, {_SPEI_TAIL}", 4, ("spei",))

# rasters
SHAPES = [[[(66.0, 6.0), (91.0, 6.0), (91.0, 24.0), (80.0, 31.0), (66.0, 19.0)]]]
#: Two shapes that share the edge at 77.5, and one that overlaps both.
UNION = [[[(66.0, 6.0), (77.5, 6.0), (77.5, 20.0), (77.5, 30.0), (66.0, 30.0)]], [[(77.5, 6.0), (90.0, 6.0), (90.0, 20.0), (77.5, 20.0)]], [[(70.0, 6.0), (90.0, 6.0), (90.0, 12.0), (70.0, 12.0)]]]


def _clip(spark: SparkSession, d: str, shapes: list) -> DataFrame:
    g = grid(spark, d, "rain")
    cells = g.df.select("lon_i", "lat_i", "lon", "lat").distinct()
    return raster.clip(g.df, cells, shapes).select("lon_i", "lat_i", "pos", "is_land", "value")


_EDGES = "[" + ", ".join(f"{{'x1': {a[0]}, 'y1': {a[1]}, 'x2': {b[0]}, 'y2': {b[1]}}}" for r in SHAPES[0] for a, b in zip(r, [*r[1:], r[0]])) + "]"
_CLIPPED = "SELECT fx.lon_i, fx.lat_i, pos, is_land AND inside AS is_land, CASE WHEN inside THEN rain END AS value FROM fx JOIN i ON i.lon_i = fx.lon_i AND i.lat_i = fx.lat_i"
_add(
    "clip",
    lambda s, d: _clip(s, d, SHAPES),
    f"""WITH {FX}, c AS (SELECT DISTINCT lon_i, lat_i, lon, lat FROM fx WHERE lon_i BETWEEN 0 AND 2 AND lat_i BETWEEN 0 AND 2),
i AS (SELECT lon_i, lat_i, len(list_filter({_EDGES}, lambda e: (e.y1 > lat) <> (e.y2 > lat) AND lon < e.x1 + (lat - e.y1) * (e.x2 - e.x1) / CASE WHEN e.y1 = e.y2 THEN 1 ELSE e.y2 - e.y1 END)) % 2 = 1 AS inside FROM c)
{_CLIPPED}""",
)
_add(
    "clip_union",
    lambda s, d: _clip(s, d, UNION),
    f"WITH {FX}, i AS (SELECT DISTINCT lon_i, lat_i, lon < 77.5 OR lat < 20 AS inside FROM fx WHERE lon_i BETWEEN 0 AND 2) {_CLIPPED}",
)
_add(
    "remap",
    lambda s, d: raster.remap(grid(s, d, "tmax").df.select("lon_i", "lat_i", "lon", "lat", "pos", "value"), [67.5, 77.5, 87.5, 97.5], [7.5, 17.5, 27.5], 4.0),
    f"""WITH {FX}, x AS (SELECT CAST(range AS INT) AS i, 67.5 + 4.0 * range AS lon, CAST(least(greatest(ceil(range * 4.0 / 10 - 0.5), 0), 3) AS INT) AS o FROM range(9)),
y AS (SELECT CAST(range AS INT) AS i, 7.5 + 4.0 * range AS lat, CAST(least(greatest(ceil(range * 4.0 / 10 - 0.5), 0), 2) AS INT) AS o FROM range(6))
SELECT x.i AS lon_i, y.i AS lat_i, x.lon, y.lat, pos, tmax AS value FROM fx JOIN x ON x.o = fx.lon_i JOIN y ON y.o = fx.lat_i""",
)
_add(
    "fill_na",
    lambda s, d: raster.fill_na(grid(s, d, "tmax").df.select("lon_i", "lat_i", "pos", "value")),
    f"""WITH {FX}, sm AS (SELECT lon_i, lat_i FROM fx GROUP BY lon_i, lat_i HAVING count(tmax) > 0 AND count(tmax) < count(*)),
gap AS (SELECT fx.pos, fx.lon_i, fx.lat_i FROM fx JOIN sm ON sm.lon_i = fx.lon_i AND sm.lat_i = fx.lat_i WHERE tmax IS NULL),
n AS (SELECT gap.pos, gap.lon_i, gap.lat_i, greatest(abs(fx.lon_i - gap.lon_i), abs(fx.lat_i - gap.lat_i)) AS r, tmax FROM gap JOIN fx ON fx.pos = gap.pos WHERE tmax IS NOT NULL),
k AS (SELECT pos, lon_i, lat_i, r, avg(tmax) AS v FROM n GROUP BY pos, lon_i, lat_i, r), f AS (SELECT pos, lon_i, lat_i, arg_min(v, r) AS v FROM k GROUP BY pos, lon_i, lat_i)
SELECT lon_i, lat_i, pos, round(max(v), 6) + 0.0 AS value FROM (SELECT lon_i, lat_i, pos, tmax AS v FROM fx UNION ALL SELECT lon_i, lat_i, pos, v FROM f) GROUP BY lon_i, lat_i, pos""",
    6,
    ("value",),
)


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "dim_cell")
    return cells.join(F.broadcast(raster.nearest_cell(cells, 20.0, 77.0)), ["lon_i", "lat_i"]).select("lon_i", "lat_i", "lon", "lat")


_add("nearest_point", _nearest, "SELECT lon_i, lat_i, lon, lat FROM dim_cell WHERE lat = 19.5 AND lon = 76.5")
_add(
    "haversine",
    lambda s, d: _rounded(table(s, d, "dim_cell").select("lon_i", "lat_i", raster.haversine_km(F.col("lat"), F.col("lon"), F.lit(19.0), F.lit(73.0)).alias("km")), 4, "km"),
    "SELECT lon_i, lat_i, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(19.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(19.0)) * pow(sin(radians(73.0 - lon) / 2), 2)))), 4) + 0.0 AS km FROM dim_cell",
)


def _surface(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Elevation pixels and coast vertices."""
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    dem = p.select((67.0 + (F.col("p_partkey") * 37 % 3100) / 100.0).alias("lon"), (7.0 + (F.col("p_partkey") * 53 % 3100) / 100.0).alias("lat"), (F.col("p_size") * 45.0 - 300.0).alias("elev"))
    coast = s.select((67.0 + (F.col("s_suppkey") * 41 % 3100) / 100.0).alias("lon"), (7.0 + (F.col("s_suppkey") * 29 % 3100) / 100.0).alias("lat"))
    return dem, coast


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return raster.classify_regions(table(spark, d, "dim_cell").select("lon_i", "lat_i", "lon", "lat"), *_surface(spark, d))


_add(
    "region_class",
    _regions,
    """WITH dem AS (SELECT 67.0 + (p_partkey * 37 % 3100) / 100.0 AS lon, 7.0 + (p_partkey * 53 % 3100) / 100.0 AS lat, p_size * 45.0 - 300.0 AS elev FROM part),
co AS (SELECT DISTINCT 67.0 + (s_suppkey * 41 % 3100) / 100.0 AS lon, 7.0 + (s_suppkey * 29 % 3100) / 100.0 AS lat FROM supplier),
e AS (SELECT CAST(floor(lon - 67.0) AS INT) AS lon_i, CAST(floor(lat - 7.0) AS INT) AS lat_i, avg(elev) AS elev FROM dem WHERE elev > -100 GROUP BY 1, 2),
k AS (SELECT c.lon_i, c.lat_i, min(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(co.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(co.lat)) * pow(sin(radians(co.lon - c.lon) / 2), 2))))) AS km FROM dim_cell c, co GROUP BY c.lon_i, c.lat_i),
x AS (SELECT lon_i, lat_i, max(elev) AS elev, max(km) AS km FROM (SELECT lon_i, lat_i, elev, CAST(NULL AS DOUBLE) AS km FROM e UNION ALL SELECT lon_i, lat_i, NULL, km FROM k) GROUP BY lon_i, lat_i)
SELECT c.lon_i, c.lat_i, CAST(CASE WHEN elev IS NULL THEN -1 WHEN elev >= 1000 THEN 1 WHEN km <= 50 THEN 2 ELSE 0 END AS INT) AS region FROM dim_cell c JOIN x ON x.lon_i = c.lon_i AND x.lat_i = c.lat_i""",
)


def _fine_cells(spark: SparkSession) -> DataFrame:
    return spark.range(121 * 121).select((F.col("id") % 121).cast("int").alias("lon_i"), F.floor(F.col("id") / 121).cast("int").alias("lat_i")).withColumns({"lon": 67.5 + 0.25 * F.col("lon_i"), "lat": 7.5 + 0.25 * F.col("lat_i")})


_add(
    "region_class_fine",
    lambda s, d: raster.classify_regions(_fine_cells(s), *_surface(s, d), res=0.25),
    """WITH cells AS (SELECT CAST(a.range AS INT) AS lon_i, CAST(b.range AS INT) AS lat_i, 67.5 + 0.25 * a.range AS lon, 7.5 + 0.25 * b.range AS lat FROM range(121) a, range(121) b),
dem AS (SELECT 67.0 + (p_partkey * 37 % 3100) / 100.0 AS lon, 7.0 + (p_partkey * 53 % 3100) / 100.0 AS lat, p_size * 45.0 - 300.0 AS elev FROM part),
co AS (SELECT DISTINCT 67.0 + (s_suppkey * 41 % 3100) / 100.0 AS lon, 7.0 + (s_suppkey * 29 % 3100) / 100.0 AS lat FROM supplier),
e AS (SELECT CAST(floor((lon - 67.5 + 0.125) / 0.25) AS INT) AS lon_i, CAST(floor((lat - 7.5 + 0.125) / 0.25) AS INT) AS lat_i, avg(elev) AS elev FROM dem WHERE elev > -100 GROUP BY 1, 2),
k AS (SELECT c.lon_i, c.lat_i, min(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(co.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(co.lat)) * pow(sin(radians(co.lon - c.lon) / 2), 2))))) AS km FROM cells c, co GROUP BY c.lon_i, c.lat_i)
SELECT c.lon_i, c.lat_i, CAST(CASE WHEN elev IS NULL THEN -1 WHEN elev >= 1000 THEN 1 WHEN km <= 50 THEN 2 ELSE 0 END AS INT) AS region
FROM cells c LEFT JOIN e ON e.lon_i = c.lon_i AND e.lat_i = c.lat_i LEFT JOIN k ON k.lon_i = c.lon_i AND k.lat_i = c.lat_i""",
)
_add("fixture", lambda s, d: rows(s, d), f"WITH {FX} SELECT lon_i, lat_i, lon, lat, pos, is_land, region, rain, tmax, tmin FROM fx")


SEA = 99.9


def _written(spark: SparkSession, d: str) -> str:
    """Thirty yearly raster files of the fixture's maximum temperature, away from the corner of the catalogued grid, SEA where nothing is; the folder."""
    folder = fresh_dir(spark, "grd")
    g = grid(spark, d, "tmax")
    shifted = g.df.withColumns({"lon_i": F.col("lon_i") + 1, "lat_i": F.col("lat_i") + 1})
    to_grd(GridFrame(shifted, Meta("tmax", START, END, ARCHIVE["tmax"])), folder, fill=SEA).collect()
    return folder


def _grd_scan(spark: SparkSession, d: str) -> DataFrame:
    """All days of the thirty files read back, on the fixture's cells."""
    folder = _written(spark, d)
    back = open_data(spark, "tmax", 1991, 2020, folder=folder).df.where("lon_i between 1 and 4 and lat_i between 1 and 3")
    return settle(_rounded(back.select((F.col("lon_i") - 1).alias("lon_i"), (F.col("lat_i") - 1).alias("lat_i"), "pos", "date", "value"), 4, "value"), [folder])


def _grd_mask(spark: SparkSession, d: str) -> DataFrame:
    """The land mask of all cells of the catalogued grid, from those files."""
    folder = _written(spark, d)
    cells = open_data(spark, "tmax", 1991, 2020, folder=folder).df.where("pos = 0").select("lon_i", "lat_i", "is_land")
    return settle(cells, [folder])


# single precision in the files
_add("grd_scan", _grd_scan, f"WITH {FX} SELECT lon_i, lat_i, pos, date, round(tmax, 4) + 0.0 AS value FROM fx")
_add(
    "land_mask_tmax",
    _grd_mask,
    f"WITH {FX}, f AS (SELECT lon_i + 1 AS lon_i, lat_i + 1 AS lat_i, arg_min(tmax IS NOT NULL, pos) AS land FROM fx GROUP BY lon_i, lat_i) "
    "SELECT c.lon_i, c.lat_i, coalesce(land, false) AS is_land FROM dim_cell c LEFT JOIN f ON f.lon_i = c.lon_i AND f.lat_i = c.lat_i",
)


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    from skygrid.streaming.ingest import daily_totals

    return _rounded(daily_totals(table(spark, d, "grid_obs"), window="30 days").select(F.to_date("window_start").alias("window_start"), "var", "readings", "at_least_2_5", "total"), 4, "total")


_add(
    "ingest_totals",
    _streamed,
    """WITH v AS (SELECT object_id, lon_i, lat_i, pos, min(var) AS var, min(value) AS value, count(DISTINCT CAST(floor((epoch(loaded_at)) / 2592000) AS BIGINT)) AS k, min(loaded_at) AS t FROM grid_obs
WHERE value IS NOT NULL AND value <> -999 AND loaded_at IS NOT NULL GROUP BY object_id, lon_i, lat_i, pos)
SELECT DATE '1970-01-01' + CAST(floor(epoch(t) / 2592000) AS INT) * 30 AS window_start, var, count(*) AS readings, count(*) FILTER (WHERE value >= 2.5) AS at_least_2_5, round(sum(value), 4) + 0.0 AS total FROM v GROUP BY 1, 2""",
)


def _live(spark: SparkSession, d: str) -> DataFrame:
    """The table as a stream, to its end: each reading once, totals per variable."""
    from skygrid.streaming.ingest import daily_totals

    folder, name = fresh_dir(spark, "stream"), f"totals_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, d, "grid_obs").schema).parquet(f"{d}/grid_obs.parquet*")
    # one window of a century: which of two deliveries comes first does not matter
    totals = daily_totals(stream, delay="36500 days", window="36500 days")
    q = totals.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", folder).trigger(availableNow=True).start()
    q.awaitTermination()
    # at most one row per variable
    out = settle(_rounded(spark.table(name).select("var", "readings", "at_least_2_5", "total"), 4, "total"), [folder])
    spark.catalog.dropTempView(name)
    return out


_add(
    "ingest_stream",
    _live,
    """WITH v AS (SELECT object_id, lon_i, lat_i, pos, min(var) AS var, min(value) AS value FROM grid_obs WHERE value IS NOT NULL AND value <> -999 AND loaded_at IS NOT NULL GROUP BY object_id, lon_i, lat_i, pos)
SELECT var, count(*) AS readings, count(*) FILTER (WHERE value >= 2.5) AS at_least_2_5, round(sum(value), 4) + 0.0 AS total FROM v GROUP BY var""",
)
