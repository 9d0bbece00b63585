import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygrid.functions import calendar, special
from skygrid.model import ARCHIVE, GridFrame, GridSpec, Meta
from skygrid.operators import drought, extreme, indices, monthly, raster, trend


def one_cell(spark, cat, values, start="2001-01-01", land=True):
    a = dt.date.fromisoformat(start)
    rows = [(0, 0, 70.0, 20.0, p, land, None if v is None else float(v)) for p, v in enumerate(values)]
    df = spark.createDataFrame(rows, "lon_i int, lat_i int, lon double, lat double, pos int, is_land boolean, value double")
    return GridFrame(df, Meta(cat, a, a + dt.timedelta(len(values) - 1)))


def yearly(spark, sums, start=2001):
    """Rain whose annual sums are the given ones; None for a missing year."""
    values = []
    for k, s in enumerate(sums):
        n = 366 if calendar.is_leap(start + k) else 365
        values += [s] + ([0.0] * (n - 1) if s is not None else [None] * (n - 1))
    return one_cell(spark, "rain", values, f"{start}-01-01")


def value(df, name):
    return [r[name] for r in df.sort("year" if "year" in df.columns else "lon_i").collect()]


def test_short_series(spark):
    g = one_cell(spark, "rain", [1, 2, 3, 4, 5, 0])
    assert value(indices.rx5d(g), "rx5d") == [15.0]
    assert value(indices.rx5d(one_cell(spark, "rain", [1, 2, 3])), "rx5d") == [6.0]
    assert value(indices.rx5d(one_cell(spark, "rain", [1, None, 3, 4, 5, 6])), "rx5d") == [None]
    assert value(indices.cwd(one_cell(spark, "rain", [3, 3, 0, 3, 3, 3])), "cwd") == [3]
    assert value(indices.cwd(one_cell(spark, "rain", [0, 1])), "cwd") == [0]
    assert value(indices.cdd(one_cell(spark, "rain", [0, 0.5, 1.0, 0])), "cdd") == [2]
    assert value(indices.cdd(one_cell(spark, "rain", [0, None, 0, 0])), "cdd") == [2]
    assert value(indices.sdii(one_cell(spark, "rain", [0, 2.5, 7.5])), "sdii") == [5.0]
    assert value(indices.sdii(one_cell(spark, "rain", [0, 1])), "sdii") == [None]
    assert value(indices.dr(one_cell(spark, "rain", [3, None, 2.5])), "dr") == [2]
    assert value(indices.dr(one_cell(spark, "rain", [3], land=False)), "dr") == [None]
    assert value(indices.rxa(one_cell(spark, "rain", [3, None])), "rxa") == [None]
    assert value(indices.rtwd(one_cell(spark, "rain", [1, None])), "rtwd") == [0.0]


def test_runs_end_with_the_year_and_pci(spark):
    wet = one_cell(spark, "rain", [3.0] * 366 + [0.0], "2001-01-01")
    assert value(indices.cwd(wet), "cwd") == [365, 1]
    equal = []
    for m in range(12):
        n = calendar.total_days(dt.date(2001, m + 1, 1), dt.date(2001 + m // 11, (m + 1) % 12 + 1, 1)) - 1
        equal += [30.0] + [0.0] * (n - 1)
    assert value(indices.pci(one_cell(spark, "rain", equal)), "pci")[0] == pytest.approx(100 / 12)


def test_years_are_cut_by_position(spark):
    g = one_cell(spark, "rain", [3.0] * 365, "2018-06-01")
    full = indices.complete(indices.dr(g), g, {"dr": 0})
    assert [(r["year"], r["dr"]) for r in full.sort("year").collect()] == [(2018, 365), (2019, 0)]


def test_trends(spark):
    assert trend.sse(yearly(spark, [1, 2, 4])).first()["sse"] == pytest.approx(1.5)
    assert trend.sstr(yearly(spark, [1, 2, 4])).first()["sstr"] == pytest.approx(1.5 * 100 * 3 / (7 / 3))
    assert trend.spr(yearly(spark, [1, 3, 2, 4])).first()["spr"] == pytest.approx(0.8 * math.sqrt(2 / 0.36))
    assert trend.spr(yearly(spark, [1, 2, 3])).first()["spr"] == math.inf
    assert trend.sse(yearly(spark, [1, None, 4])).first()["sse"] == pytest.approx(1.5)
    assert trend.mmk_hr(yearly(spark, [5, 5, 5, 5])).first()["mmk_hr"] == 0.0
    assert trend.mmk_hr(yearly(spark, [1, 2])).count() == 0


def test_mann_kendall_by_loops(spark):
    x = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0, 5.0, 8.0]
    n = len(x)
    s = sum((x[j] > x[i]) - (x[j] < x[i]) for i in range(n) for j in range(i + 1, n))
    ties = sum(x.count(v) * (x.count(v) - 1) * (2 * x.count(v) + 5) for v in set(x))
    var = (n * (n - 1) * (2 * n + 5) - ties) / 18
    slopes = sorted((x[j] - x[i]) / (j - i) for i in range(n) for j in range(i + 1, n))
    slope = (slopes[len(slopes) // 2] + slopes[(len(slopes) - 1) // 2]) / 2
    flat = [v - (i + 1) * slope for i, v in enumerate(x)]
    rank = [sum(u < v for u in flat) + (flat.count(v) + 1) / 2 for v in flat]
    c = [r - sum(rank) / n for r in rank]
    lags = 0.0
    for k in range(1, n):
        rho = sum(c[i] * c[i + k] for i in range(n - k)) / sum(v * v for v in c)
        if abs(rho) > NormalDist().inv_cdf(0.975) / math.sqrt(n):
            lags += (n - k) * (n - k - 1) * (n - k - 2) * rho
    var *= 1 + 2 / (n * (n - 1) * (n - 2)) * lags
    assert trend.mmk_hr(yearly(spark, x)).first()["mmk_hr"] == pytest.approx((s - 1) / math.sqrt(var))


def test_special_functions(spark):
    p = [0.001, 0.02, 0.3, 0.5, 0.7, 0.98, 0.999]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(special.normal_ppf("p")).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(x) for x in p], abs=1e-12)
    x = [(0.5, 1.0), (3.0, 2.0), (20.0, 3.0), (150.0, 100.0), (0.0, 2.0)]
    got = [r[0] for r in spark.createDataFrame(x, "x double, k double").select(special.gamma_cdf(F.col("x"), F.col("k"), F.lit(1.0))).collect()]
    want = [1 - sum(math.exp(-v + i * math.log(v) - math.lgamma(i + 1)) for i in range(int(k))) if v else 0.0 for v, k in x]
    assert got == pytest.approx(want, abs=1e-9)


def test_calendar():
    assert calendar.parse_range(2018) == (dt.date(2018, 1, 1), dt.date(2018, 12, 31))
    assert calendar.parse_range("2018-03-05") == (dt.date(2018, 3, 5), dt.date(2018, 3, 5))
    for bad, error in ((("x",), ValueError), ((1.5,), TypeError), ((2019, 2018), ValueError)):
        with pytest.raises(error):
            calendar.parse_range(*bad)
    assert calendar.is_leap(2000) and not calendar.is_leap(1900) and calendar.total_days(dt.date(2000, 1, 1), dt.date(2000, 12, 31)) == 366


def test_guards(spark):
    g = one_cell(spark, "tmax", [1.0])
    for call in (lambda: indices.dr(g), lambda: indices.dtr(g), lambda: g.compute("nothing"), lambda: monthly.climatology(g), lambda: extreme.norm_period(g, None, None), lambda: extreme.norm_period(g, 2001, 2005), lambda: drought.spi(g), lambda: drought.spi(one_cell(spark, "rain", [1.0]))):
        with pytest.raises(ValueError):
            call()
    done = one_cell(spark, "rain", [1.0]).compute("dr")
    with pytest.raises(ValueError):
        done.compute("dr")


def test_self_anomaly_of_one_year_is_zero(spark):
    g = one_cell(spark, "tmax", [20 + i % 7 for i in range(365)])
    assert {round(r["value"], 9) for r in monthly.anomaly(g).collect()} == {0.0}
    assert monthly.climatology(g).count() == 12
    with pytest.raises(ValueError):
        monthly.anomaly(g, monthly.climatology(g), "rain")


def test_spatial_mean_and_mask(spark):
    rows = [(0, 0, 0.0, 0.0, 0, True, 1.0), (0, 1, 0.0, 60.0, 0, True, 3.0), (1, 0, 1.0, 0.0, 0, False, 99.0), (0, 0, 0.0, 0.0, 1, True, None)]
    df = spark.createDataFrame(rows, "lon_i int, lat_i int, lon double, lat double, pos int, is_land boolean, value double")
    got = {r["pos"]: r["value"] for r in monthly.spatial_mean(df, "pos").collect()}
    assert got[0] == pytest.approx(2.5 / 1.5) and got[1] is None
    zero = one_cell(spark, "rain", [0.0] * 365).df
    assert not monthly.land_mask(zero, "rain", 365).first()["is_land"] and monthly.land_mask(zero, "rain", 300).first()["is_land"]


def test_rasters(spark):
    got = spark.range(1).select(raster.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0]
    assert got == pytest.approx(6371 * math.pi / 180)
    assert raster.new_axis([66.5, 100.0], 1.0)[-1] == 100.5 and raster.new_axis([0.0, 1.0], 0.25) == [0, 0.25, 0.5, 0.75, 1.0]
    rows = [(i, j, p, None if (i, j, p) == (1, 1, 0) or i == 2 else float(i + j)) for i in range(3) for j in range(3) for p in range(2)]
    filled = raster.fill_na(spark.createDataFrame(rows, "lon_i int, lat_i int, pos int, value double"), skip=[(0, 0)])
    got = {(r["lon_i"], r["lat_i"], r["pos"]): r["value"] for r in filled.collect()}
    assert got[1, 1, 0] == pytest.approx((0 + 1 + 2 + 1 + 3) / 5) and got[2, 0, 0] is None and got[0, 0, 1] == 0.0 and len(got) == 18
    rows[0] = (0, 0, 0, None)  # a cell to be skipped that has a gap loses its other days too
    filled = raster.fill_na(spark.createDataFrame(rows, "lon_i int, lat_i int, pos int, value double"), skip=[(0, 0)])
    got = {(r["lon_i"], r["lat_i"], r["pos"]): r["value"] for r in filled.collect()}
    assert got[1, 1, 0] == pytest.approx((1 + 2 + 1 + 3) / 4) and got[0, 0, 0] is None and got[0, 0, 1] is None


def inside(points, shapes):
    x, y = np.array([p[0] for p in points], float), np.array([p[1] for p in points], float)
    return raster.inside_union(x, y, raster._edges(shapes), len(shapes)).tolist()


def rectangle(x0, y0, x1, y1):
    return [[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]


def test_union_of_shapes(spark):
    square = rectangle(0.0, 0.0, 2.0, 2.0)
    assert inside([(1, 1), (0, 1), (2, 2), (3, 1)], [square]) == [True, False, False, False]
    # overlap, shared edge, shared corner of four, touching corner of two, outer boundary, hole
    assert inside([(1.5, 1)], [square, rectangle(1.0, 0.0, 3.0, 2.0)]) == [True]
    assert inside([(2, 1), (2, 2), (2, 0)], [square, rectangle(2.0, 0.0, 4.0, 2.0)]) == [True, False, False]
    four = [rectangle(i, j, i + 1.0, j + 1.0) for i in (0.0, 1.0) for j in (0.0, 1.0)]
    assert inside([(1, 1), (1, 0), (1, 0.5)], four) == [True, False, True] and inside([(1, 1)], [four[0], four[3]]) == [False]
    hole = [*rectangle(0.0, 0.0, 4.0, 4.0), *rectangle(1.0, 1.0, 3.0, 3.0)]
    assert inside([(2, 2), (0.5, 2), (1, 2)], [hole]) == [False, True, False]
    assert inside([(2, 2), (1, 2)], [hole, rectangle(1.0, 1.0, 3.0, 3.0)]) == [True, True]
    cells = spark.createDataFrame([(0, 0, 1.0, 1.0), (1, 0, None, 1.0)], "lon_i int, lat_i int, lon double, lat double")
    assert sorted(tuple(r) for r in raster.within(cells, [square]).collect()) == [(0, 0, True), (1, 0, False)]


def test_outline_of_many_vertices(spark):
    n = 100_000
    ring = [(5.01 + 4 * math.cos(2 * math.pi * k / n), 5.02 + 4 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    df = spark.createDataFrame([(i, j, float(i), float(j), 0, True, 1.0) for i in range(11) for j in range(11)], "lon_i int, lat_i int, lon double, lat double, pos int, is_land boolean, value double")
    got = {(r["lon_i"], r["lat_i"]): r["value"] for r in raster.clip(df, df.select("lon_i", "lat_i", "lon", "lat"), [[ring]]).collect()}
    assert set(got) == {(i, j) for i in range(1, 10) for j in range(1, 10)}
    assert all((v == 1.0) == (math.hypot(i - 5.01, j - 5.02) < 4) for (i, j), v in got.items())


def test_reach_of_the_coast(spark):
    assert raster.coast_reach(1.0, 38.5) == (1, 0) and raster.coast_reach(0.25, 38.5)[1] == 2
    cells = spark.createDataFrame([(i, j, 70 + 0.25 * i, 30 + 0.25 * j) for i in range(9) for j in range(9)], "lon_i int, lat_i int, lon double, lat double")
    dem = cells.select("lon", "lat", F.lit(10.0).alias("elev"))
    coast = spark.createDataFrame([(71.0, 31.42)], "lon double, lat double")
    got = {(r["lon_i"], r["lat_i"]): r["region"] for r in raster.classify_regions(cells, dem, coast, res=0.25).collect()}
    km = lambda a, b, c, d: 2 * 6371 * math.asin(math.sqrt(math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2))
    assert all((region == 2) == (km(30 + 0.25 * j, 70 + 0.25 * i, 31.42, 71.0) <= 50) for (i, j), region in got.items()) and got[4, 4] == 2


def test_balance_needs_matching_grids(spark):
    pet = spark.createDataFrame([(0, 0, 0, 25.0), (1, 1, 0, 50.0)], "lon_i int, lat_i int, m int, value double")
    rain = GridFrame(one_cell(spark, "rain", [1.0]).df, Meta("rain", dt.date(2001, 1, 1), dt.date(2001, 1, 1), ARCHIVE["rain"]))
    got = {(r["lon_i"], r["lat_i"]): r["value"] for r in drought.on_rain_grid(pet, ARCHIVE["tmax"], ARCHIVE["rain"]).collect()}
    # 67.5/7.5 is rain cell (4, 4), 68.5/8.5 is (8, 8)
    assert got[4, 4] == 25.0 and got[6, 6] == 25.0 and got[8, 8] == 50.0 and min(got) == (4, 4)
    with pytest.raises(ValueError):
        drought.on_rain_grid(pet, None, rain.meta.spec)
    bare = one_cell(spark, "tmax", [1.0] * 3653)
    with pytest.raises(ValueError):
        drought.spei(GridFrame(bare.df, Meta("rain", bare.meta.start, bare.meta.end, ARCHIVE["rain"])), bare, GridFrame(bare.df, Meta("tmin", bare.meta.start, bare.meta.end)))


def test_normals_of_other_years(spark):
    late, early = one_cell(spark, "tmax", [36.0] * 365, "2021-01-01"), one_cell(spark, "tmax", [31.0] * 4018, "2000-01-01")
    where = spark.createDataFrame([(0, 0, 1)], "lon_i int, lat_i int, region int")
    with pytest.raises(ValueError, match="outside the data"):
        extreme.heatwave(late, where, 2000, 2010)
    with pytest.raises(ValueError, match="another variable"):
        extreme.heatwave(late, where, 2000, 2010, GridFrame(early.df, Meta("tmin", early.meta.start, early.meta.end)))
    got = extreme.heatwave(late, where, 2000, 2010, early)
    assert {r[0] for r in got.select("class").distinct().collect()} == {1.0} and got.count() == 365


def test_baseline_must_fit(spark):
    g = one_cell(spark, "tmax", [20 + i % 7 for i in range(365)])
    base = monthly.climatology(g)
    for bad in (lambda: monthly.anomaly(g, base.where("month < 12")), lambda: monthly.anomaly(one_cell(spark, "tmax", [1.0] * 40)), lambda: monthly.anomaly(GridFrame(g.df, Meta("tmax", g.meta.start, g.meta.end, ARCHIVE["tmax"])), base, "tmax", ARCHIVE["rain"])):
        with pytest.raises(ValueError):
            bad()


def test_lags_of_the_trend(spark):
    x = yearly(spark, [float(k % 4) + 0.1 * k for k in range(24)])
    assert trend.mmk_hr(x, lag=23).first()["mmk_hr"] == trend.mmk_hr(x).first()["mmk_hr"] != trend.mmk_hr(x, lag=1).first()["mmk_hr"]


def test_gaps_are_filled_in_order_and_however_wide(spark):
    import random

    r = random.Random(2)
    ni, nj = 14, 9
    day = {0: {(i, j): 1.0 * i + 10 * j for i in range(ni) for j in range(nj)}, 1: {(0, 0): 5.0, (1, 0): 7.0}, 2: {(13, 8): 3.0}, 3: {}}
    day[4] = {c: r.random() for c in day[0] if r.random() < 0.05 and c[0] < 5}
    rows = [(i, j, p, v.get((i, j))) for p, v in day.items() for i in range(ni) for j in range(nj)]
    got = {(x["lon_i"], x["lat_i"], x["pos"]): x["value"] for x in raster.fill_na(spark.createDataFrame(rows, "lon_i int, lat_i int, pos int, value double")).collect()}
    assert len(got) == len(rows)
    for p, have in day.items():
        for i in range(ni):
            for j in range(nj):
                if (i, j) not in have and have:
                    near = [(max(abs(a - i), abs(b - j)), x) for (a, b), x in have.items()]
                    least = [x for d, x in near if d == min(near)[0]]
                    have[i, j] = sum(least) / len(least)
                assert got[i, j, p] == (pytest.approx(have[i, j]) if have else None)


def test_nearest_prefers_the_lower_index():
    s = GridSpec(0.0, 3, 10.0, 3, 1.0)
    assert s.nearest(0.5, 11.5) == (0, 1)
    with pytest.raises(ValueError):
        s.nearest(5.0, 11.0)
    assert ARCHIVE["rain"].cells == 17415


def test_spi_is_about_standard(spark):
    import random

    r = random.Random(1)
    n = calendar.total_days(dt.date(1991, 1, 1), dt.date(2010, 12, 31))
    g = one_cell(spark, "rain", [r.expovariate(0.2) if r.random() < 0.4 else 0.0 for _ in range(n)], "1991-01-01")
    v = [x["spi"] for x in drought.spi(g).sort("m").collect()]
    assert len(v) == 240 and v[0] is None and v[1] is None
    v = v[2:]
    mean = sum(v) / len(v)
    assert abs(mean) < 0.1 and abs(math.sqrt(sum((x - mean) ** 2 for x in v) / len(v)) - 1) < 0.1
