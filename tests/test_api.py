import datetime as dt
import struct

import numpy as np
import pytest

from skygrid.api import Grid
from skygrid.functions import calendar
from skygrid.model import GridSpec, Meta
from skygrid.sources import regions

SPEC = GridSpec(10.0, 2, 70.0, 2, 1.0)


@pytest.fixture(scope="module")
def ten_years(spark):
    n = calendar.total_days(dt.date(2001, 1, 1), dt.date(2010, 12, 31))
    from pyspark.sql import functions as F

    cells = spark.range(4 * n).select((F.col("id") % 2).cast("int").alias("lon_i"), (F.floor(F.col("id") / 2) % 2).cast("int").alias("lat_i"), F.floor(F.col("id") / 4).cast("int").alias("pos"))
    df = cells.select("lon_i", "lat_i", (70.0 + F.col("lon_i")).alias("lon"), (10.0 + F.col("lat_i")).alias("lat"), "pos", F.lit(True).alias("is_land"), F.when(F.col("pos") != 7, (F.col("pos") * 37 + F.col("lon_i") * 11 + F.col("lat_i")) % 30 + 20.0).alias("value"))
    return Grid(df, Meta("tmax", dt.date(2001, 1, 1), dt.date(2010, 12, 31), SPEC))


def test_month_and_year_ends():
    a, b = dt.date(2000, 1, 1), dt.date(2001, 12, 31)
    assert calendar.year_ends(a, b) == [366, 731]
    m = calendar.month_ends(a, b)
    assert m[1] == 60 and m[11] == 366 and len(m) == 24


def test_methods(spark, ten_years, tmp_path):
    g = ten_years
    assert g.climatology().df.count() == 48 and g.anomaly(g.climatology()).df.count() == 480
    annual = g.compute("mxadt")
    assert {str(r["time"]) for r in annual.timed().collect()} == {f"{y}-12-31" for y in range(2001, 2011)}
    assert annual.spatial_mean().count() == 10
    assert str(g.anomaly().timed().agg({"time": "max"}).first()[0]) == "2010-12-31"
    where = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, -1)], "lon_i int, lat_i int, region int")
    daily = g.heatwave(where, norm_start=2001, norm_end=2010)
    classes = {r[0] for r in daily.df.select("class").distinct().collect()}
    assert classes <= {None, 0.0, 1.0, 2.0} and 2.0 in classes
    count = lambda c: {(r["lon_i"], r["lat_i"], r["year"]): r["n"] for r in g.heatwave(where, "annual", c, 2001, 2010).df.collect()}
    total, wave, severe = count("total"), count("hw"), count("severe")
    assert all(total[k] is None if k[:2] == (1, 1) else total[k] == wave[k] + severe[k] for k in total)
    for bad in (lambda: g.heatwave(where, count="cw"), lambda: annual.climatology(), lambda: g.anomaly(annual), lambda: g.heatwave(where), lambda: g.coldwave(where)):
        with pytest.raises(ValueError):
            bad()
    assert g.fill_na().df.where("value is null").count() == 4  # no cell has a value on that day
    assert g.remap(0.5).meta.spec.n_lon == 3 and g.clip([[(69.5, 9.5), (70.5, 9.5), (70.5, 11.5), (69.5, 11.5)]]).df.where("value is not null and lon_i = 1").count() == 0
    assert g.at(10.9, 70.2).select("lat_i").distinct().first()[0] == 1
    assert annual.to_netcdf(str(tmp_path / "a.nc")) == 10 and annual.to_geotiff(str(tmp_path / "a.tif")) == 10
    assert struct.unpack(">i", open(tmp_path / "a.nc", "rb").read()[4:8])[0] == 10


def test_region_file(spark, tmp_path):
    np.save(tmp_path / "r.npy", np.array([[-1, 0], [1, 2]], np.int8))
    got = {(r["lon_i"], r["lat_i"]): r["region"] for r in regions.from_array_file(spark, str(tmp_path / "r.npy")).collect()}
    assert got == {(0, 0): -1, (0, 1): 0, (1, 0): 1, (1, 1): 2}
    np.save(tmp_path / "b.npy", np.array([9]))
    with pytest.raises(ValueError):
        regions.from_array_file(spark, str(tmp_path / "b.npy"))
