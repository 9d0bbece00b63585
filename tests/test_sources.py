import datetime as dt
import struct

import numpy as np
import pytest

from skygrid import model
from skygrid.model import GridFrame, GridSpec, Meta
from skygrid.sources import download, grd, naming, shapefile, sinks
from skygrid.streaming.ingest import daily_totals

TINY = GridSpec(10.0, 3, 70.0, 4, 1.0)


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setitem(model.ARCHIVE, "tmax", TINY)
    monkeypatch.setitem(model.REALTIME, "tmax", TINY)


def test_decode_and_size():
    raw = struct.pack("<24f", *range(24))
    a = grd.decode(raw, TINY, 2)
    assert a[1, 2, 3] == 23 and a[0, 1, 0] == 4
    with pytest.raises(ValueError):
        grd.decode(raw[:-4], TINY, 2)
    assert grd.decode(struct.pack(">12f", *range(12)), TINY, 1, "big")[0, 2, 3] == 11


def frame(spark, start, days, missing=None):
    rows = [(i, j, 70.0 + i, 10.0 + j, p, True, None if (i, j, p) == missing else float(p * 100 + j * 10 + i)) for p in range(days) for j in range(3) for i in range(4)]
    df = spark.createDataFrame(rows, "lon_i int, lat_i int, lon double, lat double, pos int, is_land boolean, value double")
    return GridFrame(df, Meta("tmax", start, start + dt.timedelta(days - 1), TINY))


def test_catalogued_files_round_trip(spark, tmp_path):
    """The reader runs in its own processes, so this takes the true temperature grid."""
    spec = model.ARCHIVE["tmax"]
    values = np.random.default_rng(1).normal(20, 5, (365, 31, 31)).astype("<f4")
    values[:, 0, 0] = -999
    (tmp_path / "2001.GRD").write_bytes(values.tobytes())
    g = grd.open_data(spark, "tmax", "2001-03-01", "2001-03-02", "yearwise", str(tmp_path))
    assert g.meta.days == 2 and g.shape == (2, 31, 31)
    rows = g.df.collect()
    assert len(rows) == 2 * 961
    for r in rows[::97]:
        v = values[59 + r["pos"], r["lat_i"], r["lon_i"]]
        assert r["lat"] == spec.lat(r["lat_i"]) and (r["value"] is None if v == -999 else r["value"] == pytest.approx(float(v)))
    assert {r["is_land"] for r in rows if r["lon_i"] == r["lat_i"] == 0} == {False}
    assert g.df.where("date = date'2001-03-02'").count() == 961
    (tmp_path / "2001.GRD").write_bytes(values.tobytes()[:-4])
    with pytest.raises(Exception, match="are expected"):
        grd.open_data(spark, "tmax", 2001, None, "yearwise", str(tmp_path)).df.count()


def test_temperature_sea_is_what_the_corner_holds(spark, tmp_path):
    values = np.full((365, 31, 31), 99.9, "<f4")
    values[:, 5:15, 5:15] = np.random.default_rng(2).normal(20, 5, (365, 10, 10))
    values[7, 6, 6] = 99.9
    (tmp_path / "2001.GRD").write_bytes(values.tobytes())
    g = grd.open_data(spark, "tmax", 2001, None, "yearwise", str(tmp_path))
    land = g.df.where("is_land")
    assert land.select("lon_i", "lat_i").distinct().count() == 100 and land.where("value is null").count() == 1 and g.df.where("value > 99").count() == 0
    assert grd.open_data(spark, "tmax", 2001, None, "yearwise", str(tmp_path), sentinel=-999).df.where("value > 99").count() > 0
    assert grd.open_data(spark, "tmax", 2001, None, "yearwise", str(tmp_path)).df.where("date = date'2001-01-08' and value is not null").count() == 99


def test_dense_arrays(spark, tmp_path):
    import json

    g = frame(spark, dt.date(2001, 12, 31), 2, missing=(1, 2, 1))
    made = sorted(tuple(r) for r in sinks.to_arrays(g.with_date(), "date", g.meta, str(tmp_path / "x")).collect())
    assert [(m[1], m[2]) for m in made] == [(dt.date(2001, 12, 31), 1), (dt.date(2002, 1, 1), 1)]
    with np.load(made[1][0]) as a:
        assert a["tmax"].shape == (1, 3, 4) and np.isnan(a["tmax"][0, 2, 1]) and a["tmax"][0, 2, 3] == 123 and a["lat"].tolist() == [10, 11, 12] and a["time"][0] == 11688
        attrs = json.loads(str(a["attrs"]))
    assert attrs["tmax"] == {"units": "C", "long_name": "maximum temperature"} and attrs[""]["Conventions"] == "CF-1.7"


def test_names(tmp_path):
    assert naming.yearly_path(2018, "rain", None, "f") == "f/Rainfall_ind2018_rfp25.grd"
    assert naming.yearly_path(2018, "tmax", "yearwise", "f") == "f/2018.GRD"
    assert naming.daily_path(dt.date(2020, 3, 4), "rain", "f") == "f/rain_ind0.25_20_03_04.grd"
    assert naming.daily_path(dt.date(2020, 3, 4), "tmin", "f") == "f/min04032020.grd"
    (tmp_path / "rain").mkdir()
    assert naming.yearly_path(2018, "rain", "yearwise", str(tmp_path)) == str(tmp_path / "rain" / "2018.grd")
    with pytest.raises(ValueError):
        naming.yearly_path(2018, "snow", None, "f")


def test_download(spark, tmp_path):
    calls = []

    def send(cat, key):
        calls.append((cat, key))
        return np.full(61 * 61, 21.5, "<f4").tobytes()

    g = download.get_real_data(spark, "tmax", "2020-01-01", "2020-01-02", send, str(tmp_path))
    assert g.df.count() == 2 * 61 * 61 and calls == [("tmax", "01012020"), ("tmax", "02012020")]
    download.get_real_data(spark, "tmax", "2020-01-01", None, send, str(tmp_path))
    assert len(calls) == 2
    with pytest.raises(ValueError):
        download.get_real_data(spark, "tmax", "2020-01-05", None, lambda c, k: b"", str(tmp_path))


def test_netcdf_and_geotiff(spark, tmp_path):
    g = frame(spark, dt.date(2001, 1, 1), 2, missing=(1, 2, 1))
    path = str(tmp_path / "x.nc")
    assert sinks.to_netcdf(g.with_date(), "date", TINY, path, "tmax", "C", "maximum temperature") == 2
    raw = open(path, "rb").read()
    assert raw[:4] == b"CDF\x01" and struct.unpack(">i", raw[4:8])[0] == 2
    record = 8 + 12 * 4
    last = raw[-record:]
    assert struct.unpack(">d", last[:8])[0] == 11324
    v = np.frombuffer(last[8:], ">f4").reshape(3, 4)
    assert v[2, 1] == -999 and v[2, 3] == 123
    path = str(tmp_path / "x.tif")
    assert sinks.to_geotiff(g.with_date(), "date", TINY, path) == 2
    raw = open(path, "rb").read()
    at = struct.unpack("<I", raw[4:8])[0]
    n = struct.unpack("<H", raw[at : at + 2])[0]
    tags = {struct.unpack("<H", raw[at + 2 + 12 * i : at + 4 + 12 * i])[0]: raw[at + 2 + 12 * i : at + 14 + 12 * i] for i in range(n)}
    assert list(tags) == sorted(tags) and struct.unpack("<H", tags[277][8:10])[0] == 2
    strips = struct.unpack("<2I", raw[struct.unpack("<I", tags[273][8:])[0] :][:8])
    north = np.frombuffer(raw[strips[1] : strips[1] + 48], "<f4").reshape(3, 4)
    assert np.isnan(north[0, 1]) and north[2, 0] == 100


def test_csv(spark, tmp_path):
    g = frame(spark, dt.date(2001, 1, 1), 2, missing=(1, 2, 1))
    path = sinks.to_csv(g, str(tmp_path), "p.csv", lat=11.9, lon=70.9)
    text = open(path).read()
    assert text.splitlines() == ["DateTime,11.9 70.9", "2001-01-01,21.0000", "2001-01-02,-999.0000"]
    assert spark.read.csv(sinks.to_csv(g, str(tmp_path)), header=True).count() == 24
    with pytest.raises(ValueError):
        sinks.to_csv(g, str(tmp_path), lat=0.0)


def test_shapefile(tmp_path):
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4d", 5, 0, 0, 1, 1) + struct.pack("<iii", 1, 4, 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    head = struct.pack(">i", 9994) + b"\0" * 96
    (tmp_path / "a.shp").write_bytes(head + struct.pack(">ii", 1, len(body) // 2) + body)
    assert shapefile.read_shapes(str(tmp_path / "a.shp")) == [[ring]]
    (tmp_path / "b.shp").write_bytes(b"x" * 200)
    with pytest.raises(ValueError):
        shapefile.read_shapes(str(tmp_path / "b.shp"))


def test_stream_counts_each_reading_once(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 1, 1, p, "rain", v, t + dt.timedelta(hours=p)) for p, v in enumerate([3.0, -999.0, None, 1.0])] + [(1, 1, 1, 0, "rain", 3.0, t + dt.timedelta(hours=9))]
    df = spark.createDataFrame(rows, "object_id long, lon_i int, lat_i int, pos int, var string, value double, loaded_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = daily_totals(s).writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = [(2, 1, 4.0)]
    assert [tuple(r) for r in spark.sql("select readings, at_least_2_5, total from totals").collect()] == want
    assert [(r["readings"], r["at_least_2_5"], r["total"]) for r in daily_totals(df).collect()] == want
