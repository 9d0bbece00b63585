import io
import os
import struct

import numpy as np
import pyarrow.parquet as pq
import pytest

from skygrid.operators import compact
from skygrid.sources import parquet_blocks

FILES = "file_id long, object_id long, path string, cat string, start_day string, no_days int, n_lon int, n_lat int, payload binary, year string, bucket string, block string"


def payload(*values):
    return struct.pack(f"<{len(values)}f", *values)


def files_of(spark, rows):
    full = [(i, o, path, None, None, days, 2, 1, raw, "a", "b", "c") for i, o, path, days, raw in rows]
    return spark.createDataFrame(full, FILES)


ROWS = [
    (1, 7, "o7/tmax/max01022003.grd", 1, payload(1, 2)),
    (2, 7, "o7/x/TMAX_2003-02-02.GRD", 1, payload(3, 4)),
    (3, 7, "o7/tmax/bundle_20030201_2d.grd", 2, payload(1, 2, 3, 4)),  # nothing new
    (4, 7, "o7/tmax/max01022003.grd", 1, payload(1, 9)),  # one record revised
    (5, 7, "o7/tmax/max01022003.grd", 1, payload(1, 9)),
    (6, 7, "o7/tmax/max01022003.grd", 1, payload(1, 2)[:7]),  # cut short
    (7, 7, "o7/tmax/max03022003.grd", 1, b""),
    (8, 8, "o8/tmax/max01022003.grd", 1, payload(1, 2)),  # another object
    (9, 7, "o7/tmax/max04022003.grd", 1, payload(1, 2)),  # another day
    (10, 7, "o7/tmax/max05022003.grd", 1, None),
    (11, 9, "o9/rain/rain_ind0.25_19_12_31.grd", 2, payload(-999, 0, 5, 6)),
    (12, 7, "o7/tmax/max01022003.grd", 1, payload(2, 9)),  # both values known, but 2 is new at its cell
]


def brute(rows):
    import datetime as dt

    first = {1: "2003-02-01", 2: "2003-02-02", 3: "2003-02-01", 4: "2003-02-01", 5: "2003-02-01", 8: "2003-02-01", 9: "2003-02-04", 11: "2019-12-31", 12: "2003-02-01"}
    seen, nothing = {}, []
    for i, o, _, days, raw in rows:
        new = False
        if raw and len(raw) == days * 8:
            for k, v in enumerate(struct.unpack(f"<{days * 2}f", raw)):
                key = (o, dt.date.fromisoformat(first[i]) + dt.timedelta(k // 2), k % 2, v)
                new |= seen.setdefault(key, i) == i
        if not new:
            nothing.append(i)
    return seen, nothing


def objects(spark):
    return spark.createDataFrame([(o, [20.5], [70.5, 71.5]) for o in (7, 8)], "object_id long, lat_array array<double>, lon_array array<double>")


@pytest.mark.parametrize("target", [compact.TARGET_BYTES, 8])
def test_every_record_once_and_the_files_that_add_nothing(spark, target):
    done = compact.consolidate(files_of(spark, ROWS), objects(spark), target_bytes=target)
    seen, nothing = brute(ROWS)
    assert sorted(r[0] for r in done.adds_nothing.collect()) == nothing
    back = spark.read.parquet(f"{done.out_dir}/*/*/*.parquet").collect()
    lon = lambda r: {70.5: 0, 71.5: 1}.get(r["lon"])
    got = [(r["object_id"], r["day"], lon(r), r["value"]) for r in back if r["object_id"] != 9]
    assert sorted(got) == sorted(k for k in seen if k[0] != 9)
    assert sum(r["object_id"] == 9 and np.isnan(r["lon"]) for r in back) == 4
    m = done.manifest.collect()
    assert sum(r["records"] for r in m) == len(seen) and {(r["cat"], r["year"]) for r in m} == {("tmax", 2003), ("rain", 2019), ("rain", 2020)}
    assert all((r["blocks"] >= r["days"]) and r["bytes"] > 0 for r in m)


def test_large_years_are_dealt_to_several_files(spark):
    rows = [(i, o, f"o{o}/tmax/max01{m:02d}2003.grd", 1, payload(i, o)) for i, (o, m) in enumerate((o, m) for o in range(5) for m in range(1, 13))]
    done = compact.consolidate(files_of(spark, rows), objects(spark), target_bytes=100)
    m = done.manifest.collect()
    assert len(m) == 5 and sum(r["records"] for r in m) == 120 and done.adds_nothing.count() == 0


def test_empty_null_and_undated(spark):
    none = compact.consolidate(files_of(spark, []), objects(spark))
    assert none.manifest.count() == 0 and none.adds_nothing.count() == 0
    odd = [(1, None, "max01022003.grd", 1, payload(1, 2)), (2, 7, None, 1, payload(1, 2)), (3, 7, "nothing here", 1, payload(1, 2))]
    f = files_of(spark, odd)
    assert sorted(r[0] for r in compact.undated(f).collect()) == [2, 3]
    assert sorted(r[0] for r in compact.files_adding_nothing(f, objects(spark)).collect()) == [1, 2, 3]


def test_undated_files_are_reported_not_redundant(spark, tmp_path):
    from skygrid.plans.quality import p2_found

    f = files_of(spark, [*ROWS, (20, 7, "nothing here", 1, payload(8, 9))])
    with pytest.warns(UserWarning, match="1 whole files show no day"):
        done = compact.consolidate(f, objects(spark))
    assert sorted(r[0] for r in done.adds_nothing.collect()) == brute(ROWS)[1] and [r[0] for r in done.undated.collect()] == [20]
    f.write.parquet(str(tmp_path / "raw_files.parquet"))
    objects(spark).write.parquet(str(tmp_path / "imd_objects.parquet"))
    with pytest.warns(UserWarning, match="1 whole files show no day"):
        assert sorted(r[0] for r in p2_found(spark, str(tmp_path)).collect()) == brute(ROWS)[1]


@pytest.mark.parametrize(
    ("path", "start", "day"),
    [("o1/rain/rain_ind0.25_99_11_12.grd", None, "1999-11-12"), ("a/rain_ind0.25_01_02_03.grd", None, "2001-02-03"), ("t/max29112015.grd", "x", "2015-11-29"), ("i/tmin_20170405.GRD", None, "2017-04-05"), ("i/2002/2002-07-29.grd", None, "2002-07-29"), ("none", "20100203", "2010-02-03"), (None, "2010-02-03 00:00:00", "2010-02-03"), ("i/tmin_20179905.GRD", None, None)],
)
def test_first_day(spark, path, start, day):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(path, start)], "path string, start_day string")
    got = df.select(compact.first_day(F.col("path"), F.col("start_day"))).first()[0]
    assert (got and got.isoformat()) == day


def test_block_file_is_parquet(monkeypatch):
    monkeypatch.setattr(parquet_blocks, "ROW_GROUP", 5)
    sink = io.BytesIO()
    f = parquet_blocks.BlockFile(sink)
    for d in range(4):
        f.add(1 << 40, -d, np.array([1.0, 2.0]), np.array([3.0, 4.0]), payload(d, d + 0.5))
    with pytest.raises(ValueError):
        f.add(1, 1, np.array([1.0]), np.array([1.0]), b"123")
    assert f.close() == sink.tell()
    t = pq.read_table(sink)
    assert t["value"].to_pylist() == [0, 0.5, 1, 1.5, 2, 2.5, 3, 3.5] and t["object_id"].to_pylist() == [1 << 40] * 8
    assert t["day"].cast("int32").to_pylist() == [0, 0, -1, -1, -2, -2, -3, -3] and t["lat"].to_pylist() == [1, 2] * 4 and t["lon"].to_pylist() == [3, 4] * 4
    m = pq.ParquetFile(sink).metadata
    assert m.num_row_groups == 2 and f.days == 4
    stats = m.row_group(0).column(1).statistics
    assert (stats.min, stats.max, stats.null_count) == (__import__("datetime").date(1969, 12, 30), __import__("datetime").date(1970, 1, 1), 0)
    assert pq.read_table(sink, filters=[("object_id", "=", 5)]).num_rows == 0


def test_keys_are_packed_losslessly():
    r = np.random.default_rng(3)
    sink = io.BytesIO()
    f = parquet_blocks.BlockFile(sink)
    want = []
    for k in range(300):
        n = int(r.integers(1, 40))
        lat, lon, v = r.integers(0, 700, n) / 4, r.integers(0, 3, n) * 1.0, r.normal(size=n).astype("<f4")
        f.add(k // 7, int(r.integers(-9, 9)), lat, lon, v.tobytes())
        want += list(zip([k // 7] * n, lat.tolist(), lon.tolist(), v.tolist()))
    f.close()
    t = pq.read_table(sink)
    assert list(zip(t["object_id"].to_pylist(), t["lat"].to_pylist(), t["lon"].to_pylist(), t["value"].to_pylist())) == want


def test_nothing_is_left_behind(spark, tmp_path):
    from skygrid.session import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    done = compact.consolidate(files_of(spark, ROWS), objects(spark), out_dir=f"file://{tmp_path}/out")
    left = set(os.listdir(folder)) - before
    assert all(x.count("-") == 4 and os.path.isdir(os.path.join(folder, x)) and all(y.startswith("rdd-") for y in os.listdir(os.path.join(folder, x))) for x in left)
    assert done.adds_nothing.count() == len(brute(ROWS)[1])


def test_nothing_that_grows_with_files_or_objects_is_broadcast(spark, tmp_path):
    import re

    files_of(spark, [*ROWS, (20, 7, "nothing here", 1, payload(8, 9))]).write.parquet(str(tmp_path / "files"))  # of Parquet the planner believes the sizes
    objects(spark).write.parquet(str(tmp_path / "objects"))
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(30_000)
    before = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    with pytest.warns(UserWarning, match="1 whole files show no day"):
        done = compact.consolidate(spark.read.parquet(str(tmp_path / "files")), spark.read.parquet(str(tmp_path / "objects")))
    bus.waitUntilEmpty(30_000)
    runs = store.executionsList()
    plans = [x.physicalPlanDescription() for x in map(runs.apply, range(runs.size())) if x.executionId() not in before]
    keys = {k for p in plans for k in re.findall(r"BroadcastHashJoin[^\n]*\nLeft keys \[\d+\]: \[(\w+)#", p)}
    assert "year" in keys and keys <= {"year", "path"}
    assert sorted(r[0] for r in done.adds_nothing.collect()) == brute(ROWS)[1] and [r[0] for r in done.undated.collect()] == [20]
