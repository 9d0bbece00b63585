"""Writing grids: CSV, raster files, NetCDF-3 and GeoTIFF.

CSV and raster files are written by the executors. NetCDF and GeoTIFF hold one
dense array in one file by their nature: rows come to the driver one time step at
a time, so its memory is bounded by a step (at most 17,415 or, for the merged
product, 67,721 cells) whatever the number of steps.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrid.model import METHODS, RAW_VARIABLES, GridFrame, GridSpec, Meta
from skygrid.sources.naming import YEARWISE, daily_path

FILL = -999.0


def to_csv(g: GridFrame, out_dir: str, name: str = "grid", lat: float | None = None, lon: float | None = None) -> str:
    """The whole grid in long form (a folder of parts), or with lat and lon the nearest cell's daily rows as one file, missing as the sentinel; the path written.

    out_dir: a path or a URI that every executor reaches.
    """
    if (lat is None) != (lon is None):
        raise ValueError("give both lat and lon, or neither")
    d = g.with_date()
    if lat is None:
        path = f"{out_dir}/{name}.csv"
        d.select("date", "lat", "lon", "value").write.mode("overwrite").csv(path, header=True)
        return path
    j, i = g.meta.spec.nearest(lat, lon)
    stem, ext = os.path.splitext(name)
    path = f"{out_dir}/{stem}_{lat:.2f}_{lon:.2f}{ext or '.csv'}"
    # one cell has at most one row per day: one task writes it
    cell = d.where((F.col("lon_i") == i) & (F.col("lat_i") == j)).select("date", F.format_string("%.4f", F.coalesce("value", F.lit(FILL))).alias("v"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        store.create_dir(os.path.dirname(where), recursive=True)
        part, n = f"{where}.{uuid.uuid4().hex}", 0
        with store.open_output_stream(part) as out:
            out.write(f"DateTime,{lat} {lon}\n".encode())
            for b in batches:
                out.write("".join(f"{day},{v}\n" for day, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())).encode())
                n += b.num_rows
        store.move(part, where)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    cell.repartition(1).sortWithinPartitions("date").mapInArrow(write, "n long").collect()
    return path


def to_grd(g: GridFrame, folder: str, layout: str = "yearly", fill: float = FILL) -> DataFrame:
    """Raster files of whole years (or days) as the reader takes them, one task per file, missing as fill; path and bytes of each.

    folder: a path or a URI that every executor reaches.
    """
    spec, cat = g.meta.spec, g.meta.cat
    d = g.with_date().withColumn("file", F.year("date") if layout == "yearly" else F.datediff("date", F.lit("1970-01-01").cast("date")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files: dict[int, np.ndarray] = {}
        for b in batches:
            f, day, lon_i, lat_i = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            v = b.column(4).fill_null(fill).to_numpy(zero_copy_only=False)
            for x in np.unique(f).tolist():
                first = dt.date(x, 1, 1) if layout == "yearly" else dt.date(1970, 1, 1) + dt.timedelta(x)
                n = (dt.date(x, 12, 31) - first).days + 1 if layout == "yearly" else 1
                if x not in files:
                    files[x] = np.full((n, spec.n_lat, spec.n_lon), fill, "<f4")
                at = f == x
                files[x][day[at] - (first - dt.date(1970, 1, 1)).days, lat_i[at], lon_i[at]] = v[at]
        made = []
        for x, a in files.items():
            path = os.path.join(folder, YEARWISE[cat].format(y=x)) if layout == "yearly" else daily_path(dt.date(1970, 1, 1) + dt.timedelta(x), cat, folder)
            store, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            store.create_dir(os.path.dirname(where), recursive=True)
            part = f"{where}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                out.write(a.tobytes())
            store.move(part, where)  # a task that runs again replaces the file by the same
            made.append((path, a.nbytes))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["path", "bytes"])

    rows = d.select("file", F.datediff("date", F.lit("1970-01-01").cast("date")).alias("day"), "lon_i", "lat_i", "value")
    return rows.repartition("file").mapInArrow(write, "path string, bytes long")


def to_arrays(df: DataFrame, time: str, meta: Meta, folder: str, value: str = "value") -> DataFrame:
    """Dense arrays for other tools: one .npz file per year of steps, written by the executors; path, first time and steps of each.

    A file holds time (days since 1970-01-01), lat, lon, the array named as the variable in
    (time, lat, lon) order with NaN for missing, and attrs, the CF-1.7 attributes of
    variable, axes and data set as JSON. A year of the largest catalogued grid
    (67,721 cells) is 200 MB, which bounds a task. Rows without a time are left out.
    """
    spec, name = meta.spec, meta.method or meta.cat
    units, long_name = RAW_VARIABLES.get(name, ("", METHODS.get(name, name)))
    attrs = {
        name: {"units": units, "long_name": long_name},
        "time": {"units": "days since 1970-01-01 00:00:00", "standard_name": "time", "long_name": "time"},
        "lat": {"axis": "Y", "standard_name": "latitude", "long_name": "latitude", "units": "degrees_north"},
        "lon": {"axis": "X", "standard_name": "longitude", "long_name": "longitude", "units": "degrees_east"},
        "": {"Conventions": "CF-1.7", "title": f"daily gridded data, {long_name}", "crs": "epsg:4326"},
    }

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        from pyarrow import fs

        years: dict[int, dict[int, np.ndarray]] = {}
        for b in batches:
            year, day, lon_i, lat_i = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            v = b.column(4).fill_null(np.nan).to_numpy(zero_copy_only=False)
            for y in np.unique(year).tolist():
                steps = years.setdefault(y, {})
                for t in np.unique(day[year == y]).tolist():
                    at = (year == y) & (day == t)
                    steps.setdefault(t, np.full((spec.n_lat, spec.n_lon), np.nan, "<f4"))[lat_i[at], lon_i[at]] = v[at]
        made = []
        for y, steps in years.items():
            path, raw, order = f"{folder}/{name}-{y}.npz", io.BytesIO(), sorted(steps)
            lat, lon = spec.lat0 + spec.step * np.arange(spec.n_lat), spec.lon0 + spec.step * np.arange(spec.n_lon)
            np.savez(raw, **{"time": np.array(order), "lat": lat, "lon": lon, name: np.stack([steps[t] for t in order]), "attrs": np.array(json.dumps(attrs))})
            store, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            store.create_dir(os.path.dirname(where), recursive=True)
            part = f"{where}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                out.write(raw.getvalue())
            store.move(part, where)
            made.append((path, order[0], len(order)))
        cols = list(zip(*made)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()).cast(pa.date32()), pa.array(cols[2], pa.int32())], names=["path", "first", "steps"])

    rows = df.where(F.col(time).isNotNull()).select(F.year(time).alias("year"), F.datediff(time, F.lit("1970-01-01").cast("date")).alias("day"), "lon_i", "lat_i", F.col(value).cast("double").alias("v"))
    return rows.repartition("year").mapInArrow(write, "path string, first date, steps int")


def _steps(df: DataFrame, time: str, spec: GridSpec, value: str) -> Iterator[tuple[object, np.ndarray]]:
    """(time, lat x lon array with NaN for missing) in order, one step in memory at a time."""
    current, a = None, None
    for r in df.where(F.col(time).isNotNull()).select(time, "lon_i", "lat_i", value).sort(time).toLocalIterator(prefetchPartitions=True):
        if r[0] != current:
            if a is not None:
                yield current, a
            current, a = r[0], np.full((spec.n_lat, spec.n_lon), np.nan)
        if r[3] is not None:
            a[r[2], r[1]] = r[3]
    if a is not None:
        yield current, a


def to_netcdf(df: DataFrame, time: str, spec: GridSpec, path: str, name: str = "value", units: str = "", long_name: str = "", value: str = "value") -> int:
    """A classic NetCDF file with CF-1.7 attributes; time (a date, or a number of days) is the record axis. The number of steps."""
    text = lambda s: struct.pack(">i", len(s.encode())) + s.encode() + b"\0" * (-len(s.encode()) % 4)

    def attributes(pairs: dict[str, object]) -> bytes:
        if not pairs:
            return struct.pack(">ii", 0, 0)
        out = struct.pack(">ii", 12, len(pairs))
        for k, v in pairs.items():
            out += text(k) + (struct.pack(">i", 2) + text(v) if isinstance(v, str) else struct.pack(">iif", 5, 1, v))
        return out

    size = spec.cells * 4

    def header(steps: int, begins: tuple[int, ...]) -> bytes:
        out = b"CDF\x01" + struct.pack(">i", steps)
        out += struct.pack(">ii", 10, 3) + text("time") + struct.pack(">i", 0) + text("lat") + struct.pack(">i", spec.n_lat) + text("lon") + struct.pack(">i", spec.n_lon)
        out += attributes({"Conventions": "CF-1.7", "title": long_name or name})
        out += struct.pack(">ii", 11, 4)
        variables = (
            ("lat", (1,), {"units": "degrees_north", "standard_name": "latitude"}, 6, spec.n_lat * 8),
            ("lon", (2,), {"units": "degrees_east", "standard_name": "longitude"}, 6, spec.n_lon * 8),
            ("time", (0,), {"units": "days since 1970-01-01", "calendar": "standard"}, 6, 8),
            (name, (0, 1, 2), {"units": units, "long_name": long_name, "_FillValue": FILL}, 5, size),
        )
        for (n, dims, atts, kind, room), begin in zip(variables, begins):
            out += text(n) + struct.pack(f">i{len(dims)}i", len(dims), *dims) + attributes(atts) + struct.pack(">iii", kind, room, begin)
        return out

    at = len(header(0, (0, 0, 0, 0)))
    lat_at, lon_at = at, at + spec.n_lat * 8
    begins = (lat_at, lon_at, lon_at + spec.n_lon * 8, lon_at + spec.n_lon * 8 + 8)
    steps = 0
    with open(path, "wb") as f:
        f.write(header(0, begins))
        f.write(np.array([spec.lat(i) for i in range(spec.n_lat)], ">f8").tobytes() + np.array([spec.lon(i) for i in range(spec.n_lon)], ">f8").tobytes())
        for t, a in _steps(df, time, spec, value):
            day = (t - dt.date(1970, 1, 1)).days if isinstance(t, dt.date) else float(t)
            f.write(struct.pack(">d", day) + np.where(np.isnan(a), FILL, a).astype(">f4").tobytes())
            steps += 1
        f.seek(4)
        f.write(struct.pack(">i", steps))
    return steps


def to_geotiff(df: DataFrame, time: str, spec: GridSpec, path: str, value: str = "value") -> int:
    """An uncompressed float32 GeoTIFF in EPSG:4326, one band per time step, north up, missing as NaN. The number of bands."""
    bands = 0
    row = spec.n_lat * spec.n_lon * 4
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHI", b"II", 42, 0))
        offsets = []
        for _, a in _steps(df, time, spec, value):
            offsets.append(f.tell())
            f.write(a[::-1].astype("<f4").tobytes())
            bands += 1
        extra: dict[int, tuple[int, bytes]] = {
            258: (3, struct.pack(f"<{bands}H", *[32] * bands)),
            273: (4, struct.pack(f"<{bands}I", *offsets)),
            279: (4, struct.pack(f"<{bands}I", *[row] * bands)),
            339: (3, struct.pack(f"<{bands}H", *[3] * bands)),
            33550: (12, struct.pack("<3d", spec.step, spec.step, 0.0)),
            33922: (12, struct.pack("<6d", 0, 0, 0, spec.lon0 - spec.step / 2, spec.lat(spec.n_lat - 1) + spec.step / 2, 0)),
            # one key directory: geographic model, pixel is area, EPSG 4326
            34735: (3, struct.pack("<16H", 1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326)),
            42113: (2, b"nan\0"),
        }
        if bands > 1:
            extra[338] = (3, struct.pack(f"<{bands - 1}H", *[0] * (bands - 1)))
        # planar layout 2: one strip per band
        plain = {256: (3, spec.n_lon), 257: (3, spec.n_lat), 259: (3, 1), 262: (3, 1), 277: (3, bands), 278: (3, spec.n_lat), 284: (3, 2)}
        width = {2: 1, 3: 2, 4: 4, 12: 8}
        entries = []
        for tag, (kind, raw) in extra.items():
            count = len(raw) // width[kind]
            if len(raw) > 4:
                if f.tell() % 2:
                    f.write(b"\0")
                where = struct.pack("<I", f.tell())
                f.write(raw)
            else:
                where = raw.ljust(4, b"\0")
            entries.append((tag, struct.pack("<HHI", tag, kind, count) + where))
        entries += [(tag, struct.pack("<HHIHH", tag, kind, 1, v, 0)) for tag, (kind, v) in plain.items()]
        if f.tell() % 2:
            f.write(b"\0")
        at = f.tell()
        f.write(struct.pack("<H", len(entries)) + b"".join(e for _, e in sorted(entries)) + struct.pack("<I", 0))
        f.seek(4)
        f.write(struct.pack("<I", at))
    return bands
