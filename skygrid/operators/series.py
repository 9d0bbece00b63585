"""Series blocks: the layout shared by all operators that walk one series in time.

A reading-per-row table is turned into one compact block per series and input
batch *before* the shuffle: repeated deliveries of a reading collapse there, and
what travels is a few bytes per reading instead of a row. A series holds at most
one reading per day once repeats are gone, so a block group is bounded by the
calendar (36,525 readings for a hundred years) however many rows were delivered,
and no key can become a hot partition.

Rows whose key or position is NULL belong to no series and are left out. Where
one position carries several different values, the smallest counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERIES = ("object_id", "lon_i", "lat_i")
#: Readings that one vectorised step handles at most (a single series may exceed it).
STEP = 400_000

BLOCK = T.StructType(
    [
        T.StructField("object_id", T.LongType()),
        T.StructField("lon_i", T.IntegerType()),
        T.StructField("lat_i", T.IntegerType()),
        T.StructField("tag", T.IntegerType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("p", T.BinaryType()),
        T.StructField("v", T.BinaryType()),
    ]
)
#: Codes of the variables in tag; anything else is UNKNOWN.
TAGS = {"rain": 0, "tmax": 1, "tmin": 2}
UNKNOWN = -1


def tag_of(var: Column) -> Column:
    out = F.when(var == "rain", TAGS["rain"]).when(var == "tmax", TAGS["tmax"]).when(var == "tmin", TAGS["tmin"])
    return out.otherwise(UNKNOWN).cast("int")


def _np(column: pa.ChunkedArray | pa.Array, dtype: np.dtype) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(np.nan if np.dtype(dtype).kind == "f" else 0)
    return column.to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def _encode(v: np.ndarray) -> np.ndarray:
    """Whole hundredths as int32 where that is lossless, else the doubles themselves."""
    with np.errstate(invalid="ignore", over="ignore"):
        h = np.rint(v * 100.0)
        if v.size and (np.abs(h) < 2**31).all() and (h / 100.0 == v).all():
            return h.astype("<i4")
    return v.astype("<f8")


def _pack(tables: list[pa.RecordBatch]) -> pa.RecordBatch | None:
    t = pa.Table.from_batches(tables)
    keys = [_np(t["object_id"], np.int64), _np(t["lon_i"], np.int32), _np(t["lat_i"], np.int32)]
    pos, v, tag = _np(t["pos"], np.int32), _np(t["value"], np.float64), _np(t["tag"], np.int32)
    if not pos.size:
        return None
    change = np.zeros(pos.size, bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    rising = change.copy()
    rising[1:] |= pos[1:] > pos[:-1]
    if not rising.all() or change.sum() * 8 > pos.size:
        order = np.lexsort((v, pos, *keys[::-1]))
        keys, pos, v, tag = [k[order] for k in keys], pos[order], v[order], tag[order]
        change = np.zeros(pos.size, bool)
        change[0] = True
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        # NaN (missing) sorts last, so the first of a position is a value if there is one
        new = change.copy()
        new[1:] |= pos[1:] != pos[:-1]
        starts = np.flatnonzero(change)
        tags = np.maximum.reduceat(tag, starts)
        group = np.cumsum(change) - 1
        heads = [k[starts] for k in keys]
        keep = new & ~np.isnan(v)
        pos, v, group = pos[keep], v[keep], group[keep]
    else:
        starts = np.flatnonzero(change)
        tags = np.maximum.reduceat(tag, starts)
        group = np.cumsum(change) - 1
        heads = [k[starts] for k in keys]
        keep = ~np.isnan(v)
        pos, v, group = pos[keep], v[keep], group[keep]
    counts = np.bincount(group, minlength=starts.size)
    ends = np.cumsum(counts)
    step = np.diff(pos, prepend=0).astype("<i4")
    first = (ends - counts)[counts > 0]
    step[first] = pos[first]
    ps, vs = [], []
    for e, c in zip(ends.tolist(), counts.tolist()):
        ps.append(step[e - c : e].tobytes())
        vs.append(_encode(v[e - c : e]).tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(heads[0], pa.int64()), pa.array(heads[1], pa.int32()), pa.array(heads[2], pa.int32()), pa.array(tags, pa.int32()), pa.array(counts, pa.int32()), pa.array(ps, pa.binary()), pa.array(vs, pa.binary())],
        names=BLOCK.names,
    )


def _pack_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= STEP:
            if (out := _pack(held)) is not None:
                yield out
            held, rows = [], 0
    if held and (out := _pack(held)) is not None:
        yield out


def pack(obs: DataFrame, value: str = "value", missing: float = -999.0) -> DataFrame:
    """grid_obs rows to series blocks (BLOCK), repeats collapsed within each input batch.

    NULL, NaN and the missing sentinel are no readings, but their series stays (with n = 0 if nothing else).
    """
    v = F.col(value).cast("double")
    rows = obs.where(F.col("object_id").isNotNull() & F.col("lon_i").isNotNull() & F.col("lat_i").isNotNull() & F.col("pos").isNotNull()).select(
        F.col("object_id").cast("long").alias("object_id"),
        F.col("lon_i").cast("int").alias("lon_i"),
        F.col("lat_i").cast("int").alias("lat_i"),
        F.col("pos").cast("int").alias("pos"),
        F.when(v != missing, v).alias("value"),
        tag_of(F.col("var")).alias("tag"),
    )
    return rows.mapInArrow(_pack_stream, BLOCK)


class Series:
    """Readings of whole series, concatenated; each series sorted by position without repeats."""

    def __init__(self, object_id, lon_i, lat_i, tag, counts, pos, v, extra):
        self.object_id, self.lon_i, self.lat_i, self.tag = object_id, lon_i, lat_i, tag
        self.counts, self.pos, self.v, self.extra = counts, pos, v, extra
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.sid = np.repeat(np.arange(counts.size), counts)


def _decode(p: bytes, v: bytes) -> tuple[np.ndarray, np.ndarray]:
    pos = np.cumsum(np.frombuffer(p, "<i4"), dtype=np.int32)
    if len(v) == len(p):
        return pos, np.frombuffer(v, "<i4") / 100.0
    return pos, np.frombuffer(v, "<f8")


def _unpack(rows: list[tuple], extra_names: tuple[str, ...]) -> Series:
    """rows: (object_id, lon_i, lat_i, tag, n, p, v, *extra), equal keys adjacent."""
    heads: list[tuple] = []
    index: list[int] = []
    ps, vs = [], []
    last = None
    for r in rows:
        key = r[:3]
        if key != last:
            heads.append(list(r[:4]) + list(r[7:]))
            last = key
        else:
            h = heads[-1]
            h[3] = max(h[3], r[3])
            for i, x in enumerate(r[7:], 4):
                h[i] = x if h[i] is None else h[i]
        p, v = _decode(r[5], r[6])
        ps.append(p)
        vs.append(v)
        index.append(len(heads) - 1)
    pos, v = np.concatenate(ps), np.concatenate(vs)
    sid = np.repeat(np.array(index), [x.size for x in ps])
    same = sid[1:] == sid[:-1]
    if (same & (pos[1:] <= pos[:-1])).any():
        order = np.lexsort((v, pos, sid))
        sid, pos, v = sid[order], pos[order], v[order]
        first = np.ones(pos.size, bool)
        first[1:] = (sid[1:] != sid[:-1]) | (pos[1:] != pos[:-1])
        sid, pos, v = sid[first], pos[first], v[first]
    cols = list(zip(*heads))
    extra = {n: list(cols[4 + i]) for i, n in enumerate(extra_names)}
    return Series(np.array(cols[0], np.int64), np.array(cols[1], np.int32), np.array(cols[2], np.int32), np.array(cols[3], np.int32), np.bincount(sid, minlength=len(heads)), pos, v, extra)


def _stream(fn: Callable[[Series], pa.RecordBatch | None], extra_names: tuple[str, ...], days: str | None) -> Callable:
    at = 7 + extra_names.index(days) if days else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, spread = 0, 0
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                new = not held or r[:3] != held[-1][:3]
                own = (r[at] or 0) if at and new else 0
                if new and held and (size >= STEP or spread + own > STEP):
                    if (out := fn(_unpack(held, extra_names))) is not None:
                        yield out
                    held, size, spread = [], 0, 0
                held.append(r)
                size += r[4] + 1
                spread += own
        if held and (out := fn(_unpack(held, extra_names))) is not None:
            yield out

    return run


def per_series(blocks: DataFrame, fn: Callable[[Series], pa.RecordBatch | None], schema: T.StructType, extra: tuple[str, ...] = (), days: str | None = None) -> DataFrame:
    """Apply fn to whole series: one shuffle of blocks by series, then vectorised steps over many series at once.

    days names the extra column with the days that fn makes of a series, if that is more
    than its readings: a step then has at most STEP of them (or one series).
    """
    return (
        blocks.select(*BLOCK.names, *extra)
        .repartition(*SERIES)
        .sortWithinPartitions(*SERIES)
        .mapInArrow(_stream(fn, extra, days), schema)
    )


def with_objects(blocks: DataFrame, objects: DataFrame) -> DataFrame:
    """Add start_date and days (from start_day and end_day, which are right where no_days is not) of each block's object.

    An end before the start is no day at all; what is no date is NULL, as for an unknown object.
    """
    start, end = (F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).cast("date") for c in ("start_day", "end_day"))
    days = F.greatest(F.datediff(end, start) + 1, F.lit(0))
    o = objects.where(F.col("object_id").isNotNull()).groupBy(F.col("object_id").cast("long").alias("object_id")).agg(F.min(start).alias("start_date"), F.max(F.when(start.isNotNull() & end.isNotNull(), days)).alias("days"))
    return blocks.join(o, "object_id", "left")
