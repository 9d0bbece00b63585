"""Percentiles per group from merging centroid digests, with a counted certificate of their rank error.

A digest holds the sorted values of a group clustered under the size function
k(q) = DELTA / (2 pi) * (asin(2 q - 1) + pi / 2): no cluster spans a whole unit of
k, so clusters are single values at the tails and at most pi / DELTA of the group
wide at the median. Digests merge by re-clustering their centroids, so those kept
per object or per day combine into those of any larger group. After the
percentiles are read off, a second pass over all readings counts, for every group
and percentile, the readings below and up to the estimate; that gives the true
rank error of each.

Stated bound of the rank error at q: 4 pi sqrt(q (1 - q)) / DELTA + 1 / n.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skygrid.operators.series import BLOCK, TAGS, Series, _decode, _encode, pack, per_series, with_objects
from skygrid.session import materialise, settle

DELTA = 400.0
PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: What a group is. Keys a and b are 0 where unused.
GRAINS = {"all": 0, "cell": 1, "day": 2, "object": 3}
#: Centroids that a task holds before it hands on what it has.
HELD = 2_000_000
#: Tasks' digests of a group are merged in so many parts first, each of FAN neighbouring tasks' (and those PARTS * FAN further on).
PARTS, FAN = 64, 64
#: Parts over which the readings of an object are dealt where they meet its estimates.
DEALT = 32

DIGEST = T.StructType(
    [
        T.StructField("grain", T.IntegerType()),
        T.StructField("tag", T.IntegerType()),
        T.StructField("a", T.LongType()),
        T.StructField("b", T.LongType()),
        T.StructField("salt", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("m", T.BinaryType()),
        T.StructField("w", T.BinaryType()),
    ]
)
KEY = ["grain", "tag", "a", "b"]
DAYS = T.StructType([*BLOCK.fields, T.StructField("start", T.IntegerType())])


def rank_bound(q: float, n, delta: float = DELTA):
    return 4 * np.pi * np.sqrt(q * (1 - q)) / delta + 1 / n


def cluster(g: np.ndarray, m: np.ndarray, w: np.ndarray | None, groups: int, delta: float = DELTA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-cluster centroids (group, mean, weight) of many groups at once; weight None means 1 each. Result sorted by group and mean."""
    order = np.lexsort((m, g))
    g, m = g[order], m[order]
    w = np.ones(m.size) if w is None else w[order]
    if not m.size:
        return g, m, w
    cum = np.cumsum(w)
    first = np.ones(g.size, bool)
    first[1:] = g[1:] != g[:-1]
    starts = np.flatnonzero(first)
    before = np.repeat(cum[starts] - w[starts], np.diff(np.append(starts, g.size)))
    total = np.bincount(g, weights=w, minlength=groups)
    q = np.clip((cum - before - w / 2) / total[g], 0.0, 1.0)
    k = np.floor(delta / (2 * np.pi) * (np.arcsin(2 * q - 1) + np.pi / 2)).astype(np.int64)
    new = first
    new[1:] |= k[1:] != k[:-1]
    # a group of fewer values than clusters stays as it is
    size = np.bincount(g, minlength=groups)
    new |= (size <= delta / 2)[g]
    at = np.flatnonzero(new)
    if at.size == m.size:
        return g, m, w
    ws = np.add.reduceat(w, at)
    return g[at], np.add.reduceat(m * w, at) / ws, ws


def quantiles(g: np.ndarray, m: np.ndarray, w: np.ndarray, groups: int, ps: Sequence[float]) -> np.ndarray:
    """Estimates (groups x percentiles) by interpolation between the centres of the clusters; every group has one."""
    cum = np.cumsum(w)
    n = np.bincount(g, weights=w, minlength=groups)
    start = np.cumsum(n) - n
    centre = (cum - w / 2 - start[g]) / n[g]
    first = np.searchsorted(g, np.arange(groups))
    last = np.searchsorted(g, np.arange(groups), side="right") - 1
    x = g * 2.0 + centre
    out = np.empty((groups, len(ps)))
    for j, p in enumerate(ps):
        t = np.clip(p, centre[first], centre[last]) + np.arange(groups) * 2.0
        out[:, j] = np.interp(t, x, m)
    return out


def _binary(raw: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Slices of one array as binary values (contiguous, in order)."""
    item = raw.dtype.itemsize
    offsets = np.append(starts, ends[-1] if ends.size else 0).astype(np.int64) * item
    return pa.Array.from_buffers(pa.large_binary(), ends.size, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def _rows(keys: np.ndarray, g: np.ndarray, m: np.ndarray, w: np.ndarray, salt: int) -> Iterator[pa.RecordBatch]:
    """keys: (groups x 4); digests of the groups that occur. Groups of single values carry no weights."""
    if not g.size:
        return
    single = np.ones(len(keys), bool)
    np.logical_and.at(single, g, w == 1.0)
    for flag in (True, False):
        pick = single[g] == flag
        gg, mm, ww = g[pick], m[pick], w[pick]
        if not gg.size:
            continue
        first = np.ones(gg.size, bool)
        first[1:] = gg[1:] != gg[:-1]
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], gg.size)
        at = gg[starts]
        n = np.rint(np.add.reduceat(ww, starts)).astype(np.int64)
        none = pa.array([b""] * at.size, pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[at, 0], pa.int32()), pa.array(keys[at, 1], pa.int32()), pa.array(keys[at, 2], pa.int64()), pa.array(keys[at, 3], pa.int64()), pa.array(np.full(at.size, salt), pa.int32()), pa.array(n), pa.array(ends - starts, pa.int32()), _binary(_encode(mm), ends, starts), none if flag else _binary(ww, ends, starts)],
            names=DIGEST.names,
        )


def _clean(s: Series) -> pa.RecordBatch | None:
    """Blocks again, one per series, repeats gone, with the day of position 0."""
    start = [None if d is None else d.toordinal() - 719163 for d in s.extra["start_date"]]
    ps, vs = [], []
    for b, e in zip(s.starts.tolist(), s.ends.tolist()):
        ps.append(np.diff(s.pos[b:e], prepend=0).astype("<i4").tobytes())
        vs.append(_encode(s.v[b:e]).tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(s.object_id), pa.array(s.lon_i), pa.array(s.lat_i), pa.array(s.tag), pa.array(s.counts, pa.int32()), pa.array(ps, pa.binary()), pa.array(vs, pa.binary()), pa.array(start, pa.int32())], names=DAYS.names
    )


def readings(obs: DataFrame, objects: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """Every reading once, as one block per series (DAYS), written to the shared folder for the passes over it."""
    clean = per_series(with_objects(pack(obs), objects), _clean, DAYS, ("start_date",))
    return materialise(clean, "readings", scratch)


def _keys(batches: list[pa.RecordBatch], grains: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each grain: group keys (groups x 4), the group of each reading, the readings."""
    rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))) if r[4]]
    if not rows:
        return
    parts = [_decode(r[5], r[6]) for r in rows]
    n = np.array([p[0].size for p in parts])
    pos, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    one = lambda i: np.array([-(2**40) if r[i] is None else r[i] for r in rows], np.int64)
    tag, start = one(3), one(7)
    for grain in grains:
        if grain == GRAINS["day"]:
            day = np.repeat(start, n) + pos
            known = np.repeat(start, n) > -(2**40)
            code, vv = ((day + 2**20) * 8 + np.repeat(tag, n) + 4)[known], v[known]
            u, inv = np.unique(code, return_inverse=True)
            keys = np.stack([np.full(u.size, grain), u % 8 - 4, u // 8 - 2**20, np.zeros(u.size, int)], axis=1)
            yield keys, inv, vv
            continue
        a = {GRAINS["all"]: np.zeros(n.size, np.int64), GRAINS["cell"]: one(1), GRAINS["object"]: one(0)}[grain]
        b = one(2) if grain == GRAINS["cell"] else np.zeros(n.size, np.int64)
        u, inv = np.unique(np.stack([np.full(n.size, grain), tag, a, b], axis=1), axis=0, return_inverse=True)
        yield u, np.repeat(inv.ravel(), n), v


class _Held:
    """Digests of a task, grouped over its batches."""

    def __init__(self, salt: int, delta: float):
        self.salt, self.delta = salt, delta
        self.index: dict[tuple, int] = {}
        self.g, self.m, self.w, self.size = [], [], [], 0

    def add(self, keys: np.ndarray, g: np.ndarray, m: np.ndarray, w: np.ndarray) -> None:
        if not g.size:
            return
        to = np.array([self.index.setdefault(tuple(k), len(self.index)) for k in keys.tolist()])
        self.g.append(to[g])
        self.m.append(m)
        self.w.append(w)
        self.size += g.size

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.g:
            keys = np.array(list(self.index), np.int64)
            yield from _rows(keys, *cluster(np.concatenate(self.g), np.concatenate(self.m), np.concatenate(self.w), len(keys), self.delta), self.salt)
        self.index, self.g, self.m, self.w, self.size = {}, [], [], [], 0


def _by_size(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[list[pa.RecordBatch]]:
    """Slices of the batches with about as many readings each."""
    held, size = [], 0
    for b in batches:
        sizes = b.column(column).to_numpy(zero_copy_only=False)
        begin = 0
        for i, x in enumerate(sizes.tolist(), 1):
            size += x
            if size >= most:
                held.append(b.slice(begin, i - begin))
                yield held
                held, size, begin = [], 0, i
        if begin < b.num_rows:
            held.append(b.slice(begin))
    if held:
        yield held


def _digest(grains: Sequence[int], delta: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = _Held(TaskContext.get().partitionId() // FAN % PARTS, delta)
        for part in _by_size(batches, 4, 400_000):
            for keys, g, v in _keys(part, grains):
                held.add(keys, *cluster(g, v, None, len(keys), delta))
            if held.size > HELD:
                yield from held.flush()
        yield from held.flush()

    return run


def _unbinary(size: int, m: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    mean = np.frombuffer(m, "<i4") / 100.0 if len(m) == 4 * size else np.frombuffer(m, "<f8")
    return mean, np.frombuffer(w, "<f8") if w else np.ones(size)


def _load(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """DIGEST rows, equal keys adjacent, to keys and centroids."""
    index: dict[tuple, int] = {}
    g = [index.setdefault(r[:4], len(index)) for r in rows]
    parts = [_unbinary(r[6], r[7], r[8]) for r in rows]
    return np.array(list(index), np.int64).reshape(-1, 4), np.repeat(np.array(g), [r[6] for r in rows]), np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _grouped(fn: Callable[[list[tuple]], Iterator[pa.RecordBatch]]) -> Callable:
    """Whole groups of sorted DIGEST rows, many at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                if size >= 500_000 and r[:5] != rows[-1][:5]:
                    yield from fn(rows)
                    rows, size = [], 0
                rows.append(r)
                size += r[6]
        if rows:
            yield from fn(rows)

    return run


def _merge(delta: float, keep_salt: bool) -> Callable:
    def fn(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for salt in sorted({r[4] for r in rows}) if keep_salt else [None]:
            keys, g, m, w = _load([r for r in rows if salt is None or r[4] == salt])
            yield from _rows(keys, *cluster(g, m, w, len(keys), delta), salt or 0)

    return _grouped(fn)


def merge(digests: DataFrame, delta: float = DELTA) -> DataFrame:
    """One digest per group. Any group, a hot cell or day as well as a whole variable, may have a digest from every task: they are merged in PARTS parts, then those."""
    order = [*KEY, "salt"]
    once = digests.repartition(*order).sortWithinPartitions(*order).mapInArrow(_merge(delta, True), DIGEST)
    return once.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_merge(delta, False), DIGEST)


def digests(blocks: DataFrame, grains: Sequence[str], delta: float = DELTA) -> DataFrame:
    """One digest (DIGEST) per group of each grain, from blocks of readings()."""
    part = blocks.mapInArrow(_digest([GRAINS[x] for x in grains], delta), DIGEST)
    return merge(part, delta)


def roll_up(kept: DataFrame, delta: float = DELTA) -> DataFrame:
    """Digests kept per object, day or cell combined into those of each variable as a whole.

    Digests per day lack the readings of unknown objects: certify their sum over the
    blocks whose start is known.
    """
    whole = kept.withColumns({"grain": F.lit(GRAINS["all"]), "a": F.lit(0).cast("long"), "b": F.lit(0).cast("long"), "salt": F.pmod(F.xxhash64("a", "b"), F.lit(PARTS)).cast("int")})
    return merge(whole.select(*DIGEST.names), delta)


def _estimates(ps: Sequence[float]) -> Callable:
    def fn(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, g, m, w = _load(rows)
        est = quantiles(g, m, w, len(keys), ps)
        n = np.rint(np.bincount(g, weights=w, minlength=len(keys))).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0], pa.int32()), pa.array(keys[:, 1], pa.int32()), pa.array(keys[:, 2]), pa.array(keys[:, 3]), pa.array(n), pa.array(list(est), pa.list_(pa.float64()))], names=[*KEY, "n", "est"])

    return _grouped(fn)


COUNTS = "grain int, tag int, a long, b long, below array<long>, upto array<long>"


def _count(grains: Sequence[int], sent) -> Callable:
    """Readings below and up to each estimate, per task and group. sent: broadcast of (sorted keys, estimates)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, est = sent.value
        index = {tuple(k): i for i, k in enumerate(keys.tolist())}
        size, ps = est.shape
        below, upto = np.zeros((size, ps), np.int64), np.zeros((size, ps), np.int64)
        for part in _by_size(batches, 4, 400_000):
            for own, g, v in _keys(part, grains):
                to = np.array([index.get(tuple(k), -1) for k in own.tolist()])
                if (to < 0).any():  # groups without estimate are not asked for
                    at = np.flatnonzero(to >= 0)
                    new = np.full(to.size, -1)
                    new[at] = np.arange(at.size)
                    keep = new[g] >= 0
                    g, v, to = new[g[keep]], v[keep], to[at]
                for j in range(ps):
                    e = est[to, j][g]
                    below[to, j] += np.bincount(g[v < e], minlength=to.size)
                    upto[to, j] += np.bincount(g[v <= e], minlength=to.size)
        at = np.flatnonzero(upto.any(axis=1))
        for i in range(0, at.size, 50_000):
            k = at[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(keys[k, 0], pa.int32()), pa.array(keys[k, 1], pa.int32()), pa.array(keys[k, 2]), pa.array(keys[k, 3]), pa.array(list(below[k])), pa.array(list(upto[k]))], names=[*KEY, "below", "upto"])

    return run


def _count_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _count, of blocks that carry the estimates of their object; one row per block."""
    for b in batches:
        rows = list(zip(*(b.column(i).to_pylist() for i in range(b.num_columns))))
        parts = [_decode(r[5], r[6])[1] for r in rows]
        if not rows:
            continue
        n = np.array([v.size for v in parts])
        v, g, est = np.concatenate(parts), np.repeat(np.arange(n.size), n), np.array([r[8] for r in rows])
        count = lambda op: np.stack([np.bincount(g[op(v, est[g, j])], minlength=n.size) for j in range(est.shape[1])], 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([GRAINS["object"]] * n.size, pa.int32()), pa.array([r[3] for r in rows], pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([0] * n.size, pa.int64()), pa.array(list(count(np.less))), pa.array(list(count(np.less_equal)))],
            names=[*KEY, "below", "upto"],
        )


def certify(blocks: DataFrame, merged: DataFrame, grains: Sequence[str], ps: Sequence[float] = PERCENTILES, delta: float = DELTA, scratch: list[str] | None = None) -> DataFrame:
    """Percentiles of the merged digests with their counted rank errors.

    Columns grain, tag, a, b, n, est, rank_error (both arrays by percentile),
    within_bound. Estimates of variables, cells and days are sent to every task: there
    are at most four variables, 67,721 cells in the largest catalogued grid and 36,525 days in a
    century. Those of objects, of which there is no such bound, meet the
    object's blocks by a join, dealt over DEALT parts of each object.
    """
    spark = blocks.sparkSession
    bounded = [GRAINS[x] for x in grains if x != "object"]
    est = merged.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_estimates(ps), "grain int, tag int, a long, b long, n long, est array<double>")
    est = materialise(est, "estimates", scratch)
    counts = []
    if bounded:
        got = est.where(F.col("grain").isin(bounded)).select(*KEY, "est").toPandas()
        keys = got[KEY].to_numpy(np.int64).reshape(-1, 4)
        values = np.array(got["est"].tolist(), float).reshape(-1, len(ps))
        counts.append(blocks.mapInArrow(_count(bounded, spark.sparkContext.broadcast((keys, values))), COUNTS))
    if "object" in grains:
        part = F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))
        own = est.where(F.col("grain") == GRAINS["object"]).select(F.col("a").alias("object_id"), "tag", "est", part.alias("part"))
        dealt = blocks.where("n > 0").withColumn("part", F.pmod(F.xxhash64("lon_i", "lat_i"), F.lit(DEALT)).cast("int"))
        counts.append(dealt.join(own, ["object_id", "tag", "part"]).select(*DAYS.names, "est").mapInArrow(_count_own, COUNTS))
    counts = counts[0] if len(counts) == 1 else counts[0].unionByName(counts[1])
    cols = [F.sum(F.col(x)[j]).alias(f"{x}{j}") for x in ("below", "upto") for j in range(len(ps))]
    counts = counts.groupBy(*KEY).agg(*cols)
    n = F.col("n").cast("double")
    errors = [F.greatest(F.lit(0.0), F.lit(p) - F.col(f"upto{j}") / n, F.col(f"below{j}") / n - F.lit(p)) for j, p in enumerate(ps)]
    bounds = [F.lit(float(4 * np.pi * np.sqrt(p * (1 - p)) / delta)) + 1 / n for p in ps]
    fine = F.lit(True)
    for e, b in zip(errors, bounds):
        fine = fine & (e <= b)
    return est.join(counts, KEY).select(*KEY, "n", "est", F.array(*errors).alias("rank_error"), fine.alias("within_bound"))


def named(df: DataFrame, ps: Sequence[float] = PERCENTILES) -> DataFrame:
    """certify()'s result with readable keys: grain, var, lon_i, lat_i, day, object_id, n, one column per percentile, max_rank_error, within_bound."""
    g = F.col("grain")
    names = F.when(g == 0, "all").when(g == 1, "cell").when(g == 2, "day").otherwise("object")
    var = F.when(F.col("tag") == TAGS["rain"], "rain").when(F.col("tag") == TAGS["tmax"], "tmax").when(F.col("tag") == TAGS["tmin"], "tmin")
    return df.select(
        names.alias("grain"),
        var.alias("var"),
        F.when(g == 1, F.col("a")).cast("int").alias("lon_i"),
        F.when(g == 1, F.col("b")).cast("int").alias("lat_i"),
        F.when(g == 2, F.date_from_unix_date(F.col("a").cast("int"))).alias("day"),
        F.when(g == 3, F.col("a")).alias("object_id"),
        "n",
        *[F.col("est")[j].alias(f"p{round(p * 100):02d}") for j, p in enumerate(ps)],
        F.array_max("rank_error").alias("max_rank_error"),
        "within_bound",
    )


def percentiles(obs: DataFrame, objects: DataFrame, grains: Sequence[str] = ("all", "cell", "day"), ps: Sequence[float] = PERCENTILES, delta: float = DELTA) -> DataFrame:
    """Certified percentiles of grid_obs.value per group of each grain (by variable; by variable and cell; by variable and day; by variable and object).

    Each reading counts once however often it was sent; NULL and -999 are none. A
    reading of an unknown object has no day and is left out of the day grain only.
    Variables other than rain, tmax and tmin share the group var NULL. Equal values
    are fine: a certificate counts the whole tie as the estimate's rank range. Groups
    without reading, and empty tables, give no rows.
    """
    scratch: list[str] = []
    blocks = readings(obs, objects, scratch)
    merged = digests(blocks, grains, delta)
    return settle(named(certify(blocks, merged, grains, ps, delta, scratch), ps), scratch)
