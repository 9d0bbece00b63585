"""Aggregates over trailing windows of days, for every series and every day of its object.

The active window of each series is kept as a two-stack monoid queue: the back
stack holds running (prefix) aggregates of what was pushed since the last flip,
the front stack the suffix aggregates of what remains of the batch flipped last;
the window's aggregate is front combined with back. No element is ever
subtracted, so minima and maxima work like sums. Over a dense day axis a window
of w days flips after every w pushes; ``window_scan`` runs the queues of many
series at once, one flip per w columns, as vector operations. ``TwoStackQueue``
is the same structure for any monoid, one element at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skygrid.operators.series import Series, pack, per_series, with_objects

#: Monoids that can be asked for: name to (combine, identity).
MONOIDS: dict[str, tuple[np.ufunc, float]] = {"sum": (np.add, 0), "min": (np.minimum, np.inf), "max": (np.maximum, -np.inf)}


class TwoStackQueue:
    """First-in first-out window with an aggregate over any monoid in amortised constant time."""

    def __init__(self, combine: Callable[[Any, Any], Any], identity: Any):
        self.combine, self.identity = combine, identity
        self.front: list[Any] = []  # suffix aggregates, the oldest element on top
        self.back: list[Any] = []
        self.back_total = identity

    def push(self, x: Any) -> None:
        self.back.append(x)
        self.back_total = self.combine(self.back_total, x)

    def pop(self) -> None:
        if not self.front:
            total = self.identity
            while self.back:
                total = self.combine(self.back.pop(), total)
                self.front.append(total)
            self.back_total = self.identity
        self.front.pop()

    def value(self) -> Any:
        return self.combine(self.front[-1], self.back_total) if self.front else self.back_total

    def __len__(self) -> int:
        return len(self.front) + len(self.back)


def window_scan(x: np.ndarray, lengths: np.ndarray, w: int, combine: np.ufunc, identity: float) -> np.ndarray:
    """Trailing-window aggregates of the concatenated dense series x with the given lengths."""
    if not x.size:
        return x.copy()
    # each series starts at a flip and has w - 1 identities before it
    room = -(-(lengths + w - 1) // w) * w
    begin = np.cumsum(room) - room
    own = np.cumsum(lengths) - lengths
    at = np.arange(x.size) + np.repeat(begin + (w - 1) - own, lengths)
    padded = np.full(int(room.sum()), identity, x.dtype)
    padded[at] = x
    grid = padded.reshape(-1, w)
    back = combine.accumulate(grid, axis=1).ravel()
    front = combine.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    full = (at + 1) % w == 0
    return np.where(full, back[at], combine(front[at - (w - 1)], back[at]))


def schema(windows: Sequence[int], aggs: Sequence[str]) -> T.StructType:
    fields = [T.StructField("object_id", T.LongType()), T.StructField("lon_i", T.IntegerType()), T.StructField("lat_i", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("day", T.DateType())]
    for w in windows:
        fields += [T.StructField(f"{a}_{w}", T.DoubleType()) for a in aggs] + [T.StructField(f"n_{w}", T.LongType())]
    return T.StructType(fields)


def _roll(windows: Sequence[int], aggs: Sequence[str], names: list[str]) -> Callable[[Series], pa.RecordBatch | None]:
    def run(s: Series) -> pa.RecordBatch | None:
        # an unknown object's days end with its last reading
        last = np.full(s.counts.size, -1)
        some = s.counts > 0
        last[some] = s.pos[s.ends[some] - 1]
        days = np.array([l + 1 if d is None else d for d, l in zip(s.extra["days"], last.tolist())], np.int64)
        total = int(days.sum())
        if not total:
            return None
        begin = np.cumsum(days) - days
        inside = (s.pos >= 0) & (s.pos < days[s.sid])
        at = begin[s.sid[inside]] + s.pos[inside]
        seen = np.zeros(total, np.int64)
        seen[at] = 1
        v = s.v[inside]
        cents = np.rint(v * 100.0)
        whole = bool((np.abs(cents) < 2**40).all() and (cents / 100.0 == v).all())
        sid = np.repeat(np.arange(days.size), days)
        pos = (np.arange(total) - begin[sid]).astype(np.int32)
        starts = np.array([-(2**31) if d is None else d.toordinal() - 719163 for d in s.extra["start_date"]], np.int64)
        known = starts[sid] > -(2**31)
        day = pa.array(np.where(known, starts[sid] + pos, 0).astype(np.int32), pa.int32(), mask=~known).cast(pa.date32())
        out = [pa.array(s.object_id[sid]), pa.array(s.lon_i[sid]), pa.array(s.lat_i[sid]), pa.array(pos), day]
        for w in windows:
            n = window_scan(seen, days, w, np.add, 0)
            none = n == 0
            sums = None
            for a in aggs:
                if a in ("sum", "mean"):
                    if sums is None:
                        dense = np.zeros(total, np.int64 if whole else np.float64)
                        dense[at] = cents.astype(np.int64) if whole else v
                        sums = window_scan(dense, days, w, np.add, 0)
                        sums = sums / 100.0 if whole else sums
                    got = sums if a == "sum" else sums / np.maximum(n, 1)
                else:
                    combine, identity = MONOIDS[a]
                    dense = np.full(total, identity)
                    dense[at] = v
                    got = window_scan(dense, days, w, combine, identity)
                out.append(pa.array(got, pa.float64(), mask=none))
            out.append(pa.array(n))
        return pa.RecordBatch.from_arrays(out, names=names)

    return run


def rolling(obs: DataFrame, objects: DataFrame, windows: Sequence[int] = (7, 30), aggs: Sequence[str] = ("sum", "mean")) -> DataFrame:
    """One row per series of obs and day of its object, with aggregates over the last w days, that day included.

    aggs: sum, mean, min, max; n_w is the number of readings. Each day's reading
    counts once; NULL and -999 are none. Without a reading in the window the
    aggregates are NULL and n is 0. A series with no reading at all still has all
    its days. The days come from start_day and end_day; for an object that is not
    in objects they end with the last reading and day is NULL. Readings outside
    the object's days belong to no day. Empty tables give no rows.
    """
    if not windows or any(w < 1 for w in windows) or any(a not in (*MONOIDS, "mean") for a in aggs):
        raise ValueError("windows must be positive and aggs among sum, mean, min, max")
    out = schema(windows, aggs)
    return per_series(with_objects(pack(obs), objects), _roll(tuple(windows), tuple(aggs), out.names), out, ("start_date", "days"), "days")
