"""Runs of the same or nearly the same value at successive positions, collapsed into one event each.

A streaming state machine walks each series in order of position. It holds one
open run (anchor value, first and last position, readings). A reading within the
tolerance of the anchor and within the time gap extends the run; any other closes
it, emits it if it is long enough, and opens the next. The anchor is the run's
latest reading, or its first with anchor="first". ``RunMachine`` is that machine,
one reading at a time; for the moving anchor ``close_runs`` makes the same
transitions for whole batches of series at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skygrid.operators.series import Series, pack, per_series, with_objects

RUNS = T.StructType(
    [
        T.StructField("object_id", T.LongType()),
        T.StructField("lon_i", T.IntegerType()),
        T.StructField("lat_i", T.IntegerType()),
        T.StructField("first_pos", T.IntegerType()),
        T.StructField("last_pos", T.IntegerType()),
        T.StructField("readings", T.LongType()),
        T.StructField("first_value", T.DoubleType()),
        T.StructField("last_value", T.DoubleType()),
    ]
)


class RunMachine:
    """One series; values in whole hundredths. push() and finish() return finished runs as (first, last, readings, first index)."""

    def __init__(self, tolerance: int, gap: int, least: int, anchor: str = "last"):
        self.tolerance, self.gap, self.least, self.anchor = tolerance, gap, least, anchor
        self.open: tuple[int, int, int, int, int] | None = None
        self.seen = 0

    def push(self, pos: int, cents: int) -> list[tuple[int, int, int, int]]:
        i, self.seen = self.seen, self.seen + 1
        if self.open is not None:
            held, first, last, n, at = self.open
            if pos - last <= self.gap and abs(cents - held) <= self.tolerance:
                self.open = (cents if self.anchor == "last" else held, first, pos, n + 1, at)
                return []
        done = self.finish()
        self.open = (cents, pos, pos, 1, i)
        return done

    def finish(self) -> list[tuple[int, int, int, int]]:
        done = [self.open[1:]] if self.open is not None and self.open[3] >= self.least else []
        self.open = None
        return done


def close_runs(sid: np.ndarray, pos: np.ndarray, cents: np.ndarray, tolerance: int, gap: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of at least the given length, by the moving anchor."""
    if not pos.size:
        return np.zeros(0, int), np.zeros(0, int)
    closes = np.ones(pos.size, bool)
    closes[1:] = (sid[1:] != sid[:-1]) | (pos[1:] - pos[:-1] > gap) | (np.abs(cents[1:] - cents[:-1]) > tolerance)
    start = np.flatnonzero(closes)
    n = np.diff(np.append(start, pos.size))
    return start[n >= least], n[n >= least]


def _collapse(tolerance: float, gap: int, least: int, anchor: str) -> Callable[[Series], pa.RecordBatch | None]:
    tol = round(tolerance * 100)

    def run(s: Series) -> pa.RecordBatch | None:
        cents = np.rint(np.clip(s.v, -9e13, 9e13) * 100.0).astype(np.int64)
        if anchor == "last":
            start, n = close_runs(s.sid, s.pos, cents, tol, gap, least)
        else:
            found = []
            for b, e in zip(s.starts.tolist(), s.ends.tolist()):
                m = RunMachine(tol, gap, least, anchor)
                done = [r for p, c in zip(s.pos[b:e].tolist(), cents[b:e].tolist()) for r in m.push(p, c)] + m.finish()
                found += [(b + r[3], r[2]) for r in done]
            start, n = np.array([f[0] for f in found], int), np.array([f[1] for f in found], int)
        if not start.size:
            return None
        k, end = s.sid[start], start + n - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(s.object_id[k]), pa.array(s.lon_i[k]), pa.array(s.lat_i[k]), pa.array(s.pos[start]), pa.array(s.pos[end]), pa.array(n.astype(np.int64)), pa.array(s.v[start]), pa.array(s.v[end])],
            names=RUNS.names,
        )

    return run


def collapse(obs: DataFrame, tolerance: float = 0.05, gap: int = 1, least: int = 3, anchor: str = "last") -> DataFrame:
    """One row per maximal run of at least `least` readings of a series.

    Readings are the non-missing values (not NULL, not -999), each position once
    however often it was sent. Values compare in whole hundredths. Ties and
    repeated rows make no difference; rows without key or position are left out;
    an empty table gives no rows; other columns are not looked at.
    """
    if anchor not in ("last", "first") or gap < 1 or least < 1:
        raise ValueError("anchor is last or first; gap and least are at least 1")
    return per_series(pack(obs), _collapse(tolerance, gap, least, anchor), RUNS)


def events(obs: DataFrame, objects: DataFrame, **kwargs) -> DataFrame:
    """collapse() with first and last day and the share of the object's days that the run lasts (by start_day and end_day; NULL for an unknown object)."""
    runs = with_objects(collapse(obs, **kwargs), objects)
    return runs.select(
        *RUNS.names,
        F.date_add("start_date", F.col("first_pos")).alias("first_day"),
        F.date_add("start_date", F.col("last_pos")).alias("last_day"),
        F.try_divide((F.col("last_pos") - F.col("first_pos") + 1).cast("double"), F.col("days").cast("double")).alias("share"),
    )
