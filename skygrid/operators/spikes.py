"""Implausible readings per series: impossible values, stuck stretches and spikes.

Each series is decomposed by an undecimated Haar wavelet. Its first-level detail
coefficients (differences of successive readings) are scaled by their own robust
scatter (median absolute deviation) and thresholded: a large coefficient opens
and a large one of the other sign closes a spike of one or two days. Runs of zero
detail are stuck stretches; bounds find impossible readings. Every candidate is
then checked exactly: it must leave the level of the surrounding days and the
days next to it must be back at that level, so long spells do not count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skygrid.operators.series import TAGS, Series, pack, per_series

#: Bounds beyond which a reading is impossible.
RAIN_BOUNDS = (0.0, 2000.0)
TEMP_BOUNDS = (-60.0, 60.0)
STUCK_LENGTH = 6
#: Detail coefficients beyond this many robust standard deviations open or close a candidate.
DETAIL_Z = 3.0
#: A temperature spike leaves its level by at least this many robust standard deviations of the series about its level.
TEMP_Z = 6.5
RAIN_RATIO = 4.0
#: Part of a series' wet readings that can be rain spikes: what comes more often than that is how the series is.
RAIN_CASES = 1 / 3
#: Readings on either side that make up the level.
SIDE = 4

FOUND = T.StructType([T.StructField("object_id", T.LongType()), T.StructField("lon_i", T.IntegerType()), T.StructField("lat_i", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("reason", T.StringType())])


def group_median(sid: np.ndarray, x: np.ndarray, groups: int) -> np.ndarray:
    """Median of x within each group, NaN for empty groups; sid ascending."""
    order = np.lexsort((x, sid))
    y = x[order]
    n = np.bincount(sid, minlength=groups)
    start = np.cumsum(n) - n
    out = np.full(groups, np.nan)
    has = n > 0
    lo, hi = start[has] + (n[has] - 1) // 2, start[has] + n[has] // 2
    out[has] = (y[lo] + y[hi]) / 2.0
    return out


def side_median(v: np.ndarray, sid: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """Median of the readings at the given offsets that lie in the same series, NaN if there are none."""
    n = v.size
    m = np.full((len(offsets), n), np.inf)
    idx = np.arange(n)
    for k, o in enumerate(offsets):
        j = idx + o
        ok = (j >= 0) & (j < n)
        jj = np.clip(j, 0, n - 1)
        ok &= sid[jj] == sid
        m[k] = np.where(ok, v[jj], np.inf)
    m.sort(axis=0)
    have = np.isfinite(m).sum(axis=0)
    lo, hi = np.maximum(have - 1, 0) // 2, have // 2
    hi = np.minimum(hi, len(offsets) - 1)
    out = (m[lo, idx] + m[np.where(have > 0, hi, 0), idx]) / 2.0
    return np.where(have > 0, out, np.nan)


def runs(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run, given True where a new run starts."""
    starts = np.flatnonzero(change)
    return starts, np.diff(np.append(starts, change.size))


def haar_detail(v: np.ndarray, sid: np.ndarray) -> np.ndarray:
    """Undecimated first-level Haar detail: half the difference to the reading before, NaN at a series' first."""
    d = np.full(v.size, np.nan)
    if v.size:
        d[1:] = np.where(sid[1:] == sid[:-1], (v[1:] - v[:-1]) / 2.0, np.nan)
    return d


def stuck_mask(v: np.ndarray, sid: np.ndarray, rain: np.ndarray, length: int = STUCK_LENGTH) -> np.ndarray:
    """Readings in runs of zero detail, rain of 0 excepted."""
    if not v.size:
        return np.zeros(0, bool)
    starts, n = runs(~(haar_detail(v, sid) == 0.0))
    long = (n >= length) & ~(rain[starts] & (v[starts] == 0.0))
    return np.repeat(long, n)


def temperature_spikes(v: np.ndarray, sid: np.ndarray, pos: np.ndarray, groups: int, calm: np.ndarray) -> np.ndarray:
    """Spikes of one or two successive days; calm marks the readings from which scatter is taken."""
    n = v.size
    out = np.zeros(n, bool)
    if n < 3:
        return out
    near = tuple(o for o in range(-SIDE, SIDE + 1) if o)
    level = side_median(v, sid, near)
    resid = np.abs(v - level)
    use = calm & np.isfinite(resid)
    scale = 1.4826 * group_median(sid[use], resid[use], groups)
    d = haar_detail(v, sid)
    have = np.isfinite(d) & calm
    dscale = 1.4826 * group_median(sid[have], np.abs(d[have]), groups)
    big = np.abs(np.nan_to_num(d)) > DETAIL_Z * np.nan_to_num(dscale, nan=np.inf)[sid]
    for width in (1, 2):
        i = np.arange(1, n - width)
        j = i + width
        ok = (sid[i - 1] == sid[i]) & (sid[j] == sid[i]) & big[i] & big[j] & (d[i] * d[j] < 0)
        if width == 2:
            ok &= pos[i + 1] - pos[i] == 1
        i, j = i[ok], j[ok]
        if not i.size:
            continue
        m = np.full((2 * SIDE, i.size), np.inf)
        for k in range(SIDE):
            for row, q in ((k, i - 1 - k), (SIDE + k, j + k)):
                qq = np.clip(q, 0, n - 1)
                fine = (q >= 0) & (q < n) & (sid[qq] == sid[i])
                m[row] = np.where(fine, v[qq], np.inf)
        m.sort(axis=0)
        have_n = np.isfinite(m).sum(axis=0)
        at = np.arange(i.size)
        lev = (m[(have_n - 1) // 2, at] + m[np.minimum(have_n // 2, 2 * SIDE - 1), at]) / 2.0
        first, second = v[i] - lev, v[j - 1] - lev
        size = np.minimum(np.abs(first), np.abs(second))
        back = np.maximum(np.abs(v[i - 1] - lev), np.abs(v[j] - lev))
        hit = (first * second > 0) & (size >= TEMP_Z * np.nan_to_num(scale, nan=np.inf)[sid[i]]) & (back < 0.5 * size) & (size > 0)
        for w in range(width):
            out[i[hit] + w] = True
    return out


def rain_spikes(v: np.ndarray, sid: np.ndarray, groups: int, calm: np.ndarray) -> np.ndarray:
    """Readings at least RAIN_RATIO times the largest reading of their series apart from cases, back at the level within two days.

    Going down from a series' largest readings, the deepest gap of that ratio within
    the upper RAIN_CASES of its wet readings separates the cases from the weather.
    """
    n = v.size
    out = np.zeros(n, bool)
    use = np.flatnonzero(calm & (v > 0))
    if not use.size:
        return out
    order = use[np.lexsort((-v[use], sid[use]))]
    s, x = sid[order], v[order]
    wet = np.bincount(s, minlength=groups)
    start = np.cumsum(wet) - wet
    rank = np.arange(order.size) - start[s]
    below = np.append(x[1:], 0.0)
    below[np.append(s[1:] != s[:-1], True)] = 0.0
    gap = (x >= RAIN_RATIO * below) & (below > 0) & (rank < np.maximum(np.floor(wet[s] * RAIN_CASES + 1e-9), 1))
    last = np.full(groups, -1)
    np.maximum.at(last, s[gap], rank[gap])
    cand = np.zeros(n, bool)
    cand[order[rank <= last[s]]] = True
    # one or two readings in a row, no more
    change = np.ones(n, bool)
    change[1:] = (cand[1:] != cand[:-1]) | (sid[1:] != sid[:-1])
    st, ln = runs(change)
    # the details that open and close it stand out of the series' own
    d = haar_detail(v, sid)
    have = np.isfinite(d) & calm
    bound = DETAIL_Z * 1.4826 * np.nan_to_num(group_median(sid[have], np.abs(d[have]), groups))
    after = np.append(d, np.nan)[st + ln]
    opens = ~(d[st] <= bound[sid[st]])
    closes = ~(after >= -bound[sid[st]])
    return cand & np.repeat((ln <= 2) & opens & closes, ln)


def flag(s: Series) -> pa.RecordBatch | None:
    """reason: impossible before stuck before spike."""
    v, sid = s.v, s.sid
    rain = (s.tag == TAGS["rain"])[sid]
    temp = ((s.tag == TAGS["tmax"]) | (s.tag == TAGS["tmin"]))[sid]
    lo, hi = np.where(rain, RAIN_BOUNDS[0], TEMP_BOUNDS[0]), np.where(rain, RAIN_BOUNDS[1], TEMP_BOUNDS[1])
    impossible = (rain | temp) & ((v < lo) | (v > hi))
    stuck = stuck_mask(v, sid, rain)
    spike = np.zeros(v.size, bool)
    groups = s.counts.size
    for pick, kind in ((temp, "t"), (rain, "r")):
        at = np.flatnonzero(pick & ~impossible)
        if at.size:
            calm = ~stuck[at]
            spike[at] = temperature_spikes(v[at], sid[at], s.pos[at], groups, calm) if kind == "t" else rain_spikes(v[at], sid[at], groups, calm)
    hit = np.flatnonzero(impossible | stuck | spike)
    if not hit.size:
        return None
    reason = np.where(impossible[hit], "impossible", np.where(stuck[hit], "stuck", "spike"))
    k = sid[hit]
    return pa.RecordBatch.from_arrays([pa.array(s.object_id[k]), pa.array(s.lon_i[k]), pa.array(s.lat_i[k]), pa.array(s.pos[hit]), pa.array(reason.tolist(), pa.string())], names=FOUND.names)


def implausible(obs: DataFrame) -> DataFrame:
    """One row (series key, pos, reason) per implausible reading of grid_obs.

    NULL and -999 are no readings; a repeated row counts once; rows without key or
    position are left out. A series of an unknown variable has no bounds and no
    spike rule, only stuck stretches. An empty table gives no rows. Other columns
    of obs, whatever their names, are not looked at.
    """
    return per_series(pack(obs), flag, FOUND)
