import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skygrid.operators import rolling, spikes
from skygrid.operators.series import Series, pack, per_series


def weather(n, seed, level=20.0, scatter=1.0):
    r = random.Random(seed)
    return [round(level + 5 * np.sin(i / 60) + r.gauss(0, scatter), 2) for i in range(n)]


def found(df, reason=None):
    return sorted((r["object_id"], r["pos"]) for r in df.collect() if reason is None or r["reason"] == reason)


def test_steps_count_days_not_readings():
    import pyarrow as pa

    from skygrid.operators import series

    n, seen = 100, []
    empty = [pa.array(range(n), pa.int64()), *(pa.array([1] * n, pa.int32()) for _ in range(3)), pa.array([0] * n, pa.int32()), pa.array([b""] * n), pa.array([b""] * n), pa.array([10_958] * n, pa.int32())]
    batch = pa.RecordBatch.from_arrays(empty, names=[*series.BLOCK.names, "days"])
    list(series._stream(lambda s: seen.append(s.counts.size), ("days",), "days")([batch]))
    assert sum(seen) == n and max(seen) * 10_958 <= series.STEP


def test_ten_thousand_empty_series_fit(tmp_path):
    code = '''
import resource
import numpy as np, pyarrow as pa
from skygrid.operators import rolling, series
n = 10_000
cols = [pa.array(range(n), pa.int64()), *(pa.array([1] * n, pa.int32()) for _ in range(3)), pa.array([0] * n, pa.int32()), pa.array([b""] * n), pa.array([b""] * n), pa.array([None] * n, pa.date32()), pa.array([10_958] * n, pa.int32())]
b = pa.RecordBatch.from_arrays(cols, names=[*series.BLOCK.names, "start_date", "days"])
out = rolling.schema((7, 30), ("sum", "mean"))
rows = sum(x.num_rows for x in series._stream(rolling._roll((7, 30), ("sum", "mean"), out.names), ("start_date", "days"), "days")([b]))
print(rows, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
'''
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    rows, mb = map(int, subprocess.run([sys.executable, "-c", code], cwd=root, env={**os.environ, "PYTHONPATH": root}, capture_output=True, text=True, check=True).stdout.split())
    assert rows == 10_000 * 10_958 and mb < 1000


def test_spikes_of_one_and_two_days_but_no_spell(obs_of):
    a = weather(200, 1)
    a[50] += 15
    a[90] -= 14
    a[91] -= 20
    for i in range(120, 126):
        a[i] += 12
    r = random.Random(5)
    rain = [round(max(0.0, r.gauss(-2, 6)), 2) for _ in range(200)]
    top = max(rain)
    rain[77] = round(top * 6, 2)
    got = spikes.implausible(obs_of({(1, "tmax"): a, (2, "rain"): rain}))
    assert found(got, "spike") == [(1, 50), (1, 90), (1, 91), (2, 77)]


def test_impossible_and_stuck_by_brute_force(obs_of):
    r = random.Random(3)
    series = {}
    for o in range(6):
        var = ("rain", "tmax", "tmin")[o % 3]
        vs = [round(r.uniform(5, 30), 2) for _ in range(60)]
        at = r.randrange(0, 50)
        vs[at : at + 6] = [vs[at]] * 6
        vs[at + 3 : at + 3] = [None, -999]
        vs[5 if at > 10 else 58] = 2000.5 if var == "rain" else 61
        if var == "rain":
            vs += [0.0] * 9
        series[o, var] = vs
    rows = [(999, 0, "rain", None, 3, 1, 2, series[0, "rain"][3], 0, "", "", 0, "")]
    want = []
    for (o, var), vs in series.items():
        ok = [(p, v) for p, v in enumerate(vs) if v is not None and v != -999]
        for k, (p, v) in enumerate(ok):
            low = high = k
            while low and ok[low - 1][1] == v:
                low -= 1
            while high + 1 < len(ok) and ok[high + 1][1] == v:
                high += 1
            bad = v < 0 or v > 2000 if var == "rain" else abs(v) > 60
            if bad or (high - low >= 5 and not (var == "rain" and v == 0)):
                want.append((o, p))
    got = spikes.implausible(obs_of(series, rows)).where("reason <> 'spike'")
    assert found(got) == sorted(want)


def test_nulls_unknown_variable_and_empty(spark, obs_of):
    extra = [(1, None, "tmax", None, 1, 1, 2, 99.0, 0, "", "", 0, ""), (2, 5, "tmax", None, None, 1, 2, 99.0, 0, "", "", 0, ""), (3, 6, None, None, 0, 1, 2, 1e9, 0, "", "", 0, ""), (4, 7, "tmax", None, 0, 1, 2, float("nan"), 0, "", "", 0, "")]
    assert found(spikes.implausible(obs_of({(1, "tmax"): [1.0, None, -999]}, extra))) == []
    assert spikes.implausible(obs_of({})).count() == 0
    assert rolling.rolling(obs_of({}), spark.createDataFrame([], "object_id long, start_day string, end_day string")).count() == 0


def test_blocks_keep_unsorted_repeated_and_unround_values(spark, obs_of):
    rows = [(i, 1, "tmax", None, p, 1, 2, v, 0, "", "", 0, "") for i, (p, v) in enumerate([(5, 1 / 3), (2, 7.25), (5, 1 / 3), (2, 9.0), (9, None), (1 << 20, -3.5)])]
    got = {}

    def take(s: Series):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(s.pos), pa.array(s.v)], names=["pos", "v"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("v", T.DoubleType())])
    for r in per_series(pack(obs_of({}, rows)), take, schema).collect():
        got[r["pos"]] = r["v"]
    assert got == {5: 1 / 3, 2: 7.25, 1 << 20: -3.5}


@given(st.lists(st.integers(-50, 50), max_size=60), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_queue_and_scan_agree_with_brute_force(xs, w):
    for combine, identity, ufunc in ((max, -(10**6), np.maximum), (lambda a, b: a + b, 0, np.add)):
        q, got = rolling.TwoStackQueue(combine, identity), []
        for x in xs:
            q.push(x)
            if len(q) > w:
                q.pop()
            got.append(q.value())
        want = []
        for i in range(len(xs)):
            t = identity
            for x in xs[max(0, i - w + 1) : i + 1]:
                t = combine(t, x)
            want.append(t)
        assert got == want
        two = rolling.window_scan(np.array(xs + xs, np.int64), np.array([len(xs), len(xs)]), w, ufunc, identity)
        assert two.tolist() == want + want


def test_rolling_by_brute_force(obs_of, objects_of):
    r = random.Random(9)
    vs = [r.choice([None, -999, round(r.uniform(-5, 5), 2)]) for _ in range(50)]
    extra = [(900, 1, "tmax", None, 4, 1, 2, 3.0 if vs[4] in (None, -999) else vs[4], 0, "", "", 0, "")]
    obs = obs_of({(1, "tmax"): vs, (2, "rain"): [-999, None], (3, "rain"): [1.5]}, extra)
    got = {(x["object_id"], x["pos"]): x for x in rolling.rolling(obs, objects_of({1: 55, 2: 4}), (7,), ("sum", "mean", "min", "max")).collect()}
    values = {p: v for p, v in enumerate(vs) if v is not None and v != -999}
    values.setdefault(4, 3.0)
    assert len(got) == 55 + 4 + 1
    for p in range(55):
        part = [values[k] for k in range(p - 6, p + 1) if k in values]
        row = got[1, p]
        assert row["n_7"] == len(part)
        if part:
            assert row["sum_7"] == pytest.approx(sum(part)) and row["mean_7"] == pytest.approx(sum(part) / len(part))
            assert (row["min_7"], row["max_7"]) == (min(part), max(part))
        else:
            assert row["sum_7"] is None and row["max_7"] is None
    assert got[2, 3]["n_7"] == 0 and got[2, 0]["day"].isoformat() == "2001-01-01"
    assert got[3, 0]["day"] is None and got[3, 0]["sum_7"] == 1.5
    with pytest.raises(ValueError):
        rolling.rolling(obs, objects_of({}), (0,))
