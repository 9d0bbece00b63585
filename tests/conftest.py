import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


OBS = "obs_id long, object_id long, var string, date date, pos int, lon_i int, lat_i int, value double, n int, p string, tag string, days int, start_date string"


@pytest.fixture(scope="session")
def obs_of(spark):
    """grid_obs rows from {(object_id, var): [values by position, None or -999 for missing]}, with columns whose names clash with internal ones."""

    def make(series, extra=()):
        rows = []
        for (o, var), vs in series.items():
            rows += [(len(rows), o, var, None, p, 1, 2, None if v is None else float(v), 7, "x", "y", -1, "z") for p, v in enumerate(vs)]
        rows += list(extra)
        return spark.createDataFrame(rows, OBS)

    return make


@pytest.fixture(scope="session")
def objects_of(spark):
    def make(days):
        rows = [(o, "2001-01-01", str(__import__("datetime").date(2001, 1, 1) + __import__("datetime").timedelta(n - 1)), None, [20.5], [70.5]) for o, n in days.items()]
        return spark.createDataFrame(rows, "object_id long, start_day string, end_day string, no_days int, lat_array array<double>, lon_array array<double>")

    return make
