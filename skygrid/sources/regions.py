"""Region classes of cells (-1 sea, 0 plains, 1 hilly, 2 coastal) from a table or an array file."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_table(cells: DataFrame) -> DataFrame:
    """lon_i, lat_i, region of a cell table; a NULL region is sea."""
    return cells.select("lon_i", "lat_i", F.coalesce("region", F.lit(-1)).cast("int").alias("region"))


def from_array_file(spark: SparkSession, path: str) -> DataFrame:
    """From a .npy file of (lon, lat) classes; a catalogued grid has at most 67,721 cells."""
    a = np.load(path)
    if a.ndim != 2 or not np.isin(a, (-1, 0, 1, 2)).all():
        raise ValueError("expected classes -1 to 2 by longitude and latitude")
    i, j = np.indices(a.shape)
    rows = list(zip(i.ravel().tolist(), j.ravel().tolist(), a.ravel().astype(int).tolist()))
    return spark.createDataFrame(rows, "lon_i int, lat_i int, region int")
