"""Grid transforms: nearest cell, clip by polygon, regridding, gap filling, region classes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygrid.model import CELL

Ring = Sequence[tuple[float, float]]
EARTH_KM = 6371.0
#: Elevation (m) of hilly cells, distance (km) of coastal ones, lowest land pixel (m).
HILLY, COASTAL, LAND_PIXEL = 1000.0, 50.0, -100.0


def nearest_cell(cells: DataFrame, lat: float, lon: float) -> DataFrame:
    """The one row of cells (lon_i, lat_i, lon, lat) nearest by axis; ties go to the lower index."""
    return cells.groupBy().agg(F.min_by("lon_i", F.struct(F.abs(F.col("lon") - lon), F.col("lon_i"))).alias("lon_i"), F.min_by("lat_i", F.struct(F.abs(F.col("lat") - lat), F.col("lat_i"))).alias("lat_i"))


def _edges(shapes: Sequence[Sequence[Ring]]) -> np.ndarray:
    """Rows x1, y1, x2, y2, shape."""
    out = [(*p, *q, k) for k, rings in enumerate(shapes) for ring in rings if len(ring) for p, q in zip(ring, [*ring[1:], ring[0]]) if tuple(p) != tuple(q)]
    return np.array(out, float).reshape(-1, 5)


def _in_any(x: np.ndarray, y: np.ndarray, edges: np.ndarray, n_shapes: int) -> np.ndarray:
    """Whether each point lies inside at least one shape (even-odd rule over the shape's own rings)."""
    x1, y1, x2, y2, shape = edges.T
    out = np.zeros(x.size, bool)
    for k in range(x.size):
        at = np.flatnonzero((y1 > y[k]) != (y2 > y[k]))
        hit = at[x[k] < x1[at] + (y[k] - y1[at]) * (x2[at] - x1[at]) / (y2[at] - y1[at])]
        out[k] = (np.bincount(shape[hit].astype(int), minlength=n_shapes) % 2 == 1).any()
    return out


def inside_union(x: np.ndarray, y: np.ndarray, edges: np.ndarray, n_shapes: int, step: float = 1e-7) -> np.ndarray:
    """Points strictly inside the union of the shapes: its boundary is outside, an edge that two of them share is not.

    A point on some edge is inside if every direction from it is: between the edges that
    leave it, a point a little way off lies inside one of the shapes.
    """
    out = _in_any(x, y, edges, n_shapes)
    x1, y1, x2, y2, _ = edges.T
    for k in range(x.size):
        cross = (x2 - x1) * (y[k] - y1) - (y2 - y1) * (x[k] - x1)
        on = np.flatnonzero((cross == 0) & (np.minimum(x1, x2) <= x[k]) & (x[k] <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= y[k]) & (y[k] <= np.maximum(y1, y2)))
        if not on.size:
            continue
        ends = np.concatenate([np.stack([x1[on], y1[on]], 1), np.stack([x2[on], y2[on]], 1)]) - (x[k], y[k])
        angle = np.unique(np.arctan2(ends[:, 1], ends[:, 0])[np.hypot(ends[:, 0], ends[:, 1]) > 0])
        between = angle + np.diff(np.append(angle, angle[0] + 2 * np.pi)) / 2
        out[k] = _in_any(x[k] + step * np.cos(between), y[k] + step * np.sin(between), edges, n_shapes).all()
    return out


def within(cells: DataFrame, shapes: Sequence[Sequence[Ring]]) -> DataFrame:
    """lon_i, lat_i, inside of cells (lon_i, lat_i, lon, lat): strictly inside the union of the shapes, each a list of rings.

    The outline is the stated query and goes to every task once, as one array of its
    edges; the cells are tested in batches. A NULL coordinate is outside.
    """
    edges, n = _edges(shapes), len(shapes)
    sent = cells.sparkSession.sparkContext.broadcast(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(i).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(inside_union(x, y, sent.value, n))], names=[*CELL, "inside"])

    return cells.select(F.col("lon_i").cast("int").alias("lon_i"), F.col("lat_i").cast("int").alias("lat_i"), "lon", "lat").mapInArrow(run, "lon_i int, lat_i int, inside boolean")


def clip(df: DataFrame, cells: DataFrame, shapes: Sequence[Sequence[Ring]]) -> DataFrame:
    """The rows of df within the box of the shapes' union; values of cells not inside it become NULL and their is_land false.

    The box is cut at the cells nearest to the bounds. Each distinct cell is tested
    once, not each row; cells are those of a catalogued grid (67,721 at most), so their
    verdicts are sent to every task.
    """
    xs, ys = [p[0] for s in shapes for r in s for p in r], [p[1] for s in shapes for r in s for p in r]
    pick = lambda axis, idx, v: F.min_by(idx, F.struct(F.abs(F.col(axis) - v), F.col(idx)))
    box = cells.groupBy().agg(pick("lon", "lon_i", min(xs)).alias("i0"), pick("lon", "lon_i", max(xs)).alias("i1"), pick("lat", "lat_i", min(ys)).alias("j0"), pick("lat", "lat_i", max(ys)).alias("j1"))
    boxed = cells.join(F.broadcast(box), F.col("lon_i").between(F.col("i0"), F.col("i1")) & F.col("lat_i").between(F.col("j0"), F.col("j1")))
    return df.join(F.broadcast(within(boxed, shapes)), CELL).withColumns({"value": F.when(F.col("inside"), F.col("value")), "is_land": F.col("is_land") & F.col("inside")}).drop("inside")


def new_axis(old: list[float], step: float) -> list[float]:
    """From the first to the last coordinate, one step past it where the step does not divide the range."""
    n = math.ceil((old[-1] + step - old[0]) / step - 1e-9)
    return [old[0] + i * step for i in range(n)]


def remap(df: DataFrame, lons: list[float], lats: list[float], step: float) -> DataFrame:
    """df on the grid of the new step, each cell with the rows of the nearest old one (ties: the lower index).

    Each old cell is exploded to the new cells it serves, by two literal maps of the
    axes; nothing is joined or shuffled.
    """
    for name, index, old in (("lon", "lon_i", lons), ("lat", "lat_i", lats)):
        serves: list[list[tuple[int, float]]] = [[] for _ in old]
        for i, x in enumerate(new_axis(old, step)):
            serves[min(range(len(old)), key=lambda k: (abs(old[k] - x), k))].append((i, x))
        table = F.array(*[(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(x)).alias("x")) for i, x in s]) if s else F.array().cast("array<struct<i:int,x:double>>")) for s in serves])
        df = df.withColumn("_to", F.explode(F.element_at(table, F.col(index) + 1))).withColumns({index: F.col("_to.i"), name: F.col("_to.x")}).drop("_to")
    return df


def _fill_day(day: pd.DataFrame, skip: frozenset[tuple[int, int]]) -> pd.DataFrame:
    """The gaps of one day, cell by cell in order of lon_i and lat_i, each with the mean of the smallest square around it that then holds a value."""
    passed = np.array([c in skip for c in zip(day["lon_i"], day["lat_i"])], bool)
    turn = day.loc[day["gap"].to_numpy(bool) | passed].drop_duplicates(CELL).sort_values(CELL)
    i0, j0 = int(day["lon_i"].min()), int(day["lat_i"].min())
    a = np.full((int(day["lon_i"].max()) - i0 + 1, int(day["lat_i"].max()) - j0 + 1), np.nan)
    a[day["lon_i"].to_numpy(int) - i0, day["lat_i"].to_numpy(int) - j0] = day["value"].to_numpy(float)
    if np.isnan(a).all():
        return turn.head(0)[["pos", *CELL]].assign(fill=0.0)
    fills = []
    for x, y, gap, some in zip(turn["lon_i"] - i0, turn["lat_i"] - j0, turn["gap"], turn["some"]):
        fill = np.nan
        if (x + i0, y + j0) in skip:
            if some:
                a[x, y] = np.nan
        elif gap:
            r = 0
            while fill != fill and r < max(a.shape):
                r += 1
                square = a[max(x - r, 0) : x + r + 1, max(y - r, 0) : y + r + 1]
                have = ~np.isnan(square)
                if have.any():
                    fill = float(square[have].mean())
            a[x, y] = fill
        fills.append(fill)
    return turn[["pos", *CELL]].assign(fill=fills)


def fill_na(df: DataFrame, skip: list[tuple[int, int]] | None = None) -> DataFrame:
    """Missing values of cells with some other day present, filled by the mean of the smallest square around with a value of the day.

    Within a day the gaps are filled in order of lon_i, then lat_i, and what has been
    filled counts for those that follow. The square grows until it holds a value, and
    is cut at the grid's edge; only days without any value keep their gaps. Cells in
    skip that have gaps get NULL throughout, from their turn on. Only days with gaps are looked
    at, one at a time, so a task holds a grid's cells (67,721 of the largest
    catalogued one) however many days there are.
    """
    cells = frozenset(skip or ())
    # at most one row per cell of the grid
    some = F.broadcast(df.groupBy(*CELL).agg(F.count("value").alias("have"), F.count(F.lit(1)).alias("all")).where("have > 0 and have < all").select(*CELL, F.lit(True).alias("some")))
    known = df.join(some, CELL, "left").withColumn("some", F.coalesce("some", F.lit(False)))
    gap = F.col("value").isNull() & F.col("some")
    days = known.where(gap).select("pos").distinct()
    rows = known.where(F.col("value").isNotNull() | F.col("some")).join(days, "pos", "left_semi").select("pos", *CELL, F.col("value").cast("double").alias("value"), gap.alias("gap"), "some")
    kinds = dict(df.dtypes)
    filled = rows.groupBy("pos").applyInPandas(lambda day: _fill_day(day, cells), ", ".join(f"{c} {kinds[c]}" for c in ("pos", *CELL)) + ", fill double")
    out = known.join(filled, ["pos", *CELL], "left").withColumn("value", F.coalesce("value", F.nanvl("fill", F.lit(None).cast("double"))))
    if skip:
        hit = F.lit(False)
        for i, j in skip:
            hit = hit | ((F.col("lon_i") == i) & (F.col("lat_i") == j))
        out = out.withColumn("value", F.when(~(hit & F.col("some")), F.col("value")))
    return out.drop("fill", "some").select(df.columns)


def temperature_skips(n_lon: int = 31) -> list[tuple[int, int]]:
    """Cells of the one-degree temperature grid that are not filled."""
    return sorted({(i, j) for i in (24, 25, 26) for j in range(1, 6)} | {(i, 0) for i in range(n_lon)})


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def coast_reach(res: float, lat: float) -> tuple[int, int]:
    """How many cells of the grid's step (along longitude at that latitude, along latitude) a coast vertex can lie off its own and still be within COASTAL km."""
    degrees = COASTAL / (EARTH_KM * math.pi / 180)
    wide = degrees / max(math.cos(math.radians(min(abs(lat) + degrees, 89.9))), 1e-3)
    return int(wide / res + 0.5 + 1e-6), int(degrees / res + 0.5 + 1e-6)


def classify_regions(cells: DataFrame, dem: DataFrame, coast: DataFrame, res: float = 1.0) -> DataFrame:
    """lon_i, lat_i, region: -1 without land pixel, 1 of mean elevation from HILLY, 2 with coast within COASTAL km, else 0.

    dem: lon, lat, elev. coast: lon, lat. Pixels meet cells by bucket; a coast vertex
    meets the cells that the grid's step and latitude put within COASTAL km of it.
    """
    low = cells.agg(F.min("lon"), F.min("lat"), F.max(F.abs("lat"))).first()
    if low[0] is None:
        return cells.select(*CELL, F.lit(0).alias("region"))
    bucket = lambda df: df.withColumns({"lon_i": F.floor((F.col("lon") - low[0] + res / 2) / res).cast("int"), "lat_i": F.floor((F.col("lat") - low[1] + res / 2) / res).cast("int")})
    land = bucket(dem.where(F.col("elev") > LAND_PIXEL)).groupBy(*CELL).agg(F.avg("elev").alias("elev"))
    reach = coast_reach(res, low[2])
    off = lambda n: F.explode(F.sequence(F.lit(-n), F.lit(n)))
    v = bucket(coast.select("lon", "lat").distinct()).withColumn("dx", off(reach[0])).withColumn("dy", off(reach[1]))
    v = v.select((F.col("lon_i") + F.col("dx")).alias("lon_i"), (F.col("lat_i") + F.col("dy")).alias("lat_i"), F.col("lon").alias("vlon"), F.col("lat").alias("vlat"))
    near = cells.select(*CELL, "lon", "lat").join(v, CELL).groupBy(*CELL).agg(F.min(haversine_km(F.col("lat"), F.col("lon"), F.col("vlat"), F.col("vlon"))).alias("km"))
    out = cells.select(*CELL).join(land, CELL, "left").join(near, CELL, "left")
    return out.select(*CELL, F.when(F.col("elev").isNull(), -1).when(F.col("elev") >= HILLY, 1).when(F.col("km") <= COASTAL, 2).otherwise(0).alias("region"))
