"""Thirty years of daily values on a grid of 4 x 3 cells, derived from lineitem by whole-number arithmetic.

Rows: lon_i, lat_i, lon, lat, pos, is_land, region, rain, tmax, tmin. One cell is
sea; temperatures have gaps; sums do not depend on the order of rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrid.model import GridFrame, GridSpec, Meta
from skygrid.session import table

DAYS, START, END = 10958, dt.date(1991, 1, 1), dt.date(2020, 12, 31)
SPEC = GridSpec(7.5, 3, 67.5, 4, 10.0)


def rows(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    pos = ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 1013 + F.col("l_partkey") * 3) % DAYS).cast("int")
    part = li.select(pos.alias("pos"), (F.col("l_suppkey") % 4).cast("int").alias("lon_i"), (F.col("l_partkey") % 3).cast("int").alias("lat_i"), F.col("l_quantity").cast("int").alias("q"), F.round(F.col("l_discount") * 100).cast("int").alias("d"))
    spine = spark.range(DAYS * 12).select((F.col("id") % DAYS).cast("int").alias("pos"), F.floor(F.col("id") / (DAYS * 3)).cast("int").alias("lon_i"), (F.floor(F.col("id") / DAYS) % 3).cast("int").alias("lat_i"), F.lit(0).alias("q"), F.lit(0).alias("d"))
    x = part.unionByName(spine).groupBy("pos", "lon_i", "lat_i").agg(F.sum("q").alias("q"), F.sum("d").alias("d"))
    date = F.date_add(F.lit("1991-01-01").cast("date"), F.col("pos"))
    ocean = (F.col("lon_i") == 3) & (F.col("lat_i") == 2)
    miss = (F.col("pos") * 31 + F.col("lon_i") * 7 + F.col("lat_i")) % 997 == 0
    tx = 190 + 216 - F.abs(F.dayofyear(date) - 150) + (F.col("pos").cast("long") * 7919 + F.col("lon_i") * 1047 + F.col("lat_i") * 1299) % 160 + F.col("d")
    gap = 180 + (F.col("pos") * 31 + F.col("lon_i") * 17 + F.col("lat_i") * 5) % 70
    return x.select(
        "lon_i",
        "lat_i",
        (67.5 + 10 * F.col("lon_i")).cast("double").alias("lon"),
        (7.5 + 10 * F.col("lat_i")).cast("double").alias("lat"),
        "pos",
        (~ocean).alias("is_land"),
        F.when(ocean, -1).otherwise((F.col("lon_i") + 2 * F.col("lat_i")) % 3).alias("region"),
        F.when(~ocean, F.col("q").cast("double")).alias("rain"),
        F.when(~ocean & ~miss, tx.cast("double") / 10).alias("tmax"),
        F.when(~ocean & ~miss, (tx - gap).cast("double") / 10).alias("tmin"),
    )


def grid(spark: SparkSession, d: str, cat: str) -> GridFrame:
    df = rows(spark, d).select("lon_i", "lat_i", "lon", "lat", "pos", "is_land", F.col(cat).alias("value"))
    return GridFrame(df, Meta(cat, START, END, SPEC))


#: A rain grid of a quarter of SPEC's step that starts two columns west and one row south of it.
FINE = GridSpec(5.0, 5, 62.5, 8, 2.5)


def fine_rain(spark: SparkSession, d: str) -> GridFrame:
    """Rain on FINE: the rain of cell (lon_i % 4, lat_i % 3) and a few millimetres by place and day."""
    to = lambda n, m, c: F.array(*[F.array(*[F.lit(i) for i in range(n) if i % m == k]) for k in range(m)])[F.col(c)]
    df = rows(spark, d).withColumn("i", F.explode(to(8, 4, "lon_i"))).withColumn("j", F.explode(to(5, 3, "lat_i")))
    value = F.col("rain") + (F.col("pos") * 13 + F.col("i") * 7 + F.col("j") * 3) % 5
    df = df.select(F.col("i").alias("lon_i"), F.col("j").alias("lat_i"), (62.5 + 2.5 * F.col("i")).alias("lon"), (5.0 + 2.5 * F.col("j")).alias("lat"), "pos", F.lit(True).alias("is_land"), value.alias("value"))
    return GridFrame(df, Meta("rain", START, END, FINE))


def regions(spark: SparkSession, d: str) -> DataFrame:
    cells = spark.range(12).select(F.floor(F.col("id") / 3).cast("int").alias("lon_i"), (F.col("id") % 3).cast("int").alias("lat_i"))
    return cells.withColumn("region", F.when((F.col("lon_i") == 3) & (F.col("lat_i") == 2), -1).otherwise((F.col("lon_i") + 2 * F.col("lat_i")) % 3))


FX = """
cells AS (SELECT CAST(range AS INT) AS cell FROM range(12)),
sp AS (SELECT CAST(range % 10958 AS INT) AS pos, CAST(range // 32874 AS INT) AS lon_i, CAST((range // 10958) % 3 AS INT) AS lat_i FROM range(131496)),
u AS (
  SELECT pos, lon_i, lat_i, 0 AS q, 0 AS d FROM sp
  UNION ALL
  SELECT CAST((l_orderkey * 7 + l_linenumber * 1013 + l_partkey * 3) % 10958 AS INT), CAST(l_suppkey % 4 AS INT), CAST(l_partkey % 3 AS INT),
         CAST(l_quantity AS INT), CAST(round(l_discount * 100) AS INT) FROM lineitem),
s AS (SELECT pos, lon_i, lat_i, CAST(sum(q) AS BIGINT) AS q, CAST(sum(d) AS BIGINT) AS d, DATE '1991-01-01' + pos AS date FROM u GROUP BY pos, lon_i, lat_i),
t AS (
  SELECT *, lon_i = 3 AND lat_i = 2 AS ocean, (pos * 31 + lon_i * 7 + lat_i) % 997 = 0 AS miss,
         190 + 216 - abs(dayofyear(date) - 150) + (CAST(pos AS BIGINT) * 7919 + lon_i * 1047 + lat_i * 1299) % 160 + d AS tx,
         180 + (pos * 31 + lon_i * 17 + lat_i * 5) % 70 AS gap FROM s),
fx AS (
  SELECT lon_i, lat_i, 67.5 + 10.0 * lon_i AS lon, 7.5 + 10.0 * lat_i AS lat, pos, date, CAST(year(date) AS INT) AS yr, CAST((year(date) - 1991) * 12 + month(date) - 1 AS INT) AS m,
         NOT ocean AS is_land, CASE WHEN ocean THEN -1 ELSE (lon_i + 2 * lat_i) % 3 END AS region,
         CASE WHEN NOT ocean THEN CAST(q AS DOUBLE) END AS rain,
         CASE WHEN NOT ocean AND NOT miss THEN CAST(tx AS DOUBLE) / 10 END AS tmax,
         CASE WHEN NOT ocean AND NOT miss THEN CAST(tx - gap AS DOUBLE) / 10 END AS tmin FROM t)
"""
