"""Queries p1, p2 and p3 and their SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrid.operators.compact import consolidate
from skygrid.operators.rolling import rolling
from skygrid.operators.spikes import implausible
from skygrid.session import remove, settle, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible(table(spark, d, "grid_obs")).select("object_id", "lon_i", "lat_i", "pos")


def p1_stuck(spark: SparkSession, d: str) -> DataFrame:
    """The stuck and impossible readings alone, which plain SQL can state."""
    return implausible(table(spark, d, "grid_obs")).where("reason <> 'spike'").select("object_id", "lon_i", "lat_i", "pos", "reason")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    done = consolidate(table(spark, d, "raw_files"), table(spark, d, "imd_objects"))
    remove(spark, done.out_dir)
    return done.adds_nothing


def p2_consolidated(spark: SparkSession, d: str) -> DataFrame:
    """What the consolidated files hold, read back from them."""
    done = consolidate(table(spark, d, "raw_files"), table(spark, d, "imd_objects"))
    back = spark.read.option("basePath", done.out_dir).parquet(f"{done.out_dir}/*/*/*.parquet")
    totals = (
        back.withColumn("cat", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+/[^/]+$", 1))
        .groupBy("cat", F.year("day").alias("year"))
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.countDistinct("object_id").alias("objects"),
            F.round(F.sum(F.round(F.col("value").cast("double") * 100).cast("long")) / 100.0, 2).alias("total"),
            F.round(F.sum(F.col("lat").cast("double")), 1).alias("lat_total"),
            F.round(F.sum(F.col("lon").cast("double")), 1).alias("lon_total"),
        )
    )
    # one row per kind and year
    return settle(totals, [done.out_dir])


def p3_rolling(spark: SparkSession, d: str) -> DataFrame:
    r = rolling(table(spark, d, "grid_obs"), table(spark, d, "imd_objects"))
    rounded = {c: F.round(c, 6) for c in ("sum_7", "mean_7", "sum_30", "mean_30")}
    return r.withColumns(rounded)


P1_STUCK_SQL = """
WITH r AS (
  SELECT object_id, lon_i, lat_i, pos, min(var) AS var, min(value) AS v FROM grid_obs
  WHERE value IS NOT NULL AND value <> -999 GROUP BY object_id, lon_i, lat_i, pos),
s AS (
  SELECT *, row_number() OVER (PARTITION BY object_id, lon_i, lat_i ORDER BY pos)
          - row_number() OVER (PARTITION BY object_id, lon_i, lat_i, v ORDER BY pos) AS run FROM r),
n AS (SELECT *, count(*) OVER (PARTITION BY object_id, lon_i, lat_i, v, run) AS len FROM s),
f AS (
  SELECT *, CASE WHEN var = 'rain' THEN v < 0 OR v > 2000 ELSE v < -60 OR v > 60 END AS impossible,
         len >= 6 AND NOT (var = 'rain' AND v = 0) AS stuck FROM n)
SELECT object_id, lon_i, lat_i, pos, CASE WHEN impossible THEN 'impossible' ELSE 'stuck' END AS reason
FROM f WHERE impossible OR stuck
"""

# the rules of the operator by windows: readings without impossible ones in order, levels of four readings on either side, medians per series
P1_FOUND_SQL = """
WITH r AS (
  SELECT object_id, lon_i, lat_i, pos, min(var) AS var, min(value) AS v FROM grid_obs
  WHERE value IS NOT NULL AND value <> -999 GROUP BY object_id, lon_i, lat_i, pos),
s AS (
  SELECT *, row_number() OVER (PARTITION BY object_id, lon_i, lat_i ORDER BY pos)
          - row_number() OVER (PARTITION BY object_id, lon_i, lat_i, v ORDER BY pos) AS run FROM r),
n AS (SELECT *, count(*) OVER (PARTITION BY object_id, lon_i, lat_i, v, run) AS len FROM s),
f AS (
  SELECT *, CASE WHEN var = 'rain' THEN v < 0 OR v > 2000 ELSE v < -60 OR v > 60 END AS impossible,
         len >= 6 AND NOT (var = 'rain' AND v = 0) AS stuck FROM n),
q AS (
  SELECT object_id, lon_i, lat_i, pos, var, v, stuck, (v - lag(v) OVER w) / 2 AS d,
         median(v) OVER (PARTITION BY object_id, lon_i, lat_i ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING EXCLUDE CURRENT ROW) AS level,
         list(v) OVER (PARTITION BY object_id, lon_i, lat_i ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)
           || list(v) OVER (PARTITION BY object_id, lon_i, lat_i ORDER BY pos ROWS BETWEEN 2 FOLLOWING AND 5 FOLLOWING) AS around,
         lag(v) OVER w AS v_1, lead(v) OVER w AS v1, lead(v, 2) OVER w AS v2, lead(pos) OVER w AS pos1
  FROM f WHERE NOT impossible WINDOW w AS (PARTITION BY object_id, lon_i, lat_i ORDER BY pos)),
m AS (
  SELECT object_id, lon_i, lat_i, 1.4826 * median(abs(v - level)) FILTER (WHERE NOT stuck) AS scale, 3 * 1.4826 * median(abs(d)) FILTER (WHERE NOT stuck) AS bound
  FROM q GROUP BY object_id, lon_i, lat_i),
t AS (
  SELECT q.*, scale, bound, lead(d) OVER w AS d1, lead(d, 2) OVER w AS d2, list_aggregate(around, 'median') AS level2
  FROM q JOIN m USING (object_id, lon_i, lat_i) WINDOW w AS (PARTITION BY object_id, lon_i, lat_i ORDER BY pos)),
one AS (
  SELECT object_id, lon_i, lat_i, pos FROM t WHERE var <> 'rain' AND abs(d) > bound AND abs(d1) > bound AND d * d1 < 0
     AND abs(v - level) >= 6.5 * scale AND abs(v - level) > 0 AND greatest(abs(v_1 - level), abs(v1 - level)) < 0.5 * abs(v - level)),
two AS (
  SELECT object_id, lon_i, lat_i, unnest([pos, pos1]) AS pos FROM t WHERE var <> 'rain' AND abs(d) > bound AND abs(d2) > bound AND d * d2 < 0 AND pos1 = pos + 1
     AND (v - level2) * (v1 - level2) > 0 AND least(abs(v - level2), abs(v1 - level2)) >= 6.5 * scale
     AND greatest(abs(v_1 - level2), abs(v2 - level2)) < 0.5 * least(abs(v - level2), abs(v1 - level2))),
w AS (
  SELECT object_id, lon_i, lat_i, pos, v, row_number() OVER k - 1 AS rank, coalesce(lead(v) OVER k, 0) AS below, count(*) OVER (PARTITION BY object_id, lon_i, lat_i) AS wet
  FROM q WHERE var = 'rain' AND NOT stuck AND v > 0 WINDOW k AS (PARTITION BY object_id, lon_i, lat_i ORDER BY v DESC, pos)),
c AS (
  SELECT object_id, lon_i, lat_i, pos FROM (
    SELECT *, max(rank) FILTER (WHERE v >= 4 * below AND below > 0 AND rank < greatest(wet // 3, 1)) OVER (PARTITION BY object_id, lon_i, lat_i) AS last FROM w) WHERE rank <= last),
y AS (
  SELECT t.object_id, t.lon_i, t.lat_i, t.pos, d, d1, bound, c.pos IS NOT NULL AS cand,
         row_number() OVER (PARTITION BY t.object_id, t.lon_i, t.lat_i ORDER BY t.pos) - row_number() OVER (PARTITION BY t.object_id, t.lon_i, t.lat_i, c.pos IS NOT NULL ORDER BY t.pos) AS run
  FROM t LEFT JOIN c ON c.object_id = t.object_id AND c.lon_i = t.lon_i AND c.lat_i = t.lat_i AND c.pos = t.pos WHERE var = 'rain'),
z AS (
  SELECT object_id, lon_i, lat_i, run FROM y WHERE cand GROUP BY object_id, lon_i, lat_i, run
  HAVING count(*) <= 2 AND coalesce(arg_min(coalesce(d, 1e9), pos) > coalesce(max(bound), 0), true) AND coalesce(arg_max(coalesce(d1, -1e9), pos) < -coalesce(max(bound), 0), true))
SELECT object_id, lon_i, lat_i, pos FROM f WHERE impossible OR stuck
UNION SELECT * FROM one UNION SELECT * FROM two
UNION SELECT y.object_id, y.lon_i, y.lat_i, y.pos FROM y JOIN z USING (object_id, lon_i, lat_i, run) WHERE y.cand
"""

_RECORDS_SQL = r"""
w AS (
  SELECT *, regexp_extract(path, '[^/]*$') AS base,
         CASE WHEN lower(path) LIKE '%rain%' THEN 'rain' WHEN regexp_matches(lower(path), 'tmax|/max') THEN 'tmax' ELSE 'tmin' END AS kind
  FROM raw_files
  WHERE octet_length(payload) > 0 AND octet_length(payload) = no_days * n_lat * n_lon * 4),
dd AS (
  SELECT *, CAST(coalesce(
    try_strptime(CASE WHEN regexp_extract(base, 'ind0\.25_(\d\d)_', 1) <> '' THEN
      (CASE WHEN regexp_extract(base, 'ind0\.25_(\d\d)_', 1) >= '91' THEN '19' ELSE '20' END) || regexp_extract(base, 'ind0\.25_(\d\d_\d\d_\d\d)', 1) END, '%Y_%m_%d'),
    try_strptime(nullif(regexp_extract(base, '(?i)(max|min)(\d{8})', 2), ''), '%d%m%Y'),
    try_strptime(nullif(regexp_extract(base, '\d{4}-\d\d-\d\d'), ''), '%Y-%m-%d'),
    try_strptime(nullif(regexp_extract(base, '\d{8}'), ''), '%Y%m%d')) AS DATE) AS d0 FROM w),
x AS (SELECT *, unnest(range(0, CAST(octet_length(payload) // 4 AS BIGINT))) AS k FROM dd),
r AS (
  SELECT file_id, object_id, kind, n_lon, d0 + CAST(k // (n_lat * n_lon) AS INT) AS day, CAST(k % (n_lat * n_lon) AS INT) AS cell,
         substr(hex(payload), CAST(k * 8 + 1 AS BIGINT), 8) AS raw FROM x)
"""

P2_FOUND_SQL = f"""
WITH {_RECORDS_SQL},
c AS (SELECT min(file_id) AS f FROM r GROUP BY object_id, day, cell, raw)
SELECT file_id FROM raw_files WHERE file_id NOT IN (SELECT f FROM c)
"""

# the float32 of four little-endian bytes, by sign, exponent and fraction
P2_CONSOLIDATED_SQL = f"""
WITH {_RECORDS_SQL},
c AS (SELECT object_id, min(kind) AS cat, min(n_lon) AS n_lon, day, cell, raw FROM r GROUP BY object_id, day, cell, raw),
b AS (
  SELECT c.*, CAST('0x' || substr(raw, 7, 2) || substr(raw, 5, 2) || substr(raw, 3, 2) || substr(raw, 1, 2) AS BIGINT) AS bits FROM c),
v AS (
  SELECT b.*, CASE WHEN bits % 2147483648 = 0 THEN 0.0 ELSE (CASE WHEN bits >= 2147483648 THEN -1.0 ELSE 1.0 END)
    * pow(2.0, CAST((bits // 8388608) % 256 - 127 AS DOUBLE)) * (1.0 + CAST(bits % 8388608 AS DOUBLE) / 8388608.0) END AS value FROM b)
SELECT v.cat, CAST(year(day) AS INT) AS year, count(*) AS records, count(DISTINCT v.object_id) AS objects,
       round(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100.0, 2) AS total,
       round(sum(lat_array[CAST(cell // v.n_lon AS INT) + 1]), 1) AS lat_total, round(sum(lon_array[CAST(cell % v.n_lon AS INT) + 1]), 1) AS lon_total
FROM v JOIN imd_objects o ON o.object_id = v.object_id GROUP BY v.cat, year(day)
"""

P3_SQL = """
WITH o AS (
  SELECT object_id, CAST(start_day AS DATE) AS s, date_diff('day', CAST(start_day AS DATE), CAST(end_day AS DATE)) + 1 AS n_days FROM imd_objects),
g AS (SELECT object_id, lon_i, lat_i, pos, max(nullif(value, -999)) AS v FROM grid_obs GROUP BY object_id, lon_i, lat_i, pos),
k AS (SELECT DISTINCT object_id, lon_i, lat_i FROM g),
sp AS (SELECT k.object_id, lon_i, lat_i, CAST(unnest(range(0, n_days)) AS INT) AS pos FROM k JOIN o ON o.object_id = k.object_id),
u AS (SELECT object_id, lon_i, lat_i, pos, CAST(NULL AS DOUBLE) AS v FROM sp UNION ALL SELECT object_id, lon_i, lat_i, pos, v FROM g),
y AS (SELECT object_id, lon_i, lat_i, pos, max(v) AS v FROM u GROUP BY object_id, lon_i, lat_i, pos),
x AS (SELECT y.*, o.s FROM y JOIN o ON o.object_id = y.object_id WHERE pos BETWEEN 0 AND n_days - 1)
SELECT object_id, lon_i, lat_i, pos, s + pos AS day,
       round(sum(v) OVER w7, 6) AS sum_7, round(avg(v) OVER w7, 6) AS mean_7, count(v) OVER w7 AS n_7,
       round(sum(v) OVER w30, 6) AS sum_30, round(avg(v) OVER w30, 6) AS mean_30, count(v) OVER w30 AS n_30
FROM x
WINDOW w7 AS (PARTITION BY object_id, lon_i, lat_i ORDER BY pos ROWS 6 PRECEDING),
       w30 AS (PARTITION BY object_id, lon_i, lat_i ORDER BY pos ROWS 29 PRECEDING)
"""

QUERIES = {"p1_found": p1_found, "p1_stuck": p1_stuck, "p2_found": p2_found, "p2_consolidated": p2_consolidated, "p3_rolling": p3_rolling}
SQL = {"p1_found": P1_FOUND_SQL, "p1_stuck": P1_STUCK_SQL, "p2_found": P2_FOUND_SQL, "p2_consolidated": P2_CONSOLIDATED_SQL, "p3_rolling": P3_SQL}
