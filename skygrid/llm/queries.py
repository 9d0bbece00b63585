"""Queries of the llm subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrid.llm import digests, leakage, mixing, runs, stuffing
from skygrid.session import settle, table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse(table(spark, d, "grid_obs")).select("object_id", "lon_i", "lat_i", "first_pos", "last_pos")


def p4_events(spark: SparkSession, d: str) -> DataFrame:
    return runs.events(table(spark, d, "grid_obs"), table(spark, d, "imd_objects")).withColumn("share", F.round("share", 6))


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return digests.percentiles(table(spark, d, "grid_obs"), table(spark, d, "imd_objects"))


def p5_certified(spark: SparkSession, d: str) -> DataFrame:
    """What SQL can state of p5_percentiles: the groups and their readings, and the percentiles themselves of groups of so few readings that their digests hold every value."""
    df = p5_percentiles(spark, d)
    ps = [c for c in df.columns if c[0] == "p" and c[1:].isdigit()]
    return df.select("grain", "var", "lon_i", "lat_i", "day", "n", *[F.when(F.col("n") <= int(digests.DELTA / 2), F.round(c, 4)).alias(c) for c in ps])


def p5_combined(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each variable from the digests kept per object and from those kept per day, each certified."""
    scratch: list[str] = []
    blocks = digests.readings(table(spark, d, "grid_obs"), table(spark, d, "imd_objects"), scratch).where("start is not null")
    parts = []
    for grain in ("object", "day"):
        whole = digests.roll_up(digests.digests(blocks, [grain]))
        got = digests.named(digests.certify(blocks, whole, ["all"], scratch=scratch))
        parts.append(got.select(F.lit(grain).alias("kept_per"), "var", "n", *[c for c in got.columns if c[0] == "p" and c[1:].isdigit()], "max_rank_error", "within_bound"))
    return settle(parts[0].unionByName(parts[1]), scratch)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "eval_id")


def p7_method(spark: SparkSession, d: str) -> DataFrame:
    """The method alone: rates whose expected totals by soft membership match the targets; wanted, expected and actual shares by source."""
    targets = table(spark, d, "mix_targets")
    uses, about = mixing.mix(table(spark, d, "documents"), targets, soft_only=True)
    return mixing.expected(uses, targets, about)


def p7_uses(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0].drop("p")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    uses, about = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return mixing.shares(uses, table(spark, d, "mix_targets"), about["tokenizer"])


def p7_balance(spark: SparkSession, d: str) -> DataFrame:
    """What SQL can state of p7_shares: documents and the wanted share of the sources that have texts, which the actual one must equal to a hundredth."""
    s = p7_shares(spark, d).where("tokens_used > 0")
    return s.select("source", "documents", F.round("actual_share", 2).alias("share"), (F.col("max_repeats") - F.col("most_uses") < 0).alias("over_cap"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed(table(spark, d, "documents")).where("found").select("doc_id")


def p8_features(spark: SparkSession, d: str) -> DataFrame:
    """The measures behind p8_found, of every document."""
    return stuffing.stuffed(table(spark, d, "documents"))


_READINGS = """r AS (
  SELECT object_id, lon_i, lat_i, pos, min(var) AS var, min(value) AS v FROM grid_obs
  WHERE value IS NOT NULL AND value <> -999 GROUP BY object_id, lon_i, lat_i, pos)"""

_RUNS = f"""{_READINGS},
c AS (SELECT *, CAST(round(v * 100) AS BIGINT) AS h FROM r),
l AS (
  SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 AND abs(h - lag(h) OVER w) <= 5 THEN 0 ELSE 1 END AS opens FROM c
  WINDOW w AS (PARTITION BY object_id, lon_i, lat_i ORDER BY pos)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY object_id, lon_i, lat_i ORDER BY pos) AS run FROM l),
f AS (
  SELECT object_id, lon_i, lat_i, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS readings,
         arg_min(v, pos) AS first_value, arg_max(v, pos) AS last_value
  FROM g GROUP BY object_id, lon_i, lat_i, run HAVING count(*) >= 3)"""

P4_FOUND_SQL = f"WITH {_RUNS} SELECT object_id, lon_i, lat_i, first_pos, last_pos FROM f"

P4_EVENTS_SQL = f"""WITH {_RUNS}
SELECT f.*, CAST(start_day AS DATE) + first_pos AS first_day, CAST(start_day AS DATE) + last_pos AS last_day,
       round((last_pos - first_pos + 1) / CAST(date_diff('day', CAST(start_day AS DATE), CAST(end_day AS DATE)) + 1 AS DOUBLE), 6) AS share
FROM f JOIN imd_objects o ON o.object_id = f.object_id"""

# interpolation between the middles of the ranks
_EXACT = ", ".join(
    f"CASE WHEN n <= 200 THEN round(l[CAST(floor(x{q}) AS BIGINT) + 1] + (x{q} - floor(x{q})) * (coalesce(l[CAST(floor(x{q}) AS BIGINT) + 2], 0) - l[CAST(floor(x{q}) AS BIGINT) + 1]) * CAST(floor(x{q}) + 1 < n AS INT), 4) END AS p{q}"
    for q in ("05", "25", "50", "75", "95", "99")
)
_RANKS = ", ".join(f"least(greatest(0.{q} * n - 0.5, 0), n - 1) AS x{q}" for q in ("05", "25", "50", "75", "95", "99"))

P5_CERTIFIED_SQL = f"""WITH {_READINGS},
x AS (SELECT r.*, CAST(o.start_day AS DATE) + r.pos AS day FROM r JOIN imd_objects o ON o.object_id = r.object_id),
g AS (SELECT 'all' AS grain, var, CAST(NULL AS INT) AS lon_i, CAST(NULL AS INT) AS lat_i, CAST(NULL AS DATE) AS day, count(*) AS n, list(v ORDER BY v) AS l FROM x GROUP BY var
UNION ALL SELECT 'cell', var, lon_i, lat_i, NULL, count(*), list(v ORDER BY v) FROM x GROUP BY var, lon_i, lat_i
UNION ALL SELECT 'day', var, NULL, NULL, day, count(*), list(v ORDER BY v) FROM x GROUP BY var, day),
k AS (SELECT *, {_RANKS} FROM g)
SELECT grain, var, lon_i, lat_i, day, n, {_EXACT} FROM k"""

P7_BALANCE_SQL = """WITH n AS (SELECT source, count(*) AS documents, max(length(text)) AS longest FROM documents GROUP BY source),
t AS (SELECT t.source, documents, max_repeats, target_share FROM mix_targets t JOIN n ON n.source = t.source WHERE longest > 0)
SELECT source, documents, round(target_share / sum(target_share) OVER (), 2) AS share, max_repeats < 0 AS over_cap FROM t"""

QUERIES = {"p4_found": p4_found, "p4_events": p4_events, "p5_percentiles": p5_percentiles, "p5_certified": p5_certified, "p5_combined": p5_combined, "p6_found": p6_found, "p7_method": p7_method, "p7_uses": p7_uses, "p7_shares": p7_shares, "p7_balance": p7_balance, "p8_found": p8_found, "p8_features": p8_features}
SQL = {"p4_found": P4_FOUND_SQL, "p4_events": P4_EVENTS_SQL, "p5_certified": P5_CERTIFIED_SQL, "p7_balance": P7_BALANCE_SQL}
