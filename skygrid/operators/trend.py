"""Trend statistics of annual series, one row per land cell.

The years of a cell form one array (a cell has as many entries as years), and the
statistics are expressions over it, so only the annual sums shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statistics import NormalDist

from skygrid.model import CELL, GridFrame
from skygrid.operators.monthly import annual_series


def _arrays(g: GridFrame) -> DataFrame:
    """Per cell with a value in the first year: x, the annual values in order, NULL where missing."""
    years = annual_series(g)
    one = years.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("a"))
    return one.select(*CELL, F.transform("a", lambda s: s["x"]).alias("x")).where(F.exists("x", lambda v: v.isNotNull()))


def _pairs(x: str) -> Column:
    """Slopes (x_j - x_i) / (j - i) of the pairs i < j of present values."""
    n = F.size(x)
    each = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda lag: F.transform(F.sequence(F.lit(1), F.greatest(n - lag, F.lit(1))), lambda i: F.when(i + lag <= n, (F.try_element_at(x, i + lag) - F.try_element_at(x, i)) / lag)),
    )
    return F.filter(F.flatten(each), lambda v: v.isNotNull())


def _median(array: Column) -> Column:
    s = F.array_sort(array)
    n = F.size(s)
    low, high = F.try_element_at(s, F.floor((n + 1) / 2).cast("int")), F.try_element_at(s, F.floor((n + 2) / 2).cast("int"))
    return F.when(n > 0, low + (high - low) * 0.5)


def _mean(x: str) -> Column:
    """NULL if any value is missing."""
    n = F.size(x)
    total = F.aggregate(F.col(x), F.lit(0.0), lambda a, v: a + v)
    return F.when(~F.exists(x, lambda v: v.isNull()), total / n)


def _with_slope(g: GridFrame) -> DataFrame:
    # computed once per cell: later columns refer to it by name
    return _arrays(g).withColumn("pairs", _pairs("x")).withColumn("slope", _median(F.col("pairs"))).drop("pairs")


def sse(g: GridFrame) -> DataFrame:
    """Sen slope per year: median of the pairwise slopes of present values."""
    return _with_slope(g).select(*CELL, F.col("slope").alias("sse"))


def sstr(g: GridFrame) -> DataFrame:
    """Sen slope over the whole period as a percentage of the mean; NULL if a year is missing or the mean is 0."""
    return _with_slope(g).select(*CELL, F.try_divide(F.col("slope") * 100.0 * F.size("x"), _mean("x")).alias("sstr"))


def _ranks(array: str) -> Column:
    """Ranks from 1, ties averaged."""
    return F.transform(array, lambda v: (F.size(F.filter(array, lambda u: u < v)) + F.size(F.filter(array, lambda u: u <= v)) + 1) / 2.0)


def spr(g: GridFrame) -> DataFrame:
    """Spearman rank statistic against time; plus or minus infinity for a perfect order, NULL for fewer than three years or a missing one."""
    a = _arrays(g).withColumn("r", _ranks("x")).withColumn("n", F.size("x").cast("double"))
    d2 = F.aggregate(F.transform("r", lambda r, i: (r - (i + 1)) * (r - (i + 1))), F.lit(0.0), lambda s, v: s + v)
    a = a.withColumn("rho", 1.0 - 6.0 * d2 / (F.col("n") * (F.col("n") * F.col("n") - 1.0)))
    z = F.when(F.col("rho") >= 1.0, F.lit(float("inf"))).when(F.col("rho") <= -1.0, F.lit(float("-inf"))).otherwise(F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2.0, 1.0 - F.col("rho") * F.col("rho"))))
    return a.select(*CELL, F.when((F.col("n") >= 3) & ~F.exists("x", lambda v: v.isNull()), z).alias("spr"))


def mmk_hr(g: GridFrame, alpha: float = 0.05, lag: int | None = None) -> DataFrame:
    """Modified Mann-Kendall Z (variance corrected for significant autocorrelation of the detrended ranks at lags up to lag, all without it); NULL for fewer than three present years."""
    critical = NormalDist().inv_cdf(1 - alpha / 2)
    add = lambda s, v: s + v
    a = _with_slope(g).withColumn("y", F.filter("x", lambda v: v.isNotNull())).withColumn("n", F.size("y").cast("double")).where("n >= 3")
    sign = F.aggregate(
        F.transform("y", lambda v, i: F.aggregate(F.transform("y", lambda u, j: F.when(j > i, F.signum(u - v)).otherwise(0.0)), F.lit(0.0), add)),
        F.lit(0.0),
        add,
    )
    ties = F.aggregate(F.transform(F.array_distinct("y"), lambda v: F.size(F.filter("y", lambda u: u == v)).cast("double")), F.lit(0.0), lambda s, c: s + c * (c - 1.0) * (2.0 * c + 5.0))
    n = F.col("n")
    a = a.withColumn("s", sign).withColumn("v", (n * (n - 1.0) * (2.0 * n + 5.0) - ties) / 18.0)
    a = a.withColumn("flat", F.transform("y", lambda v, i: v - (i + 1) * F.col("slope"))).withColumn("r", _ranks("flat"))
    a = a.withColumn("c", F.transform("r", lambda v: v - (n + 1.0) / 2.0))
    zero = F.aggregate(F.transform("c", lambda v: v * v), F.lit(0.0), add)

    def one(k: Column) -> Column:
        cov = F.aggregate(F.transform("c", lambda v, i: F.when(i + k < n, v * F.try_element_at(F.col("c"), (i + k + 1).cast("int"))).otherwise(0.0)), F.lit(0.0), add)
        rho = F.try_divide(cov, F.col("zero"))
        return F.when(F.abs(rho) > critical / F.sqrt(n), (n - k) * (n - k - 1.0) * (n - k - 2.0) * rho).otherwise(0.0)

    a = a.withColumn("zero", zero)
    last = F.size("y") - 1 if lag is None else F.least(F.size("y") - 1, F.lit(lag))
    lags = F.aggregate(F.transform(F.sequence(F.lit(1), last), one), F.lit(0.0), add)
    a = a.withColumn("var", F.col("v") * (1.0 + 2.0 / (n * (n - 1.0) * (n - 2.0)) * lags))
    z = F.when(F.col("s") == 0, F.lit(0.0)).when(F.col("var") > 0, (F.col("s") - F.signum("s")) / F.sqrt(F.when(F.col("var") > 0, F.col("var"))))
    return a.select(*CELL, z.alias("mmk_hr"))


for _f in (sse, sstr, spr, mmk_hr):
    GridFrame.register(_f.__name__, "A", _f)
