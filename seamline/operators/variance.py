"""Variance between and within groups, and gaps inside groups, from per-group counts of values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_way(counts: DataFrame, group: str, value: str, n: str) -> DataFrame:
    """One row: n, groups, eta squared and the unbiased intraclass correlation of a value over groups.

    `counts` holds n rows of `value` per group and value. The correlation is null with fewer than two groups, without
    rows beyond one per group, or where its denominator is zero; eta squared is 0 without variance or rows.
    """
    counts = counts.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_x"), F.col(n).alias("_n"))
    x, w = F.col("_x"), F.col("_n")
    g = counts.groupBy("_g").agg(F.sum(w).alias("m"), F.sum(x * w).alias("s"), F.sum(x * x * w).alias("ss"))
    a = g.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"), F.coalesce(F.sum("ss"), F.lit(0.0)).alias("ss"),
        F.sum(F.col("s") * F.col("s") / F.col("m")).alias("between"), F.sum(F.col("m") * F.col("m")).alias("mm"),
    )
    base = F.try_divide(F.col("s") * F.col("s"), F.col("n"))
    a = a.withColumn("b", F.col("between") - base).withColumn("t", F.col("ss") - base)
    msb, msw = F.col("b") / (F.col("k") - 1), (F.col("t") - F.col("b")) / (F.col("n") - F.col("k"))
    m0 = (F.col("n") - F.col("mm") / F.col("n")) / (F.col("k") - 1)
    usable = (F.col("k") > 1) & (F.col("n") > F.col("k"))
    down = msb + (m0 - 1) * msw
    icc = F.when(usable, F.when((m0 > 0) & (down != 0), (msb - msw) / down))
    return a.select(F.col("n").alias("n_obs"), F.col("k").alias("n_groups"), F.coalesce(F.try_divide("b", "t"), F.lit(0.0)).alias("eta_squared"), icc.alias("icc"))


def within_gap(counts: DataFrame, group: str, side: str, a: str, b: str, value: str, n: str) -> DataFrame:
    """One row: groups with both sides, rows they cover, and the mean gap a - b inside groups, weighted by the smaller
    side's rows and unweighted; null where no group has both sides."""
    counts = counts.select(F.col(group).alias("_g"), F.col(side).alias("_side"), F.col(value).cast("double").alias("_x"), F.col(n).alias("_n"))
    x, w = F.col("_x"), F.col("_n")
    part = lambda s, v: F.sum(F.when(F.col("_side") == s, v).otherwise(0))
    g = counts.filter(F.col("_side").isin(a, b)).groupBy("_g").agg(part(a, w).alias("na"), part(b, w).alias("nb"), part(a, x * w).alias("sa"), part(b, x * w).alias("sb"))
    both = (F.col("na") > 0) & (F.col("nb") > 0)
    gap = F.when(both, F.try_divide("sa", "na") - F.try_divide("sb", "nb"))
    less = F.when(both, F.least("na", "nb"))
    return g.agg(
        F.count(F.lit(1)).alias("n_groups"), F.count(F.when(both, 1)).alias("n_both"), F.coalesce(F.sum(F.when(both, F.col("na") + F.col("nb"))), F.lit(0)).alias("n_covered"),
        F.coalesce(F.sum(F.when(both, F.col("na"))), F.lit(0)).alias("n_a"), F.try_divide(F.sum(gap * less), F.sum(less)).alias("weighted_gap"), F.avg(gap).alias("unweighted_gap"),
    )
