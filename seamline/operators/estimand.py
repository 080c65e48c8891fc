"""Difference-in-differences of fit scores and what is reported beside it, from counts by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGN = {("men", "upper"): 1, ("men", "lower"): -1, ("women", "upper"): -1, ("women", "lower"): 1}


def contrast(cells: DataFrame, mean: str, *groups: str) -> DataFrame:
    """tau per group from one mean per (gender, half); null unless all four cells have one."""
    one = lambda g, h: F.max(F.when((F.col("gender") == g) & (F.col("half") == h), F.col(mean)))
    value = sum((F.lit(s) * one(g, h) for (g, h), s in SIGN.items()), F.lit(0.0))
    return cells.groupBy(*groups).agg(value.alias("tau"))


def cell_means(counts: DataFrame, value: Column, n: str, *groups: str) -> DataFrame:
    """Mean of a value per cell, every observation counting the same."""
    w = F.when(value.isNotNull(), F.col(n))
    return counts.groupBy(*groups, "gender", "half").agg(F.sum(w).alias("n"), (F.sum(value * F.col(n)) / F.sum(w)).alias("mean"))


def style_means(counts: DataFrame, value: Column, n: str, style: str) -> DataFrame:
    """Mean over styles of each style's mean, every style counting the same."""
    per = cell_means(counts, value, n, style)
    return per.groupBy("gender", "half").agg(F.count("mean").alias("n"), F.avg("mean").alias("mean"))


def within_person(counts: DataFrame, value: Column, n: str, person: str) -> DataFrame:
    """Per gender: persons with both halves and the mean of their upper minus lower mean."""
    part = lambda h, v: F.sum(F.when(F.col("half") == h, v).otherwise(0.0))
    p = counts.filter(value.isNotNull()).groupBy(F.col(person).alias("_person"), "gender").agg(
        part("upper", F.col(n)).alias("nu"), part("lower", F.col(n)).alias("nl"), part("upper", value * F.col(n)).alias("su"), part("lower", value * F.col(n)).alias("sl")
    )
    p = p.filter((F.col("nu") > 0) & (F.col("nl") > 0))
    return p.groupBy("gender").agg(F.count(F.lit(1)).alias("n_persons"), F.avg(F.col("su") / F.col("nu") - F.col("sl") / F.col("nl")).alias("difference"))


def residualised(counts: DataFrame, within: str, value: Column, x: Column, n: str, *keep: str) -> DataFrame:
    """(keep, x, y, n): value and the interaction x as what is left of them after fixed effects of `within` and the main
    effects male and upper, so the slope of y on x is the interaction's and can be tested by cluster.

    Rows without a value are left out; a main effect without variation inside groups drops out. Group sums are joined
    back to counts, not to observations. An empty table gives none.
    """
    male, upper = F.when(F.col("gender") == "men", 1.0).otherwise(0.0), F.when(F.col("half") == "upper", 1.0).otherwise(0.0)
    v = {"_m": male, "_u": upper, "_x": x, "_y": value}
    d = counts.filter(value.isNotNull()).select(*keep, F.col(within).alias("_f"), F.col(n).cast("double").alias("_w"), *[c.cast("double").alias(k) for k, c in v.items()])
    means = d.groupBy("_f").agg(*[(F.sum(F.col("_w") * F.col(k)) / F.sum("_w")).alias(f"{k}_mean") for k in v])
    d = d.join(means, d["_f"].eqNullSafe(means["_f"])).select(*keep, "_w", *[(F.col(k) - F.col(f"{k}_mean")).alias(k) for k in v])
    left = list(v)
    for main in ("_m", "_u"):
        left.remove(main)
        sums = d.agg(*[F.sum(F.col("_w") * F.col(main) * F.col(k)).alias(f"{k}_with") for k in (main, *left)])
        slope = lambda k, main=main: F.when(F.col(f"{main}_with") > 1e-9, F.col(f"{k}_with") / F.col(f"{main}_with")).otherwise(0.0)
        d = d.crossJoin(F.broadcast(sums)).select(*keep, "_w", *[(F.col(k) - slope(k) * F.col(main)).alias(k) for k in left])  # one row of sums
    return d.select(*keep, F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_w").alias("n"))


def inverse_probability(counts: DataFrame, reported: Column, n: str, *strata: str) -> DataFrame:
    """Counts with w: the inverse of the share of each stratum's rows that report; null where none does."""
    rate = counts.groupBy(*strata).agg((F.sum(F.when(reported, F.col(n)).otherwise(0)) / F.sum(n)).alias("rate"))
    return counts.join(rate, [*strata]).withColumn("w", F.when(F.col("rate") > 0, F.col(n) / F.col("rate")))


def bounds(counts: DataFrame, value: Column, n: str, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """One row: tau when every row without a value had the one or the other extreme, whichever is worse per cell."""
    filled = counts.groupBy("gender", "half").agg(*[(F.sum(F.coalesce(value, F.lit(v)) * F.col(n)) / F.sum(n)).alias(name) for name, v in (("at_low", low), ("at_high", high))])
    up = F.lit(None).cast("int")
    for (g, h), s in SIGN.items():
        up = F.when((F.col("gender") == g) & (F.col("half") == h), s).otherwise(up)
    worst = F.when(up > 0, F.col("at_low")).otherwise(F.col("at_high"))
    best = F.when(up > 0, F.col("at_high")).otherwise(F.col("at_low"))
    f = filled.withColumn("worst", worst).withColumn("best", best)
    return contrast(f, "worst").withColumnRenamed("tau", "low").crossJoin(contrast(f, "best").withColumnRenamed("tau", "high"))


def trend(points: DataFrame, x: Column, y: Column, weight: Column, *groups: str) -> DataFrame:
    """Weighted least-squares slope of y on x per group; null without spread."""
    p = points.select(*groups, x.cast("double").alias("_x"), y.cast("double").alias("_y"), weight.cast("double").alias("_w"))
    a, b, w = F.col("_x"), F.col("_y"), F.col("_w")
    s = p.groupBy(*groups).agg(F.sum(w).alias("_n"), F.sum(w * a).alias("_sx"), F.sum(w * b).alias("_sy"), F.sum(w * a * b).alias("_sxy"), F.sum(w * a * a).alias("_sxx"))
    down = F.col("_sxx") - F.col("_sx") * F.col("_sx") / F.col("_n")
    return s.select(*groups, F.when(down > 1e-12, (F.col("_sxy") - F.col("_sx") * F.col("_sy") / F.col("_n")) / down).alias("slope"))


def agreement_band(points: Column) -> Column:
    """Band of a difference in percentage points: below 8, up to 15, and from 15 on."""
    return F.when(F.abs(points) < 8, "agree").when(F.abs(points) < 15, "partial").otherwise("diverge")


def lambda_gate(factor: Column, design: Column | float, target: Column | float) -> Column:
    """Whether a factor still lets the target effect be detected."""
    design, target = (v if isinstance(v, Column) else F.lit(v) for v in (design, target))
    return F.when(factor >= design / target, "pass").otherwise("fail")


def survey_score(percent: Column) -> Column:
    """Score of a four-step size answer: 25 -> -1, 50 -> 0, 75 and 100 -> 1; 0 and others are missing."""
    return F.when(percent == 25, -1.0).when(percent == 50, 0.0).when(percent.isin(75, 100), 1.0)


def censored(level: Column, at: int = 6) -> Column:
    """Struct level, censored: the level cut at `at`, and whether it was."""
    return F.struct(F.least(level, F.lit(at)).alias("level"), (level >= at).alias("censored"))
