"""Aggregates over cells, items, stores and years. Counts come in weighted by n (see frames)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, *keys: str, weight: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))


def with_share(df: DataFrame, weight: str, name: str = "share", *within: str) -> DataFrame:
    """Each row's share of the sum of `weight`, over all rows or `within` groups; meant for aggregated frames."""
    return df.withColumn(name, F.try_divide(F.col(weight), F.sum(weight).over(Window.partitionBy(*within))))


def top(df: DataFrame, k: int, weight: str, *ties: str) -> DataFrame:
    """The k rows of most weight; ties in the order of `ties`."""
    return df.orderBy(F.desc(weight), *ties).limit(k)


def top_within(df: DataFrame, k: int, group: list[str], order: list[Column]) -> DataFrame:
    """The first k rows of each group; rows beyond k are dropped before they are gathered (window group limit)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def size_moments(sizes: DataFrame, n: str, *groups: str) -> DataFrame:
    """Number, sum, mean, population SD, CV, largest and share of single ones of cluster sizes."""
    out = sizes.groupBy(*groups).agg(
        F.count(n).alias("n_clusters"), F.sum(n).alias("n_obs"), F.avg(n).alias("m_bar"), F.stddev_pop(n).alias("sd"), F.max(n).alias("largest"),
        F.avg(F.when(F.col(n) == 1, 1.0).otherwise(0.0)).alias("singletons"),
    )
    return out.withColumn("cv", F.try_divide("sd", "m_bar"))


def positional_quantiles(sizes: DataFrame, n: str, shares: dict[str, tuple[int, int]]) -> DataFrame:
    """Values at position floor(len * a / b) of the sorted sizes, without interpolation; null where there are none.

    Sizes are counted by value first, so what is ordered is the distinct sizes, not the clusters.
    """
    by = sizes.filter(F.col(n).isNotNull()).groupBy(F.col(n).alias("v")).agg(F.count(F.lit(1)).alias("w"))
    total = by.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("total"))
    run = by.crossJoin(F.broadcast(total)).withColumn("upto", F.sum("w").over(Window.orderBy("v")))
    at = {name: F.least(F.floor(F.col("total") * a / b), F.col("total") - 1) for name, (a, b) in shares.items()}
    return run.agg(*[F.min(F.when(F.col("upto") > p, F.col("v"))).alias(name) for name, p in at.items()])


def concentration(weights: DataFrame, n: str, tie: str, ks: list[int]) -> DataFrame:
    """(k, share): share of the k largest in the sum, for each k.

    Only the max(ks) largest are ordered; the sum is taken over all.
    """
    total = weights.agg(F.sum(n).alias("_total"))
    largest = weights.orderBy(F.desc(n), tie).limit(max(ks)).select(F.col(n).alias("_n"))
    ranked = largest.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_n")))).crossJoin(F.broadcast(total))
    row = ranked.agg(*[F.sum(F.when(F.col("_r") <= k, F.col("_n")).otherwise(0)).alias(f"k{k}") for k in ks], F.first("_total").alias("total"))
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.try_divide(F.col(f"k{k}"), F.col("total")).alias("share")) for k in ks])).alias("x")).select("x.*")


def hhi(weights: DataFrame, n: str) -> DataFrame:
    """Herfindahl index of the weights and the effective number of holders."""
    a = weights.agg(F.sum(n).alias("s"), F.sum(F.col(n).cast("double") * F.col(n)).alias("ss"))
    h = F.try_divide(F.col("ss"), F.col("s").cast("double") * F.col("s"))
    return a.select(h.alias("hhi"), F.try_divide(F.lit(1.0), h).alias("effective"))


def funnel(joined: DataFrame, window_from: int, buckets: list[str]) -> DataFrame:
    """Per parent_asin: reviews left after each filter, from counts by (yr, verified, label)."""
    in_window = F.coalesce(F.col("yr") >= window_from, F.lit(False))
    label = F.col("label").isin(buckets)
    count = lambda cond, name: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(name)
    out = joined.groupBy("parent_asin").agg(
        F.sum("n").alias("in_scope"), count(in_window, "window"), count(F.col("verified"), "verified"), count(in_window & F.col("verified"), "window_verified"),
        count(label, "labelled_any"), count(label & in_window, "labelled_window"), count(label & in_window & F.col("verified"), "labelled_final"),
    )
    return out.withColumn("survival", F.coalesce(F.try_divide("labelled_final", "labelled_any"), F.lit(0.0)))


def year_on_year(by_year: DataFrame, columns: dict[str, float]) -> DataFrame:
    """Change of each column against the reported year before, and whether all stay below their limits."""
    w = Window.orderBy("yr")  # one row per year
    out = by_year
    stable = F.lit(True)
    for c, limit in columns.items():
        d = F.col(c) - F.lag(c).over(w)
        out = out.withColumn(f"d_{c}", d)
        stable = stable & (F.abs(F.col(f"d_{c}")) < limit)
    return out.withColumn("stable", stable)


def stable_from(deltas: DataFrame) -> DataFrame:
    """The first year of the stable run that lasts to the end, null if the last year isn't stable."""
    last = deltas.agg(F.max(F.when(~F.coalesce("stable", F.lit(False)), F.col("yr"))).alias("last_unstable"))
    after = deltas.crossJoin(F.broadcast(last)).filter(F.col("stable") & (F.coalesce("last_unstable", F.lit(0)) < F.col("yr")))
    return after.agg(F.min("yr").alias("stable_from"))


def half_split(sizes: DataFrame, n: str, name: str) -> DataFrame:
    """The sizes with `treated`: the largest, then in falling order while the sum before stays below half of all.

    Equal sizes come in the order of a hash of `name`. Distinct sizes are ordered first, and of the one size that half
    of the sum falls into, hash parts before members, so no task orders all clusters.
    """
    run = Window.orderBy(F.desc("_size"))  # one row per distinct size
    keep = sizes.columns
    sizes = sizes.withColumn("_size", F.col(n))
    size, before, take = F.col("_size"), F.col("_before"), F.col("_take")
    by = sizes.groupBy("_size").agg(F.count(F.lit(1)).alias("_w"))
    total = sizes.agg(F.sum("_size").alias("_total"))
    by = by.withColumn("_before", F.sum(F.col("_w") * size).over(run) - F.col("_w") * size).crossJoin(F.broadcast(total))
    # members taken of each size: the largest size always gives one
    wanted = F.greatest(F.ceil((F.col("_total") / 2 - before) / size), F.when(before == 0, 1).otherwise(0))
    by = by.withColumn("_take", F.least(F.greatest(wanted, F.lit(0)), F.col("_w")))
    split = F.broadcast(by.filter((take > 0) & (take < F.col("_w"))).select("_size", "_take"))  # at most one size
    whole = F.broadcast(by.agg(F.min(F.when(take == F.col("_w"), size)).alias("_from")))
    hashed = sizes.withColumn("_h", F.md5(F.col(name).cast("string"))).withColumn("_part", F.substring("_h", 1, 3))
    edge = hashed.join(split, "_size")
    parts = edge.groupBy("_part").agg(F.count(F.lit(1)).alias("_c")).withColumn("_skip", F.sum("_c").over(Window.orderBy("_part")) - F.col("_c"))
    edge = edge.join(F.broadcast(parts), "_part")  # at most 4096 parts
    edge = edge.withColumn("treated", F.col("_skip") + F.row_number().over(Window.partitionBy("_part").orderBy("_h", name)) <= take)
    rest = hashed.join(split.select("_size"), "_size", "left_anti").crossJoin(whole).withColumn("treated", F.coalesce(size >= F.col("_from"), F.lit(False)))
    return rest.select(*keep, "treated").unionByName(edge.select(*keep, "treated"))
