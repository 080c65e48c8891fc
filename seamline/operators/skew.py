"""Joins and aggregates that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A group is hot when it holds at least one part in HOT_PARTS of all rows, so there are at most HOT_PARTS of them.
HOT_PARTS = 200


def attach_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of `rows` with one row per group, without sending a hot group's rows to one task.

    `groups` has unique `keys` and in `size` the number of `rows` of each group. Groups holding at least 1/HOT_PARTS
    of all rows are at most HOT_PARTS by counting, so they are broadcast and their rows don't move; all others are
    joined by shuffle. Keys compare with =, so null keys match nothing. Both inputs are read twice: pass written or
    cheap ones. Empty inputs give an empty result.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("_total"))
    sized = groups.crossJoin(F.broadcast(total))
    is_hot = F.col(size) * HOT_PARTS >= F.col("_total")
    hot = sized.filter(is_hot).drop("_total")
    cold = sized.filter(~is_hot).drop("_total")
    few = F.broadcast(hot)
    return rows.join(few, keys, "inner").unionByName(rows.join(few.select(*keys), keys, "left_anti").join(cold, keys, "inner"))


def compress_values(df: DataFrame, keys: list[str], values: list[str], weight: str = "w") -> DataFrame:
    """One row per distinct (keys, values) with its number of rows: what every per-key statistic below starts from.

    The count is combined before the shuffle, so a key with a third of all rows costs a task only its distinct values.
    Null keys and null values are groups of their own; an empty table gives an empty one.
    """
    return df.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias(weight))


def weighted_distinct(weighted: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact number of distinct non-null values of each key, from compressed values."""
    return weighted.groupBy(*keys, value).agg(F.lit(1).alias("_one")).groupBy(*keys).agg(F.count(value).alias(name))


def weighted_mode(weighted: DataFrame, keys: list[str], value: str, weight: str, name: str) -> DataFrame:
    """Most frequent non-null value of each key, the smallest of equally frequent ones; null where all are null."""
    per_value = weighted.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    best = F.max(F.when(F.col(value).isNotNull(), F.struct(F.col("_w").alias("w"), (-F.col(value)).alias("v"))))
    return per_value.groupBy(*keys).agg((-best["v"]).alias(name))


def value_bin(value) -> F.Column:
    """A bin that never falls as the value rises, the same for every key: 64 bins for each doubling of size."""
    return F.when(F.isnan(value), F.lit(1 << 20)).otherwise(
        F.least(F.greatest(F.floor(F.signum(value) * F.log2(F.abs(value) + 1) * 64), F.lit(-70000)), F.lit(70000))
    )


def weighted_percentile(weighted: DataFrame, keys: list[str], value: str, weight: str, share: float, name: str) -> DataFrame:
    """Exact lower percentile of each key: the smallest non-null value with at least `share` of the key's rows at or below it.

    Two steps keep a hot key out of one task: weights are summed by key and value bin (at most some 140,000 bins a key),
    the bin that holds the wanted rank is found on those sums, and only that bin's values are ordered. Keys whose values
    are all null get no row.
    """
    v = weighted.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    v = v.withColumn("_bin", value_bin(F.col(value).cast("double")))
    over_bins = Window.partitionBy(*keys)
    bins = v.groupBy(*keys, "_bin").agg(F.sum("_w").alias("_bw"))
    bins = bins.select(
        *keys, "_bin",
        (F.sum("_bw").over(over_bins.orderBy("_bin")) - F.col("_bw")).alias("_before"),
        "_bw",
        F.greatest(F.ceil(F.sum("_bw").over(over_bins) * F.lit(share)), F.lit(1)).alias("_rank"),
    ).filter((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_bw")))
    inside = v.join(bins.drop("_bw"), [*keys, "_bin"])
    upto = F.col("_before") + F.sum("_w").over(Window.partitionBy(*keys, "_bin").orderBy(value))
    return inside.withColumn("_upto", upto).filter(F.col("_upto") >= F.col("_rank")).groupBy(*keys).agg(F.min(value).alias(name))
