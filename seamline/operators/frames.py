"""The frames that analyses start from: labelled reviews, the style index, and labelled observations.

Reviews are counted by item, label, year and what else a result needs before anything is joined to them, so an item
with a large part of all reviews costs the join a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import taxonomy, text
from ..functions.text import BUCKETS

WINDOW_FROM = 2019


def year_start_ms(year: int) -> int:
    """First millisecond of a UTC year."""
    import datetime

    return int(datetime.datetime(year, 1, 1, tzinfo=datetime.timezone.utc).timestamp() * 1000)


def since(df: DataFrame, year: int) -> DataFrame:
    """Reviews of `year` and later, by ranges of the stored number so that the scan can skip the rest.

    Times count as seconds up to 1e11, as milliseconds beyond. Reviews without a time are left out.
    """
    ms = year_start_ms(year)
    t = F.col("ts_ms")
    return df.filter((t >= max(ms, 100_000_000_001)) | ((t >= ms // 1000) & (t <= 100_000_000_000)))


def labelled_reviews(review: DataFrame, *also: Column | str) -> DataFrame:
    """review_id, asin, parent_asin, verified, yr, label and `also` of every review.

    A null verified_purchase is not verified; reviews without a time have no year; null texts count as empty.
    """
    us = F.when(F.col("ts_ms") > 100_000_000_000, F.col("ts_ms") * 1000).otherwise(F.col("ts_ms") * 1_000_000)
    return review.select(
        "review_id", "asin", "parent_asin", F.coalesce("verified_purchase", F.lit(False)).alias("verified"),
        F.year(F.timestamp_micros(us)).alias("yr"), text.label_of(F.col("title"), F.col("text")).alias("label"), *also,
    )


def with_taxonomy(metadata: DataFrame) -> DataFrame:
    """Metadata with segs, path, gender, half, gradient. A null or empty path is unknown in all of them."""
    df = metadata.withColumn("segs", taxonomy.segments(F.col("categories"))).withColumn("garment", taxonomy.garment_segments(F.col("segs")))
    df = df.withColumn("path", F.array_join("segs", " | "))
    return df.withColumn("gender", taxonomy.gender(F.col("path"))).withColumn("half", taxonomy.half(F.col("garment"))).withColumn("gradient", taxonomy.gradient(F.col("garment")))


def style_index(metadata: DataFrame, *also: str) -> DataFrame:
    """One row per parent_asin in scope: gender, half, gradient, path, item_title, store and `also`.

    Of several rows of a parent the one with the largest item_id counts. Parents that are null or empty, and items not
    for men or women or neither upper nor lower, are left out. A missing or blank store is `(unnamed)`.
    """
    t = with_taxonomy(metadata).filter(taxonomy.in_scope(F.col("gender"), F.col("half")) & (F.col("parent_asin") != ""))
    t = t.select(
        "parent_asin", "item_id", "gender", "half", "gradient", "path", text.squash(F.coalesce("title", F.lit(""))).alias("item_title"),
        F.coalesce(F.nullif(F.trim("store"), F.lit("")), F.lit("(unnamed)")).alias("store"), *also,
    )
    rest = [c for c in t.columns if c not in ("parent_asin", "item_id")]
    last = t.groupBy("parent_asin").agg(F.max_by(F.struct(*rest), "item_id").alias("i"))
    return last.select("parent_asin", *[f"i.{c}" for c in rest])


def only(df: DataFrame, column: str, keep) -> DataFrame:
    """The rows whose `column` fulfils keep(column). Unlike a filter this never computes the column a second time, so it
    is for columns that are expensive; rows where the condition is null are left out."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.filter(F.array(column), keep)).alias(column))


def bucketed(reviews: DataFrame) -> DataFrame:
    """The reviews whose label is a bucket."""
    return only(reviews, "label", lambda x: x.isin(BUCKETS))


def counted(reviews: DataFrame, *keys: str) -> DataFrame:
    """Labelled reviews counted by parent_asin and `keys`, combined before the shuffle; n is the count."""
    return reviews.groupBy("parent_asin", *keys).agg(F.count(F.lit(1)).alias("n"))


def final_counts(reviews: DataFrame, index: DataFrame, *keys: str, window_from: int = WINDOW_FROM) -> DataFrame:
    """Counts of labelled, verified reviews of the window by parent_asin, label and `keys`, joined to the index."""
    kept = reviews.filter(F.col("verified") & (F.col("yr") >= window_from))
    return counted(bucketed(kept), "label", *keys).join(index, "parent_asin")
