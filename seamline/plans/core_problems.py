"""Queries of the general data problems: orphan references (p1) and hot keys (p2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cuts import cut
from ..operators import orphans, skew
from ..session import table

HOT_SHARE = 0.025


def _us(column: str) -> F.Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every orphan of review (against metadata at ts_ms) and of metadata (against parent_store at first_seen)."""
    review, meta, store = (table(spark, d, t) for t in ("review", "metadata", "parent_store"))
    parts = (
        ("review", review.select(F.col("review_id").alias("row_id"), F.col("parent_asin").alias("key"), orphans.epoch_us(F.col("ts_ms")).alias("at_us")),
         meta.select(F.col("parent_asin").alias("key"), _us("first_seen").alias("from_us"), _us("removed_at").alias("to_us"))),
        ("metadata", meta.select(F.col("item_id").alias("row_id"), F.col("parent_asin").alias("key"), _us("first_seen").alias("at_us")),
         store.select(F.col("parent_asin").alias("key"), _us("added_at").alias("from_us"), _us("dropped_at").alias("to_us"))),
    )
    found = [orphans.find_orphans(r, t).select(F.lit(name).alias("src_table"), "row_id", "kind", orphans.year_of_us(F.col("at_us")).alias("yr")) for name, r, t in parts]
    return found[0].unionByName(found[1])


def p1_by_year(spark: SparkSession, d: str) -> DataFrame:
    """Orphans counted per table, kind and year."""
    return p1_found(spark, d).groupBy("src_table", "kind", "yr").agg(F.count(F.lit(1)).alias("n_orphans"))


P1_SQL = """
WITH rv AS (SELECT review_id row_id, upper(trim(parent_asin, ' \t\n\r')) k,
                   CASE WHEN ts_ms > 100000000000 THEN ts_ms * 1000 ELSE ts_ms * 1000000 END t FROM review),
md AS (SELECT item_id row_id, upper(trim(parent_asin, ' \t\n\r')) k, epoch_us(first_seen) t, epoch_us(removed_at) e FROM metadata),
ps AS (SELECT upper(trim(parent_asin, ' \t\n\r')) k, epoch_us(added_at) t, epoch_us(dropped_at) e FROM parent_store),
refs AS (SELECT 'review' src_table, row_id, k, t FROM rv UNION ALL SELECT 'metadata', row_id, k, t FROM md),
tgt AS (SELECT 'review' src_table, k, t, e FROM md UNION ALL SELECT 'metadata', k, t, e FROM ps),
ext AS (SELECT src_table, k, min(t) first_t FROM tgt GROUP BY 1, 2),
alive AS (SELECT DISTINCT r.src_table, r.row_id FROM refs r JOIN tgt g ON r.src_table = g.src_table AND r.k = g.k AND g.t <= r.t AND (g.e IS NULL OR r.t < g.e)),
found AS (SELECT r.src_table, r.row_id,
       CASE WHEN x.k IS NULL THEN 'missing' WHEN r.t IS NULL OR a.row_id IS NOT NULL THEN NULL WHEN r.t < x.first_t THEN 'late' ELSE 'deleted' END kind,
       coalesce(CAST(year(make_timestamp(r.t)) AS BIGINT), 0) yr
FROM refs r LEFT JOIN ext x ON r.src_table = x.src_table AND r.k = x.k LEFT JOIN alive a ON a.src_table = r.src_table AND a.row_id = r.row_id
WHERE r.k IS NOT NULL AND r.k <> '')
"""


def _reviews_by_item(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "review").select(orphans.clean_key(F.col("parent_asin")).alias("parent_asin"), "rating", "verified_purchase", "user_id")
    return r.filter("parent_asin is not null")


def _item_sums(pairs: DataFrame) -> DataFrame:
    """Rows, mean rating and verified share of each item, from its distinct (rating, verified) pairs and their counts."""
    w = F.col("w")
    items = pairs.groupBy("parent_asin").agg(
        F.sum("w").alias("n_rows"),
        F.try_divide(F.sum(F.col("rating") * w), F.sum(F.when(F.col("rating").isNotNull(), w))).alias("mean_rating"),
        (F.sum(F.when(F.col("verified_purchase"), w).otherwise(0)) / F.sum("w")).alias("verified_share"),
    )
    total = items.agg(F.sum("n_rows").alias("_all"))
    return items.crossJoin(F.broadcast(total)).withColumn("is_hot", F.col("n_rows") >= F.col("_all") * F.lit(HOT_SHARE)).drop("_all")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return skew.compress_values(_reviews_by_item(spark, d), ["parent_asin"], ["rating", "verified_purchase"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Items holding at least 2.5 % of the reviews that name an item."""
    return _item_sums(_pairs(spark, d)).filter("is_hot").select("parent_asin")


def p2_items(spark: SparkSession, d: str) -> DataFrame:
    """Every item with rows, mean rating, verified share, distinct reviewers and ratings, mode and median rating.

    Nulls: reviews without an item are left out; a null rating counts as a row but not in the rating figures, which are
    null where an item has no rating; a null verified_purchase counts as not verified.
    """
    pairs = cut(_pairs(spark, d), "pairs")  # at most the ratings times three for each item
    ratings = pairs.groupBy("parent_asin", "rating").agg(F.sum("w").alias("w"))
    users = skew.compress_values(_reviews_by_item(spark, d), ["parent_asin"], ["user_id"])
    k = ["parent_asin"]
    out = _item_sums(pairs)
    for more in (
        skew.weighted_distinct(users, k, "user_id", "n_users"),
        skew.weighted_distinct(ratings, k, "rating", "n_ratings"),
        skew.weighted_mode(ratings, k, "rating", "w", "mode_rating"),
        skew.weighted_percentile(ratings, k, "rating", "w", 0.5, "median_rating"),
    ):
        out = out.join(more, k, "left")
    return out.select("parent_asin", "n_rows", F.round("mean_rating", 6).alias("mean_rating"), F.round("verified_share", 6).alias("verified_share"), "is_hot", "n_users", "n_ratings", "mode_rating", "median_rating")


P2_KEYED = """
WITH r AS (SELECT upper(trim(parent_asin, ' \t\n\r')) AS parent_asin, rating, verified_purchase, user_id FROM review
           WHERE trim(parent_asin, ' \t\n\r') <> '')
"""

QUERIES = {"p1_found": p1_found, "p1_by_year": p1_by_year, "p2_found": p2_found, "p2_items": p2_items}

ORACLE = {
    "p1_found": P1_SQL + "SELECT src_table, row_id, kind, yr FROM found WHERE kind IS NOT NULL",
    "p1_by_year": P1_SQL + "SELECT src_table, kind, yr, count(*) AS n_orphans FROM found WHERE kind IS NOT NULL GROUP BY 1, 2, 3",
    "p2_found": P2_KEYED + f"SELECT parent_asin FROM r GROUP BY 1 HAVING count(*) >= {HOT_SHARE} * (SELECT count(*) FROM r)",
    "p2_items": P2_KEYED + f"""
, n AS (SELECT parent_asin, rating, count(*) c FROM r WHERE rating IS NOT NULL GROUP BY 1, 2),
m AS (SELECT parent_asin, rating FROM n QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY c DESC, rating) = 1)
SELECT r.parent_asin, count(*) AS n_rows, round(avg(r.rating), 6) AS mean_rating,
       round(sum(CASE WHEN verified_purchase THEN 1 ELSE 0 END) / count(*), 6) AS verified_share,
       count(*) >= {HOT_SHARE} * (SELECT count(*) FROM r) AS is_hot, count(DISTINCT user_id) AS n_users,
       count(DISTINCT r.rating) AS n_ratings, min(m.rating) AS mode_rating, quantile_disc(r.rating, 0.5) AS median_rating
FROM r LEFT JOIN m ON r.parent_asin = m.parent_asin GROUP BY r.parent_asin""",
}
