"""Misclassification of labels: confusion counts, attenuation factors and their bootstrap interval.

Everything is a function of nine counts c_kj (assigned bucket k, true bucket j), so groups, cells and bootstrap
replicates are rows that carry the nine counts as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cuts import cut
from ..functions import patterns as P
from ..functions.text import BUCKETS, uniform

PAIRS = [(k, j) for k in BUCKETS for j in BUCKETS]
#: Draws of clusters made in a task, and clusters that are broadcast at most; beyond, draws are shuffled to them.
DRAWS, SENT = 2_000_000, 500_000


def c(k: str, j: str) -> str:
    return f"c_{k}__{j}"


def confusion_columns(rows: DataFrame, *groups: str, n: Column | None = None, none_as_zero: bool = True) -> DataFrame:
    """One row per group with the nine counts. `none` counts as true to size or is dropped; `unclear` is always dropped."""
    weight = F.lit(1) if n is None else n
    human = F.when(F.col("human") == "none", "true_to_size").otherwise(F.col("human")) if none_as_zero else F.col("human")
    return rows.groupBy(*groups).agg(*[F.sum(F.when((F.col("assigned") == k) & (human == j), weight).otherwise(0)).alias(c(k, j)) for k, j in PAIRS])


def conditionals() -> dict[tuple[str, str], Column]:
    """P(true = j | assigned = k); null where nothing was assigned to k."""
    total = {k: sum((F.col(c(k, j)) for j in BUCKETS), F.lit(0)) for k in BUCKETS}
    return {(k, j): F.when(total[k] > 0, F.col(c(k, j)) / total[k]) for k, j in PAIRS}


def _weights(prevalence: dict[str, float]) -> dict[str, float]:
    total = sum(prevalence.values())
    return {k: v / total for k, v in prevalence.items()}


def with_lambda(counts: DataFrame, prevalence: dict[str, float] | None = None) -> DataFrame:
    """The counts with lambda, residual and lambda_reverse; null where a bucket has no rows or no true ones."""
    p, w = conditionals(), _weights(prevalence or P.ASSIGNED)
    small, right, large = BUCKETS
    whole = F.lit(True)
    for k in BUCKETS:
        whole = whole & p[k, small].isNotNull()
    true = {j: sum((F.lit(w[k]) * p[k, j] for k in BUCKETS), F.lit(0.0)) for j in BUCKETS}
    some = whole & (true[small] > 0) & (true[right] > 0) & (true[large] > 0)
    a = {j: (F.lit(w[large]) * p[large, j] - F.lit(w[small]) * p[small, j]) / true[j] for j in BUCKETS}
    expected = {k: p[k, large] - p[k, small] for k in BUCKETS}
    return (
        counts.withColumn("lambda", F.when(some, (a[large] - a[small]) / 2))
        .withColumn("residual", F.when(some, a[right] - (a[small] + a[large]) / 2))
        .withColumn("lambda_reverse", F.when(whole, (expected[large] - expected[small]) / 2))
    )


def p_zero(assigned: dict[str, float]) -> Column:
    """P(true to size) in a cell with these assigned counts."""
    p, w = conditionals(), _weights(assigned)
    return sum((F.lit(w[k]) * p[k, "true_to_size"] for k in BUCKETS), F.lit(0.0))


def score_sd(prevalence: dict[str, float] | None = None) -> float:
    """Standard deviation of the score where buckets have this prevalence."""
    w = _weights(prevalence or P.ASSIGNED)
    small, _, large = BUCKETS
    return ((w[small] + w[large]) - (w[large] - w[small]) ** 2) ** 0.5


def operative_mde(mde: Column, factor: Column, strict: bool = True) -> Column:
    """Detectable true effect; a factor that isn't positive is an error, or gives null if not strict."""
    other = F.raise_error(F.lit("lambda must be positive")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(factor > 0, mde / factor).otherwise(other)


def join_labels(labels: DataFrame, key: DataFrame) -> DataFrame:
    """Labels (review_id_hash, human) with their key; both have one row per hash. Labels without a key are left out, and so
    are keys without a label and null hashes."""
    return labels.join(key, "review_id_hash")


def bootstrap_lambda(rows: DataFrame, unit: str, replicates: int = 4000, seed: str = "20260814") -> DataFrame:
    """One row: n_clusters, n_valid, and the 2.5 % and 97.5 % positions of lambda over cluster resamples.

    `rows`: assigned, human and the cluster `unit` (null clusters are one). The counts of a resample are the sums of its
    clusters' counts, so clusters are aggregated and numbered once (rows here are hand-labelled, so they are few enough for
    one task) and replicates draw cluster numbers by a seeded hash. Draws are made once, in parts of DRAWS whatever the
    number of clusters, and added up by replicate where they are made: they are neither shuffled nor written. Replicates
    without lambda are left out.
    """
    cols = [c(k, j) for k, j in PAIRS]
    clusters = confusion_columns(rows.withColumn("_u", F.coalesce(F.col(unit).cast("string"), F.lit(""))), "_u")
    clusters = cut(clusters.withColumn("at", (F.row_number().over(Window.orderBy("_u")) - 1).cast("long")).drop("_u"), "label-clusters")
    spark, g = rows.sparkSession, clusters.count()
    parts = max(spark.sparkContext.defaultParallelism, -(-replicates * g // DRAWS))
    numbers = spark.range(0, replicates * g, 1, parts).select(F.expr(f"id div {max(g, 1)}").alias("rep"), F.expr(f"id % {max(g, 1)}").alias("draw"))
    at = F.floor(uniform(F.concat_ws("|", F.lit(seed), "rep", "draw")) * g)
    # never null; told so, the join has no filter before it that would draw a second time
    draws = numbers.select("rep", F.coalesce(at, F.lit(0).cast("long")).alias("at"))
    sums = draws.join(F.broadcast(clusters) if g <= SENT else clusters, "at").groupBy("rep").agg(*[F.sum(x).alias(x) for x in cols])
    lam = cut(with_lambda(sums).filter(F.col("lambda").isNotNull()).select("lambda"), "lambdas")  # one number per replicate
    low, high = interval_positions(lam, "lambda")
    return lam.agg(F.count(F.lit(1)).alias("n_valid")).crossJoin(low).crossJoin(high).withColumn("n_clusters", F.lit(g).cast("long"))


def interval_positions(values: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The values at positions floor(0.025 n) and floor(0.975 n) of the sorted values, each as one row."""
    ranked = values.withColumn("_r", F.row_number().over(Window.orderBy(column)) - 1)  # one value per replicate
    n = values.agg(F.count(F.lit(1)).alias("_n"))
    at = ranked.crossJoin(F.broadcast(n))
    low = at.agg(F.max(F.when(F.col("_r") == F.floor(F.col("_n") * 25 / 1000), F.col(column))).alias("low"))
    high = at.agg(F.max(F.when(F.col("_r") == F.least(F.col("_n") - 1, F.floor(F.col("_n") * 975 / 1000)), F.col(column))).alias("high"))
    return low, high
