"""Queries on reviews and items: labels, taxonomy, cells, items, stores, years, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import sizes, taxonomy, text
from ..functions.text import BUCKETS
from ..operators import cells, frames, sampling
from ..session import spread, table
from . import sql as S

WINDOW = frames.WINDOW_FROM
#: Distinct asins from which a listing is taken for several products in one.
MANY_ASINS = 20
ASIN_STEPS = [10, 20, 50, 100]


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The reviews, over all cores even if they lie in few files: reading their text is heavy per row."""
    return spread(table(spark, d, "review"))


def _reviews(spark: SparkSession, d: str, *also) -> DataFrame:
    return frames.labelled_reviews(_texts(spark, d), *also)


def _index(spark: SparkSession, d: str) -> DataFrame:
    return frames.style_index(table(spark, d, "metadata"))


def _windowed(spark: SparkSession, d: str, *also) -> DataFrame:
    """Labelled reviews of the window; the range reaches the scan."""
    return frames.labelled_reviews(spread(frames.since(table(spark, d, "review"), WINDOW)), *also)


def _final(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    return frames.final_counts(_windowed(spark, d), _index(spark, d), *keys)


def _joined(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    return frames.counted(_reviews(spark, d), "label", "yr", "verified", *keys).join(_index(spark, d), "parent_asin")


# --- labels -----------------------------------------------------------------------------------------------------------


def label_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Reviews per label, with how many have no text and how many are verified."""
    r = _reviews(spark, d, (F.length(text.squash(F.coalesce("text", F.lit("")))) == 0).alias("blank"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return r.groupBy("label").agg(F.count(F.lit(1)).alias("n"), one(F.col("blank")).alias("n_blank"), one(F.col("verified")).alias("n_verified"))


def pattern_hits(spark: SparkSession, d: str) -> DataFrame:
    """How often each pattern was the first of its bucket to match, ambiguous reviews included."""
    r = _texts(spark, d).select(text.folded(text.blob(F.col("title"), F.col("text"))).alias("b"))
    return r.select(F.explode(text.pattern_hits(F.col("b"))).alias("h")).groupBy("h.bucket", "h.pattern").agg(F.count(F.lit(1)).alias("n"))


def top_patterns(spark: SparkSession, d: str) -> DataFrame:
    """The six most frequent patterns of each bucket."""
    return cells.top_within(pattern_hits(spark, d), 6, ["bucket"], [F.desc("n"), F.col("pattern")])


def buyer_rates(spark: SparkSession, d: str) -> DataFrame:
    """Who reviews say they were bought for, by gender of the item's category."""
    r = _texts(spark, d).select("parent_asin", text.folded(text.blob(F.col("title"), F.col("text"))).alias("b"))
    flags = r.select("parent_asin", text.buyer_flags(F.col("b")).alias("f"), text.own_purchase(F.col("b")).alias("own"))
    few = flags.groupBy("parent_asin", "own", "f.third_party", "f.cross_gender", "f.stated_gender").agg(F.count(F.lit(1)).alias("n"))
    j = few.join(_index(spark, d), "parent_asin")
    mismatch = F.coalesce(F.col("stated_gender") != F.col("gender"), F.lit(False))
    sum_if = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return j.groupBy("gender").agg(
        F.sum("n").alias("n"), sum_if(F.col("third_party")).alias("third_party"), sum_if(F.col("cross_gender")).alias("cross_gender"),
        sum_if(F.col("stated_gender").isNotNull()).alias("stated"), sum_if(mismatch).alias("mismatch"),
        sum_if(F.col("third_party") | F.col("cross_gender") | mismatch).alias("suspect"), sum_if(F.col("own")).alias("own"),
    )


def review_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The pseudonym of every review."""
    return table(spark, d, "review").select("review_id", text.review_hash(F.col("user_id"), F.col("asin"), F.col("ts_ms")).alias("review_id_hash"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    """The text around the first bucket pattern of every labelled review."""
    r = _texts(spark, d).select("review_id", "title", "text", text.label_of(F.col("title"), F.col("text")).alias("label"))
    r = frames.bucketed(r)
    pattern = F.lit(None).cast("string")
    for b in BUCKETS:
        pattern = F.when(F.col("label") == b, text.any_of(P.FIT[b])).otherwise(pattern)
    return r.select("review_id", "label", text.snippet(F.col("title"), F.col("text"), pattern).alias("snippet"))


# --- items ------------------------------------------------------------------------------------------------------------


def gender_hist(spark: SparkSession, d: str) -> DataFrame:
    return cells.with_share(cells.histogram(frames.with_taxonomy(table(spark, d, "metadata")), "gender"), "n")


def half_hist(spark: SparkSession, d: str) -> DataFrame:
    return cells.with_share(cells.histogram(frames.with_taxonomy(table(spark, d, "metadata")), "half"), "n")


def cells_2x2(spark: SparkSession, d: str) -> DataFrame:
    """Items in scope by gender and half, with how many have a size that can be told."""
    m = frames.with_taxonomy(table(spark, d, "metadata")).filter(taxonomy.in_scope(F.col("gender"), F.col("half")))
    entry = sizes.size_entry(sizes.flat_keys(sizes.details_map(F.col("details"))))
    m = m.withColumn("e", entry).withColumn("sized", F.col("e").isNotNull() & sizes.normal_size(F.col("e.value"))["size"].isNotNull())
    return m.groupBy("gender", "half").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("sized"), 1).otherwise(0)).alias("n_sized"))


def cells_gradient(spark: SparkSession, d: str) -> DataFrame:
    """Items in scope by gender and garment class, classes as columns."""
    m = frames.with_taxonomy(table(spark, d, "metadata")).filter(taxonomy.in_scope(F.col("gender"), F.col("half")) & F.col("gradient").isNotNull())
    return m.groupBy("gender").pivot("gradient", list(P.GRADIENT_POSITION)).agg(F.count(F.lit(1))).na.fill(0)


def details_keys(spark: SparkSession, d: str) -> DataFrame:
    """Frequency of each key in details, keys in their common spelling."""
    m = table(spark, d, "metadata").select(sizes.details_map(F.col("details")).alias("m"))
    return cells.histogram(m.select(F.explode(F.map_keys("m")).alias("k")).select(F.rtrim(F.lower(text.squash(F.col("k"))), F.lit(":")).alias("key")), "key")


def top_details_keys(spark: SparkSession, d: str) -> DataFrame:
    """The 20 most frequent keys, ties by name."""
    return cells.top(details_keys(spark, d), 20, "n", "key")


def size_examples(spark: SparkSession, d: str) -> DataFrame:
    """Sixty size entries as typed, every set of sixty equally likely."""
    m = table(spark, d, "metadata").select("item_id", sizes.size_entry(sizes.flat_keys(sizes.details_map(F.col("details")))).alias("e")).filter("e is not null")
    m = m.select("item_id", F.concat(F.col("e.key"), F.lit(" = "), F.coalesce(F.col("e.value"), F.lit("null"))).alias("raw"), F.lit(1).alias("one"))
    return sampling.stratified(m, ["one"], F.col("item_id").cast("string"), 60, "sizes").select("item_id", "raw")


def size_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Which rule found a size entry, how its size was told, and the size."""
    m = table(spark, d, "metadata").select(sizes.details_map(F.col("details")).alias("m"))
    m = m.withColumn("e", F.when(F.size("m") > 0, sizes.size_entry(sizes.flat_keys(F.col("m")))))
    told = sizes.normal_size(F.col("e.value"))
    reason = F.when(F.coalesce(F.size("m"), F.lit(0)) <= 0, "no_details").when(F.col("e").isNull(), "no_size_key").otherwise(told["reason"])
    return m.select(F.col("e.rule").alias("rule"), reason.alias("reason"), F.when(F.col("e").isNotNull(), told["size"]).alias("size")).groupBy("rule", "reason", "size").agg(F.count(F.lit(1)).alias("n"))


# --- cells ------------------------------------------------------------------------------------------------------------


def cell_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Labelled, verified reviews of the window by gender, half and bucket."""
    return cells.histogram(_final(spark, d), "gender", "half", "label", weight="n")


def gradient_bucket(spark: SparkSession, d: str) -> DataFrame:
    return cells.histogram(_final(spark, d).filter("gradient is not null"), "gender", "gradient", "label", weight="n")


def per_parent_counts(spark: SparkSession, d: str) -> DataFrame:
    return cells.histogram(_final(spark, d), "parent_asin", weight="n")


def heavy_listings(spark: SparkSession, d: str) -> DataFrame:
    """The 20 listings with most labelled reviews, their share of all and their mean score."""
    f = _final(spark, d)
    a = f.groupBy("parent_asin", "gender", "half").agg(F.sum("n").alias("n"), (F.sum(text.score(F.col("label")) * F.col("n")) / F.sum("n")).alias("mean_score"))
    total = a.agg(F.sum("n").alias("all_n"))
    a = a.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("all_n"), 6)).withColumn("mean_score", F.round("mean_score", 6)).drop("all_n")
    return cells.top(a, 20, "n", "parent_asin")


def exposure(spark: SparkSession, d: str) -> DataFrame:
    """Per cell: labelled reviews in all, of the 5 and of the 20 heaviest listings overall."""
    per = cells.histogram(_final(spark, d), "parent_asin", "gender", "half", weight="n")
    heavy = per.orderBy(F.desc("n"), "parent_asin").limit(20)
    heavy = heavy.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "parent_asin"))).select("parent_asin", "r")
    j = per.join(F.broadcast(heavy), "parent_asin", "left")  # 20 rows
    return j.groupBy("gender", "half").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("r") <= 5, F.col("n")).otherwise(0)).alias("top5"), F.sum(F.when(F.col("r") <= 20, F.col("n")).otherwise(0)).alias("top20"))


def first_titles(spark: SparkSession, d: str) -> DataFrame:
    """The titles of the first six reviews, by arrival, of each of the ten heaviest listings."""
    per = cells.histogram(_final(spark, d), "parent_asin", weight="n").orderBy(F.desc("n"), "parent_asin").limit(10).select("parent_asin")
    r = table(spark, d, "review").select("review_id", "parent_asin", "title").join(F.broadcast(per), "parent_asin")  # 10 rows
    return cells.top_within(r, 6, ["parent_asin"], [F.col("review_id")]).select("parent_asin", "review_id", "title", "rank")


def asin_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct asins of each parent in scope, and whether they pass each step."""
    pairs = table(spark, d, "review").filter("asin is not null and asin <> ''").select("parent_asin", "asin").distinct()
    n = pairs.join(_index(spark, d).select("parent_asin"), "parent_asin").groupBy("parent_asin").agg(F.count("asin").alias("n_asins"))
    return n.select("parent_asin", "n_asins", *[(F.col("n_asins") > k).alias(f"over_{k}") for k in ASIN_STEPS])


def listing_medians(spark: SparkSession, d: str) -> DataFrame:
    """Median, mean and largest number of distinct asins and of labelled reviews per listing with labelled reviews."""
    a = _final(spark, d).groupBy("parent_asin").agg(F.sum("n").alias("n")).join(asin_distinct(spark, d).select("parent_asin", "n_asins"), "parent_asin")
    return a.agg(*[f(c).alias(f"{name}_{c}") for c in ("n_asins", "n") for name, f in (("median", F.median), ("mean", lambda x: F.round(F.avg(x), 6)), ("max", F.max))])


def shared_asins(spark: SparkSession, d: str) -> DataFrame:
    """Asins that reviews name under more than one parent in scope."""
    pairs = table(spark, d, "review").filter("asin is not null and asin <> ''").select("parent_asin", "asin").distinct()
    return pairs.join(_index(spark, d).select("parent_asin"), "parent_asin").groupBy("asin").agg(F.count("parent_asin").alias("n_parents")).filter("n_parents > 1")


def styles_per_store(spark: SparkSession, d: str) -> DataFrame:
    return cells.histogram(_index(spark, d), "store")


def survival_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Per listing: reviews left after each filter, and the share of labelled ones that survive all."""
    return cells.funnel(_joined(spark, d), WINDOW, BUCKETS).withColumn("survival", F.round("survival", 6))


def cells_spanned(spark: SparkSession, d: str) -> DataFrame:
    """Stores and reviews by the number of cells a store's reviews span."""
    per = cells.histogram(_final(spark, d).filter("store <> '(unnamed)'"), "store", "gender", "half", weight="n")
    stores = per.groupBy("store").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    out = stores.groupBy("k").agg(F.count(F.lit(1)).alias("n_stores"), F.sum("n").alias("n_obs"))
    return cells.with_share(out, "n_obs").withColumn("share", F.round("share", 6))


def seller_identifying(spark: SparkSession, d: str) -> DataFrame:
    """Per cell: reviews, and how many come from stores that span three cells or more."""
    per = cells.histogram(_final(spark, d).filter("store <> '(unnamed)'"), "store", "gender", "half", weight="n")
    k = per.groupBy("store").agg(F.count(F.lit(1)).alias("k"))
    out = per.join(k, "store").groupBy("gender", "half").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("k") >= 3, F.col("n")).otherwise(0)).alias("n_identifying"))
    return out.withColumn("retained", F.round(F.col("n_identifying") / F.col("n"), 6))


# --- years ------------------------------------------------------------------------------------------------------------


def _composition(spark: SparkSession, d: str) -> DataFrame:
    r = _reviews(spark, d, F.length(F.concat(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))).alias("chars"), F.coalesce("rating", F.lit(0.0)).alias("rating0"))
    lab = F.col("label").isin(BUCKETS)
    y = r.filter("yr is not null").groupBy("yr").agg(
        F.count(F.lit(1)).alias("n"), F.avg("chars").alias("mean_chars"), F.avg(F.when(F.col("verified"), 100.0).otherwise(0.0)).alias("verified_pct"),
        (F.sum("rating0") / F.count(F.lit(1))).alias("mean_rating"), F.avg(F.when(lab, 100.0).otherwise(0.0)).alias("labelled_pct"), F.sum(F.when(lab, 1).otherwise(0)).alias("labelled"),
    )
    return y.filter("n >= 300")


def year_composition(spark: SparkSession, d: str) -> DataFrame:
    """Per UTC year with 300 reviews or more: length, verified and labelled share, mean rating over all rows."""
    return _composition(spark, d).select("yr", "n", "labelled", *[F.round(c, 4).alias(c) for c in ("mean_chars", "verified_pct", "mean_rating", "labelled_pct")])


def year_delta(spark: SparkSession, d: str) -> DataFrame:
    """Change of each share against the reported year before, and whether the year is stable."""
    out = cells.year_on_year(_composition(spark, d), {"verified_pct": 2.0, "mean_chars": 15.0, "labelled_pct": 1.5})
    return out.select("yr", *[F.round(f"d_{c}", 4).alias(f"d_{c}") for c in ("verified_pct", "mean_chars", "labelled_pct")], "stable")


def stable_from(spark: SparkSession, d: str) -> DataFrame:
    """Start of the last uninterrupted run of stable years."""
    return cells.stable_from(year_delta(spark, d))


#: Trailing windows in years; 1.5 keeps one calendar year, as years are whole and the start is not.
TRAILING = [1.5, 3.0, 5.0, 8.0, 100.0]


def candidate_windows(spark: SparkSession, d: str) -> DataFrame:
    """Reviews, labelled ones and labelled ones in scope of each trailing window."""
    by = frames.counted(_reviews(spark, d).filter("yr is not null"), "label", "yr").join(_index(spark, d).select("parent_asin", F.lit(1).alias("in_idx")), "parent_asin", "left")
    lab = F.col("label").isin(BUCKETS)
    years = by.groupBy("yr").agg(F.sum("n").alias("n"), F.sum(F.when(lab, F.col("n")).otherwise(0)).alias("labelled"), F.sum(F.when(lab & F.col("in_idx").isNotNull(), F.col("n")).otherwise(0)).alias("in_scope"))
    last = years.agg(F.max("yr").alias("last"))
    spans = spark.createDataFrame([(b,) for b in TRAILING], "years_back double")
    j = years.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(spans)).filter(F.col("yr") >= F.col("last") - F.col("years_back") + 1)
    return j.groupBy("years_back").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("in_scope").alias("in_scope"))


# --- clusters ---------------------------------------------------------------------------------------------------------


def scenario_sizes(spark: SparkSession, d: str, threshold: int = MANY_ASINS) -> DataFrame:
    """(scenario, cluster_id, n): clusters of labelled reviews when listings of many asins are kept, excluded or split.

    STORE takes the store as cluster.
    """
    f = _final(spark, d, "asin")
    many = asin_distinct(spark, d).filter(F.col("n_asins") > threshold).select("parent_asin")
    per = cells.histogram(f, "parent_asin", weight="n")
    keep = per.select(F.lit("KEEP").alias("scenario"), F.col("parent_asin").alias("cluster_id"), "n")
    passing = per.join(many, "parent_asin", "left_anti").select(F.col("parent_asin").alias("cluster_id"), "n")
    split = f.filter("asin is not null and asin <> ''").join(many, "parent_asin", "left_semi").groupBy("parent_asin", "asin").agg(F.sum("n").alias("n"))
    split = split.select(F.concat_ws("/", "parent_asin", "asin").alias("cluster_id"), "n")
    store = cells.histogram(f, "store", weight="n").select(F.lit("STORE").alias("scenario"), F.col("store").alias("cluster_id"), "n")
    return keep.unionByName(passing.withColumn("scenario", F.lit("EXCLUDE"))).unionByName(passing.unionByName(split).withColumn("scenario", F.lit("SPLIT"))).unionByName(store)


def cluster_params(spark: SparkSession, d: str) -> DataFrame:
    """Moments and design effect of each scenario's clusters."""
    m = cells.size_moments(scenario_sizes(spark, d), "n", "scenario")
    deff = 1 + ((F.col("cv") * F.col("cv") + 1) * F.col("m_bar") - 1) * 0.05
    return m.select("scenario", "n_clusters", "n_obs", "largest", *[F.round(c, 6).alias(c) for c in ("m_bar", "sd", "cv", "singletons")], F.round(deff, 6).alias("deff"))


def cluster_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Positional median, 90 % and 99 % of labelled reviews per listing."""
    return cells.positional_quantiles(per_parent_counts(spark, d), "n", {"p50": (1, 2), "p90": (9, 10), "p99": (99, 100)})


def half_split(spark: SparkSession, d: str) -> DataFrame:
    """Listings split into two halves of the labelled reviews, the largest listing first."""
    return cells.half_split(per_parent_counts(spark, d), "n", "parent_asin")


# --- size pairs -------------------------------------------------------------------------------------------------------


def size_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Usual and bought size of the reviews that state both."""
    b = text.folded(text.blob(F.col("title"), F.col("text")))
    r = _texts(spark, d).select("review_id", "parent_asin", text.let(b, lambda x: F.when(text.talks_size(x), text.size_pair(x))).alias("s"))
    return frames.only(r, "s", lambda x: x.isNotNull()).select("review_id", "parent_asin", "s.usual", "s.bought", "s.deviation")


def _deviations(spark: SparkSession, d: str) -> DataFrame:
    few = size_pairs(spark, d).groupBy("parent_asin", "deviation").agg(F.count(F.lit(1)).alias("n"))
    return few.join(_index(spark, d), "parent_asin")


def deviation_hist(spark: SparkSession, d: str) -> DataFrame:
    return cells.with_share(cells.histogram(size_pairs(spark, d), "deviation"), "n").withColumn("share", F.round("share", 6))


def deviation_cells(spark: SparkSession, d: str) -> DataFrame:
    """Per cell: reviews, mean deviation, and how many bought a larger, the same and a smaller size."""
    n, x = F.col("n"), F.col("deviation")
    part = lambda c: F.sum(F.when(c, n).otherwise(0))
    a = _deviations(spark, d).groupBy("gender", "half").agg(F.sum("n").alias("n_pairs"), (F.sum(x * n) / F.sum("n")).alias("mean"), part(x > 0).alias("up"), part(x == 0).alias("same"), part(x < 0).alias("down"))
    return a.withColumn("mean", F.round("mean", 6))


def store_deviations(spark: SparkSession, d: str) -> DataFrame:
    """Per store: size pairs, sum of deviations, larger ones bought in all and by gender."""
    n, x = F.col("n"), F.col("deviation")
    up = lambda c: F.sum(F.when((x > 0) & c, n).otherwise(0))
    return _deviations(spark, d).groupBy("store").agg(F.sum("n").alias("n_pairs"), F.sum(x * n).alias("total"), up(F.lit(True)).alias("up"), up(F.col("gender") == "men").alias("up_men"), up(F.col("gender") == "women").alias("up_women"))


def store_concentration(spark: SparkSession, d: str) -> DataFrame:
    """Share of the k stores with most larger-size purchases."""
    return cells.concentration(store_deviations(spark, d).filter("up > 0"), "up", "store", [1, 5, 10, 25, 50]).withColumn("share", F.round("share", 6))


def store_hhi(spark: SparkSession, d: str) -> DataFrame:
    h = cells.hhi(store_deviations(spark, d).filter("up > 0"), "up")
    return h.select(F.round("hhi", 8).alias("hhi"), F.round("effective", 4).alias("effective"))


QUERIES = {
    f.__name__: f
    for f in (
        label_histogram, pattern_hits, top_patterns, buyer_rates, review_hashes, snippets, gender_hist, half_hist, cells_2x2, cells_gradient, details_keys, top_details_keys, size_examples, size_reasons,
        cell_bucket, gradient_bucket, per_parent_counts, heavy_listings, exposure, first_titles, asin_distinct, listing_medians, shared_asins, styles_per_store, survival_funnel, cells_spanned,
        seller_identifying, year_composition, year_delta, stable_from, candidate_windows, scenario_sizes, cluster_params, cluster_quantiles, half_split,
        size_pairs, deviation_hist, deviation_cells, store_deviations, store_concentration, store_hhi,
    )
}

_LAB = f"WITH {S.labelled('review', 'title', 'text')}"
_HITS = f"""{_LAB}, ph AS ({' UNION ALL '.join(f"SELECT '{b}' AS bucket, {S.first_pattern('b', b)} AS pattern FROM lab WHERE h{k} = 1" for k, b in enumerate(BUCKETS))}),
pc AS (SELECT bucket, pattern, count(*) AS n FROM ph GROUP BY 1, 2)"""
_FLAGS = f"""{S.JOINED}, fl AS (SELECT gender, {S.has('b', P.THIRD_PARTY)} AS tp, {S.has('b', P.CROSS_GENDER)} AS cg,
CASE WHEN {S.has('b', P.SELF_WOMAN)} AND NOT {S.has('b', P.SELF_MAN)} THEN 'women' WHEN {S.has('b', P.SELF_MAN)} AND NOT {S.has('b', P.SELF_WOMAN)} THEN 'men' END AS st FROM obs)"""
_NO_SIZE = S.q(rf"\b{text.SIZE}\b({P.NOT_A_SIZE[3:-1]})")
_LADDER = "CASE x " + " ".join(f"WHEN {S.q(k)} THEN {v}" for k, v in P.TEXT_LADDER.items()) + " END"


def _steps_sql(patterns: list[str]) -> str:
    """Distinct ladder steps; sizes that may not count are blotted out first, as this engine has no lookahead."""
    found = ", ".join(f"regexp_extract_all({'nb' if '{no}' in p else 'b'}, {S.q(text.sized(p.replace('{no}', '')))}, 1)" for p in patterns)
    return f"list_distinct(list_transform(flatten([{found}]), lambda x: {_LADDER}))"


_PAIRS = f"""WITH bl AS (SELECT review_id, parent_asin, {S.folded('title', 'text')} AS b FROM review),
nb AS (SELECT *, regexp_replace(b, {_NO_SIZE}, 'zz\\2', 'g') AS nb FROM bl WHERE contains(b, 'size') OR contains(b, 'wear') OR contains(b, 'order')),
st AS (SELECT *, {_steps_sql(P.USUAL)} AS us, {_steps_sql(P.BOUGHT)} AS bo FROM nb),
sp AS (SELECT review_id, parent_asin, us[1] AS usual, bo[1] AS bought, bo[1] - us[1] AS deviation FROM st
       WHERE len(us) = 1 AND len(bo) = 1 AND NOT {S.has('b', P.NUMBER_SIZE)} AND NOT {S.has('b', text.sized(P.EITHER_SIZE))})"""
_DEV = f"{_PAIRS}, {S.TAXONOMY}, dv AS (SELECT sp.*, i.gender, i.half, i.store FROM sp JOIN idx i ON sp.parent_asin = i.parent_asin)"
_UPS = f"{_DEV}, up AS (SELECT store, count(*) AS n FROM dv WHERE deviation > 0 GROUP BY 1)"
_SPANNED = f"{S.FINAL}, per AS (SELECT store, gender, half, count(*) n FROM fin WHERE store <> '(unnamed)' GROUP BY 1, 2, 3)"
_ASINS = f"{S.JOINED}, pa AS (SELECT DISTINCT parent_asin, asin FROM obs WHERE asin <> '')"
_YEARS = f"""{_LAB}, yy AS (SELECT {S.YEAR} AS yr, count(*) AS n, sum(CASE WHEN {S.IN_BUCKETS} THEN 1 ELSE 0 END) AS labelled,
avg(length(coalesce(title, '') || coalesce(text, ''))) AS mean_chars, 100.0 * sum(CASE WHEN verified_purchase THEN 1 ELSE 0 END) / count(*) AS verified_pct,
sum(coalesce(rating, 0)) / count(*) AS mean_rating, 100.0 * sum(CASE WHEN {S.IN_BUCKETS} THEN 1 ELSE 0 END) / count(*) AS labelled_pct
FROM lab WHERE ts_ms IS NOT NULL GROUP BY 1 HAVING count(*) >= 300)"""
_DELTAS = f"""{_YEARS}, dd AS (SELECT yr, {', '.join(f'{c} - lag({c}) OVER (ORDER BY yr) AS d_{c}' for c in ('verified_pct', 'mean_chars', 'labelled_pct'))} FROM yy),
de AS (SELECT *, abs(d_verified_pct) < 2 AND abs(d_mean_chars) < 15 AND abs(d_labelled_pct) < 1.5 AS stable FROM dd)"""
_SCENARIOS = f"""{S.FINAL}, pa AS (SELECT DISTINCT parent_asin, asin FROM obs WHERE asin <> ''),
many AS (SELECT parent_asin FROM pa GROUP BY 1 HAVING count(*) > {MANY_ASINS}), per AS (SELECT parent_asin, count(*) n FROM fin GROUP BY 1),
sc AS (SELECT 'KEEP' AS scenario, parent_asin AS cluster_id, n FROM per
UNION ALL SELECT s, parent_asin, n FROM per CROSS JOIN (VALUES ('EXCLUDE'), ('SPLIT')) v(s) WHERE parent_asin NOT IN (SELECT parent_asin FROM many)
UNION ALL SELECT 'SPLIT', parent_asin || '/' || asin, count(*) FROM fin WHERE asin <> '' AND parent_asin IN (SELECT parent_asin FROM many) GROUP BY parent_asin, asin
UNION ALL SELECT 'STORE', store, count(*) FROM fin GROUP BY store)"""
_DET = f"WITH dk AS (SELECT item_id, unnest(json_keys(details)) AS k FROM metadata WHERE json_valid(details) AND json_type(details) = 'OBJECT')"

_FLAT = f"rtrim(lower({S.squash('k')}), ':')"
_ALPHA = "CASE @x@ " + " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in P.ITEM_LADDER.items()) + " END"
_TAILS = ", ".join(f"CASE WHEN starts_with(cand, {S.q(p)}) THEN {_ALPHA.replace('@x@', f'trim(substr(cand, {len(p) + 1}))')} END" for p in P.SIZE_PREFIXES)
_SIZES = f"""sz0 AS (SELECT *, CASE WHEN CASE WHEN json_valid(details) THEN json_type(details) = 'OBJECT' ELSE false END THEN json_keys(details) END AS ks FROM @src@),
sz1 AS (SELECT *, list_transform(ks, lambda k: {_FLAT}) AS fl FROM sz0),
sz2 AS (SELECT *, list_position(fl, 'size') AS ps, list_position(list_transform(fl, lambda k: {S.has('k', P.SIZE_KEY)} AND NOT {S.has('k', P.NO_SIZE_KEY)}), true) AS pl FROM sz1),
sz3 AS (SELECT *, CASE WHEN ps > 0 THEN 'strict' WHEN pl > 0 THEN 'loose' END AS rule, json_extract_string(details, '$."' || ks[CASE WHEN ps > 0 THEN ps ELSE pl END] || '"') AS raw FROM sz2),
sz4 AS (SELECT *, lower({S.squash('raw')}) AS v FROM sz3), sz5 AS (SELECT *, trim(regexp_replace(v, '\\s*\\([^)]*\\)\\s*$', '')) AS stripped FROM sz4),
sz6 AS (SELECT *, trim(CASE WHEN stripped <> '' THEN stripped ELSE v END, ' .,-/') AS cand FROM sz5),
sz7 AS (SELECT *, coalesce({_ALPHA.replace('@x@', 'cand')}, {_TAILS}) AS alpha FROM sz6),
sz AS (SELECT *, CASE WHEN raw IS NULL THEN 'absent' WHEN v = '' THEN 'empty' WHEN {S.has('cand', P.ONE_SIZE)} THEN 'one_size' WHEN alpha IS NOT NULL THEN 'alpha' WHEN {S.has('cand', P.WAIST_INSEAM)} THEN 'waist_inseam'
       WHEN {S.has('cand', P.PLAIN_NUMERIC)} THEN 'numeric' ELSE 'unmapped' END AS why FROM sz7),
szd AS (SELECT *, CASE why WHEN 'alpha' THEN alpha WHEN 'waist_inseam' THEN 'W' || regexp_extract(cand, {S.q(P.WAIST_INSEAM)}, 1) || 'xL' || regexp_extract(cand, {S.q(P.WAIST_INSEAM)}, 2)
       WHEN 'numeric' THEN 'NUM' || regexp_extract(cand, {S.q(P.PLAIN_NUMERIC)}, 1) END AS size FROM sz)"""

ORACLE = {
    "size_reasons": f"WITH {_SIZES.replace('@src@', 'metadata')} SELECT rule, CASE WHEN coalesce(len(ks), 0) = 0 THEN 'no_details' WHEN rule IS NULL THEN 'no_size_key' ELSE why END AS reason, CASE WHEN rule IS NOT NULL THEN size END AS size, count(*) AS n FROM szd GROUP BY 1, 2, 3",
    "size_examples": f"WITH {_SIZES.replace('@src@', 'metadata')} SELECT item_id, fl[CASE WHEN ps > 0 THEN ps ELSE pl END] || ' = ' || coalesce(raw, 'null') AS raw FROM szd WHERE rule IS NOT NULL ORDER BY md5('sizes|' || item_id), item_id::VARCHAR LIMIT 60",
    "cells_2x2": f"WITH {S.TAXONOMY}, {_SIZES.replace('@src@', 'tax')} SELECT gender, half, count(*) AS n, sum((rule IS NOT NULL AND size IS NOT NULL)::INT) AS n_sized FROM szd WHERE gender IN ('men', 'women') AND half IN ('upper', 'lower') GROUP BY 1, 2",
    "label_histogram": f"{_LAB} SELECT label, count(*) AS n, sum(CASE WHEN {S.squash(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} = '' THEN 1 ELSE 0 END) AS n_blank, sum(CASE WHEN verified_purchase THEN 1 ELSE 0 END) AS n_verified FROM lab GROUP BY 1",
    "pattern_hits": f"{_HITS} SELECT * FROM pc",
    "top_patterns": f"{_HITS} SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, pattern) AS rank FROM pc QUALIFY rank <= 6",
    "buyer_rates": f"{_FLAGS} SELECT gender, count(*) AS n, sum(tp::INT) AS third_party, sum(cg::INT) AS cross_gender, count(st) AS stated, sum(coalesce((st <> gender)::INT, 0)) AS mismatch, sum((tp OR cg OR coalesce(st <> gender, false))::INT) AS suspect, sum((NOT tp AND NOT cg)::INT) AS own FROM fl GROUP BY 1",
    "review_hashes": "SELECT review_id, substr(sha256(coalesce(user_id, 'None') || '|' || coalesce(asin, 'None') || '|' || coalesce(ts_ms::VARCHAR, 'None')), 1, 16) AS review_id_hash FROM review",
    "gender_hist": f"WITH {S.TAXONOMY} SELECT gender, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM tax GROUP BY 1",
    "half_hist": f"WITH {S.TAXONOMY} SELECT half, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM tax GROUP BY 1",
    "cells_gradient": f"WITH {S.TAXONOMY} SELECT gender, count(*) FILTER (gradient = 'jeans_trousers') AS jeans_trousers, count(*) FILTER (gradient = 'shirt') AS shirt, count(*) FILTER (gradient = 'tshirt') AS tshirt FROM tax WHERE gender IN ('men', 'women') AND half IN ('upper', 'lower') AND gradient IS NOT NULL GROUP BY 1",
    "details_keys": f"{_DET} SELECT rtrim(lower({S.squash('k')}), ':') AS key, count(*) AS n FROM dk GROUP BY 1",
    "top_details_keys": f"{_DET} SELECT rtrim(lower({S.squash('k')}), ':') AS key, count(*) AS n FROM dk GROUP BY 1 ORDER BY n DESC, key LIMIT 20",
    "listing_medians": f"{S.FINAL}, pa AS (SELECT parent_asin, count(DISTINCT asin) n_asins FROM obs WHERE asin <> '' GROUP BY 1), pn AS (SELECT parent_asin, count(*) n FROM fin GROUP BY 1), j AS (SELECT * FROM pa JOIN pn USING (parent_asin)) SELECT median(n_asins) AS median_n_asins, round(avg(n_asins), 6) AS mean_n_asins, max(n_asins) AS max_n_asins, median(n) AS median_n, round(avg(n), 6) AS mean_n, max(n) AS max_n FROM j",
    "cell_bucket": f"{S.FINAL} SELECT gender, half, label, count(*) AS n FROM fin GROUP BY 1, 2, 3",
    "gradient_bucket": f"{S.FINAL} SELECT gender, gradient, label, count(*) AS n FROM fin WHERE gradient IS NOT NULL GROUP BY 1, 2, 3",
    "per_parent_counts": f"{S.FINAL} SELECT parent_asin, count(*) AS n FROM fin GROUP BY 1",
    "heavy_listings": f"{S.FINAL} SELECT parent_asin, gender, half, count(*) AS n, round(avg(score), 6) AS mean_score, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM fin GROUP BY 1, 2, 3 ORDER BY n DESC, parent_asin LIMIT 20",
    "exposure": f"{S.FINAL}, per AS (SELECT parent_asin, gender, half, count(*) n FROM fin GROUP BY 1, 2, 3), rk AS (SELECT *, row_number() OVER (ORDER BY n DESC, parent_asin) r FROM per) SELECT gender, half, sum(n) AS n, coalesce(sum(n) FILTER (r <= 5), 0) AS top5, coalesce(sum(n) FILTER (r <= 20), 0) AS top20 FROM rk GROUP BY 1, 2",
    "first_titles": f"{S.FINAL}, hv AS (SELECT parent_asin FROM fin GROUP BY 1 ORDER BY count(*) DESC, parent_asin LIMIT 10) SELECT parent_asin, review_id, title, row_number() OVER (PARTITION BY parent_asin ORDER BY review_id) AS rank FROM review WHERE parent_asin IN (SELECT parent_asin FROM hv) QUALIFY rank <= 6",
    "asin_distinct": f"{_ASINS} SELECT parent_asin, count(*) AS n_asins, {', '.join(f'count(*) > {k} AS over_{k}' for k in ASIN_STEPS)} FROM pa GROUP BY 1",
    "shared_asins": f"{_ASINS} SELECT asin, count(*) AS n_parents FROM pa GROUP BY 1 HAVING count(*) > 1",
    "styles_per_store": f"WITH {S.TAXONOMY} SELECT store, count(*) AS n FROM idx GROUP BY 1",
    "survival_funnel": f"""{S.JOINED}, st AS (SELECT parent_asin, coalesce(yr >= {WINDOW}, false) AS w, verified AS v, {S.IN_BUCKETS} AS l FROM obs)
SELECT parent_asin, count(*) AS in_scope, sum(w::INT) AS window, sum(v::INT) AS verified, sum((w AND v)::INT) AS window_verified, sum(l::INT) AS labelled_any, sum((l AND w)::INT) AS labelled_window,
sum((l AND w AND v)::INT) AS labelled_final, CASE WHEN sum(l::INT) = 0 THEN 0.0 ELSE round(sum((l AND w AND v)::INT) / sum(l::INT), 6) END AS survival FROM st GROUP BY 1""",
    "cells_spanned": f"{_SPANNED}, s AS (SELECT store, count(*) k, sum(n) n FROM per GROUP BY 1) SELECT k, count(*) AS n_stores, sum(n) AS n_obs, round(sum(n) / sum(sum(n)) OVER (), 6) AS share FROM s GROUP BY 1",
    "seller_identifying": f"{_SPANNED}, s AS (SELECT *, count(*) OVER (PARTITION BY store) k FROM per) SELECT gender, half, sum(n) AS n, coalesce(sum(n) FILTER (k >= 3), 0) AS n_identifying, round(coalesce(sum(n) FILTER (k >= 3), 0) / sum(n), 6) AS retained FROM s GROUP BY 1, 2",
    "year_composition": f"{_YEARS} SELECT yr, n, labelled, round(mean_chars, 4) AS mean_chars, round(verified_pct, 4) AS verified_pct, round(mean_rating, 4) AS mean_rating, round(labelled_pct, 4) AS labelled_pct FROM yy",
    "year_delta": f"{_DELTAS} SELECT yr, round(d_verified_pct, 4) AS d_verified_pct, round(d_mean_chars, 4) AS d_mean_chars, round(d_labelled_pct, 4) AS d_labelled_pct, stable FROM de",
    "stable_from": f"{_DELTAS} SELECT min(yr) AS stable_from FROM de WHERE stable AND yr > coalesce((SELECT max(yr) FROM de WHERE NOT coalesce(stable, false)), 0)",
    "candidate_windows": f"""{S.REVIEWS}, o AS (SELECT {S.YEAR} yr, {S.IN_BUCKETS} AS l, i.parent_asin IS NOT NULL AS s FROM lab x LEFT JOIN idx i ON x.parent_asin = i.parent_asin WHERE ts_ms IS NOT NULL)
SELECT b::DOUBLE AS years_back, count(*) AS n, sum(l::INT) AS labelled, sum((l AND s)::INT) AS in_scope FROM o CROSS JOIN (VALUES {', '.join(f'({b})' for b in TRAILING)}) v(b) WHERE yr >= (SELECT max(yr) FROM o) - b + 1 GROUP BY 1""",
    "scenario_sizes": f"{_SCENARIOS} SELECT * FROM sc",
    "cluster_params": f"""{_SCENARIOS}, m AS (SELECT scenario, count(*) n_clusters, sum(n) n_obs, max(n) largest, avg(n) m_bar, stddev_pop(n) sd, stddev_pop(n) / avg(n) cv, avg((n = 1)::INT) singletons FROM sc GROUP BY 1)
SELECT scenario, n_clusters, n_obs, largest, round(m_bar, 6) AS m_bar, round(sd, 6) AS sd, round(cv, 6) AS cv, round(singletons, 6) AS singletons, round(1 + ((cv * cv + 1) * m_bar - 1) * 0.05, 6) AS deff FROM m""",
    "cluster_quantiles": f"{S.FINAL}, s AS (SELECT list_sort(list(n)) l FROM (SELECT count(*) n FROM fin GROUP BY parent_asin)) SELECT l[len(l) // 2 + 1] AS p50, l[len(l) * 9 // 10 + 1] AS p90, l[least(len(l), len(l) * 99 // 100 + 1)] AS p99 FROM s",
    "half_split": f"""{S.FINAL}, per AS (SELECT parent_asin, count(*) n FROM fin GROUP BY 1),
o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n DESC, md5(parent_asin), parent_asin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per)
SELECT parent_asin, n, before = 0 OR before < (SELECT sum(n) FROM per) / 2 AS treated FROM o""",
    "size_pairs": f"{_PAIRS} SELECT * FROM sp",
    "deviation_hist": f"{_PAIRS} SELECT deviation, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM sp GROUP BY 1",
    "deviation_cells": f"{_DEV} SELECT gender, half, count(*) AS n_pairs, round(avg(deviation), 6) AS mean, sum((deviation > 0)::INT) AS up, sum((deviation = 0)::INT) AS same, sum((deviation < 0)::INT) AS down FROM dv GROUP BY 1, 2",
    "store_deviations": f"{_DEV} SELECT store, count(*) AS n_pairs, sum(deviation) AS total, sum((deviation > 0)::INT) AS up, sum((deviation > 0 AND gender = 'men')::INT) AS up_men, sum((deviation > 0 AND gender = 'women')::INT) AS up_women FROM dv GROUP BY 1",
    "store_concentration": f"{_UPS}, rk AS (SELECT n, row_number() OVER (ORDER BY n DESC, store) AS r FROM up) SELECT k, round(sum(n) FILTER (r <= k) / sum(n), 6) AS share FROM rk CROSS JOIN (VALUES (1), (5), (10), (25), (50)) v(k) GROUP BY 1",
    "store_hhi": f"{_UPS}, h AS (SELECT sum(n * n) / (sum(n) * sum(n)) AS h FROM up) SELECT round(h, 8) AS hhi, round(1 / h, 4) AS effective FROM h",
}
