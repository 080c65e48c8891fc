"""Queries on labels and estimates: validation, attenuation, variance, inference, estimands, samples, power."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cuts import cut
from ..functions import patterns as P
from ..functions import stats, text
from ..functions.text import BUCKETS
from ..operators import attenuation, cells, estimand, frames, resample, sampling, validation, variance
from ..session import table
from . import measures_sql
from . import reviews as R


def _round(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --- labels by hand ---------------------------------------------------------------------------------------------------


KEYED = ["parent_asin", "assigned_bucket", "gender", "body_half", "review_title", "review_text"]


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    """The sample's key, one row per review_id_hash: what the labellers did not see."""
    k = table(spark, d, "precision_key").filter("review_id_hash is not null")
    one = k.groupBy("review_id_hash").agg(F.max(F.struct(*KEYED)).alias("k")).select("review_id_hash", *[f"k.{c}" for c in KEYED])
    return one.withColumnRenamed("assigned_bucket", "assigned")


def _hand_labels(spark: SparkSession, d: str) -> DataFrame:
    """The labellers' sheet, one non-blank label per review_id_hash."""
    k = table(spark, d, "precision_key").withColumn("human", F.trim("human_label")).filter("human <> '' and review_id_hash is not null")
    return k.groupBy("review_id_hash").agg(F.max("human").alias("human"))


def labels_with_key(spark: SparkSession, d: str) -> DataFrame:
    """The labellers' sheet joined to the key on the review's hash, counted by assigned bucket and label."""
    return attenuation.join_labels(_hand_labels(spark, d), _keyed(spark, d)).groupBy("assigned", "human").agg(F.count(F.lit(1)).alias("n"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Hand-labelled rows, one per review_id_hash, with the store of their parent as of its last entry."""
    k = table(spark, d, "precision_key").withColumn("human", F.trim("human_label")).filter("human <> '' and review_id_hash is not null")
    cols = ["parent_asin", "assigned_bucket", "gender", "body_half", "human", "review_title", "review_text"]
    one = k.groupBy("review_id_hash").agg(F.max(F.struct(*cols)).alias("k")).select("review_id_hash", *[f"k.{c}" for c in cols])
    store = table(spark, d, "parent_store").groupBy("parent_asin").agg(F.max_by("store", F.struct("added_at", "store")).alias("store"))
    return one.join(store, "parent_asin", "left").withColumnRenamed("assigned_bucket", "assigned")


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return cells.histogram(_labelled(spark, d), "assigned", "human")


def hand_precision(spark: SparkSession, d: str) -> DataFrame:
    """Precision of each bucket with and without unclear rows, Wilson intervals and verdict."""
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    h, a = F.col("human"), F.col("assigned")
    t = _labelled(spark, d).groupBy("assigned").agg(
        F.count(F.lit(1)).alias("n"), one(h == a).alias("correct"), one(h == "unclear").alias("unclear"), one(h == "none").alias("none_"),
        one(h.isin(BUCKETS) & (h != a)).alias("other"),
    )
    usable = F.col("n") - F.col("unclear")
    low, high = stats.wilson(F.col("correct"), usable)
    slow, shigh = stats.wilson(F.col("correct"), F.col("n"))
    t = t.select("assigned", "n", "correct", "unclear", "none_", "other", F.coalesce(F.try_divide(F.col("correct"), usable), F.lit(0.0)).alias("precision"), low.alias("low"), high.alias("high"), (F.col("correct") / F.col("n")).alias("strict"), slow.alias("strict_low"), shigh.alias("strict_high"), stats.gate(low, high).alias("verdict"))
    return _round(t, 6, "precision", "low", "high", "strict", "strict_low", "strict_high")


def _by_group(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d)
    return rows.withColumn("grp", F.explode(F.array(F.lit("all"), F.concat(F.lit("gender="), "gender"))))


def lambdas(spark: SparkSession, d: str) -> DataFrame:
    """Attenuation factor, residual and the reverse factor, over all labels and by gender, with the operative effect."""
    t = attenuation.with_lambda(attenuation.confusion_columns(_by_group(spark, d), "grp"))
    t = t.withColumn("operative", attenuation.operative_mde(F.lit(0.156), F.col("lambda"), strict=False))
    return _round(t.select("grp", "lambda", "residual", "lambda_reverse", "operative"), 6, "lambda", "residual", "lambda_reverse", "operative")


def lambdas_without_advice(spark: SparkSession, d: str) -> DataFrame:
    """The factor without labels whose first pattern is advice on which size to order, matched by review."""
    b = text.folded(text.blob(F.col("review_title"), F.col("review_text")))
    rows = _labelled(spark, d).withColumn("hits", text.let(b, text.pattern_hits))
    fired = F.get(F.filter("hits", lambda h: h["bucket"] == F.col("assigned")), F.lit(0))
    kept = rows.filter(~F.coalesce(text.is_advice(fired["bucket"], fired["pattern"]), F.lit(False)))
    t = attenuation.with_lambda(attenuation.confusion_columns(kept))
    return _round(t.select("lambda", "residual", "lambda_reverse"), 6, "lambda", "residual", "lambda_reverse")


def lambdas_without_advice_by_item(spark: SparkSession, d: str) -> DataFrame:
    """The same by the older rule: a label is left out by the pattern of the first review (by its hash) of the same parent
    and bucket that has one, so two reviews of one item can swap patterns."""
    b = text.folded(text.blob(F.col("review_title"), F.col("review_text")))
    keyed = _keyed(spark, d).withColumn("hits", text.let(b, text.pattern_hits))
    fired = F.get(F.filter("hits", lambda h: h["bucket"] == F.col("assigned")), F.lit(0))
    first = keyed.withColumn("fired", fired).filter("fired is not null").groupBy("parent_asin", "assigned").agg(F.min_by("fired", "review_id_hash").alias("fired"))
    rows = _labelled(spark, d).join(first, ["parent_asin", "assigned"], "left")
    kept = rows.filter(~F.coalesce(text.is_advice(F.col("fired.bucket"), F.col("fired.pattern")), F.lit(False)))
    t = attenuation.with_lambda(attenuation.confusion_columns(kept))
    return _round(t.select("lambda", "residual", "lambda_reverse"), 6, "lambda", "residual", "lambda_reverse")


def p_zero(spark: SparkSession, d: str) -> DataFrame:
    """P(true to size) of each cell, from the hand labels and the cell's assigned counts."""
    one = attenuation.confusion_columns(_labelled(spark, d))
    each = [F.struct(F.lit(g).alias("gender"), F.lit(h).alias("half"), attenuation.p_zero(counts).alias("p0")) for (g, h), counts in P.CELL_ASSIGNED.items()]
    return _round(one.select(F.explode(F.array(*each)).alias("x")).select("x.*"), 6, "p0")


def residual_bias(spark: SparkSession, d: str) -> DataFrame:
    """What the residual adds to tau, in standard deviations; null where a gender has no factor."""
    g = attenuation.with_lambda(attenuation.confusion_columns(_labelled(spark, d).filter("gender in ('men', 'women')"), "gender"))
    terms = F.lit(None).cast("double")
    for gender in ("men", "women"):
        gap = attenuation.p_zero(P.CELL_ASSIGNED[gender, "upper"]) - attenuation.p_zero(P.CELL_ASSIGNED[gender, "lower"])
        terms = F.when(F.col("gender") == gender, F.col("residual") * gap).otherwise(terms)
    t = g.select("gender", terms.alias("term"))
    side = lambda x: F.max(F.when(F.col("gender") == x, F.col("term")))
    return _round(t.agg(((side("men") - side("women")) / F.lit(attenuation.score_sd())).alias("bias_sd"), side("men").alias("term_men"), side("women").alias("term_women")), 8, "bias_sd", "term_men", "term_women")


def lambda_interval(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap interval of the factor, clusters being stores (the parent where it has none)."""
    rows = _labelled(spark, d).withColumn("unit", F.coalesce("store", "parent_asin"))
    return _round(attenuation.bootstrap_lambda(rows, "unit"), 6, "low", "high")


# --- structured answers -----------------------------------------------------------------------------------------------


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return validation.judged(table(spark, d, "fit_corpus"))


def truth_prediction(spark: SparkSession, d: str) -> DataFrame:
    """Counts by corpus, half, truth and guess with their sums (grouping sets)."""
    j = validation.in_scope(_judged(spark, d))
    return j.groupingSets([["corpus", "half", "truth", "guess"], ["corpus", "truth", "guess"], ["corpus"]], "corpus", "half", "truth", "guess").agg(F.count(F.lit(1)).alias("n"))


def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    return _round(validation.precision_recall(validation.matrix(_judged(spark, d))), 6, "precision", "recall", "f1")


def reweighted_precision(spark: SparkSession, d: str) -> DataFrame:
    return _round(validation.reweighted_precision(validation.matrix(_judged(spark, d)), P.PREDICTED), 6, "reweighted")


def recall_by_half(spark: SparkSession, d: str) -> DataFrame:
    t = validation.recall_by_half(_judged(spark, d)).withColumn("band", estimand.agreement_band(F.col("gap_pp")))
    return _round(t, 6, "upper_recall", "lower_recall", "gap_pp")


def labelled_rate(spark: SparkSession, d: str) -> DataFrame:
    return _round(validation.labelled_rate(_judged(spark, d)), 6, "labelled")


def pattern_precision(spark: SparkSession, d: str) -> DataFrame:
    return _round(validation.pattern_precision(_judged(spark, d), 5), 6, "precision")


# --- variance and inference -------------------------------------------------------------------------------------------


def _store_scores(spark: SparkSession, d: str) -> DataFrame:
    return R._final(spark, d).withColumn("score", text.score(F.col("label"))).groupBy("store", "gender", "score").agg(F.sum("n").alias("n"))


def score_anova(spark: SparkSession, d: str) -> DataFrame:
    """How much of the score's variance lies between stores."""
    return _round(variance.one_way(_store_scores(spark, d), "store", "score", "n"), 8, "eta_squared", "icc")


def deviation_anova(spark: SparkSession, d: str) -> DataFrame:
    """How much of the size deviation's variance lies between stores."""
    return _round(variance.one_way(R._deviations(spark, d), "store", "deviation", "n"), 8, "eta_squared", "icc")


def within_store_gap(spark: SparkSession, d: str) -> DataFrame:
    """Gap between men's and women's scores inside stores that sell to both, and whether there are enough."""
    t = variance.within_gap(_store_scores(spark, d), "store", "gender", "men", "women", "score", "n")
    t = t.withColumn("enough", (F.col("n_both") >= 15) & (F.col("n_a") >= 30))
    return _round(t, 8, "weighted_gap", "unweighted_gap")


def wild_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Slope of the score on men's uppers, robust t and wild bootstrap p-value, clusters being listings."""
    f = R._final(spark, d)
    x = F.when((F.col("gender") == "men") & (F.col("half") == "upper"), 1.0).otherwise(0.0)
    return _round(resample.wild_bootstrap(f, [], "parent_asin", x, text.score(F.col("label")), F.col("n"), 399), 6, "beta", "t", "p")


def scenario_bound(spark: SparkSession, d: str) -> DataFrame:
    """The same slope when many-product listings are kept, excluded or split and with stores as clusters; a claim holds
    only if it holds for all."""
    f = R._final(spark, d, "asin")
    many = R.asin_distinct(spark, d).filter(F.col("n_asins") > R.MANY_ASINS).select("parent_asin", F.lit(True).alias("many"))
    f = f.join(many, "parent_asin", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    split = F.when(F.col("many"), F.concat_ws("/", "parent_asin", F.coalesce("asin", F.lit("")))).otherwise(F.col("parent_asin"))
    pair = lambda name, cluster, ok=True: F.when(F.lit(ok) if ok is True else ok, F.struct(F.lit(name).alias("scenario"), cluster.alias("cluster")))
    each = F.array_compact(F.array(pair("KEEP", F.col("parent_asin")), pair("EXCLUDE", F.col("parent_asin"), ~F.col("many")), pair("SPLIT", split), pair("STORE", F.col("store"))))
    o = f.withColumn("s", F.explode(each)).select("s.scenario", "s.cluster", "gender", "half", "label", "n")
    o = o.groupBy("scenario", "cluster", "gender", "half", "label").agg(F.sum("n").alias("n"))
    x = F.when((F.col("gender") == "men") & (F.col("half") == "upper"), 1.0).otherwise(0.0)
    t = resample.wild_bootstrap(o, ["scenario"], "cluster", x, text.score(F.col("label")), F.col("n"), 399)
    t = t.withColumn("max_p", F.max("p").over(Window.partitionBy(F.lit(1)))).withColumn("claim", F.col("max_p") < 0.05)  # four rows
    return _round(t, 6, "beta", "t", "p", "max_p")


def homogeneity(spark: SparkSession, d: str) -> DataFrame:
    """Whether the products of the four heaviest many-product listings share one distribution of fit labels."""
    f = R._final(spark, d, "asin")
    many = R.asin_distinct(spark, d).filter(F.col("n_asins") > R.MANY_ASINS).select("parent_asin")
    heavy = cells.histogram(f, "parent_asin", weight="n").join(many, "parent_asin", "left_semi").orderBy(F.desc("n"), "parent_asin").limit(4).select("parent_asin")
    m = f.filter("asin is not null and asin <> ''").join(F.broadcast(heavy), "parent_asin")  # 4 rows
    m = m.groupBy("parent_asin", "asin").agg(*[F.sum(F.when(F.col("label") == b, F.col("n")).otherwise(0)).alias(b) for b in BUCKETS])
    m = m.filter(sum((F.col(b) for b in BUCKETS), F.lit(0)) >= 5)
    t = resample.homogeneity(m, "parent_asin", "asin", 999).withColumn("testable", F.col("n_members") >= 3)
    return _round(t, 6, "x2", "dispersion", "p")


#: No effect, and those that the smallest detectable one is looked for among.
EFFECTS = [0.0, 0.05, 0.10, 0.15, 0.20, 0.30, 0.45, 0.60]


STUDIED = ["KEEP", "EXCLUDE", "SPLIT", "STORE"]
SHARES = {"ran_small": 0.30, "true_to_size": 0.53, "ran_large": 0.17}


def _studies(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The clusters of each scenario in two halves; cut, as they are read several times and a few bytes each."""
    sizes = cut(R.scenario_sizes(spark, d), "study-sizes")
    return {s: cut(cells.half_split(sizes.filter(F.col("scenario") == s).select("cluster_id", "n"), "n", "cluster_id"), "study-split") for s in STUDIED}


def _rejections(studies: dict[str, DataFrame]) -> DataFrame:
    each = [resample.power(split, EFFECTS, 60, 0.05, SHARES, 199).withColumn("scenario", F.lit(s)) for s, split in studies.items()]
    return reduce(DataFrame.unionByName, each)


def wild_power(spark: SparkSession, d: str) -> DataFrame:
    """Rejection rates of simulated studies with the clusters of each scenario, by wild bootstrap and by the asymptotic t,
    with Wilson intervals."""
    r = _rejections(_studies(spark, d))
    for name in ("wild", "asymptotic"):
        low, high = stats.wilson(F.col(name), F.col("trials"))
        r = r.withColumn(f"{name}_low", F.round(low, 6)).withColumn(f"{name}_high", F.round(high, 6))
    return r


def detectable_effect(spark: SparkSession, d: str) -> DataFrame:
    """For each scenario the smallest simulated effect found in 80 % of the studies (null if none is), beside what the
    formula says."""
    studies = _studies(spark, d)
    halves = reduce(DataFrame.unionByName, [split.withColumn("scenario", F.lit(s)) for s, split in studies.items()])
    m = cells.size_moments(halves, "n", "scenario", "treated").withColumn("deff", stats.design_effect(F.col("m_bar"), 0.05, F.coalesce("cv", F.lit(0.0))))
    formula = m.groupBy("scenario").agg((F.lit(stats.multiplier()) * F.sqrt(F.sum(F.col("deff") / F.col("n_obs")))).alias("formula"))
    enough = (F.col("effect") > 0) & (F.col("wild") >= 0.8 * F.col("trials"))
    found = _rejections(studies).groupBy("scenario").agg(F.min(F.when(enough, F.col("effect"))).alias("simulated"))
    return _round(formula.join(found, "scenario", "left"), 6, "formula")


# --- estimands --------------------------------------------------------------------------------------------------------


def _scored(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    return R._final(spark, d, *keys).withColumn("score", text.score(F.col("label")))


def cell_means(spark: SparkSession, d: str) -> DataFrame:
    return _round(estimand.cell_means(_scored(spark, d), F.col("score"), "n"), 8, "mean")


def tau(spark: SparkSession, d: str) -> DataFrame:
    """The difference in differences of mean scores, by purchases and by styles."""
    f = _scored(spark, d)
    by_review = estimand.contrast(estimand.cell_means(f, F.col("score"), "n"), "mean").select(F.lit("review").alias("weighting"), "tau")
    by_style = estimand.contrast(estimand.style_means(f, F.col("score"), "n", "parent_asin"), "mean").select(F.lit("style").alias("weighting"), "tau")
    return _round(by_review.unionByName(by_style), 8, "tau")


def tau_by_year(spark: SparkSession, d: str) -> DataFrame:
    """tau of every year and its trend over them."""
    y = estimand.contrast(estimand.cell_means(_scored(spark, d, "yr"), F.col("score"), "n", "yr"), "mean", "yr")
    slope = estimand.trend(y.filter("tau is not null"), F.col("yr"), F.col("tau"), F.lit(1))
    return _round(y.crossJoin(F.broadcast(slope)), 8, "tau", "slope")


def interaction(spark: SparkSession, d: str) -> DataFrame:
    """Interaction of male and upper with fixed effects of the garment category, tested by style.

    The category is the path's last segment behind the general ones: whole paths name the gender, so within them the
    interaction has no variation; inside a garment category only the gender varies.
    """
    category = F.coalesce(F.try_element_at("garment", F.lit(-1)), F.lit("(none)")).alias("category")
    index = frames.style_index(table(spark, d, "metadata"), category)
    f = frames.final_counts(R._windowed(spark, d), index).withColumn("score", text.score(F.col("label")))
    x = F.when((F.col("gender") == "men") & (F.col("half") == "upper"), 1.0).otherwise(0.0)
    left = estimand.residualised(f, "category", F.col("score"), x, "n", "parent_asin")
    return _round(resample.wild_bootstrap(left, [], "parent_asin", F.col("x"), F.col("y"), F.col("n"), 399), 6, "beta", "t", "p")


def within_person(spark: SparkSession, d: str) -> DataFrame:
    """Upper minus lower score of buyers who reviewed both."""
    r = R._windowed(spark, d, "user_id").filter("user_id is not null")
    f = frames.final_counts(r, R._index(spark, d), "user_id").withColumn("score", text.score(F.col("label")))
    return _round(estimand.within_person(f, F.col("score"), "n", "user_id"), 8, "difference")


def calibration(spark: SparkSession, d: str) -> DataFrame:
    """Share of a listing's labelled reviews whose label came from advice on which size to order."""
    b = text.folded(text.blob(F.col("title"), F.col("text")))
    r = R._texts(spark, d).select("parent_asin", text.let(b, text.pattern_hits).alias("h"))
    r = frames.only(r, "h", lambda h: F.size(h) == 1)
    one = F.get("h", F.lit(0))
    n = r.groupBy("parent_asin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(text.is_advice(one["bucket"], one["pattern"]), 1.0).otherwise(0.0)).alias("calibration"))
    return _round(n.join(R._index(spark, d).select("parent_asin"), "parent_asin"), 8, "calibration")


def tau_without_advice(spark: SparkSession, d: str) -> DataFrame:
    """tau with advice patterns counted as labels (folded) and left out (excluded)."""
    b = text.folded(text.blob(F.col("title"), F.col("text")))
    one = F.get("h", F.lit(0))
    r = frames.labelled_reviews(R._texts(spark, d), text.let(b, text.pattern_hits).alias("h"))
    r = r.withColumn("advice", F.coalesce(text.is_advice(one["bucket"], one["pattern"]), F.lit(False)))
    f = frames.final_counts(r, R._index(spark, d), "advice").withColumn("score", text.score(F.col("label")))
    folded = estimand.contrast(estimand.cell_means(f, F.col("score"), "n"), "mean").select(F.lit("folded").alias("spec"), "tau")
    left = estimand.contrast(estimand.cell_means(f.filter("not advice"), F.col("score"), "n"), "mean").select(F.lit("excluded").alias("spec"), "tau")
    return _round(folded.unionByName(left), 8, "tau")


def _window_all(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all verified reviews of the window in scope, labelled or not."""
    r = R._windowed(spark, d).filter(F.col("verified") & (F.col("yr") >= R.WINDOW))
    return frames.counted(r, "label").join(R._index(spark, d), "parent_asin").withColumn("score", text.score(F.col("label")))


def reporting(spark: SparkSession, d: str) -> DataFrame:
    """Share of each cell's reviews that report a fit, and tau of that share."""
    f = _window_all(spark, d).withColumn("reported", F.when(F.col("score").isNotNull(), 1.0).otherwise(0.0))
    means = estimand.cell_means(f, F.col("reported"), "n")
    return _round(means.crossJoin(F.broadcast(estimand.contrast(means, "mean"))), 8, "mean", "tau")


def weighted_tau(spark: SparkSession, d: str) -> DataFrame:
    """tau with each labelled review weighted by the inverse share of reports in its cell and garment class."""
    f = _window_all(spark, d).withColumn("g", F.coalesce("gradient", F.lit("none")))
    w = estimand.inverse_probability(f, F.col("score").isNotNull(), "n", "gender", "half", "g").filter("score is not null")
    m = w.groupBy("gender", "half").agg((F.sum(F.col("score") * F.col("w")) / F.sum("w")).alias("mean"))
    return _round(estimand.contrast(m, "mean"), 8, "tau")


def tau_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of tau when unreported fits were all small or all large."""
    return _round(estimand.bounds(_window_all(spark, d), F.col("score"), "n"), 8, "low", "high")


def gradient_trend(spark: SparkSession, d: str) -> DataFrame:
    """Slope of the score over the order of garment classes, by gender, tested by style."""
    f = _scored(spark, d).filter("gradient is not null")
    at = F.lit(None).cast("int")
    for g, p in P.GRADIENT_POSITION.items():
        at = F.when(F.col("gradient") == g, p).otherwise(at)
    return _round(resample.wild_bootstrap(f, ["gender"], "parent_asin", at, F.col("score"), F.col("n"), 399), 6, "beta", "t", "p")


def buyer_gender(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent garment gender of buyers with three reviews in scope or more, counted by that gender and how often
    it is the only one. Ties go to men."""
    r = table(spark, d, "review").filter("user_id is not null").groupBy("user_id", "parent_asin").agg(F.count(F.lit(1)).alias("n"))
    u = r.join(R._index(spark, d).select("parent_asin", "gender"), "parent_asin")
    u = u.groupBy("user_id").agg(F.sum(F.when(F.col("gender") == "men", F.col("n")).otherwise(0)).alias("men"), F.sum(F.when(F.col("gender") == "women", F.col("n")).otherwise(0)).alias("women"))
    u = u.filter("men + women >= 3").withColumn("gender", F.when(F.col("men") >= F.col("women"), "men").otherwise("women"))
    return u.groupBy("gender").agg(F.count(F.lit(1)).alias("n_buyers"), F.sum(F.when(F.least("men", "women") == 0, 1).otherwise(0)).alias("n_only"))


# --- samples ----------------------------------------------------------------------------------------------------------

PER_STRATUM = 25
SEED = "20260811"


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """25 labelled reviews of the window per bucket and gender, with the key fields a labeller must not see."""
    r = frames.bucketed(R._windowed(spark, d).filter(F.col("yr") >= R.WINDOW))
    j = r.select("review_id", "parent_asin", "label").join(R._index(spark, d).select("parent_asin", "gender", "half", "item_title"), "parent_asin")
    return sampling.stratified(j, ["label", "gender"], F.col("review_id").cast("string"), PER_STRATUM, SEED).select("review_id", "label", "gender", "half", "item_title", "rank")


def sample_frame(spark: SparkSession, d: str) -> DataFrame:
    """Eligible and drawn reviews per stratum of that sample."""
    r = frames.bucketed(R._windowed(spark, d).filter(F.col("yr") >= R.WINDOW))
    n = frames.counted(r, "label").join(R._index(spark, d).select("parent_asin", "gender"), "parent_asin").groupBy("label", "gender").agg(F.sum("n").alias("eligible"))
    return n.withColumn("drawn", F.least("eligible", F.lit(PER_STRATUM)))


def blind_sample(spark: SparkSession, d: str) -> DataFrame:
    """The same reviews as a labeller sees them: pseudonym, titles and text, in hashed order."""
    s = stratified_sample(spark, d).select("review_id", "item_title")
    r = table(spark, d, "review").select("review_id", "title", "text", text.review_hash(F.col("user_id"), F.col("asin"), F.col("ts_ms")).alias("review_id_hash"))
    j = r.join(F.broadcast(s), "review_id")  # 25 rows a stratum
    squashed = lambda c: text.squash(F.coalesce(c, F.lit(""))).alias(f"review_{c}")
    return sampling.shuffled(j, F.col("review_id_hash"), SEED).select("review_id_hash", F.col("item_title").alias("product_title"), squashed("title"), squashed("text"))


def label_examples(spark: SparkSession, d: str) -> DataFrame:
    """Six reviews per label."""
    r = frames.only(R._reviews(spark, d), "label", lambda x: x != "none")
    return sampling.stratified(r.select("review_id", "label"), ["label"], F.col("review_id").cast("string"), 6, SEED)


def distinct_records(spark: SparkSession, d: str) -> DataFrame:
    """Reviews delivered, distinct ones by a hash of who, what, when and text, and whether every one has such a key."""
    whole = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("user_id", "asin", "ts_ms", "title", "text")]), 256)
    r = table(spark, d, "review").select(whole.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    return r.agg(F.sum("c").alias("n"), F.count("k").alias("n_distinct"), (F.sum("c") == F.sum(F.when(F.col("k").isNotNull(), F.col("c")))).alias("complete"))


def block_sample(spark: SparkSession, d: str) -> DataFrame:
    """24 evenly spaced blocks of reviews."""
    return sampling.block_sample(table(spark, d, "review").select("review_id"), "review_id", 2400, 24)


def block_composition(spark: SparkSession, d: str) -> DataFrame:
    """Label shares of head, middle and tail blocks, their spread and whether it is within tolerance."""
    b = frames.labelled_reviews(sampling.three_blocks(table(spark, d, "review"), "review_id", 2000), "block")
    rate = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    one = b.groupBy("block").agg(*[rate(F.col("label") == x).alias(x) for x in BUCKETS], rate(F.col("label").isin(BUCKETS)).alias("usable"), rate(F.col("verified")).alias("verified"))
    return _within(one, {**dict.fromkeys([*BUCKETS, "usable"], 2.0), "verified": 8.0})


def _within(one: DataFrame, tol: dict[str, float]) -> DataFrame:
    """(measure, spread, tolerance, ok) of rates by block."""
    spread = one.agg(*[(F.max(m) - F.min(m)).alias(m) for m in tol])
    long = spread.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("spread"), F.lit(t).alias("tolerance")) for m, t in tol.items()])).alias("x")).select("x.*")
    return _round(long.withColumn("ok", F.col("spread") <= F.col("tolerance")), 6, "spread")


# Tolerances of the items' shares in percentage points.
ITEM_TOLERANCE = {"both": 3.0, "men": 3.0, "women": 4.0, "upper": 3.0, "lower": 2.0}


def item_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Shares of genders, body halves and items with both in head, middle and tail blocks, their spread and whether it is
    within tolerance."""
    b = frames.with_taxonomy(sampling.three_blocks(table(spark, d, "metadata").select("item_id", "categories"), "item_id", 2000))
    rate = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    g, h = F.col("gender"), F.col("half")
    both = g.isin("men", "women") & h.isin("upper", "lower")
    one = b.groupBy("block").agg(rate(both).alias("both"), *[rate(c == x).alias(x) for c, x in ((g, "men"), (g, "women"), (h, "upper"), (h, "lower"))])
    return _within(one, ITEM_TOLERANCE)


# --- power ------------------------------------------------------------------------------------------------------------

# Usable observations per cell of each analysis window, and the clustering scenarios.
WINDOW_CELLS = [
    ("18 months (2022+)", 23, 12, 141, 50), ("3 years (2021+)", 214, 151, 1045, 446), ("5 years (2019+)", 405, 307, 1721, 798),
    ("8 years (2016+)", 514, 394, 1876, 960), ("full history", 535, 431, 1893, 981),
]
SCENARIOS = [("no clustering", 0.0, 0.0), ("ICC 0.02, CV 1", 0.02, 1.0), ("ICC 0.05, CV 1", 0.05, 1.0), ("ICC 0.05, CV 2", 0.05, 2.0), ("ICC 0.10, CV 2", 0.10, 2.0)]
M_BAR = 20.0
CELLS = ["men_upper", "men_lower", "women_upper", "women_lower"]


def window_power(spark: SparkSession, d: str) -> DataFrame:
    """Smallest detectable tau of each window and scenario."""
    w = spark.createDataFrame(WINDOW_CELLS, "window string, " + ", ".join(f"{c} int" for c in CELLS))
    s = spark.createDataFrame(SCENARIOS, "scenario string, icc double, cv double")
    j = w.crossJoin(s).withColumn("deff", stats.design_effect(F.lit(M_BAR), F.col("icc"), F.col("cv")))
    inverse = sum((1 / stats.effective_n(F.col(c), F.lit(1.0), F.col("deff")) for c in CELLS), F.lit(0.0))
    return _round(j.select("window", "scenario", "deff", stats.mde(inverse).alias("mde")), 6, "deff", "mde")


#: Effect that the windows' figures are compared with.
TARGET = 0.2


def target_multipliers(spark: SparkSession, d: str) -> DataFrame:
    """How many times the observations each window and scenario needs to detect TARGET."""
    return _round(window_power(spark, d).select("window", "scenario", stats.multiplier_to(F.col("mde"), TARGET).alias("times")), 4, "times")


def corpus_scale(spark: SparkSession, d: str) -> DataFrame:
    """Labelled reviews of each bucket scaled to the whole corpus."""
    r = R.label_histogram(spark, d).select("label", "n")
    total = r.agg(F.sum("n").alias("scanned"))
    t = r.filter(F.col("label").isin(BUCKETS)).crossJoin(F.broadcast(total)).withColumn("factor", stats.scale_factor(F.col("scanned")))
    return _round(t.select("label", "n", "factor", (F.col("n") * F.col("factor")).alias("in_corpus")), 4, "factor", "in_corpus")


def variance_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of tau's variance that each cell of a window brings."""
    w = spark.createDataFrame(WINDOW_CELLS, "window string, " + ", ".join(f"{c} int" for c in CELLS))
    long = w.select("window", F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), F.col(c).alias("n")) for c in CELLS])).alias("x")).select("window", "x.*")
    return _round(long.withColumn("share", (1 / F.col("n")) / F.sum(1 / F.col("n")).over(Window.partitionBy("window"))), 6, "share")


# Raw reviews, response rates, and shares of the raw pool per scenario.
RAW = 30_700
RESPONSE = {"men_upper": 0.37, "men_lower": 0.37, "women_upper": 0.67, "women_lower": 0.61}
POOL_SHARES = [("even", 0.25, 0.25, 0.25, 0.25), ("27 % men", 0.155, 0.115, 0.415, 0.315), ("5 % men lower", 0.27, 0.05, 0.40, 0.28)]
ICC_GRID, CV_GRID = (0.02, 0.05, 0.10), (0.0, 1.0, 2.0)


def power_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """Smallest detectable tau and reviews needed per cell over pool shares, ICC and CV."""
    p = spark.createDataFrame(POOL_SHARES, "pool string, " + ", ".join(f"{c} double" for c in CELLS))
    g = spark.createDataFrame([(i, c) for i in ICC_GRID for c in CV_GRID], "icc double, cv double")
    j = p.crossJoin(g).withColumn("deff", stats.design_effect(F.lit(M_BAR), F.col("icc"), F.col("cv")))
    n = lambda c: stats.effective_n(F.floor(F.col(c) * RAW + 1e-9), F.lit(RESPONSE[c]), F.col("deff"))
    inverse = sum((1 / n(c) for c in CELLS), F.lit(0.0))
    t = j.select("pool", "icc", "cv", stats.mde(inverse).alias("mde"), stats.required_n(F.lit(0.2), F.col("deff")).alias("needed"))
    return _round(t, 6, "mde", "needed")


def trend_power(spark: SparkSession, d: str) -> DataFrame:
    """Design effect and detectable effects of each scenario's clusters: pooled contrast, trend, and within a gender."""
    m = cells.size_moments(R.scenario_sizes(spark, d).filter("scenario <> 'STORE'"), "n", "scenario").select("scenario", "m_bar", "cv")
    f = R._final(spark, d, "asin").filter("gradient is not null")
    many = R.asin_distinct(spark, d).filter(F.col("n_asins") > R.MANY_ASINS).select("parent_asin")
    tag = lambda df, s: df.withColumn("scenario", F.explode(F.array(*map(F.lit, s))))
    g = tag(f, ["KEEP", "SPLIT"]).unionByName(tag(f.join(many, "parent_asin", "left_anti"), ["EXCLUDE"]))
    part = lambda s, c: F.sum(F.when((F.col("gender") == s) & (F.col("gradient") == c), F.col("n")).otherwise(0)).cast("double").alias(f"{s}_{c}")
    n = g.groupBy("scenario").agg(*[part(s, c) for s in ("men", "women") for c in P.GRADIENT_POSITION])
    j = n.join(m, "scenario").withColumn("deff", stats.design_effect(F.col("m_bar"), 0.05, F.col("cv")))
    cols = lambda s: [F.col(f"{s}_{c}") for c in P.GRADIENT_POSITION]
    s_m, s_w = stats.scatter(*cols("men")), stats.scatter(*cols("women"))
    four = sum((F.col("deff") / F.greatest(x, F.lit(1e-9)) for s in ("men", "women") for x in (cols(s)[1] + cols(s)[2], cols(s)[0])), F.lit(0.0))
    span = (stats.pooled_span(*cols("men")) + stats.pooled_span(*cols("women"))) / 2
    ok = (s_m > 0) & (s_w > 0)
    t = j.select(
        "scenario", "deff", F.when(ok, stats.trend_mde(F.col("deff"), s_m, s_w, per_step=True)).alias("trend"), stats.within_mde(F.col("deff"), s_m).alias("men"),
        stats.within_mde(F.col("deff"), s_w).alias("women"), F.when(ok & (span > 0), stats.mde(four) / span).alias("pooled"),
    )
    return _round(t.withColumn("gain", F.try_divide("pooled", "trend")), 6, "deff", "trend", "men", "women", "pooled", "gain")


QUERIES = {
    f.__name__: f
    for f in (
        confusion, labels_with_key, hand_precision, lambdas, lambdas_without_advice, lambdas_without_advice_by_item, p_zero, residual_bias, lambda_interval, truth_prediction, precision_recall, reweighted_precision, recall_by_half,
        labelled_rate, pattern_precision, score_anova, deviation_anova, within_store_gap, wild_bootstrap, scenario_bound, homogeneity, wild_power, detectable_effect, cell_means, tau, tau_by_year,
        interaction, within_person, calibration, tau_without_advice, reporting, weighted_tau, tau_bounds, gradient_trend, buyer_gender, stratified_sample, sample_frame, blind_sample,
        label_examples, distinct_records, block_sample, block_composition, item_blocks, window_power, target_multipliers, corpus_scale, variance_share, power_scenarios, trend_power,
    )
}
_COUNTS = ", ".join(f"(count(*) FILTER (gender = '{s}' AND gradient = '{c}'))::DOUBLE AS {s[0]}{k}" for s in ("men", "women") for k, c in enumerate(["jeans_trousers", "shirt", "tshirt"]))
_MEAN = "(({s}1 + 2 * {s}2) / nullif({s}0 + {s}1 + {s}2, 0))"
_SCATTER = f"coalesce({{s}}0 * {_MEAN} ** 2 + {{s}}1 * (1 - {_MEAN}) ** 2 + {{s}}2 * (2 - {_MEAN}) ** 2, 0)"
_SPAN = "coalesce(({s}1 + 2 * {s}2) / nullif({s}1 + {s}2, 0), 0)"
_FOUR = " + ".join(f"deff / greatest({x}, 1e-9)" for s in "mw" for x in (f"{s}1 + {s}2", f"{s}0"))
_Z = repr(stats.multiplier())
TREND_SQL = f"""{R._SCENARIOS}, mo AS (SELECT scenario, avg(n) AS m_bar, stddev_pop(n) / avg(n) AS cv FROM sc WHERE scenario <> 'STORE' GROUP BY 1),
gg AS (SELECT v.scenario, gender, gradient FROM fin, (VALUES ('KEEP'), ('SPLIT'), ('EXCLUDE')) v(scenario) WHERE gradient IS NOT NULL AND (v.scenario <> 'EXCLUDE' OR parent_asin NOT IN (SELECT parent_asin FROM many))),
nn AS (SELECT scenario, {_COUNTS} FROM gg GROUP BY 1),
j AS (SELECT nn.*, 1 + ((cv * cv + 1) * m_bar - 1) * 0.05 AS deff FROM nn JOIN mo ON nn.scenario = mo.scenario),
k AS (SELECT *, {_SCATTER.format(s="m")} AS sm, {_SCATTER.format(s="w")} AS sw, ({_SPAN.format(s="m")} + {_SPAN.format(s="w")}) / 2 AS span FROM j),
r AS (SELECT scenario, deff, CASE WHEN sm > 0 AND sw > 0 THEN {_Z} * sqrt(deff * (1 / sm + 1 / sw)) END AS trend, CASE WHEN sm > 0 THEN {_Z} * sqrt(deff / sm) END AS men, CASE WHEN sw > 0 THEN {_Z} * sqrt(deff / sw) END AS women,
CASE WHEN sm > 0 AND sw > 0 AND span > 0 THEN {_Z} * sqrt({_FOUR}) / span END AS pooled FROM k)
SELECT scenario, round(deff, 6) AS deff, round(trend, 6) AS trend, round(men, 6) AS men, round(women, 6) AS women, round(pooled, 6) AS pooled, round(pooled / trend, 6) AS gain FROM r"""

ORACLE = {"trend_power": TREND_SQL, "deviation_anova": measures_sql.anova(R._DEV, "dv", "deviation")} | measures_sql.oracle(WINDOW_CELLS, SCENARIOS, CELLS, M_BAR, RAW, RESPONSE, POOL_SHARES, ICC_GRID, CV_GRID, PER_STRATUM, SEED, R.MANY_ASINS)
