"""Labels against structured answers: confusion, precision, recall, per pattern and per body half."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import taxonomy, text
from ..functions.text import BUCKETS

GUESSES = [*BUCKETS, "ambiguous", "none", "no_text"]


def judged(corpus: DataFrame) -> DataFrame:
    """(corpus, truth, half, guess, pattern) of every row with a structured answer.

    guess is `no_text` where summary and text are blank; pattern is the number of the first pattern of the guessed
    bucket, null for other guesses. Rows without a known answer are left out.
    """
    truth = F.lit(None).cast("string")
    for answer, bucket in P.FIT_ANSWERS.items():
        truth = F.when(F.col("fit") == answer, bucket).otherwise(truth)
    blob = text.folded(text.blob(F.col("review_summary"), F.col("review_text")))

    def read(b):
        pattern = F.lit(None).cast("int")
        label = text.fit_label(b)
        for bucket in BUCKETS:
            pattern = F.when(label == bucket, text.first_pattern(b, bucket)).otherwise(pattern)
        return F.struct(F.when(b == "", "no_text").otherwise(label).alias("guess"), pattern.alias("pattern"))

    df = corpus.withColumn("truth", truth).filter("truth is not null").withColumn("g", text.let(blob, read))
    return df.select("corpus", "truth", taxonomy.corpus_half(F.col("corpus"), F.col("category")).alias("half"), "g.guess", "g.pattern")


def in_scope(j: DataFrame) -> DataFrame:
    return j.filter(F.col("half").isin("upper", "lower"))


def matrix(j: DataFrame) -> DataFrame:
    """(corpus, truth, guess, n); everything below is computed from it."""
    return in_scope(j).groupBy("corpus", "truth", "guess").agg(F.count(F.lit(1)).alias("n"))


def precision_recall(m: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of each bucket, 0 where a denominator is."""
    sum_if = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    each = m.withColumn("bucket", F.explode(F.array(*map(F.lit, BUCKETS))))
    hit, said = F.col("truth") == F.col("bucket"), F.col("guess") == F.col("bucket")
    a = each.groupBy("corpus", "bucket").agg(sum_if(hit & said).alias("tp"), sum_if(~hit & said).alias("fp"), sum_if(hit & ~said).alias("fn"))
    zero = F.lit(0.0)
    a = a.withColumn("precision", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), zero)).withColumn("recall", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), zero))
    return a.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))


def reweighted_precision(m: DataFrame, target: dict[str, float]) -> DataFrame:
    """Precision with each true bucket weighted to its share in `target`."""
    want = {b: v / sum(target.values()) for b, v in target.items()}
    truths = m.groupBy("corpus", "truth").agg(F.sum("n").alias("t"))
    all_ = m.groupBy("corpus").agg(F.sum("n").alias("all_n"))
    share = F.lit(None).cast("double")
    for b, v in want.items():
        share = F.when(F.col("truth") == b, F.lit(v)).otherwise(share)
    w = truths.join(all_, "corpus").withColumn("w", share / (F.col("t") / F.col("all_n"))).select("corpus", "truth", "w")
    wn = m.filter(F.col("guess").isin(BUCKETS)).join(w, ["corpus", "truth"]).withColumn("wn", F.col("w") * F.col("n"))
    out = wn.groupBy("corpus", F.col("guess").alias("bucket")).agg(F.sum(F.when(F.col("truth") == F.col("guess"), F.col("wn")).otherwise(0.0)).alias("num"), F.sum("wn").alias("den"))
    return out.select("corpus", "bucket", F.coalesce(F.try_divide("num", "den"), F.lit(0.0)).alias("reweighted"))


def recall_by_half(j: DataFrame) -> DataFrame:
    """Recall of each bucket in upper and lower, and the gap in percentage points."""
    n = in_scope(j).groupBy("corpus", "truth", "half").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("guess") == F.col("truth"), 1).otherwise(0)).alias("tp"))
    part = lambda h, x: F.sum(F.when(F.col("half") == h, F.col(x)).otherwise(0))
    a = n.groupBy("corpus", F.col("truth").alias("bucket")).agg(part("upper", "n").alias("upper_n"), part("upper", "tp").alias("upper_tp"), part("lower", "n").alias("lower_n"), part("lower", "tp").alias("lower_tp"))
    rate = lambda h: F.coalesce(F.try_divide(f"{h}_tp", f"{h}_n"), F.lit(0.0))
    return a.select("corpus", "bucket", "upper_n", "lower_n", rate("upper").alias("upper_recall"), rate("lower").alias("lower_recall"), ((rate("upper") - rate("lower")) * 100).alias("gap_pp"))


def labelled_rate(j: DataFrame) -> DataFrame:
    """Share of each half's rows that get any bucket."""
    return in_scope(j).groupBy("corpus", "half").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("guess").isin(BUCKETS), 1.0).otherwise(0.0)).alias("labelled"))


def pattern_precision(j: DataFrame, least: int = 40) -> DataFrame:
    """Share of right guesses of each pattern, over all corpora, from `least` guesses on."""
    p = in_scope(j).filter(F.col("guess").isin(BUCKETS))
    a = p.groupBy(F.col("guess").alias("bucket"), "pattern").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("truth") == F.col("guess"), 1).otherwise(0)).alias("right"))
    return a.filter(F.col("n") >= least).withColumn("precision", F.col("right") / F.col("n"))
