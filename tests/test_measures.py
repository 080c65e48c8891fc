"""Published and hand-computed figures, and plain re-computations."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.functions import patterns as P
from seamline.functions import stats
from seamline.functions.text import BUCKETS
from seamline.operators import attenuation, cells, estimand, resample, sampling, validation, variance


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_design_effects(spark):
    for m, icc, cv, want in [(20, 0.05, 1, 2.95), (4.845, 0.05, 11.21, 31.63), (3.723, 0.05, 3.89, 3.95), (2.332, 0.05, 4.34, 3.26), (5.668, 0.05, 15.30, 67.57)]:
        assert one(spark, stats.design_effect(F.lit(float(m)), icc, cv)) == pytest.approx(want, abs=0.01)
    with pytest.raises(Exception, match="positive"):
        one(spark, stats.design_effect(F.lit(0.0), 0.05))


def test_window_power(spark, data):
    from seamline.plans import measures

    got = {(r.window, r.scenario): r.mde for r in measures.window_power(spark, data).collect()}
    assert got["5 years (2019+)", "ICC 0.05, CV 1"] == pytest.approx(0.418, abs=0.0005)
    shares = {r.cell: r.share for r in measures.variance_share(spark, data).collect() if r.window == "5 years (2019+)"}
    assert [round(shares[c], 3) for c in ("men_lower", "men_upper", "women_lower", "women_upper")] == [0.431, 0.327, 0.166, 0.077]


def test_wilson(spark):
    low, high = stats.wilson(F.lit(8), F.lit(9))
    assert one(spark, low) == pytest.approx(0.5650, abs=1e-3) and one(spark, high) == pytest.approx(0.9801, abs=1e-3)
    assert one(spark, stats.wilson(F.lit(0), F.lit(0))[0]) == 0.0 and one(spark, stats.wilson(F.lit(0), F.lit(0))[1]) == 1.0


SMALL, RIGHT, LARGE = BUCKETS
EVEN = dict.fromkeys(BUCKETS, 1.0)


def factor(spark, matrix, prevalence=EVEN):
    rows = [(a, h, n) for (a, h), n in matrix.items()]
    df = spark.createDataFrame(rows, "assigned string, human string, n long")
    return attenuation.with_lambda(attenuation.confusion_columns(df, n=F.col("n")), prevalence).first()


def test_lambda_by_hand(spark):
    perfect = {(b, b): 10 for b in BUCKETS}
    assert factor(spark, perfect)["lambda"] == pytest.approx(1.0)
    swap = {(SMALL, SMALL): 8, (SMALL, LARGE): 2, (LARGE, LARGE): 8, (LARGE, SMALL): 2, (RIGHT, RIGHT): 10}
    assert factor(spark, swap)["lambda"] == pytest.approx(0.6)
    leak = {(SMALL, SMALL): 10, (RIGHT, RIGHT): 10, (LARGE, LARGE): 10, (SMALL, RIGHT): 5}
    assert factor(spark, leak, {SMALL: 15.0, RIGHT: 10.0, LARGE: 10.0})["residual"] == pytest.approx(-1 / 3)
    assert factor(spark, {(SMALL, SMALL): 5, (LARGE, LARGE): 5})["lambda"] is None
    assert factor(spark, {**perfect, (SMALL, "unclear"): 50})["lambda"] == pytest.approx(1.0)


def test_operative_mde(spark):
    assert one(spark, attenuation.operative_mde(F.lit(0.3), F.lit(0.6))) == pytest.approx(0.5)
    with pytest.raises(Exception, match="positive"):
        one(spark, attenuation.operative_mde(F.lit(0.3), F.lit(0.0)))


def test_bootstrap_of_one_cluster_is_a_point(spark):
    rows = [("s", b, b) for b in BUCKETS for _ in range(4)] + [("s", SMALL, LARGE)]
    r = attenuation.bootstrap_lambda(spark.createDataFrame(rows, "u string, assigned string, human string"), "u", 50).first()
    assert r.n_clusters == 1 and r.low == r.high


def python_interval(rows, replicates, seed):
    """n_valid, low and high by hand: lambda of each resample of the clusters, drawn by the hash."""
    units = sorted({u for u, _, _ in rows})
    total = sum(P.ASSIGNED.values())
    lams = []
    for rep in range(replicates):
        n = dict.fromkeys(itertools.product(BUCKETS, BUCKETS), 0)
        for draw in range(len(units)):
            u = int(hashlib.md5(f"{seed}|{rep}|{draw}".encode()).hexdigest()[:8], 16) / 2**32
            for unit, a, h in rows:
                n[a, h] += unit == units[int(u * len(units))]
        sums = {k: sum(n[k, j] for j in BUCKETS) for k in BUCKETS}
        if all(sums.values()):
            p = {(k, j): n[k, j] / sums[k] for k, j in n}
            true = {j: sum(P.ASSIGNED[k] / total * p[k, j] for k in BUCKETS) for j in BUCKETS}
            if all(true.values()):
                a = {j: (P.ASSIGNED[LARGE] * p[LARGE, j] - P.ASSIGNED[SMALL] * p[SMALL, j]) / total / true[j] for j in BUCKETS}
                lams.append((a[LARGE] - a[SMALL]) / 2)
    lams.sort()
    return len(lams), lams[len(lams) * 25 // 1000], lams[min(len(lams) - 1, len(lams) * 975 // 1000)]


@pytest.mark.parametrize("sent", [500_000, 0])
def test_bootstrap_draws_once_in_bounded_parts(spark, monkeypatch, sent):
    """Each replicate draws each cluster once, however many results are made of it, and no task makes more than DRAWS."""
    rng = random.Random(12)
    rows = [(f"s{rng.randrange(13):02d}", a, a if rng.random() < 0.7 else rng.choice(BUCKETS)) for a in rng.choices(BUCKETS, k=90)]
    assert len({u for u, _, _ in rows}) == 13
    drawn, most = spark.sparkContext.accumulator(0), 100
    native = attenuation.uniform

    def counted(text):
        def add(u):
            drawn.add(1)
            return u

        return F.udf(add, "double")(native(text))

    monkeypatch.setattr(attenuation, "uniform", counted)
    monkeypatch.setattr(attenuation, "DRAWS", most, raising=False)
    monkeypatch.setattr(attenuation, "SENT", sent, raising=False)
    parts, ranged = [], spark.range
    monkeypatch.setattr(type(spark), "range", lambda _, *x: parts.append(x) or ranged(*x))
    got = attenuation.bootstrap_lambda(spark.createDataFrame(rows, "u string, assigned string, human string"), "u", 80, "9").first()
    assert drawn.value == 80 * 13
    assert [(x[1], x[3]) for x in parts] == [(80 * 13, -(-80 * 13 // most))]
    n_valid, low, high = python_interval(rows, 80, "9")
    assert (got.n_clusters, got.n_valid) == (13, n_valid) and (got.low, got.high) == pytest.approx((low, high), abs=1e-12)


def test_bootstrap_of_nothing(spark):
    r = attenuation.bootstrap_lambda(spark.createDataFrame([], "u string, assigned string, human string"), "u", 50).first()
    assert (r.n_clusters, r.n_valid, r.low, r.high) == (0, 0, None, None)


def python_wild(rows, replicates, sign):
    def t_of(y):
        n = len(rows)
        xb, yb = sum(r[1] for r in rows) / n, sum(y) / n
        sxx = sum((r[1] - xb) ** 2 for r in rows)
        beta = sum((r[1] - xb) * (v - yb) for r, v in zip(rows, y, strict=True)) / sxx
        by = {}
        for r, v in zip(rows, y, strict=True):
            by[r[0]] = by.get(r[0], 0.0) + (r[1] - xb) * (v - yb - beta * (r[1] - xb))
        g = len(by)
        return beta, beta / math.sqrt(g / (g - 1) * sum(s * s for s in by.values()) / sxx**2)

    y = [r[2] for r in rows]
    beta, t = t_of(y)
    yb = sum(y) / len(y)
    hits = sum(abs(t_of([yb + (r[2] - yb) * sign(k, r[0]) for r in rows])[1]) >= abs(t) for k in range(1, replicates + 1))
    return beta, t, (hits + 1) / (replicates + 1)


def test_wild_bootstrap_equals_observation_level(spark):
    import hashlib

    rng = random.Random(4)
    rows = [(f"c{k}", float(k % 2), rng.choice([-1.0, 0.0, 1.0]) + 0.3 * (k % 2)) for k in range(12) for _ in range(rng.randrange(1, 9))]
    uniform = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16) / 2**32
    want = python_wild(rows, 49, lambda r, c: 1.0 if uniform(f"9|{r}|{c}") < 0.5 else -1.0)
    df = spark.createDataFrame(rows, "c string, x double, y double")
    got = resample.wild_bootstrap(df, [], "c", F.col("x"), F.col("y"), F.lit(1), 49, "9").first()
    assert (got.beta, got.t, got.p) == pytest.approx(want, abs=1e-9)


def test_homogeneity(spark):
    same = [("p", f"a{k}", 10, 20, 10) for k in range(6)]
    apart = [("q", f"a{k}", 30 * (k % 2), 5, 30 * (1 - k % 2)) for k in range(6)]
    alone = [("r", "a", 3, 3, 3)]
    df = spark.createDataFrame(same + apart + alone, "g string, m string, " + ", ".join(f"{b} long" for b in BUCKETS))
    r = {x.g: x for x in resample.homogeneity(df, "g", "m", 99).collect()}
    assert r["p"].x2 == pytest.approx(0) and r["p"].p == 1.0
    assert r["q"].p == pytest.approx(0.01) and r["q"].dispersion > 10
    assert (r["r"].x2, r["r"].dispersion, r["r"].p) == (0.0, 0.0, 1.0)


def test_power_grows_with_the_effect(spark):
    sizes = spark.createDataFrame([(f"c{k}", 1 + k % 5) for k in range(60)], "cluster_id string, n long")
    split = cells.half_split(sizes, "n", "cluster_id")
    r = {x.effect: x.wild for x in resample.rejection_rates(resample.simulated(split, [0.0, 0.8], 10, 0.05, {SMALL: 0.3, RIGHT: 0.53, LARGE: 0.17}), 49).collect()}
    assert r[0.8] >= 8 and r[0.0] <= 3


def test_anova_and_gap(spark):
    rng = random.Random(6)
    rows = [(f"s{rng.randrange(5)}", rng.choice(["men", "women"]), rng.randrange(-2, 3)) for _ in range(200)]
    df = spark.createDataFrame(rows, "s string, g string, v long").withColumn("n", F.lit(1))
    r = variance.one_way(df, "s", "v", "n").first()
    mean = sum(v for *_, v in rows) / 200
    by = {}
    for s, _, v in rows:
        by.setdefault(s, []).append(v)
    between = sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in by.values())
    total = sum((v - mean) ** 2 for *_, v in rows)
    msb, msw = between / 4, (total - between) / 195
    m0 = (200 - sum(len(v) ** 2 for v in by.values()) / 200) / 4
    assert r.eta_squared == pytest.approx(between / total) and r.icc == pytest.approx((msb - msw) / (msb + (m0 - 1) * msw))
    empty = variance.one_way(df.limit(0), "s", "v", "n").first()
    assert (empty.n_obs, empty.n_groups, empty.eta_squared, empty.icc) == (0, 0, 0.0, None)
    assert variance.within_gap(df.filter("g = 'men'"), "s", "g", "men", "women", "v", "n").first().weighted_gap is None


def test_interaction_left_after_effects(spark):
    """Slope and robust t against least squares with dummies; an effect that isn't identified is 0 with p 1."""
    rng = np.random.default_rng(3)
    rows = [(f"s{k // 4}", f"c{k % 5}", ("men", "women")[(k // 4) % 2], ("upper", "lower")[k % 5 > 2], float(rng.normal()), int(rng.integers(1, 4))) for k in range(240)]
    df = spark.createDataFrame(rows, "style string, f string, gender string, half string, y double, n long")
    male_upper = F.when((F.col("gender") == "men") & (F.col("half") == "upper"), 1.0).otherwise(0.0)
    left = estimand.residualised(df, "f", F.col("y"), male_upper, "n", "style")
    got = resample.wild_bootstrap(left, [], "style", F.col("x"), F.col("y"), F.col("n"), 19).first()
    male = np.array([r[2] == "men" for r in rows], float)
    upper = np.array([r[3] == "upper" for r in rows], float)
    design = np.column_stack([*[np.array([r[1] == f"c{j}" for r in rows], float) for j in range(5)], male, male * upper])
    w, y = np.array([r[5] for r in rows], float), np.array([r[4] for r in rows])
    beta = np.linalg.lstsq(design * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    assert got.beta == pytest.approx(beta[-1])
    rest = design[:, :-1]
    x = male * upper - rest @ np.linalg.lstsq(rest * np.sqrt(w)[:, None], male * upper * np.sqrt(w), rcond=None)[0]
    score = {}
    for k, r in enumerate(rows):
        score[r[0]] = score.get(r[0], 0.0) + w[k] * x[k] * (y[k] - design[k] @ beta)
    g, sxx = len(score), (w * x * x).sum()
    assert got.t == pytest.approx(beta[-1] / np.sqrt(g / (g - 1) * sum(v * v for v in score.values()) / sxx**2))
    flat = estimand.residualised(df.filter("gender = 'men'"), "f", F.col("y"), male_upper, "n", "style")
    none = resample.wild_bootstrap(flat, [], "style", F.col("x"), F.col("y"), F.col("n"), 19).first()
    assert (none.beta, none.t, none.p) == (0.0, 0.0, 1.0)
    assert estimand.residualised(df.limit(0), "f", F.col("y"), male_upper, "n", "style").count() == 0


def test_small_maps(spark):
    df = spark.createDataFrame([(0,), (25,), (50,), (75,), (100,), (None,)], "p int").select(estimand.survey_score(F.col("p")).alias("s"))
    assert [r.s for r in df.collect()] == [None, -1.0, 0.0, 1.0, 1.0, None]
    assert one(spark, estimand.censored(F.lit(9))).asDict() == {"level": 6, "censored": True}
    assert [one(spark, estimand.agreement_band(F.lit(x))) for x in (7.9, -8.0, 15.0)] == ["agree", "partial", "diverge"]
    assert one(spark, estimand.lambda_gate(F.lit(0.8), 0.156, 0.2)) == "pass"


def test_quantiles_concentration_split(spark):
    df = spark.createDataFrame([(f"c{k}", k) for k in range(1, 11)], "c string, n long")
    q = cells.positional_quantiles(df, "n", {"p50": (1, 2), "p90": (9, 10), "p99": (99, 100)}).first()
    assert (q.p50, q.p90, q.p99) == (6, 10, 10)
    assert cells.positional_quantiles(df.limit(0), "n", {"p50": (1, 2)}).first().p50 is None
    assert {r.k: round(r.share, 4) for r in cells.concentration(df, "n", "c", [1, 3, 50]).collect()} == {1: round(10 / 55, 4), 3: round(27 / 55, 4), 50: 1.0}
    h = cells.hhi(df, "n").first()
    assert h.hhi == pytest.approx(385 / 55**2) and h.effective == pytest.approx(55**2 / 385)
    for sizes in ([5, 5, 5, 5], [100, 1, 1, 1], [1] * 9, [4], [3, 3, 2, 2, 2, 1]):
        d = spark.createDataFrame([(f"c{k}", n) for k, n in enumerate(sizes)], "c string, n long")
        treated = sorted((r.n for r in cells.half_split(d, "n", "c").collect() if r.treated), reverse=True)
        want, run = [], 0
        for n in sorted(sizes, reverse=True):
            if not want or run < sum(sizes) / 2:
                want.append(n)
                run += n
        assert treated == want, sizes


def test_samples(spark):
    df = spark.createDataFrame([(k * 7, k % 3) for k in range(1000)], "id long, s int")
    uneven = spark.createDataFrame([(k if k < 900 else k * k * k,) for k in range(1000)] + [(None,)], "id long")
    got = {(r.block, r.id) for r in sampling.block_sample(uneven, "id", 200, 10).collect()}
    assert got == {(k // 100, k if k < 900 else k * k * k) for k in range(1000) if k % 100 < 20}
    assert sampling.block_sample(df.limit(0), "id", 100, 10).count() == sampling.three_blocks(df.limit(0), "id", 10).count() == 0
    b = sampling.block_sample(df, "id", 103, 10).collect()
    assert len(b) == 100 and {r.block for r in b} == set(range(10)) and min(r.id for r in b if r.block == 3) == 300 * 7
    assert sampling.block_sample(df.limit(3), "id", 100, 10).count() == 0
    t = sampling.three_blocks(df, "id", 100).collect()
    assert sorted({(r.block, sum(x.block == r.block for x in t)) for r in t}) == [("head", 100), ("middle", 100), ("tail", 100)]
    assert min(r.id for r in t if r.block == "tail") == 880 * 7
    s = sampling.stratified(df, ["s"], F.col("id").cast("string"), 5, "x").collect()
    assert len(s) == 15
    assert {r.id for r in s} == {r.id for r in sampling.stratified(df.orderBy(F.rand()), ["s"], F.col("id").cast("string"), 5, "x").collect()}


def test_precision_and_recall(spark):
    m = spark.createDataFrame([("c", SMALL, SMALL, 6), ("c", SMALL, "none", 2), ("c", RIGHT, SMALL, 2)], "corpus string, truth string, guess string, n long")
    r = {x.bucket: x for x in validation.precision_recall(m).collect()}
    assert (r[SMALL].precision, r[SMALL].recall) == (0.75, 0.75) and (r[LARGE].precision, r[LARGE].recall, r[LARGE].f1) == (0.0, 0.0, 0.0)


def test_power_equals_observation_level(spark):
    """Sums per task against regressions over single clusters with the same outcomes and signs."""
    import numpy as np

    rng = random.Random(5)
    shares = {SMALL: 0.3, RIGHT: 0.53, LARGE: 0.17}
    rows = [(f"c{k}", rng.choice([1, 2, 3, 5, 40]), k % 2 == 0) for k in range(30)]
    df = spark.createDataFrame(rows, "cluster_id string, n long, treated boolean")
    got = {r.effect: (r.trials, r.wild, r.asymptotic) for r in resample.power(df, [0.0, 0.45], 6, 0.05, shares, 99).collect()}
    key = np.array([r[0] for r in df.select(F.xxhash64(F.lit("7"), "cluster_id")).collect()], np.int64).view(np.uint64)
    n, x = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for effect in (0.0, 0.45):
        wild = asymptotic = 0
        for trial in range(6):
            keys = resample.study_keys(key, effect, trial)
            y = resample.study_outcomes(keys, n, x, effect, 0.05, shares) / n
            signs, t = resample.study_signs(keys, 99), []
            xb, u = np.average(x, weights=n), y - np.average(y, weights=n)
            sxx = (n * (x - xb) ** 2).sum()
            for w in signs:
                beta = (n * (x - xb) * w * u).sum() / sxx
                e = w * u - np.average(w * u, weights=n) - beta * (x - xb)
                t.append(abs(beta) / np.sqrt(len(n) / (len(n) - 1) * ((n * (x - xb) * e) ** 2).sum() / sxx**2))
            wild += (sum(s >= t[0] - 1e-9 for s in t[1:]) + 1) / 100 < 0.05
            asymptotic += t[0] > 1.95996
        assert got[effect] == (6, wild, asymptotic)
    assert abs(np.mean(signs[1:])) < 0.1 and set(np.unique(signs)) == {-1.0, 1.0}


def test_detectable_effect_has_the_whole_grid(spark, data):
    from seamline.plans import measures

    got = {r.effect: r.trials for r in measures.wild_power(spark, data).collect()}
    assert got == {e: 60 for e in (0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.45, 0.6)}
