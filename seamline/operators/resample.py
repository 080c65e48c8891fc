"""Inference that allows for clusters: robust t, wild cluster bootstrap, homogeneity test, power by simulation.

Rows are reduced to a few sums per cluster before anything is replicated. A replicate's statistic is then a function of
sums over clusters, so replicates cost clusters, not observations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cuts import cut
from ..functions.text import BUCKETS, uniform
from ..session import spread


def cluster_sums(obs: DataFrame, groups: list[str], cluster: str, x: Column, y: Column, n: Column) -> DataFrame:
    """Per group and cluster: A = sum (x - mean x) u, B = sum (x - mean x), U = sum u with u = y - mean y, and per group
    sxx and n_obs. `n` is the number of observations a row stands for."""
    d = obs.select(*groups, F.col(cluster).alias("cluster"), x.cast("double").alias("x"), y.cast("double").alias("y"), n.cast("double").alias("n"))
    per = d.groupBy(*groups, "cluster").agg(
        F.sum("n").alias("m"), F.sum(F.col("x") * F.col("n")).alias("sx"), F.sum(F.col("y") * F.col("n")).alias("sy"),
        F.sum(F.col("x") * F.col("y") * F.col("n")).alias("sxy"), F.sum(F.col("x") * F.col("x") * F.col("n")).alias("sx2"),
    )
    all_ = per.groupBy(*groups).agg(F.sum("m").alias("n_obs"), F.sum("sx").alias("tx"), F.sum("sy").alias("ty"), F.sum("sx2").alias("tx2"), F.count(F.lit(1)).alias("g"))
    j = per.join(all_, groups) if groups else per.crossJoin(F.broadcast(all_))
    xb, yb = F.col("tx") / F.col("n_obs"), F.col("ty") / F.col("n_obs")
    return j.select(
        *groups, "cluster", "n_obs", "g",
        (F.col("sxy") - xb * F.col("sy") - yb * F.col("sx") + xb * yb * F.col("m")).alias("A"),
        (F.col("sx") - xb * F.col("m")).alias("B"), (F.col("sx2") - 2 * xb * F.col("sx") + xb * xb * F.col("m")).alias("C"),
        (F.col("sy") - yb * F.col("m")).alias("U"), (F.col("tx2") - xb * F.col("tx")).alias("sxx"),
    )


def _t(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """beta and cluster-robust t per key from clusters carrying a sign w; t is 0 with one cluster or no variance.

    A cluster's score is wA - sB - beta C with s the mean residual. As w is 1 or -1, the sum of its squares is a
    polynomial in s and beta whose coefficients are plain sums: one aggregation, and nothing is joined back to clusters.
    """
    w, a, b, c = (F.col(x) for x in ("w", "A", "B", "C"))
    sums = weighted.groupBy(*keys).agg(
        F.first("sxx").alias("sxx"), F.first("n_obs").alias("n_obs"), F.first("g").alias("g"), F.sum(w * a).alias("wa"), F.sum(w * F.col("U")).alias("wu"), F.sum(a * a).alias("aa"),
        F.sum(b * b).alias("bb"), F.sum(c * c).alias("cc"), F.sum(w * a * b).alias("wab"), F.sum(w * a * c).alias("wac"), F.sum(b * c).alias("bc"),
    )
    beta = F.when(F.col("sxx") > 0, F.col("wa") / F.col("sxx")).otherwise(0.0)
    t = sums.withColumn("beta", beta).withColumn("s", F.col("wu") / F.col("n_obs"))
    s, v = F.col("s"), F.col("beta")
    meat = F.col("aa") + s * s * F.col("bb") + v * v * F.col("cc") - 2 * s * F.col("wab") - 2 * v * F.col("wac") + 2 * s * v * F.col("bc")
    t = t.withColumn("meat", meat)
    ok = (F.col("sxx") > 0) & (F.col("g") > 1) & (F.col("meat") > 1e-12 * (1 + F.col("aa")))
    stat = v / F.sqrt(F.col("g") / (F.col("g") - 1) * F.col("meat") / (F.col("sxx") * F.col("sxx")))
    return t.select(*keys, "beta", F.when(ok, stat).otherwise(0.0).alias("t"), "g")


def wild_bootstrap(obs: DataFrame, groups: list[str], cluster: str, x: Column, y: Column, n: Column, replicates: int = 399, seed: str = "0") -> DataFrame:
    """Per group: slope, robust t, clusters and the wild cluster bootstrap p-value of slope 0 (signs by cluster, null
    imposed). Signs come from a hash of seed, replicate, group and cluster. Empty input gives no row."""
    sums = cluster_sums(obs, groups, cluster, x, y, n)
    if not groups:
        sums = sums.withColumn("_all", F.lit(0))
    keys = groups or ["_all"]
    sums = spread(cut(sums, "cluster-sums"))  # a few numbers per cluster, read by every replicate
    seen = _t(sums.withColumn("w", F.lit(1.0)), keys).withColumnRenamed("t", "t_obs")
    rep = sums.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    sign = F.when(uniform(F.concat_ws("|", F.lit(seed), "rep", *groups, "cluster")) < 0.5, 1.0).otherwise(-1.0)
    stars = _t(rep.withColumn("w", sign), [*keys, "rep"]).select(*keys, "t")
    far = F.sum(F.when(F.abs("t") >= F.abs("t_obs"), 1).otherwise(0))
    out = stars.join(seen, keys).groupBy(*keys).agg(F.first("beta").alias("beta"), F.first("t_obs").alias("t"), F.first("g").alias("n_clusters"), ((far + 1) / F.lit(replicates + 1)).alias("p"))
    return out.select(*groups, "beta", "t", "n_clusters", "p")


def homogeneity(members: DataFrame, group: str, member: str, replicates: int = 999, seed: str = "20260815") -> DataFrame:
    """Per group: do its members draw from one bucket distribution? X2, X2 / df and a parametric bootstrap p-value.

    `members` holds one row per group and member with a count per bucket. Fewer than two members or no counts give
    (0, 0, 1).
    """
    members = members.select(F.col(group).alias("_group"), F.col(member).alias("_member"), *BUCKETS)
    n = sum((F.col(b) for b in BUCKETS), F.lit(0))
    m = members.withColumn("size", n).filter("size > 0")
    pool = m.groupBy("_group").agg(*[F.sum(b).alias(f"p_{b}") for b in BUCKETS], F.sum("size").alias("total"), F.count(F.lit(1)).alias("k"))
    share = {b: F.col(f"p_{b}") / F.col("total") for b in BUCKETS}
    x2 = sum((F.when(share[b] > 0, (F.col(b) - F.col("size") * share[b]) * (F.col(b) - F.col("size") * share[b]) / (F.col("size") * share[b])).otherwise(0.0) for b in BUCKETS), F.lit(0.0))
    base = m.join(pool, "_group")
    seen = base.groupBy("_group").agg(F.sum(x2).alias("x2"), F.first("k").alias("k"))
    draws = base.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size"))))
    u = uniform(F.concat_ws("|", F.lit(seed), "_group", "_member", "rep", "draw"))
    first, second = share[BUCKETS[0]], share[BUCKETS[0]] + share[BUCKETS[1]]
    draws = draws.withColumn("u", u).withColumn("b", F.when(F.col("u") <= first, 0).when(F.col("u") <= second, 1).otherwise(2))
    keep = [f"p_{b}" for b in BUCKETS]
    sim = draws.groupBy("_group", "_member", "rep", "size", "total", *keep).agg(*[F.sum(F.when(F.col("b") == i, 1).otherwise(0)).alias(b) for i, b in enumerate(BUCKETS)])
    stars = sim.groupBy("_group", "rep").agg(F.sum(x2).alias("x2_star"))
    hits = stars.join(seen, "_group").groupBy("_group").agg(F.sum(F.when(F.col("x2_star") >= F.col("x2") - 1e-9, 1).otherwise(0)).alias("hits"))
    out = seen.join(hits, "_group", "left")
    one = F.col("k") < 2
    return out.select(
        F.col("_group").alias(group), F.col("k").alias("n_members"), F.when(one, 0.0).otherwise(F.col("x2")).alias("x2"), F.when(one, 0.0).otherwise(F.col("x2") / ((F.col("k") - 1) * 2)).alias("dispersion"),
        F.when(one, 1.0).otherwise((F.coalesce("hits", F.lit(0)) + 1) / F.lit(replicates + 1)).alias("p"),
    )


def simulated(sizes: DataFrame, effects: list[float], trials: int, icc: float, shares: dict[str, float], seed: str = "7") -> DataFrame:
    """Outcomes of simulated studies: (effect, trial, cluster_id, treated, y_sum, n).

    `sizes`: cluster_id, n, treated. An observation is -1, 0 or 1 with the given shares, plus a normal shift of its
    cluster with variance `icc`, plus the effect where treated; a cluster keeps the sum only.
    """
    spark = sizes.sparkSession
    grid = F.broadcast(spark.createDataFrame([(float(e), t) for e in effects for t in range(trials)], "effect double, trial int"))
    j = sizes.select("cluster_id", "n", "treated").crossJoin(grid)  # the design: every study has every cluster
    key = lambda *x: F.concat_ws("|", F.lit(seed), "effect", "trial", "cluster_id", *x)
    u1, u2 = uniform(key(F.lit("a"))), uniform(key(F.lit("b")))
    shift = F.sqrt(-2 * F.log(1 - u1)) * F.cos(2 * F.pi() * u2) * F.lit(icc**0.5)
    small, right, _ = (shares[b] for b in BUCKETS)
    draw = lambda k: uniform(key(k.cast("string")))
    point = lambda u: F.when(u < small, -1.0).when(u < small + right, 0.0).otherwise(1.0)
    total = F.aggregate(F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda k: point(draw(k))), F.lit(0.0), lambda a, b: a + b)
    y = total + F.col("n") * (shift + F.when(F.col("treated"), F.col("effect")).otherwise(0.0))
    return j.select("effect", "trial", "cluster_id", "treated", y.alias("y_sum"), "n")


def rejection_rates(studies: DataFrame, replicates: int, seed: str = "11") -> DataFrame:
    """Per effect: trials, and how many the wild bootstrap and the asymptotic t reject at 5 %."""
    x = F.when(F.col("treated"), 1.0).otherwise(0.0)
    w = wild_bootstrap(studies, ["effect", "trial"], "cluster_id", x, F.col("y_sum") / F.col("n"), F.col("n"), replicates, seed)
    return w.groupBy("effect").agg(F.count(F.lit(1)).alias("trials"), F.sum(F.when(F.col("p") < 0.05, 1).otherwise(0)).alias("wild"), F.sum(F.when(F.abs("t") > 1.95996, 1).otherwise(0)).alias("asymptotic"))


_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Observations drawn at once, and clusters whose signs are held at once.
_DRAWS, _SIGNS = 1_000_000, 2_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of each 64-bit number (splitmix64)."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)) * 2.0**-53


def study_keys(clusters: np.ndarray, effect: float, trial: int) -> np.ndarray:
    """A hash of each cluster in one study."""
    study = _mixed(_mixed(np.array([effect]).view(np.uint64)) + np.uint64(trial))
    return _mixed(clusters ^ study)


def study_outcomes(keys: np.ndarray, n: np.ndarray, treated: np.ndarray, effect: float, icc: float, shares: dict[str, float]) -> np.ndarray:
    """Sum of each cluster's n outcomes, drawn as in `simulated`."""
    small, right, _ = (shares[b] for b in BUCKETS)
    ends, total = np.cumsum(n), np.zeros(len(n))
    for at in range(0, int(ends[-1]), _DRAWS):
        p = np.arange(at, min(at + _DRAWS, int(ends[-1])))
        c = np.searchsorted(ends, p, side="right")
        u = _unit(_mixed(keys[c] + (p - (ends - n)[c] + 1).astype(np.uint64) * _STEP))
        total += np.bincount(c, np.where(u < small, -1.0, np.where(u < small + right, 0.0, 1.0)), len(n))
    u1, u2 = _unit(_mixed(keys ^ np.uint64(1 << 62))), _unit(_mixed(keys ^ np.uint64(1 << 63)))
    return total + n * (np.sqrt(-2 * np.log(1 - u1)) * np.cos(2 * np.pi * u2) * icc**0.5 + np.where(treated, effect, 0.0))


def study_signs(keys: np.ndarray, replicates: int) -> np.ndarray:
    """Rows of signs, 1 or -1, one for each replicate behind a first one that is 1; columns are clusters."""
    words = np.arange(-(-replicates // 64), dtype=np.uint64) + np.uint64(1 << 61)
    bits = np.unpackbits(_mixed(keys[:, None] ^ words).view(np.uint8), axis=1)[:, :replicates]
    return np.concatenate([np.ones((1, len(keys))), 2.0 * bits.T - 1.0])


def study_t(sums: np.ndarray) -> np.ndarray:
    """t of the observed outcomes and of each replicate, as `_t` has it, from the sums of control and treated clusters.

    As x is the same throughout a cluster, A, B, C and U are multiples of a cluster's y_sum - mean y * n and n.
    sums: (2, replicates + 1, 6) with sum w y_sum, sum w n, sum w y_sum n, sum w n n, sum y_sum y_sum, clusters.
    """
    n_obs, g = sums[:, 0, 1].sum(), sums[:, 0, 5].sum()
    mean = sums[:, 0, 0].sum() / n_obs
    d = (np.array([0.0, 1.0]) - sums[1, 0, 1] / n_obs)[:, None]
    sxx = (d[:, 0] ** 2 * sums[:, 0, 1]).sum()
    u, un = sums[:, :, 0] - mean * sums[:, :, 1], sums[:, :, 2] - mean * sums[:, :, 3]
    nn, uu = sums[:, :1, 3], sums[:, :1, 4] - 2 * mean * sums[:, :1, 2] + mean * mean * sums[:, :1, 3]
    of = lambda k, x: (d**k * x).sum(axis=0)
    if sxx <= 0 or g < 2:
        return np.zeros(u.shape[1])
    v, s = of(1, u) / sxx, u.sum(axis=0) / n_obs
    meat = of(2, uu) + s * s * of(2, nn) + v * v * of(4, nn) - 2 * s * of(2, un) - 2 * v * of(3, un) + 2 * s * v * of(3, nn)
    ok = meat > 1e-12 * (1 + of(2, uu))
    return np.where(ok, v / np.sqrt(g / (g - 1) * np.where(ok, meat, 1.0) / sxx**2), 0.0)


def power(sizes: DataFrame, effects: list[float], trials: int, icc: float, shares: dict[str, float], replicates: int, seed: str = "7") -> DataFrame:
    """Per effect: trials, and how many the wild bootstrap and the asymptotic t reject at 5 %, of studies as in `simulated`.

    `sizes`: cluster_id (unique), n, treated. Each task draws outcomes and signs of its clusters from hashes of seed,
    effect, trial and cluster and adds them up, so what is shuffled depends on studies and replicates, not on clusters.
    """
    studies = [(float(e), t) for e in effects for t in range(trials)]
    shape = (2, replicates + 1, 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(studies), *shape))
        for b in batches:
            if not b.num_rows:
                continue
            clusters = b.column("key").to_numpy().view(np.uint64)
            n, treated = b.column("n").to_numpy(), b.column("treated").to_numpy(zero_copy_only=False)
            for k, (effect, trial) in enumerate(studies):
                keys = study_keys(clusters, effect, trial)
                y = study_outcomes(keys, n, treated, effect, icc, shares)
                each = np.stack([y, n, y * n, n * n.astype(float)], axis=1)
                for at in range(0, len(n), _SIGNS):
                    part = slice(at, at + _SIGNS)
                    w, x = study_signs(keys[part], replicates), treated[part, None]
                    both = w @ np.concatenate([each[part] * ~x, each[part] * x], axis=1)
                    sums[k, 0, :, :4] += both[:, :4]
                    sums[k, 1, :, :4] += both[:, 4:]
                for j in (0, 1):
                    sums[k, j, :, 4] += (y[treated == j] ** 2).sum()
                    sums[k, j, :, 5] += (treated == j).sum()
        if sums[:, :, 0, 5].any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(studies), dtype=np.int32)), pa.array([x.tobytes() for x in sums], pa.binary())], ["study", "sums"])

    def judge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for raw in b.column("sums").to_pylist():
                total += np.frombuffer(raw, np.float64).reshape(shape)
        t = np.abs(study_t(total))
        wild = (np.count_nonzero(t[1:] >= t[0]) + 1) / (replicates + 1) < 0.05
        yield pa.RecordBatch.from_arrays([pa.array([studies[key[0].as_py()][0]]), pa.array([int(wild)], pa.int64()), pa.array([int(t[0] > 1.95996)], pa.int64())], ["effect", "wild", "asymptotic"])

    keyed = spread(sizes.filter("n > 0").select(F.xxhash64(F.lit(seed), "cluster_id").alias("key"), F.col("n").cast("long").alias("n"), F.col("treated").cast("boolean").alias("treated")))
    judged = keyed.mapInArrow(run, "study int, sums binary").groupBy("study").applyInArrow(judge, "effect double, wild long, asymptotic long")
    return judged.groupBy("effect").agg(F.count(F.lit(1)).alias("trials"), F.sum("wild").alias("wild"), F.sum("asymptotic").alias("asymptotic"))
