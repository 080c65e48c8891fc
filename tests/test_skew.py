"""Skew-proof joins and per-key statistics against plain computation."""

import random
from collections import Counter

from seamline.operators import skew


def test_attach_groups_keeps_every_row(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(50)}") for i in range(2000)] + [(9000, None)]
    n = Counter(k for _, k in rows if k)
    groups = spark.createDataFrame([(k, c, k.upper()) for k, c in n.items() if k != "k3"], "k string, n long, tag string")
    got = skew.attach_groups(spark.createDataFrame(rows, "id long, k string"), groups, ["k"], "n").collect()
    assert sorted((r.id, r.tag) for r in got) == sorted((i, k.upper()) for i, k in rows if k and k != "k3")


def test_attach_groups_empty(spark):
    rows, groups = spark.createDataFrame([], "id long, k string"), spark.createDataFrame([], "k string, n long")
    assert skew.attach_groups(rows, groups, ["k"], "n").count() == 0


def test_weighted_statistics(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1.0, 1.5, -3.25, 1e9, 0.0, 2.0])) for _ in range(500)] + [("empty", None)]
    w = skew.compress_values(spark.createDataFrame(rows, "k string, v double"), ["k"], ["v"])
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    some = {k: sorted(x for x in vs if x is not None) for k, vs in by.items()}
    assert {r.k: r.d for r in skew.weighted_distinct(w, ["k"], "v", "d").collect()} == {k: len(set(v)) for k, v in some.items()}
    modes = {k: (min(x for x, c in Counter(v).items() if c == max(Counter(v).values())) if v else None) for k, v in some.items()}
    assert {r.k: r.m for r in skew.weighted_mode(w, ["k"], "v", "w", "m").collect()} == modes
    for share in (0.0, 0.1, 0.5, 0.9, 1.0):
        import math

        want = {k: v[max(math.ceil(len(v) * share), 1) - 1] for k, v in some.items() if v}
        got = {r.k: r.p for r in skew.weighted_percentile(w.filter("k is not null"), ["k"], "v", "w", share, "p").collect()}
        assert got == {k: v for k, v in want.items() if k is not None}
