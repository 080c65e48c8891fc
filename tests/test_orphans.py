"""Orphan references against a plain reading of the definition, on awkward tables."""

import random

from pyspark.sql import functions as F

from seamline.operators import orphans

REFS = "row_id long, key string, at_us long"
TARGET = "key string, from_us long, to_us long"


def brute(refs, target):
    live = {}
    for k, a, b in target:
        k = (k or "").strip().upper()
        if k:
            live.setdefault(k, []).append((a, b))
    out = []
    for i, k, t in refs:
        k = (k or "").strip().upper()
        if not k:
            continue
        if k not in live:
            out.append((i, "missing"))
        elif t is not None:
            spans = [(a, b) for a, b in live[k] if a is not None]
            if not any(a <= t and (b is None or t < b) for a, b in spans):
                out.append((i, "late" if all(t < a for a, _ in spans) else "deleted"))
    return sorted(out, key=str)


def found(spark, refs, target):
    df = orphans.find_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(target, TARGET))
    return sorted(((r.row_id, r.kind) for r in df.collect()), key=str)


def test_random_tables(spark):
    rng = random.Random(5)
    day = 86_400_000_000
    keys = ["A1", "A2", "A3", "A5", "0A1", "00A1", "ZZZZZZZZZZZ", "ZZZZZZZZZZZZ", "K-7", "ß1", "x1", "X1 ", None, " ", "", "\tA1\n"]
    for _ in range(4):
        refs = [(i, rng.choice(keys), rng.choice([None, rng.randrange(-3 * day, 9 * day), day, 2 * day])) for i in range(300)]
        target = []
        for _ in range(25):
            a = rng.choice([None, rng.randrange(-3 * day, 9 * day), day])
            target.append((rng.choice(keys), a, None if a is None or rng.random() < 0.3 else a + rng.choice([0, 1, day, 3 * day])))
        assert found(spark, refs, target) == brute(refs, target)


def test_one_key_holds_most_rows(spark):
    refs = [(i, "HOT", 1_000 * i) for i in range(3000)] + [(5000 + i, f"C{i}", 5) for i in range(50)]
    target = [("hot", 500_000, 900_000), ("HOT", 950_000, None), ("C7", 0, None)]
    assert found(spark, refs, target) == brute(refs, target)


def test_a_third_on_one_day_of_a_key_with_gaps(spark, monkeypatch):
    monkeypatch.setattr(orphans, "PART_ROWS", 100)
    rng = random.Random(6)
    refs = [(i, "HOT" if i % 3 == 0 else f"C{i % 40}", rng.randrange(2_000_000)) for i in range(3000)]
    target = [("hot", 1000 * a, 1000 * a + 500) for a in range(0, 1900, 7)] + [(f"C{i}", rng.randrange(10**6), rng.choice([None, 10**6])) for i in range(30)] * 2
    assert found(spark, refs, target) == brute(refs, target)


def test_empty_tables(spark):
    assert found(spark, [], [("A", 1, 2)]) == []
    assert found(spark, [(1, "A", 5), (2, None, 5)], []) == [(1, "missing")]


def test_key_parts_differ_for_different_keys(spark):
    keys = ["A", "0A", "00A", "A0", "ZZZZZZZZZZZ", "ZZZZZZZZZZZZ", "a b", "A-B", "-1", "Ü"]
    rest, num = orphans.key_parts(F.col("k"))
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select(rest.alias("r"), num.alias("n")).collect()
    assert len({tuple(r) for r in rows}) == len(keys)


def test_runs_are_contiguous(spark):
    nums = [1, 2, 3, 7, 8, 20, (1 << 20) - 1, 1 << 20]
    runs = orphans.key_runs(spark.createDataFrame([("", n) for n in nums], "rest string, num long")).collect()
    assert sorted((r.run_from, r.run_to) for r in runs) == [(1, 3), (7, 8), (20, 20), ((1 << 20) - 1, (1 << 20) - 1), (1 << 20, 1 << 20)]


def test_extra_columns_with_clashing_names(spark):
    refs = spark.createDataFrame([(1, "A", 5, 9, "x")], "row_id long, key string, at_us long, num long, missing string")
    target = spark.createDataFrame([("A", 6, None, 1, "y")], "key string, from_us long, to_us long, block long, missing string")
    assert [(r.row_id, r.kind) for r in orphans.find_orphans(refs, target).collect()] == [(1, "late")]
