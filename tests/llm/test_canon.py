"""The similarity join against all pairs, and mapping on typed values with known meaning."""

import random

import pytest
from pyspark.sql import functions as F

from seamline.llm import canon

REF = [
    (1, "color", "Navy Blue", ["Marine"]), (2, "color", "Sky Blue", None), (3, "color", "White", None), (4, "color", "Ivory", ["Off-White"]), (5, "brand", "Vesluth & Puhift", ["Xyzzyq"]),
    (6, "brand", "Staththo Tregé", None), (7, "material", "Cotton", None), (8, "material", "Organic Cotton", None), (9, "material", "Acrylic", None), (10, "brand", "Vusiloom", None),
    (11, "brand", "3M", None), (12, "brand", "Forever 21", ["F21"]), (13, "brand", "Forster", None),
]


def refs(spark):
    return spark.createDataFrame(REF, "canon_id long, attr string, canonical string, aliases array<string>")


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8])
def test_join_loses_no_pair(spark, least):
    rng = random.Random(4)
    sets = lambda n, side: [(f"{side}{k}", rng.choice(["p", "q"]), rng.sample("abcdefghij", rng.randrange(0, 8))) for k in range(n)]
    v, r = sets(60, "v"), sets(40, "r")
    schema = "id string, attr string, tokens array<string>"
    got = {(x.value_id, x.ref_id): x.jaccard for x in canon.similar_pairs(spark.createDataFrame(v, schema), spark.createDataFrame(r, schema), least).collect()}
    want = {}
    for a, p, x in v:
        for b, q, y in r:
            union = set(x) | set(y)
            if p == q and union and len(set(x) & set(y)) / len(union) >= least:
                want[a, b] = len(set(x) & set(y)) / len(union)
    assert got == pytest.approx(want)


TYPED = [
    ("color", "NAVY BLUE", 1), ("color", "blue navy", 1), ("color", "Marine ", 1), ("color", "nvay blue", 1), ("color", "Color: Sky Blue", 2), ("color", "white 3", 3), ("color", "off white", 4), ("color", "pattern 14", -1),
    ("brand", "puhift/vesluth", 5), ("brand", "vesluthpuhift", 5), ("brand", "Vesluth and Puhift Inc", 5), ("brand", "xyzzyq", 5), ("brand", "staththo trege", 6), ("brand", "Staththo Markdro", -1), ("brand", "Vusiloom Haskme", -1),
    ("brand", "vusiloom official", 10), ("material", "arcylic", 9), ("material", "100% coton", 7), ("material", "cotton organic", 8), ("material", "Shell: Cotton", 7), ("material", "???", -1), ("shape", "Cotton", -1), ("material", "x" * 5000, -1),
    ("brand", "3M", 11), ("brand", "3m inc", 11), ("brand", "4M", -1), ("brand", "Forever 21", 12), ("brand", "forever21", 12), ("brand", "Forevr 21", 12), ("brand", "forever", -1), ("brand", "Forever 22", -1), ("brand", "f21", 12),
    ("brand", "forster", 13), ("brand", "", -1),
]


#: What sellers add, beside whole names.
ADDED = [
    *(("color", v) for name in ("navy blue", "white", "ivory") for v in (f"{name} 3", f"color: {name}", f"the {name}")),
    *(("brand", v) for name in ("Vusiloom", "Xyzzyq", "Staththo Trege", "Forster") for v in (f"{name} Inc.", f"{name} (Official)")),
    *(("material", v) for name in ("cotton", "acrylic", "organic cotton") for v in (f"100% {name}", f"shell: {name}")),
]


def test_added_words(spark):
    v = spark.createDataFrame(ADDED + [("brand", "Vusiloom Haskme"), ("brand", "Xyzzyq Haskme"), ("color", "blue navy sky")], "attr string, value string")
    forms = canon.reference_forms(refs(spark)).select("canon_id", "attr", canon.words(F.col("form")).alias("ws"))
    got = {tuple(r) for r in canon.added_words(v.select("attr", canon.words(F.col("value")).alias("ws")), forms).collect()}
    assert got == {("color", "3"), ("color", "color"), ("color", "the"), ("brand", "inc"), ("brand", "official"), ("material", "100"), ("material", "shell")}


def test_a_hot_token(spark, monkeypatch):
    monkeypatch.setattr(canon, "HOT_PARTS", 20)
    v = [(f"v{k}", "p", ["hot", f"a{k % 7}"]) for k in range(200)]
    r = [(f"r{k}", "p", ["hot", f"a{k}"]) for k in range(7)]
    schema = "id string, attr string, tokens array<string>"
    got = [tuple(x) for x in canon.similar_pairs(spark.createDataFrame(v, schema), spark.createDataFrame(r, schema), 0.3).collect()]
    assert len(got) == len(set(got)) == 1400 and sum(x[2] == 1.0 for x in got) == 200


def test_typed_values(spark):
    rows = [(k, a, v) for k, (a, v, _) in enumerate(TYPED * 2)] + [(100 + k, "color", "White") for k in range(60)]
    rows += [(999, "brand", None)] + [(1000 + k, a, v) for k, (a, v) in enumerate(ADDED)]
    got = {r.item_id: r.canon_id for r in canon.map_values(spark.createDataFrame(rows, "item_id long, attr string, value string"), refs(spark), "item_id").collect()}
    want = {k: c for k, (_, _, c) in enumerate(TYPED * 2)} | {100 + k: 3 for k in range(60)}
    assert {k: c for k, c in got.items() if k < 1000} == want and -1 not in {c for k, c in got.items() if k >= 1000}


def test_object_values(spark):
    cases = {
        1: ('{" Color :": "Red", "BRAND": "b"}', {("color", "Red"), ("brand", "b")}), 2: ('{"color": " ", "Color:": "Blue"}', {("color", "Blue")}), 3: ('{"color": "Red"', set()), 4: ("[]", set()),
        5: (None, set()), 6: ("{}", set()), 7: ('{"color": null, "Material": 5}', {("material", "5")}), 8: ("{'color': 'x'}", set()), 9: ("", set()),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "item_id long, details string")
    got = {}
    for r in canon.object_values(df, "item_id", "details", ["brand", "color", "material"]).collect():
        got.setdefault(r.item_id, set()).add((r.attr, r.value))
    assert got == {k: v[1] for k, v in cases.items() if v[1]}


def test_empty(spark):
    rows = spark.createDataFrame([], "item_id long, attr string, value string")
    assert canon.map_values(rows, refs(spark), "item_id").count() == 0
    some = spark.createDataFrame([(1, "color", "Red")], "item_id long, attr string, value string")
    assert [r.canon_id for r in canon.map_values(some, refs(spark).limit(0), "item_id").collect()] == [-1]


def test_differing(spark):
    d = lambda a, b: spark.range(1).select(canon.differing(F.lit(a), F.lit(b)).alias("d")).first().d
    assert [d("cotton", "cottno"), d("cotton", "coton"), d("cotton", "coxxon"), d("ab", "cd")] == [1, 1, 2, 2]
