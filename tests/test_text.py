"""Labels against Python's own regular expressions and hand-derived cases."""

import re

import pytest
from pyspark.sql import functions as F

from seamline.functions import patterns as P
from seamline.functions import sizes, taxonomy, text

# text, label, advice, third party, cross gender, stated, talks size, deviation
CASES = [
    ("runs small, too tight", "ran_small", False, False, False, None, False, None),
    ("true to size, perfect fit", "true_to_size", False, False, False, None, True, None),
    ("runs large, too big", "ran_large", False, False, False, None, False, None),
    ("nice colour, great gift", "none", False, False, False, None, False, None),
    ("not true to size at all", "none", False, False, False, None, True, None),
    ("no need to size up", "true_to_size", False, False, False, None, True, None),
    ("too small in the waist but true to size", "ambiguous", False, False, False, None, True, None),
    ("i usually wear a medium, ordered a large, fits great", "none", False, False, False, None, True, 1),
    ("i usually wear a large, i bought a medium and it is fine", "none", False, False, False, None, True, -1),
    ("bought this for my husband, he loves it and it runs big", "ran_large", False, True, False, None, False, None),
    ("i am a woman and i prefer men's sizes", "none", False, False, True, "women", True, None),
    ("size up, it is very tight", "ran_small", False, False, False, None, True, None),
    ("size down next time", "ran_large", True, False, False, None, True, None),
    ("usually a small or medium, i ordered a medium", "none", False, False, False, None, True, None),
    ("i usually wear a medium, size 8 in jeans, i ordered a large", "none", False, False, False, None, True, None),
    ("i always wear a large, i ordered a large", "none", False, False, False, None, True, 0),
    ("i usually wear a large print top, i ordered a medium", "none", False, False, False, None, True, None),
    ("fits as expected", "true_to_size", False, False, False, None, False, None),
    ("too big but size up", "ambiguous", False, False, False, None, True, None),
    ("for my wife, size down", "ran_large", True, True, False, None, True, None),
    ("i'm usually a medium, got a large", "none", False, False, False, None, False, 1),
    ("i am a guy and this runs a bit small", "ran_small", False, False, False, "men", False, None),
    ("sizing runs large", "ran_large", False, False, False, None, False, None),
    ("Runs SMALL é", "ran_small", False, False, False, None, False, None),
    ("", "none", False, False, False, None, False, None),
]


def test_cases(spark):
    b = F.col("b")
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string").withColumn("b", text.folded(text.blob(F.lit(None).cast("string"), F.col("t"))))
    hit = F.get(text.pattern_hits(b), F.lit(0))
    rows = df.select("i", text.fit_label(b).alias("label"), text.is_advice(hit["bucket"], hit["pattern"]).alias("advice"), text.buyer_flags(b).alias("f"), text.talks_size(b).alias("talk"), text.size_pair(b).alias("s")).orderBy("i").collect()
    for r, (t, label, advice, third, cross, stated, talk, dev) in zip(rows, CASES, strict=True):
        assert r.label == label, t
        if label != "ambiguous":
            assert r.advice == advice, t
        assert (r.f.third_party, r.f.cross_gender, r.f.stated_gender, r.talk) == (third, cross, stated, talk), t
        assert (r.s.deviation if r.s else None) == dev, t


def python_label(title, body):
    blob = re.sub(r"\s+", " ", f"{title or ''} {body or ''}".lower()).strip()
    hits = [b for b, ps in P.FIT.items() if any(re.search(p, blob) for p in ps) and not any(re.search(p, blob) for p in P.VETOES[b])]
    return hits[0] if len(hits) == 1 else "ambiguous" if hits else "none"


def python_pair(title, body):
    blob = re.sub(r"\s+", " ", f"{title or ''} {body or ''}".lower()).strip()
    steps = lambda ps: {P.TEXT_LADDER[m.group(1)] for p in ps for m in re.finditer(text.sized(p), blob)}
    u, b = steps(P.USUAL), steps(P.BOUGHT)
    if len(u) != 1 or len(b) != 1 or re.search(P.NUMBER_SIZE, blob) or re.search(text.sized(P.EITHER_SIZE), blob):
        return None
    return b.pop() - u.pop()


def test_reviews_against_python(spark, data):
    r = spark.read.parquet(f"{data}/review.parquet")
    b = text.folded(text.blob(F.col("title"), F.col("text")))
    for row in r.select("title", "text", text.label_of(F.col("title"), F.col("text")).alias("l"), text.size_pair(b)["deviation"].alias("d")).collect():
        assert row.l == python_label(row.title, row.text), row
        assert row.d == python_pair(row.title, row.text), row


def test_every_pattern_means_the_same_in_java(spark):
    words = ["runs", "ran", "a", "bit", "small", "large", "too", "tight", "size", "up", "down", "true", "to", "not", "perfect", "fit", "order", "sizes", "larger", "my", "usual", "in", "it", "no", "need"]
    import random

    rng = random.Random(3)
    texts = [" ".join(rng.choices(words, k=rng.randrange(2, 9))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.pattern_hits(F.col("t")).alias("h")).collect()
    for row in rows:
        want = {b: next((k for k, p in enumerate(ps) if re.search(p, row.t)), None) for b, ps in P.FIT.items() if not any(re.search(p, row.t) for p in P.VETOES[b])}
        assert {h.bucket: h.pattern for h in row.h} == {b: k for b, k in want.items() if k is not None}, row.t


@pytest.mark.parametrize(
    ("raw", "size", "reason"),
    [(None, None, "absent"), ("  ", None, "empty"), ("Large", "L", "alpha"), ("36W x 32L", "W36xL32", "waist_inseam"), ("One Size", None, "one_size"), ("3 Piece Set", None, "unmapped"),
     ("XL (Chest 44-46)", "XL", "alpha"), ("US Large", "L", "alpha"), ("us 8", "NUM8", "numeric"), ("8.5", "NUM8.5", "numeric"), ("xx-large.", "XXL", "alpha"), ("(42)", None, "unmapped")],
)
def test_sizes(spark, raw, size, reason):
    r = spark.createDataFrame([(raw,)], "r string").select(sizes.normal_size(F.col("r")).alias("x")).first().x
    assert (r.size, r.reason) == (size, reason)


def test_size_entries(spark):
    cases = [
        ('{"Size": "L"}', "strict", "L"), ('{"Item Size:": "M"}', "loose", "M"), ('{"Package Size": "9"}', None, None), ("not json", None, None), ("{}", None, None), (None, None, None),
        ('{"Color": "x", "SIZE:": "S"}', "strict", "S"), ('{"a": 1, "Ring Size": "7", "Cup Size": "B"}', "loose", "7"), ('{"Size": "L", "Col', None, None),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "d string").select("d", sizes.size_entry(sizes.flat_keys(sizes.details_map(F.col("d")))).alias("e"))
    got = {r.d: (r.e.rule, r.e.value) if r.e else (None, None) for r in df.collect()}
    assert got == {c[0]: c[1:] for c in cases}


def test_taxonomy(spark):
    root = "Clothing, Shoes & Jewelry"
    cases = [
        ([root, "Women", "Clothing", "Tops, Tees & Blouses", "T-Shirts"], "women", "upper", "tshirt"), ([root, "Women", "Clothing", "Tops, Tees & Blouses", "Blouses & Button-Down Shirts"], "women", "upper", "shirt"),
        ([root, "Men", "Clothing", "Pants", "Chinos"], "men", "lower", "jeans_trousers"), ([root, "Women", "Clothing", "Dresses"], "women", "excluded", None), ([root, "Men", "Clothing", "Active", "Shorts"], "men", "lower", None),
        ([root, "Girls", "Clothing", "Tops"], "children_excluded", "upper", None), ([root, "Novelty & More", "Unisex", "Hoodies"], "unisex", "upper", None), ([], "unknown", "unknown", None), (None, "unknown", "unknown", None),
        ([None, "", "Men", "Women"], "ambiguous", "unknown", None),
    ]
    from seamline.operators import frames

    df = frames.with_taxonomy(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, categories array<string>")).orderBy("i")
    assert [(r.gender, r.half, r.gradient) for r in df.collect()] == [c[1:] for c in cases]


def test_review_hash_and_snippet(spark):
    import hashlib

    df = spark.createDataFrame([("u", None, 5)], "u string, a string, t long")
    assert df.select(text.review_hash(F.col("u"), F.col("a"), F.col("t")).alias("h")).first().h == hashlib.sha256(b"u|None|5").hexdigest()[:16]
    s = spark.createDataFrame([("T", "x" * 100 + " too tight " + "y" * 100)], "a string, b string").select(text.snippet(F.col("a"), F.col("b"), F.lit("too tight")).alias("s")).first().s
    assert s.startswith("...") and s.endswith("...") and "too tight" in s and len(s) == 6 + 110 + 9


def test_epoch_year(spark):
    df = spark.createDataFrame([("1600000000000",), ("1600000000",), ("x",), (None,), ("1e300",)], "t string").select(text.epoch_year(F.col("t")).alias("y"))
    assert [r.y for r in df.collect()] == [2020, 2020, None, None, None]
