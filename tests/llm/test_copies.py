"""Copies against grouping the bare fields in Python."""

import json
import random

from seamline.llm import copies


def bare(s):
    return "".join(c for c in (s or "").upper().lower() if c.isalnum())


def brute(records):
    groups = {}
    for i, u, a, t in records:
        if bare(t):
            groups.setdefault((bare(u), bare(a), bare(t)), []).append(i)
    return sorted((min(g), i) for g in groups.values() for i in g if i != min(g))


def test_random_records(spark):
    rng = random.Random(3)
    texts = ["Runs small!", "runs  SMALL", "r.u.n.s small", "Straße", "STRASSE", "ışık", "IŞIK", "12", "1-2", "...", "", None, "É", "é", "x" * 100_000]
    records = [(i, rng.choice(["u1", "U1 ", None, ""]), rng.choice(["A", "a-", None]), rng.choice(texts)) for i in range(600)]
    df = spark.createDataFrame(records, "id long, user_id string, asin string, text string")
    assert sorted(map(tuple, copies.copies(df).collect())) == brute(records)
    g = copies.counted(df).collect()
    assert sum(r.n_copies for r in g) == 600 and not any(r.collided for r in g)
    signs = {(bare(u), bare(a), bare(t) or " ".join((t or "").split()), bool(bare(t))) for _, u, a, t in records}
    assert len(g) == len(signs)


def test_form_of_words_and_numbers(spark):
    same = [("runs 1.5 sizes", "RUNS  1.5 sizes!"), ("cafe\u0301", "CAFÉ"), ("ＦＵＬＬ", "full"), ("well-made", "well made"), ("a\u00a0b\u200b", "a b"), ("раper", "paper"), ("10-12 cm.", "10-12 CM"), ("👍👍", "👍👍"), ("!!!", " !!! "), (None, "")]
    other = ["runs 15 sizes", "runs 1 5 sizes", "rerun 1.5 sizes", "👍", "!!", "wellmade"]
    rows = [(2 * k + j, "u", "a", t) for k, pair in enumerate(same) for j, t in enumerate(pair)] + [(100 + k, "u", "a", t) for k, t in enumerate(other)]
    df = spark.createDataFrame(rows, "id long, user_id string, asin string, text string")
    got = {(r.first_id, r.n_copies) for r in copies.counted(copies.consistent(df), copies.spaced).collect()}
    assert got == {(2 * k, 2) for k in range(len(same))} | {(100 + k, 1) for k in range(len(other))}


def test_collisions_are_told_apart(spark):
    rows = [(1, b"p", 5, True), (2, b"p", 6, True), (3, b"p", 5, True), (4, b"q", 7, True), (5, b"q", 7, True)]
    g = copies.copy_groups(spark.createDataFrame(rows, "id long, print binary, check long, worded boolean"))
    assert {(r.first_id, r.n_copies, r.collided) for r in g.collect()} == {(1, 2, True), (2, 1, True), (4, 2, False)}


def test_a_third_in_one_group(spark):
    records = [(i, "u", "a", "same" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(records, "id long, user_id string, asin string, text string")
    assert sorted(map(tuple, copies.copies(df).collect())) == brute(records)


def test_lines_in_any_order(spark):
    rec = {"user_id": "u", "asin": "a", "text": "t", "rating": 5}
    lines = [json.dumps(rec), json.dumps(dict(reversed(rec.items()))), json.dumps(rec, indent=1), json.dumps(rec)[:-3], "[]", "", None, '{"text": null}', '{"text": "a", "text": 1} ']
    df = spark.createDataFrame([(k, x, 9) for k, x in enumerate(lines)], "line_id long, payload string, text int")
    got = {r.id: (r.user_id, r.asin, r.text) for r in copies.parsed_lines(df, "line_id", "payload").collect()}
    assert {k: v for k, v in got.items() if k < 7} == {0: ("u", "a", "t"), 1: ("u", "a", "t"), 2: ("u", "a", "t")}
    assert got[7] == (None, None, None)


def test_empty(spark):
    df = spark.createDataFrame([], "id long, user_id string, asin string, text string")
    assert copies.copies(df).count() == 0 and copies.counted(df).count() == 0 and copies.counted(copies.consistent(df), copies.spaced).count() == 0
