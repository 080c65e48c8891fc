"""The transducer against a slow reading of its rules, and on awkward values."""

import random
import unicodedata

import pytest
import regex

from seamline.llm import forms


def one(s):
    return forms.transducer().consistent(s)


@pytest.mark.parametrize(
    ("written", "meant"),
    [
        ("ＦＵＬＬ　ｗｉｄｔｈ　１２", "FULL width 12"), ("ﬁne oﬃce", "fine office"), ("café", "café"), ("façade", "façade"), ("a​b­c⁠d﻿", "abcd"),
        ("no break thin", "no break thin"), ("tаnk", "tank"), ("Τhіѕ", "This"), ("が".replace("が", "が"), "が"), ("й", "й"), ("Å", "Å"), ("a‍b", "ab"),
        ("e​́", "é"), ("ｔаｎｋ", "tank"), ("x\x00y", "xy"), ("👍‍", "👍"),
    ],
)
def test_changes(written, meant):
    assert one(written) == meant


@pytest.mark.parametrize(
    "kept",
    ["", "plain", "naïve façade", "размер", "πολύ ωραίο", "すごくいい", "“quotes” – — …", "tab\tline\r\nend", "👩‍👧 👍🏽 ❤️ 1️⃣ 🇹🇷", "می‌خواهم", "x̂", "½ ™ №", "30х30", "а", "ОТЛИЧНЫЙ"],
)
def test_keeps(kept):
    assert one(kept) == kept


def test_forms_are_final():
    rng = random.Random(1)
    pool = "abcXYZ éñ" + "ａＺ１．　" + "ﬁﬀﬃ" + "゙̧́̈" + "​‌‍­﻿⁠️" + "  　" + "аеорсухіјѕΑΒοινρ" + "размер" + "👍🏽👩👧❤か"
    for _ in range(3000):
        s = "".join(rng.choices(pool, k=rng.randrange(1, 14)))
        assert one(one(s)) == one(s), repr(s)


def test_against_separate_passes():
    """Latin text with one disguise at a time: what the rules say one after the other."""
    rng = random.Random(2)
    words = ["tank", "fits", "naïve", "office", "size", "crêpe", "boxy"]
    back = {v: k for k, v in forms.LOOK_ALIKES.items()}
    for _ in range(500):
        plain = " ".join(rng.choices(words, k=4))
        how = rng.randrange(5)
        if how == 0:
            s = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" and rng.random() < 0.5 else c for c in plain)
        elif how == 1:
            s = unicodedata.normalize("NFD", plain)
        elif how == 2:
            s = "".join(c + rng.choice(["", "", "​", "­", "‍"]) for c in plain)
        elif how == 3:
            s = "".join(rng.choice([" ", " ", "　"]) if c == " " else c for c in plain)
        else:
            s = regex.sub(r"\b(\p{L})(\p{L}+)\b", lambda m: m.group(1) + "".join(back.get(c, c) if rng.random() < 0.5 else c for c in m.group(2)), plain)
            s = s if all(regex.search(r"\p{Latin}", w) for w in s.split()) else plain
        assert one(s) == plain, (s, plain)


def test_conflicts_are_found():
    with pytest.raises(forms.MappingConflict):
        forms.compile_trie([("a", "x", "y"), ("b", "x", "z")])
    with pytest.raises(forms.MappingConflict):
        forms.compile_trie([("a", "x", "y"), ("b", "y", "z")])


def test_longest_match():
    trie = forms.compile_trie([("t", "ab", "1"), ("t", "abc", "2"), ("t", "b", "3")])
    assert forms.clusterwise("abcabxb", trie) == "21x3"


def test_columns(spark):
    rows = [(1, "ok", "ﬁne", "k"), (2, None, "", "k"), (3, "tаnk", None, None), (4, "a" * 200_000 + "é", " " * 3, "k")]
    df = spark.createDataFrame(rows, "review_id long, title string, text string, value string")
    got = {(r.review_id, r.fld, r.form) for r in forms.changed_values(df, "review_id", ["title", "text"]).collect()}
    assert got == {(1, "text", "fine"), (3, "title", "tank"), (4, "text", "   ")}
    out = {r.review_id: (r.title, r.text) for r in forms.with_consistent_form(df, {"title": "title", "text": "text"}).collect()}
    assert out == {1: ("ok", "fine"), 2: (None, ""), 3: ("tank", None), 4: ("a" * 200_000 + "é", "   ")}
    assert forms.changed_values(df.limit(0), "review_id", ["title"]).count() == 0


def test_invisible_characters_beside_emoji_and_tags():
    flag = "\U0001f3f4\U000e0067\U000e0062\U000e007f"
    for written, meant in [("a\U000e0041b", "ab"), ("\U0001f44d\u034f", "\U0001f44d"), ("\u00a9\u200c", "\u00a9"), ("\U0001f44d\U000e0041", "\U0001f44d"), (flag, flag), ("3\ufe0f", "3")]:
        assert one(written) == meant


def test_confusables(spark):
    more = forms.confusables(spark)
    assert len(more) > 100 and more["\u13a0"] == "D" and more["\u0430"] == "a" and more["\u0406"] == "I"
    t = forms.transducer(more)
    for written, meant in [("\u13a0pple", "Dpple"), ("\u0455\u0435\u0445\u043e", "\u0455\u0435\u0445\u043e"), ("n\u0430\u0308ve", "n\u00e4ve"), ("c\u03bf\u0301mo", "c\u00f3mo"), ("p\u0430p\u044der", "pap\u044der")]:
        assert t.consistent(written) == meant and t.consistent(meant) == meant, written
    assert t.unmapped("pap\u044der") and not t.unmapped("\u0440\u0430\u0437 size") and not t.unmapped("\u044d\u044d\u044da")
    rng = random.Random(4)
    pool = "abcXYZ é" + "аеорсухіјѕΑΒοινρразмерэщ" + "\u0301\u0308\u200b" + "ﬀｔ" + "\u13a0\u2c9f"
    for _ in range(3000):
        s = "".join(rng.choices(pool, k=rng.randrange(1, 14)))
        assert t.consistent(t.consistent(s)) == t.consistent(s), repr(s)


def test_letters_without_a_look_alike_are_reported(spark):
    df = spark.createDataFrame([(1, "pap\u044der"), (2, "\u0440\u0430\u0437\u043c\u0435\u0440 M"), (3, "plain")], "review_id long, text string")
    assert [(r.review_id, r.form) for r in forms.changed_values(df, "review_id", ["text"]).collect()] == [(1, "pap\u044der")]
