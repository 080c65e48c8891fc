"""Budgets by hand, and mixtures that keep caps and reach shares."""

import random

import pytest

from seamline.llm import mixture

DOCS = "doc_id long, text string, lang string, source string"
TARGETS = "source string, target_share double, max_repeats int"


def test_shortage_goes_to_siblings_first():
    tree = mixture.tree([(("d1", "en", "a"), 0.4, 10.0), (("d1", "en", "b"), 0.1, 1000.0), (("d2", "en", "c"), 0.5, 1000.0)])
    assert mixture.hand_down(tree, 100.0) == pytest.approx({("d1", "en", "a"): 10.0, ("d1", "en", "b"): 40.0, ("d2", "en", "c"): 50.0})
    tree = mixture.tree([(("d1", "en", "a"), 0.4, 10.0), (("d1", "en", "b"), 0.1, 20.0), (("d2", "en", "c"), 0.5, 1000.0)])
    assert mixture.hand_down(tree, 100.0) == pytest.approx({("d1", "en", "a"): 10.0, ("d1", "en", "b"): 20.0, ("d2", "en", "c"): 70.0})


def test_share_out_limits():
    assert mixture.share_out(100, []) == []
    assert mixture.share_out(100, [(0.0, 50.0), (1.0, 30.0)]) == [0.0, 30.0]
    assert sum(mixture.share_out(60, [(0.2, 10.0), (0.3, 15.0), (0.5, 100.0)])) == pytest.approx(60)


def docs(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(1500):
        s = rng.choices(["big", "mid", "tiny", "loose", None], [60, 30, 3, 5, 2])[0]
        rows.append((k, " ".join(rng.choices(["fit", "size", "tunic", "navy"], k=rng.randrange(0, 60))), rng.choice(["en", "EN", "tr", None, "und", "??"]), s))
    return rows


TARGET_ROWS = [("big", 0.3, 1), ("mid", 0.4, 3), ("tiny", 0.2, 4), ("gone", 0.1, 2)]


@pytest.mark.parametrize("total", ["supply", "exact", 5000])
def test_mixture(spark, total):
    t = spark.createDataFrame(TARGET_ROWS, TARGETS)
    sized = mixture.sized_documents(spark.createDataFrame(docs(1), DOCS))
    plan = mixture.plan_mixture(sized, t, {"big": "x", "mid": "x"}, total)
    chosen = mixture.select_documents(sized, plan).collect()
    cap = {s: r for s, _, r in TARGET_ROWS}
    assert len({r.doc_id for r in chosen}) == len(chosen) and all(1 <= r.times <= cap[r.source] for r in chosen)
    got = {}
    for r in chosen:
        got[r.source, r.lang] = got.get((r.source, r.lang), 0) + r.times * r.n_tokens
    for s, lang, _, _, g, _ in plan.leaves:
        assert abs(got.get((s, lang), 0) - g) <= 60
    shares = {r.source: r for r in mixture.mixture_shares(sized, mixture.select_documents(sized, plan), t, plan, {}).collect()}
    assert shares["gone"].status == "empty" and shares["loose"].status == "no target" and shares[None].status == "no target" and shares["loose"].tokens == 0
    assert sum(r.actual_share for r in shares.values()) == pytest.approx(1, abs=1e-4)
    if total == "supply":
        assert shares["tiny"].status == "short" and shares["tiny"].most_repeats == 4
    if total == "exact":
        for s, want in (("big", 0.3), ("mid", 0.4), ("tiny", 0.2)):
            assert shares[s].actual_share >= want - 0.02
    again = mixture.select_documents(sized, plan).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, chosen))


def test_empty(spark):
    t = spark.createDataFrame(TARGET_ROWS, TARGETS)
    sized = mixture.sized_documents(spark.createDataFrame([], DOCS))
    plan = mixture.plan_mixture(sized, t, {})
    assert mixture.select_documents(sized, plan).count() == 0
    assert {r.status for r in mixture.mixture_shares(sized, mixture.select_documents(sized, plan), t, plan, {}).collect()} == {"empty"}
    some = mixture.sized_documents(spark.createDataFrame(docs(2), DOCS))
    none = mixture.plan_mixture(some, t.limit(0), {})
    assert mixture.select_documents(some, none).count() == 0


def test_token_counts_match_a_second_library():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    for text in ["", "Runs small!", "naïve çok güzel — すごく", "a  b\n\n c", "1234 it's"]:
        assert mixture.encoder(mixture.VOCABULARY).encode_ordinary(text) == other.encode(text, add_special_tokens=False).ids
