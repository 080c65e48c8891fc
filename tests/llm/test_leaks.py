"""Leaks against brute force: recall over random documents, and the parts of the method by themselves."""

import pickle
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.llm import leaks

VOCAB = [f"w{k}" for k in range(150)]
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words_of(text):
    return [w.upper().lower() for w in re.findall(r"[^\W_]+", text)]


def held_out(spark, items):
    return list(leaks._blocks_of(spark.createDataFrame(items, ITEMS)))


def worded(spark, docs):
    return spark.createDataFrame(docs, DOCS).select("doc_id", leaks.word_hashes(F.col("text")).alias("words"))


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = words_of(t or "")
        for p in range(len(w) - 11):
            grams.setdefault(tuple(w[p : p + 12]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words_of(t or "")
        for p in range(len(w) - 11):
            out |= {(d, i) for i in grams.get(tuple(w[p : p + 12]), ())}
    return out


def corpus(seed):
    rng = random.Random(seed)
    items = [(k, " ".join(rng.choices(VOCAB, k=rng.randrange(8, 45)))) for k in range(60)] + [(900, None), (901, ""), (902, "too short")]
    docs = []
    for d in range(400):
        words = rng.choices(VOCAB + [f"x{k}" for k in range(400)], k=rng.randrange(0, 150))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w = words_of(items[rng.randrange(60)][1])
            n = rng.choice([5, 11, 12, 13, 20, len(w)])
            at = rng.randrange(max(1, len(w) - n + 1))
            cut = w[at : at + n]
            to = rng.randrange(len(words) + 1)
            words[to:to] = [c.upper() if rng.random() < 0.2 else c for c in cut]
        docs.append((d, rng.choice([" ", ", ", " - ", "\n"]).join(words)))
    docs += [(1000, None), (1001, ""), (1002, items[0][1]), (1002, items[0][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_and_precision(spark, seed):
    docs, items = corpus(seed)
    got = [tuple(r) for r in leaks.leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()]
    want = brute(docs, items)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_several_blocks_of_items(spark, monkeypatch):
    docs, items = corpus(3)
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 400)
    monkeypatch.setattr(leaks, "PIECE", 32)
    monkeypatch.setattr(leaks, "CHUNK", 50)
    assert len(held_out(spark, items)) > 3
    got = {tuple(r) for r in leaks.leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == brute(docs, items)


def test_paraphrases(spark):
    item = "the wearer moved from medium toward large because the inseam became rugged at the warehouse yesterday evening"
    docs = [(1, item), (2, item.replace("moved", "went").replace("became", "turned").replace("because", "since")), (3, "nothing of the sort " * 10)]
    other = [(8, "some readers of the magazine kept the plum tunic although the zipper gave out before the holidays began"), (9, item)]
    got = {(r.doc_id, r.item_id): r.kind for r in leaks.paraphrased_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(other, ITEMS)).collect()}
    assert got == {(1, 9): "verbatim", (2, 9): "paraphrase"}


def test_empty(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    full = spark.createDataFrame([(1, "a b c")], DOCS)
    assert leaks.leaked_items(docs, spark.createDataFrame([(1, " ".join("abcdefghijklmn"))], ITEMS)).count() == 0
    assert leaks.leaked_items(full, items).count() == 0
    assert leaks.paraphrased_items(full, items).count() == 0


def test_words_without_regard_to_case(spark):
    t = "The İNCE, straße_x1\tΣΟΦΌΣ — ½ ② it's"
    got = spark.createDataFrame([(1, t), (2, "the ince STRASSE X1 σοφός ½ ② IT S")], DOCS).select(leaks.word_hashes(F.col("text")).alias("w")).collect()
    assert len(got[0].w) == 9 and sum(a == b for a, b in zip(got[0].w, got[1].w, strict=True)) >= 8


def test_directions_span_what_matters(spark):
    """Cosines in the latent space stay close to those of the full TF-IDF rows when the rank allows it."""
    docs, items = corpus(5)
    held = held_out(spark, items)[0]
    idf = np.append(np.ones(held.other), 0.0).astype(np.float32)
    v = leaks.latent_directions(worded(spark, docs), held, idf, rank=held.other)
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-3)
    x = np.zeros((50, held.other + 1), np.float32)
    for k, w in enumerate(held.windows()[0][:50]):
        np.add.at(x[k], w, idf[w])
    x = x[:, :-1]
    assert np.allclose((x @ v) @ (x @ v).T, x @ x.T, atol=1e-2)
    sums = leaks.sums_up_to(held.texts[0], leaks.word_vectors(idf, v))
    assert np.allclose((sums[12] - sums[0]) / leaks.SCALE, leaks.word_vectors(idf, v)[held.texts[0][:12]].sum(axis=0) / leaks.SCALE)


def test_clusters_against_all_pairs():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 40))
    rows = leaks._unit(np.repeat(base, 20, axis=0) + 0.5 * rng.standard_normal((6000, 40)))
    asks = leaks._unit(base[:200] + 0.5 * rng.standard_normal((200, 40)))
    want = set(zip(*np.nonzero(asks @ rows.T >= 0.6), strict=True))
    i, j, _ = leaks.Clusters(rows).search(asks, 0.6)
    got = set(zip(i.tolist(), j.tolist(), strict=True))
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 1000


def test_many_items_and_words(spark):
    """4,000 items of 50,000 different words: what goes to a task stays small, and every leak is found."""
    rng = random.Random(11)
    items = [(k, " ".join(f"w{rng.randrange(50_000)}" for _ in range(40))) for k in range(4000)]
    docs = [(d, " ".join([f"x{rng.randrange(9)}" for _ in range(20)] + items[rng.randrange(4000)][1].split()[10 : 10 + rng.randrange(9, 30)])) for d in range(60)]
    blocks = held_out(spark, items)
    assert len(blocks) == 2 and sum(b.other for b in blocks) > 50_000
    assert max(len(pickle.dumps(b)) for b in blocks) < 20_000_000
    got = {tuple(r) for r in leaks.leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == brute(docs, items) and len(got) > 30


def test_subsequence_and_run():
    rng = random.Random(6)
    for _ in range(200):
        a, b = [rng.choices(range(5), k=rng.randrange(0, 12)) for _ in range(2)]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        run = 0
        r = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
                r[i + 1][j + 1] = r[i][j] + 1 if x == y else 0
                run = max(run, r[i + 1][j + 1])
        assert leaks.common_subsequence(a, b) == t[-1][-1]
        if a and b:
            assert leaks.longest_run(np.array(a), np.array(b)) == run


def test_a_common_leak_is_found_everywhere(spark):
    """A twelve-word fragment in a third of the documents, between few and rarer words of other items."""
    rng = random.Random(7)
    items = [(k, " ".join(rng.choices(VOCAB[:100], k=40))) for k in range(1, 40)] + [(0, " ".join(f"i{j}" for j in range(40)))]
    fragment = [f"i{j}" for j in range(5, 17)]
    docs = []
    for d in range(600):
        words = rng.sample(VOCAB[:100], 3) * 8
        docs.append((d, " ".join(words[:12] + fragment * (d % 3 == 0) + words[12:])))
    got = {tuple(r) for r in leaks.leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == brute(docs, items) and len(got) == 200


LONG = [
    "compared against last theatre this wearer moved from small toward large because their waist became silky at the warehouse "
    "whereas every sand cardigan carried one delicate mark beside both calves until some tailor altered that rugged inseam once more again",
    "compared against last studio this wearer moved from ten toward twelve because their back became sleek at the office "
    "whereas every rust camisole carried one stubborn crease beside both knees until some sister folded that airy hemline twice more again",
]


@pytest.mark.parametrize("part", [slice(0, 40), slice(0, 20), slice(10, 30), slice(20, 40)])
def test_paraphrases_of_long_items(spark, part):
    """Whole and half items of 40 words at every offset to the passages; of the words that both items share, which
    aren't answers, every third is another one."""
    items = [(k, " ".join(words_of(t)[:40])) for k, t in enumerate(LONG)]
    assert all(len(words_of(t)) == 40 for _, t in items)
    shared = set(items[0][1].split()) & set(items[1][1].split())
    rng = random.Random(8)
    around = [f"x{k}" for k in range(300)] + ["this", "the", "from", "became", "every", "one"]
    docs = [(100 + k, " ".join(rng.choices(around, k=80))) for k in range(100)]
    for at in range(12):
        told = items[0][1].split()[part]
        for k in [k for k, w in enumerate(told) if w in shared][at % 3 :: 3]:
            told[k] = f"y{k}"
        docs.append((at, " ".join(rng.choices(around, k=24 + at) + told + rng.choices(around, k=30))))
    got = leaks.paraphrased_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id, r.kind) for r in got} == {(at, 0, "paraphrase") for at in range(12)}


def test_verbatim_pairs_are_those_found(spark):
    """A run stands beside rarer words, so that its passage's cosine to the item is low."""
    rng = random.Random(9)
    items = [(k, " ".join(rng.choices(VOCAB[:100], k=40))) for k in range(1, 40)] + [(0, " ".join(f"i{j}" for j in range(40)))]
    docs = []
    for d in range(300):
        words = rng.sample(VOCAB[:100], 3) * 8
        docs.append((d, " ".join(words[:12] + [f"i{j}" for j in range(5, 17)] * (d % 3 == 0) + words[12:])))
    docs, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = {(r.doc_id, r.item_id) for r in leaks.paraphrased_items(docs, items).filter("kind = 'verbatim'").collect()}
    assert got == {tuple(r) for r in leaks.leaked_items(docs, items).collect()} and len(got) == 100


def test_a_run_is_not_joined_over_other_words(spark):
    w = [f"i{j}" for j in range(20)]
    docs, items = [(1, " ".join([*w[:7], "zz", *w[7:14]]))], [(5, " ".join(w))]
    got = leaks.paraphrased_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert [(r.run, r.common, r.kind) for r in got] == [(7, 14, "paraphrase")]


@pytest.mark.parametrize("operator", [leaks.leaked_items, leaks.paraphrased_items])
def test_directions_are_fitted_on_every_document(spark, monkeypatch, operator):
    """4,000 documents of 3.2 M words in all; the item's first word stands in one document only."""
    item = " ".join(f"i{j}" for j in range(20))
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") == 77, item).otherwise("i5 i6"), F.repeat(F.lit(" x"), 798)).alias("text"))
    fit, fitted = leaks.latent_directions, []
    monkeypatch.setattr(leaks, "latent_directions", lambda words, *x: fitted.append(words.agg(F.count("doc_id"), F.sum(F.size("words"))).first()) or fit(words, *x))
    got = [(r.doc_id, r.item_id) for r in operator(docs, spark.createDataFrame([(5, item)], ITEMS)).collect()]
    assert got == [(77, 5)]
    assert [tuple(x) for x in fitted] == [(4000, 3999 * 800 + 818)]


def test_centres_are_fitted_on_all_rows(monkeypatch):
    rows = leaks._unit(np.random.default_rng(13).standard_normal((25_000, 6)))
    centres = rows[np.random.default_rng(3).choice(len(rows), int(len(rows) ** 0.5), replace=False)]
    for _ in range(6):
        nearest = (rows @ centres.T).argmax(axis=1)
        centres = leaks._unit(np.stack([rows[nearest == k].sum(axis=0, dtype=np.float64) for k in range(len(centres))]))
    assert np.allclose(leaks.Clusters(rows).centres, centres, atol=1e-4)
    monkeypatch.setattr(leaks, "ROWS", 700)
    assert np.allclose(leaks.Clusters(rows).centres, centres, atol=1e-4)


def test_rows_without_other_words_give_the_same_sums():
    """Against dense rows: passages of other words only, repeated words and a last passage that is short."""
    rng = np.random.default_rng(14)
    nums = rng.choice([0, 1, 2, 3, 4, 5, 9, 9, 9], 500).clip(max=6).astype(np.int32)
    nums[24:72] = 6
    firsts, idf = np.arange(0, 500, 24), np.append(rng.random(6), 0.0).astype(np.float32)
    omega = rng.standard_normal((7, 4)).astype(np.float32) * idf[:, None]
    g, b = np.zeros((4, 4)), np.zeros((7, 4))
    assert leaks._add_rows(g, b, nums, firsts, omega, idf) == 21
    x = np.stack([np.bincount(nums[at : at + 24], minlength=7) for at in firsts]).astype(np.float64)
    y = x @ omega
    assert np.allclose(g, y.T @ y, rtol=1e-4) and np.allclose(b, (x * idf).T @ y, rtol=1e-4)
    assert leaks._add_rows(g, b, np.full(30, 6, np.int32), np.array([0, 24]), omega, idf) == 2
