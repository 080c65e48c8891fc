"""Shared spans against comparing every window."""

import random

import numpy as np
import pytest

from seamline.llm import spans

DOCS = "doc_id long, text string"


def brute(docs, least):
    where = {}
    for d, t in docs:
        for p in range(len(t or "") - least + 1):
            where.setdefault(t[p : p + least], set()).add(d)
    out = set()
    for d, t in docs:
        run = None
        for p in range(len(t or "") - least + 1):
            if len(where[t[p : p + least]]) > 1:
                if run and p <= run[1]:
                    run[1] = p + least
                else:
                    if run:
                        out.add((d, *run))
                    run = [p, p + least]
        if run:
            out.add((d, *run))
    return out


def found(spark, docs, least):
    return {tuple(r) for r in spans.shared_spans(spark.createDataFrame(docs, DOCS), least).collect()}


def corpus(seed, alphabet="abcdefgh ığ😀", n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choices(alphabet, k=k))
    pieces = [text(rng.randrange(15, 120)) for _ in range(12)]
    docs = []
    for d in range(n):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(pieces)
            a = rng.randrange(len(p))
            parts.append(rng.choice([text(rng.randrange(0, 50)), p, p[a:], p[:a], p + p]))
        docs.append((d, "".join(parts)))
    docs += [(900, None), (901, ""), (902, docs[3][1]), (903, docs[3][1])]
    return docs


@pytest.mark.parametrize(("seed", "least"), [(1, 20), (2, 31), (3, 40), (4, 7)])
def test_random_documents(spark, seed, least):
    docs = corpus(seed)
    assert found(spark, docs, least) == brute(docs, least)


def test_repetitive_text(spark):
    docs = [(1, "ab" * 60), (2, "ab" * 25 + "x" + "ab" * 25), (3, "a" * 100), (4, "b" * 10 + "a" * 33), (5, "z" * 90)]
    assert found(spark, docs, 20) == brute(docs, 20)


def test_a_third_are_copies(spark):
    rng = random.Random(5)
    text = lambda k: "".join(rng.choices("abcdef", k=k))
    hot, note = text(200), text(25)
    docs = [(k, hot if k % 3 == 0 else text(80) + (note if k % 3 == 1 else "") + text(60)) for k in range(300)]
    assert found(spark, docs, 20) == brute(docs, 20)


def test_repeated_only_inside_one_document(spark):
    t = "".join(random.Random(6).choices("abcdef", k=50))
    assert found(spark, [(1, t + "-" + t), (2, "q" * 70)], 20) == set()


def test_many_surroundings_of_one_anchor(spark, monkeypatch):
    monkeypatch.setattr(spans, "TOGETHER", 3)
    rng = random.Random(8)
    text = lambda k: "".join(rng.choices("abcdef", k=k))
    notes = [text(15) for _ in range(3)]
    ends = [text(rng.randrange(0, 12)) for _ in range(9)]
    docs = [(k, text(rng.randrange(0, 9)) + rng.choice(ends) + rng.choice(notes) + rng.choice(ends) + text(rng.randrange(0, 9))) for k in range(150)]
    for least in (20, 21, 26):
        assert found(spark, docs, least) == brute(docs, least)
    docs = corpus(7)
    assert found(spark, docs, 20) == brute(docs, 20)


def test_rows_of_one_document(spark):
    rng = random.Random(9)
    text = lambda k: "".join(rng.choices("abcdef", k=k))
    note, own = text(30), text(30)
    docs = [(1, note + text(5)), (1, own + text(9)), (1, text(4) + own), (2, text(7) + note)]
    assert found(spark, docs, 20) == {(1, 0, 30), (2, 7, 37)}


def test_empty_and_extra_columns(spark):
    assert found(spark, [], 20) == set()
    docs = [(1, "x" * 40, 5, "h"), (2, "x" * 40, 6, "at")]
    df = spark.createDataFrame(docs, "doc_id long, text string, at int, h string")
    assert {tuple(r) for r in spans.shared_spans(df, 20).collect()} == {(1, 0, 40), (2, 0, 40)}
    with pytest.raises(ValueError, match="least"):
        spans.shared_spans(df, 1)


def test_hashes_agree_wherever_the_window_stands():
    codes = np.random.default_rng(1).integers(0, 0x10FFFF, 5000).astype(np.uint32)
    h = spans.rolling_hashes(codes, 150)
    assert (spans.rolling_hashes(codes[777:], 150) == h[777:]).all() and len(set(h.tolist())) == len(h)


def test_shares(spark):
    df = spark.createDataFrame([(1, "x" * 40), (2, "x" * 40 + "y" * 40), (3, ""), (4, None)], DOCS)
    got = {r.doc_id: (r.n_chars, r.n_shared, r.share) for r in spans.shared_shares(df, spans.shared_spans(df, 20)).collect()}
    assert got == {1: (40, 40, 1.0), 2: (80, 40, 0.5), 3: (0, 0, 0.0), 4: (0, 0, 0.0)}


def test_anchors_over_chunks_and_texts(monkeypatch):
    rng = random.Random(10)
    texts = ["".join(rng.choices("abc", k=k)) for k in (5, 40, 300, 20, 19, 700)]
    ends = np.cumsum([len(t) for t in texts])
    places, h = spans.anchors(spans.code_points("".join(texts)), ends, 10, 20)
    monkeypatch.setattr(spans, "CHUNK", 64)
    again, h2 = spans.anchors(spans.code_points("".join(texts)), ends, 10, 20)
    assert (places == again).all() and (h == h2).all()
    starts = [0, *ends[:-1].tolist()]
    for t, b in zip(texts, starts, strict=True):
        alone, _ = spans.anchors(spans.code_points(t), np.array([len(t)]), 10, 20)
        assert (alone + b).tolist() == [p for p in places.tolist() if b <= p < b + len(t)]
        assert all(any(p <= q <= p + 10 for q in alone.tolist()) for p in range(len(t) - 19))
