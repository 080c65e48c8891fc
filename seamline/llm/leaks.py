"""Held-out passages that leaked into documents, by latent semantic retrieval.

Documents and held-out texts become arrays of word hashes. A distributed randomised SVD of the documents' passages, as
sparse TF-IDF rows over the words of the held-out texts, gives each word a vector in a latent space; a stretch of text is
the sum of its words' vectors. Vectors are kept in whole numbers, so sums are the same in any order and two stretches of
equal words always have cosine 1. Candidates come from that space: for runs of words, the signs of the leading
directions are a bucket that stretches at cosine 1 share; for paraphrases, passages are compared with the held-out
windows of the nearest clusters. Candidates are then checked word by word: the longest common subsequence, which for a
run must be all of its words, and whether the answer words of that part of the item, its rarest ones, are there.

Held-out texts are handled in blocks of a bounded number of words. What is sent to tasks depends on a block only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cuts import cut

#: Consecutive words that make a leak.
RUN = 12
#: Words of a passage: any run of RUN words stands in one that starts at most RUN words before it.
PASSAGE = 2 * RUN
#: Words of an item that are held against a passage at a time, and from one searched passage to the next: a paraphrase of
#: STRETCH words stands whole in a passage and beside no more than six other words.
STRETCH, SEARCH_STEP = 3 * RUN // 2, 4
#: Latent directions kept, and random directions beyond them; the leading ones give the bucket of a run.
RANK, OVERSAMPLE, BITS = 64, 8, 32
#: Words of the held-out texts handled at once, and of the pieces that longer texts are cut into (they overlap).
BLOCK_WORDS, PIECE = 100_000, 4096
#: Held-out items are spread over so many parts to be put into blocks.
PARTS = 1024
#: Words of documents embedded at once.
CHUNK = 1 << 16
#: Clusters of windows at most, clusters searched for a passage, and windows held against all centres at once.
CLUSTERS, PROBED, ROWS = 256, 24, 20_000
#: Paraphrases: least cosine, share of the passage's words in common order, and share of the answer words present.
PARA_COSINE, PARA_COMMON, PARA_ANSWERS = 0.6, 0.5, 2 / 3
#: Words of a stretch that count as its answer: those that the fewest other items have.
ANSWERS = 6
#: Vectors are whole multiples of 1/SCALE.
SCALE = 1 << 18


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the text's words, maximal runs of letters and digits, without regard to case; null gives none."""
    # by way of upper case, so that letters meet that share one; the step between keeps the optimizer from dropping it.
    # A letter of which case makes several characters stays in its word, as words are told apart before.
    folded = F.lower(F.translate(F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), "İ", "I"))
    return F.coalesce(F.transform(F.filter(F.split(folded, " "), lambda w: w != ""), lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


class HeldOut:
    """A block of held-out texts, given as (item, word hashes), as numbers of the block's words; `other` is no such word."""

    def __init__(self, texts: list[tuple[int, np.ndarray]]):
        texts = [(i, np.asarray(w, np.int64)) for i, w in texts if len(w)]
        self.vocabulary = np.unique(np.concatenate([w for _, w in texts])) if texts else np.empty(0, np.int64)
        self.other = len(self.vocabulary)
        self.items = [i for i, _ in texts]
        self.texts = [np.searchsorted(self.vocabulary, w).astype(np.int32) for _, w in texts]

    def runs(self) -> tuple[np.ndarray, list[list[int]]]:
        """The different runs of RUN words, and the items of each."""
        rows = [np.lib.stride_tricks.sliding_window_view(a, RUN) for a in self.texts if len(a) >= RUN]
        if not rows:
            return np.empty((0, RUN), np.int32), []
        owner = np.concatenate([np.full(len(a) - RUN + 1, i, np.int64) for i, a in zip(self.items, self.texts, strict=True) if len(a) >= RUN])
        runs, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        items: list[set[int]] = [set() for _ in runs]
        for k, i in zip(which.ravel().tolist(), owner.tolist(), strict=True):
            items[k].add(i)
        return runs, [sorted(x) for x in items]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs and stretches at every word, the text each comes from, and its answer words, those of the stretch around."""
        in_items = np.zeros(self.other + 1, np.int64)
        words_of: dict[int, list[np.ndarray]] = {}
        for i, a in zip(self.items, self.texts, strict=True):
            words_of.setdefault(i, []).append(a)
        for texts in words_of.values():
            in_items[np.unique(np.concatenate(texts))] += 1
        windows, source, answers = [], [], []
        for k, a in enumerate(self.texts):
            last = max(0, len(a) - STRETCH)
            rare = [sorted(set(a[p : p + STRETCH].tolist()), key=lambda x: (in_items[x], x))[:ANSWERS] for p in range(last + 1)]
            for p in range(last + 1):
                windows.append(a[p : p + STRETCH])
                answers.append(rare[p])
            for p in range(max(1, len(a) - RUN + 1)):
                windows.append(a[p : p + RUN])
                answers.append(rare[min(last, max(0, p - (STRETCH - RUN) // 2))])
            source += [k] * (len(windows) - len(source))
        full = np.full((len(windows), STRETCH), self.other, np.int32)
        wanted = np.full((len(windows), ANSWERS), self.other, np.int32)
        for r, (w, rare) in enumerate(zip(windows, answers, strict=True)):
            full[r, : len(w)] = w
            wanted[r, : len(rare)] = rare
        return full, np.array(source, np.int64), wanted


def _chunks(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray, overlap: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, where each starts and ends in the words, word numbers) of some CHUNK words at a time.

    Longer documents come in several parts, of which each starts with the last `overlap` words of the one before.
    """
    for b in batches:
        docs, lists = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("words")
        values = lists.flatten().to_numpy(zero_copy_only=False)
        nums = np.searchsorted(vocabulary, values).astype(np.int32)
        if len(vocabulary):
            nums[vocabulary[np.minimum(nums, len(vocabulary) - 1)] != values] = len(vocabulary)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
        k = 0
        while k < len(docs):
            to = max(int(np.searchsorted(ends, starts[k] + CHUNK, "right")), k + 1)
            if ends[to - 1] - starts[k] > CHUNK:
                for at in range(int(starts[k]), int(ends[k]), CHUNK):
                    lo, hi = max(at - overlap, int(starts[k])), min(at + CHUNK, int(ends[k]))
                    yield docs[k : k + 1], np.zeros(1, np.int64), np.array([hi - lo]), nums[lo:hi]
            elif ends[to - 1] > starts[k]:
                yield docs[k:to], starts[k:to] - starts[k], ends[k:to] - starts[k], nums[starts[k] : ends[to - 1]]
            k = to


def document_frequencies(worded: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """In how many of the documents (doc_id, words) each word of the vocabulary occurs; combined before the shuffle, as
    many rows as words to the driver."""
    sent = worded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        v = len(sent.value)
        total, last, seen = np.zeros(v + 1, np.int64), None, set()
        for docs, starts, ends, nums in _chunks(batches, sent.value):
            of = np.repeat(np.arange(len(docs), dtype=np.int64), ends - starts)
            pairs = np.unique(of * (v + 1) + nums)
            if len(docs) == 1 and docs[0] == last:  # a further part of a long document
                pairs = np.array(sorted(set(pairs.tolist()) - seen), np.int64)
            elif len(docs) == 1:
                seen = set()
            last = docs[0] if len(docs) == 1 else None
            if last is not None:
                seen |= set(pairs.tolist())
            total += np.bincount(pairs % (v + 1), minlength=v + 1)
        some = np.flatnonzero(total[:v])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["word", "df"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in worded.mapInArrow(run, "word int, df long").groupBy("word").agg(F.sum("df").alias("df")).collect():
        out[r["word"]] = r["df"]
    return out


def latent_directions(worded: DataFrame, held: HeldOut, idf: np.ndarray, rank: int = RANK, seed: int = 20) -> np.ndarray:
    """The leading `rank` right singular vectors (words x rank) of all passages' TF-IDF rows, by one randomised pass.

    Rows stay sparse: a passage's product with the random directions is the sum of its words' rows, and each word adds up
    the products of the passages it stands in. The held-out windows are rows too, with as much weight in all as the
    passages, so directions that only they use are kept. Tasks send a row for each word they met, added up word by word before
    they reach the driver; the sums' size depends on the block of held-out texts, not on the documents.
    """
    v = held.other
    width = min(rank + OVERSAMPLE, v)
    omega = np.random.default_rng(seed).standard_normal((v + 1, width)).astype(np.float32) * idf[:, None]
    sent = worded.sparkSession.sparkContext.broadcast((held.vocabulary, omega, idf))

    def run(batches):
        vocabulary, omega, idf = sent.value
        g, b, met, n = np.zeros((width, width)), np.zeros((v + 1, width)), np.zeros(v + 1, bool), 0
        for _, starts, ends, nums in _chunks(batches, vocabulary):
            firsts = np.concatenate([np.arange(lo, hi, PASSAGE) for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True)])
            n += _add_rows(g, b, nums, firsts, omega, idf)
            met[nums] = True
        some = np.flatnonzero(met[:v])
        rows = [*(g[k].tobytes() for k in range(width)), np.float64(n).tobytes(), *(b[k].tobytes() for k in some.tolist())]
        names = np.concatenate([np.arange(-width - 1, 0), some]).astype(np.int32)  # negative: the rows of g, then n
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(rows, pa.binary())], ["row", "sums"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for part in batches:
            for raw in part.column("sums").to_pylist():
                total = total + np.frombuffer(raw, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.asarray(total).tobytes()], pa.binary())], ["row", "sums"])

    g, b, n = np.zeros((width, width)), np.zeros((v + 1, width)), 0.0
    for r in worded.mapInArrow(run, "row int, sums binary").groupBy("row").applyInArrow(add, "row int, sums binary").collect():
        sums = np.frombuffer(bytes(r["sums"]), np.float64)
        if r["row"] >= 0:
            b[r["row"]] = sums
        elif r["row"] == -1:
            n = float(sums[0])
        else:
            g[r["row"] + width + 1] = sums
    own_g, own_b = np.zeros((width, width)), np.zeros((v + 1, width))
    windows = held.windows()[0]
    m = _add_rows(own_g, own_b, windows.ravel(), np.arange(0, windows.size, STRETCH), omega, idf)
    share = max(n, 1.0) / m
    g, b = g + share * own_g, b + share * own_b
    values, vectors = np.linalg.eigh(g)
    kept = values > 1e-9 * max(values[-1], 1e-12)  # fewer than `width` where the rows have fewer directions
    q = vectors[:, kept] / np.sqrt(values[kept])
    return np.linalg.svd(b[:v] @ q, full_matrices=False)[0][:, :rank].astype(np.float32)


def _add_rows(g: np.ndarray, b: np.ndarray, nums: np.ndarray, firsts: np.ndarray, omega: np.ndarray, idf: np.ndarray) -> int:
    """Adds passages, words `nums` from each of `firsts` to the next, to g = sum of y y' and b = sum of x y'; their number.

    Other words have no weight and are left out first, as are passages of nothing else.
    """
    known = np.flatnonzero(nums < len(idf) - 1)
    if not len(known):
        return len(firsts)
    passage, nums = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(nums))))[known], nums[known]
    heads = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    y = np.add.reduceat(omega[nums], heads, axis=0)
    g += y.T.astype(np.float64) @ y
    row = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(nums))))
    order = np.argsort(nums, kind="stable")
    word = nums[order]
    heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    b[word[heads]] += np.add.reduceat(y[row[order]], heads, axis=0) * idf[word[heads]][:, None]
    return len(firsts)


def word_vectors(idf: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Each word's weighted place in the latent space in whole numbers; zero for other words."""
    return np.rint(np.vstack([directions * idf[:-1, None], np.zeros((1, directions.shape[1]))]) * SCALE).astype(np.int32)


def sums_up_to(nums: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Running sums of the words' vectors. They may run over, but differences of PASSAGE words are right."""
    out = np.zeros((len(nums) + 1, vectors.shape[1]), np.int32)
    np.cumsum(vectors[nums], axis=0, dtype=np.int32, out=out[1:])
    return out


def buckets(sums: np.ndarray) -> np.ndarray:
    """The signs of the leading directions as a number."""
    bits = np.packbits(sums[:, :BITS] > 0, axis=1)
    full = np.zeros((len(bits), 8), np.uint8)
    full[:, : bits.shape[1]] = bits
    return full.view(np.uint64).ravel()


@dataclass
class RunIndex:
    """The different runs of a block, in the order of their buckets."""

    codes: np.ndarray
    first: np.ndarray
    runs: np.ndarray
    items: list[list[int]]

    @classmethod
    def of(cls, held: HeldOut, vectors: np.ndarray) -> RunIndex:
        runs, items = held.runs()
        code = buckets(vectors[runs].sum(axis=1, dtype=np.int32)) if len(runs) else np.empty(0, np.uint64)
        order = np.argsort(code, kind="stable")
        codes, first = np.unique(code[order], return_index=True)
        return cls(codes, np.append(first, len(order)), runs[order], [items[k] for k in order.tolist()])

    def hits(self, nums: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray, other: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, run) of each run of the block among the words: candidates share its bucket, and all RUN of their words
        are in common order."""
        none = np.empty(0, np.int64)
        n = len(nums) - RUN + 1
        if n <= 0 or not len(self.codes):
            return none, none
        unknown = np.concatenate([[0], np.cumsum(nums == other)])
        last = np.repeat(ends, ends - starts)[:n]
        at = np.flatnonzero((unknown[RUN:] == unknown[:-RUN]) & (np.arange(n) + RUN <= last))
        code = buckets(sums[at + RUN, :BITS] - sums[at, :BITS])
        k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        near = np.flatnonzero(self.codes[k] == code)
        at, k = at[near], k[near]
        many = self.first[k + 1] - self.first[k]
        place = np.repeat(at, many)
        run = np.repeat(self.first[k], many) + np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
        same = np.ones(len(place), bool)
        for j in range(RUN):
            same &= nums[place + j] == self.runs[run, j]
        return place[same], run[same]


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """Words of the longest stretch that stands in both."""
    same = a[:, None] == b[None, :]
    best, row = 0, np.zeros(len(b) + 1, np.int32)
    for r in same:
        row[1:] = np.where(r, row[:-1] + 1, 0)
        best = max(best, int(row.max()))
    return best


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over b."""
    where: dict[int, int] = {}
    for k, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Clusters:
    """Unit rows in clusters around centres; a search looks into the PROBED clusters nearest to a row.

    Centres start at rows drawn by seed and are fitted on all rows.
    """

    def __init__(self, rows: np.ndarray, seed: int = 3):
        self.probed = PROBED
        rng = np.random.default_rng(seed)
        self.centres = rows[rng.choice(len(rows), min(CLUSTERS, max(1, int(len(rows) ** 0.5))), replace=False)]
        for _ in range(6):
            nearest = self._nearest(rows)
            sums = np.zeros(self.centres.shape)
            np.add.at(sums, nearest, rows)
            self.centres = np.where(np.abs(sums).sum(axis=1, keepdims=True) > 0, _unit(sums), self.centres)
        nearest = self._nearest(rows)
        self.order = np.argsort(nearest, kind="stable")
        self.rows = rows[self.order]
        self.first = np.searchsorted(nearest[self.order], np.arange(len(self.centres) + 1))

    def _nearest(self, rows: np.ndarray) -> np.ndarray:
        """The centre nearest to each row."""
        return np.concatenate([(rows[at : at + ROWS] @ self.centres.T).argmax(axis=1) for at in range(0, len(rows), ROWS)])

    def search(self, x: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of x, row of the index, cosine) of the pairs found at `near` or more."""
        close = x @ self.centres.T
        most = min(self.probed, close.shape[1])
        probed = np.argpartition(-close, most - 1, axis=1)[:, :most]
        asks, cluster = np.repeat(np.arange(len(x)), most), probed.ravel()
        order = np.argsort(cluster, kind="stable")
        asks, bounds = asks[order], np.searchsorted(cluster[order], np.arange(len(self.centres) + 1))
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
        for c in range(len(self.centres)):
            mine = asks[bounds[c] : bounds[c + 1]]
            lo, hi = self.first[c], self.first[c + 1]
            if len(mine) and hi > lo:
                cosines = x[mine] @ self.rows[lo:hi].T
                i, j = np.nonzero(cosines >= near)
                found.append((mine[i], self.order[lo + j], cosines[i, j]))
        return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def _found_runs(worded: DataFrame, held: HeldOut, vectors: np.ndarray) -> DataFrame:
    """(doc_id, item_id) of each run of the block that stands in a document."""
    sent = worded.sparkSession.sparkContext.broadcast((held.vocabulary, vectors[:, :BITS], RunIndex.of(held, vectors)))

    def run(batches):
        vocabulary, vectors, index = sent.value
        for docs, starts, ends, nums in _chunks(batches, vocabulary, RUN - 1):
            place, r = index.hits(nums, starts, ends, sums_up_to(nums, vectors), len(vocabulary))
            if len(place):
                doc = docs[np.searchsorted(ends, place, "right")]
                once = np.unique(np.stack([doc, r], axis=1), axis=0)
                pairs = {(d, i) for d, k in once.tolist() for i in index.items[k]}
                d, i = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64())], ["doc_id", "item_id"])

    return worded.mapInArrow(run, "doc_id long, item_id long")


EVIDENCE = "doc_id long, item_id long, cosine double, run long, common long, common_share double, answers double"


def _evidence(worded: DataFrame, held: HeldOut, vectors: np.ndarray) -> DataFrame:
    """The evidence of each passage and item of which the passage holds a run, or comes near a window that it has enough
    answer words of."""
    windows, source, answers = held.windows()
    clusters = Clusters(_unit(vectors[windows].sum(axis=1, dtype=np.int32)))
    sent = worded.sparkSession.sparkContext.broadcast((held, vectors, RunIndex.of(held, vectors), clusters, source, answers))

    def run(batches):
        held, vectors, index, clusters, source, answers = sent.value
        texts_of: dict[int, list[int]] = {}
        for k, i in enumerate(held.items):
            texts_of.setdefault(i, []).append(k)
        wanted = np.maximum((answers != held.other).sum(axis=1), 1)
        for docs, starts, ends, nums in _chunks(batches, held.vocabulary, PASSAGE):
            sums = sums_up_to(nums, vectors)
            n = np.maximum(1, -(-(ends - starts - PASSAGE) // SEARCH_STEP) + 1) * (ends > starts)
            head = np.cumsum(n) - n
            of = np.repeat(np.arange(len(docs)), n)
            begin = starts[of] + (np.arange(len(of)) - head[of]) * SEARCH_STEP
            end = np.minimum(begin + PASSAGE, ends[of])
            # words beyond a passage's end count as other words
            words = np.append(nums, held.other)[np.where((grid := begin[:, None] + np.arange(PASSAGE)) < end[:, None], grid, len(nums))]
            forced: dict[int, set[int]] = {}
            for place, r in zip(*(x.tolist() for x in index.hits(nums, starts, ends, sums, held.other)), strict=True):
                d = int(np.searchsorted(ends, place, "right"))
                p = int(head[d]) + min((place - int(starts[d])) // SEARCH_STEP, int(n[d]) - 1)
                forced.setdefault(p, set()).update(index.items[r])
            e = _unit(sums[end] - sums[begin])
            out = []
            for lo in range(0, len(e), 2000):
                near, window, cosine = clusters.search(e[lo : lo + 2000], PARA_COSINE)
                present = np.zeros(len(near), np.int64)
                for at in range(0, len(near), 100_000):
                    w, has = answers[window[at : at + 100_000]], words[lo + near[at : at + 100_000]]
                    present[at : at + 100_000] = ((w[:, :, None] == has[:, None, :]).any(axis=2) & (w != held.other)).sum(axis=1)
                share = present / wanted[window]
                good = set(near[share >= PARA_ANSWERS].tolist())
                order = np.argsort(near, kind="stable")
                bounds = np.searchsorted(near[order], np.arange(min(2000, len(e) - lo) + 1))
                for k in sorted(good | {p - lo for p in forced if lo <= p < lo + 2000}):
                    mine = order[bounds[k] : bounds[k + 1]]
                    row = words[lo + k]
                    for x in _judged(row, source[window[mine]], share[mine], cosine[mine], forced.get(lo + k, set()), held, texts_of, e[lo + k]):
                        out.append((int(docs[of[lo + k]]), *x))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "item_id", "cosine", "run", "common", "common_share", "answers"])

    return worded.mapInArrow(run, EVIDENCE)


def _judged(row: np.ndarray, texts: np.ndarray, share: np.ndarray, cosine: np.ndarray, leaked: set[int], held: HeldOut, texts_of: dict[int, list[int]], e: np.ndarray) -> Iterator[tuple]:
    """(item, cosine, run, common, common_share, answers) of one passage's items, from each text's best window.

    Items of which the passage holds a run come out in any case; of the others those with enough answer words and words in
    common order, unless another text near the passage has more of these.
    """
    best: dict[int, tuple[float, float]] = {}
    for k, s, c in zip(texts.tolist(), share.tolist(), cosine.tolist(), strict=True):
        best[k] = max(best.get(k, (-1.0, 0.0)), (s, c))
    for i in leaked:
        for k in texts_of[i]:
            best.setdefault(k, (1.0, 1.0))
    words = row[row != held.other].tolist()
    common: dict[int, int] = {}

    def in_order(k: int) -> int:
        if k not in common:
            common[k] = common_subsequence(words, held.texts[k].tolist())
        return common[k]

    part = lambda k: in_order(k) / min(max(1, len(words)), len(held.texts[k]))
    told = [k for k, (s, _) in best.items() if s >= PARA_ANSWERS and part(k) >= PARA_COMMON]
    nearest = max((in_order(k), s) for k, (s, _) in best.items()) if told else None
    for k, (s, c) in best.items():
        if held.items[k] in leaked or k in told and (in_order(k), s) == nearest:
            yield held.items[k], c, longest_run(row, held.texts[k]), in_order(k), part(k), s


def _blocks_of(items: DataFrame) -> list[HeldOut]:
    """The held-out texts in blocks of BLOCK_WORDS words and a piece more; one block at a time is in memory with its texts."""
    w = items.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("words")).filter("item_id is not null and size(words) > 0")
    step = PIECE - PASSAGE
    pieces = w.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - PASSAGE, F.lit(1)), F.lit(step)), lambda at: F.slice("words", at, PIECE))).alias("words"))
    pieces = pieces.select("item_id", "words", F.size("words").alias("n"), F.pmod(F.xxhash64("item_id", "words"), F.lit(PARTS)).alias("part"))
    sums = {r["part"]: r["n"] for r in pieces.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    before, offsets = 0, []
    for part in sorted(sums):
        offsets.append((part, before))
        before += sums[part]
    if not before:
        return []
    spark = items.sparkSession
    running = F.sum("n").over(Window.partitionBy("part").orderBy("item_id", "words").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = pieces.join(F.broadcast(spark.createDataFrame(offsets, "part long, before long")), "part")
    placed = cut(placed.withColumn("block", F.floor((F.col("before") + running) / F.lit(BLOCK_WORDS))).select("item_id", "words", "block"), "held-out")

    def block(k: int) -> HeldOut:
        return HeldOut([(r["item_id"], np.array(r["words"], np.int64)) for r in placed.filter(F.col("block") == k).orderBy("item_id", "words").collect()])

    return (block(k) for k in range((before - 1) // BLOCK_WORDS + 1))


def _blocks(docs: DataFrame, items: DataFrame, one) -> DataFrame | None:
    """The union of one(documents as words, held-out block, word vectors) over blocks of the held-out items.

    Documents are turned into words once for all blocks.
    """
    worded = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), word_hashes(F.col("text")).alias("words"))
    worded = cut(worded, "worded").filter("size(words) > 0")  # filtered before it is written, words would be made twice
    total = worded.count()
    out = None
    for held in _blocks_of(items):
        if not held.other:
            continue
        df = document_frequencies(worded, held.vocabulary)
        idf = np.append(np.log((1 + total) / (1 + np.minimum(df, total))) + 1e-3, 0.0).astype(np.float32)
        vectors = word_vectors(idf, latent_directions(worded, held, idf))
        found = one(worded, held, vectors)
        out = found if out is None else out.unionByName(found)
    return out


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the document holds at least RUN consecutive words of the item's text.

    Words compare without regard to case and to what stands between them. Null and empty texts hold nothing; items of
    fewer than RUN words can't leak. A pair comes out once, however often the document repeats the passage. A run has
    cosine 1 to its equal and the same bucket whatever stands beside it and however common it is, so none is lost.
    """
    found = _blocks(docs, items, _found_runs)
    return docs.sparkSession.createDataFrame([], "doc_id long, item_id long") if found is None else found.distinct()


def paraphrased_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, run, common, common_share, answers, kind) of the nearest passage of each pair.

    kind `verbatim`: RUN or more consecutive words, the pairs of leaked_items; `paraphrase`: cosine to a run or stretch of
    the item, words in common order and answer words of that stretch present reach PARA_COSINE, PARA_COMMON and
    PARA_ANSWERS, so part of a long item is enough, and no other item of its block has more words in common order with the
    passage, or as many and more answer words. Other pairs don't come out. Nulls and empty texts as in leaked_items.
    """
    found = _blocks(docs, items, _evidence)
    if found is None:
        found = docs.sparkSession.createDataFrame([], EVIDENCE)
    kind = F.when(F.col("run") >= RUN, "verbatim").when((F.col("common_share") >= PARA_COMMON) & (F.col("answers") >= PARA_ANSWERS), "paraphrase")
    rank = F.struct((F.col("kind") == "verbatim").alias("v"), "common_share", "answers", "cosine", "run", "common", "kind")
    best = found.withColumn("kind", kind).filter("kind is not null").groupBy("doc_id", "item_id").agg(F.max(rank).alias("b"))
    return best.select("doc_id", "item_id", F.round("b.cosine", 4).alias("cosine"), "b.run", "b.common", F.round("b.common_share", 4).alias("common_share"), F.round("b.answers", 4).alias("answers"), "b.kind")
