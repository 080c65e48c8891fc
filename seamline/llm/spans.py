"""Long stretches of text that stand verbatim in more than one document.

Anchors by content: every rolling window of the wanted length is stood for by the one of its blocks, half as long, whose
rolling hash is smallest. Neighbouring windows mostly share that block, so about one character in 75 carries an anchor,
and a window has the same anchor at the same place wherever it is repeated. Anchors are grouped by their hash, which
takes one scan of the texts and no filter, however many texts there are. Those in two documents are then extended: the
text on both sides either stands around the same anchor in another document as a whole, or is compared with the other
texts around that anchor character by character, which gives the maximal exact repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cuts import cut
from ..operators.skew import attach_groups

#: Characters of a shared stretch, at least.
LEAST = 300
#: Different surroundings of one anchor that are compared in one go; more are split by the text next to the anchor.
TOGETHER = 48
#: Contexts of a large group, of different documents, that all its other contexts are held against first.
PIVOTS = 4
#: Parts that such a group's windows are split into at a time.
PARTS = 6
#: Characters hashed in one go.
CHUNK = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
#: Low bits that hold a block's place beside the upper bits of its hash; a chunk and its overlap have fewer places.
_PLACE = _U((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: dict[str, np.ndarray] = {}


def _power(n: int, which: str) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        full = np.empty(max(n, 1 << 16), _U)
        full[0] = 1
        full[1:] = _BASE if which == "up" else _INVERSE
        have = _powers[which] = np.multiply.accumulate(full)
    return have[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def rolling_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of `width` code points, equal for equal windows wherever they stand."""
    n = len(codes)
    if n < width:
        return np.empty(0, _U)
    out = np.empty(n - width + 1, _U)
    with np.errstate(over="ignore"):
        for at in range(0, n - width + 1, CHUNK):
            part = codes[at : at + CHUNK + width - 1]
            terms = _mix(part.astype(_U) + _U(1)) * _power(len(part), "up")
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(terms, dtype=_U)])
            w = (sums[width:] - sums[:-width]) * _power(len(sums) - width, "down")
            out[at : at + len(w)] = _mix(w)
    return out


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, from running minima inside stretches of that width."""
    n = len(x)
    if width == 1:
        return x
    filled = np.full(-(-n // width) * width, np.iinfo(_U).max, _U)
    filled[:n] = x
    rows = filled.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(codes: np.ndarray, ends: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the blocks that stand for some window of `least` characters lying inside one text.

    `codes` are texts one after the other, `ends` where each of them ends. Which block stands for a window depends on the
    window's characters only; the first of several equal ones is taken.
    """
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    places, hashes = [], []
    for at in range(0, max(len(codes) - least + 1, 0), CHUNK):
        part = codes[at : at + CHUNK + least - 1]
        h = rolling_hashes(part, width)
        low = sliding_minimum((h & ~_PLACE) | np.arange(len(h), dtype=_U), least - width + 1)
        # windows that reach into the next text stand for nothing
        step = np.zeros(len(low) + 1, np.int32)
        lo, hi = np.clip(starts - at, 0, len(low)), np.clip(ends - least + 1 - at, 0, len(low))
        some = hi > lo
        np.add.at(step, lo[some], 1)
        np.add.at(step, hi[some], -1)
        chosen = (low[np.cumsum(step[:-1]) > 0] & _PLACE).astype(np.int64)
        chosen = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])] if len(chosen) else chosen
        places.append(chosen + at)
        hashes.append(h[chosen])
    if not places:
        return np.empty(0, np.int64), np.empty(0, _U)
    found, first = np.unique(np.concatenate(places), return_index=True)
    return found, np.concatenate(hashes)[first]


def _record(columns: list[tuple[str, pa.DataType]], values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for (_, t), v in zip(columns, values, strict=True)], [n for n, _ in columns])


def _anchors(docs: DataFrame, width: int, least: int) -> DataFrame:
    """(h, doc_id, row, at) of every anchor of docs (doc_id, row, text); `row` tells texts of one document apart."""
    columns = [("h", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int32())]

    def found(texts, ids, rows):
        codes = code_points("".join(texts))
        ends = np.cumsum([len(t) for t in texts])
        places, h = anchors(codes, ends, width, least)
        k = np.searchsorted(ends, places, "right")
        return _record(columns, [h.view(np.int64), ids[k], rows[k], (places - np.concatenate([[0], ends])[k]).astype(np.int32)])

    def run(batches):
        for b in batches:
            ids, rows = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row"))
            texts, since, size = [], 0, 0
            for k, t in enumerate(b.column("text").to_pylist()):
                texts.append(t)
                size += len(t)
                if size >= CHUNK:
                    yield found(texts, ids[since : k + 1], rows[since : k + 1])
                    texts, since, size = [], k + 1, 0
            if texts:
                yield found(texts, ids[since:], rows[since:])

    return docs.mapInArrow(run, "h long, doc_id long, row long, at int")


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


_CONTEXT = "h long, doc_id long, row long, at int, c1 long, c2 long, l int, r int"


def _surroundings(docs: DataFrame, shared: DataFrame, width: int, least: int) -> DataFrame:
    """`shared` (h, doc_id, row, at) with c1 and c2, a 128-bit hash of the text from l characters before the anchor to r
    behind it: all that a window of `least` characters holding the anchor can reach inside the text."""
    side = least - width

    def run(batches):
        for b in batches:
            out = [[] for _ in range(8)]
            for doc, row, text, places in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "text", "places")), strict=True):
                codes = code_points(text)
                data, n = codes.tobytes(), len(codes)
                for p in places:
                    at = p["at"]
                    lo, hi = max(at - side, 0), min(at + width + side, n)
                    d = xxhash.xxh3_128_intdigest(data[4 * lo : 4 * hi])
                    for o, v in zip(out, (p["h"], doc, row, at, _signed(d >> 64), _signed(d & (1 << 64) - 1), at - lo, hi - at - width), strict=True):
                        o.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield _record(list(zip(("h", "doc_id", "row", "at", "c1", "c2", "l", "r"), kinds, strict=True)), out)

    of_text = shared.groupBy("doc_id", "row").agg(F.collect_set(F.struct("h", "at")).alias("places"))  # bounded by the text's length
    return docs.join(of_text, ["doc_id", "row"]).select("doc_id", "row", "text", "places").mapInArrow(run, _CONTEXT)


def _with_text(docs: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(h, c1, c2, l, r, doc_id, twice, n, text) of contexts `asked`, each with the text around its first place."""
    kept = ("h", "c1", "c2", "l", "r", "at", "twice", "n")
    of_text = asked.groupBy("doc_id", "row").agg(F.collect_list(F.struct(*kept)).alias("places"))
    each = docs.join(of_text, ["doc_id", "row"]).select("doc_id", "row", "text", F.explode("places").alias("p"))
    around = F.expr(f"substring(text, p.at - p.l + 1, p.l + {width} + p.r)")
    return each.select(*[f"p.{c}" for c in kept if c != "at"], "doc_id", around.alias("text"))


def reach(lefts: np.ndarray, k: int) -> np.ndarray:
    """How many leading codes of row `k` each row of a matrix shares."""
    same = lefts == lefts[k]
    return np.where(same.all(axis=1), lefts.shape[1], same.argmin(axis=1))


def compared(contexts: list[dict], width: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(position in the list, characters before the anchor, behind the anchor's start) that a context shares with others.

    A context that stands in one document (`twice` false) is held against all contexts of other documents: a stretch
    counts if with the anchor it has `least` characters or more, and the furthest ends on both sides are given.
    """
    side, n = least - width, len(contexts)
    left = np.empty((n, side), np.int64)
    right = np.empty((n, side), np.int64)
    left[:] = right[:] = -1 - np.arange(n)[:, None]  # beyond a text's end nothing is equal
    for k, c in enumerate(contexts):
        codes = code_points(c["text"])
        left[k, : c["l"]] = codes[: c["l"]][::-1]
        right[k, : c["r"]] = codes[len(codes) - c["r"] :]
    docs = np.array([c["doc_id"] for c in contexts])
    twice = np.array([c["twice"] for c in contexts])
    for k in np.flatnonzero(~twice).tolist():
        before, behind = reach(left, k), reach(right, k)
        good = (twice | (docs != docs[k])) & (before + behind >= side)
        good[k] = False
        if good.any():
            yield k, int(before[good].max()), width + int(behind[good].max())


_EDGE = "h long, c1 long, c2 long, l int, r int, before int, behind int"


def _compare(rows: DataFrame, width: int, least: int) -> DataFrame:
    """(h, c1, c2, l, r, before, behind) from contexts of groups (g1, g2) of at most TOGETHER rows."""

    def run(batches):
        for b in batches:
            out = []
            for group in b.column("group"):
                contexts = group.as_py()
                if len(contexts) > 1:
                    out += [(*(contexts[k][c] for c in ("h", "c1", "c2", "l", "r")), before, behind) for k, before, behind in compared(contexts, width, least)]
            if out:
                kinds = [pa.int64()] * 3 + [pa.int32()] * 4
                yield _record(list(zip(("h", "c1", "c2", "l", "r", "before", "behind"), kinds, strict=True)), list(zip(*out, strict=True)))

    group = F.collect_list(F.struct("h", "c1", "c2", "l", "r", "doc_id", "twice", "text")).alias("group")
    return rows.groupBy("g1", "g2").agg(group).select("group").mapInArrow(run, _EDGE)


def common(a: str, b: str) -> int:
    """Length of the common start of two texts."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def _against_pivots(large: DataFrame, width: int, least: int) -> DataFrame:
    """`large` with what each context shares with the pivots of its group: `cover`, for each pivot the windows (by the
    characters before the anchor) that stand in both, and in before and behind the reach of those of other documents."""
    side = least - width
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(PIVOTS))  # pivots of different buckets are of different documents
    pivot = [F.min(F.when(bucket == k, F.struct("doc_id", "twice", "l", "text"))) for k in range(PIVOTS)]
    groups = large.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"), F.filter(F.array(*pivot), lambda x: x.isNotNull()).alias("pivots"))
    rows = attach_groups(large.drop("n"), groups, ["g1", "g2"], "n")
    names = ["cover", "before", "behind"]
    kinds = [pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])), pa.int32(), pa.int32()]

    def run(batches):
        for b in batches:
            cover, reach_ = [], []
            sides: dict[tuple[str, int], tuple[str, str]] = {}
            for doc, l, text, pivots in zip(*(b.column(c).to_pylist() for c in ("doc_id", "l", "text", "pivots")), strict=True):
                left, right = text[:l][::-1], text[l + width :]
                mine, best = [], [None, None]
                for p in pivots:
                    key = p["text"], p["l"]
                    if key not in sides:
                        sides[key] = p["text"][: p["l"]][::-1], p["text"][p["l"] + width :]
                    before, behind = common(left, sides[key][0]), common(right, sides[key][1])
                    if before + behind >= side:
                        mine.append({"lo": side - behind, "hi": before})
                        if p["twice"] or p["doc_id"] != doc:
                            best = [max(best[0] or 0, before), max(best[1] or 0, behind + width)]
                cover.append(mine)
                reach_.append(best)
            kept = [b.column(k) for k, c in enumerate(b.schema.names) if c != "pivots"]
            made = [pa.array(v, t) for v, t in zip((cover, *zip(*reach_, strict=True)), kinds, strict=True)] if cover else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(kept + made, [c for c in b.schema.names if c != "pivots"] + names)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("pivots").schema.fields)
    return rows.mapInArrow(run, f"{fields}, cover array<struct<lo:int,hi:int>>, before int, behind int")


def _split(rows: DataFrame, width: int, least: int) -> DataFrame:
    """Each row once for every PARTS-th of its group's windows, grouped by the text that all windows of a part hold.

    A group's windows start from el characters before the anchor to `least` - width - er. A part whose windows all stand
    in two pivots is left out: any other context with such a window has met a pivot of another document.
    """
    side = least - width
    last = F.lit(side) - F.col("er")
    step = F.ceil((last - F.col("el") + 1) / PARTS).cast("int")
    part = lambda lo: F.struct(lo.cast("int").alias("el"), (F.lit(side) - F.least(lo + step - 1, last)).cast("int").alias("er"))
    parts = F.explode(F.transform(F.sequence(F.col("el"), last, step), part)).alias("s")
    both = rows.filter(F.col("el") <= last).select("h", "c1", "c2", "l", "r", "doc_id", "twice", "text", "cover", "el", "er", parts)
    both = both.select("h", "c1", "c2", "l", "r", "doc_id", "twice", "text", "cover", "s.el", "s.er").filter("el <= l and er <= r")
    both = both.filter(f"size(filter(cover, c -> c.lo <= el and c.hi >= {side} - er)) < 2")
    core = F.expr(f"substring(text, l - el + 1, el + {width} + er)")
    return both.withColumn("g1", F.xxhash64("h", "el", "er", core)).withColumn("g2", F.xxhash64(F.lit(1), core))


def _edges(rows: DataFrame, width: int, least: int) -> DataFrame:
    """(h, c1, c2, l, r, before, behind) of the contexts of one document that share a stretch with another one's.

    `rows`: contexts with text, and in `n` how many contexts their anchor has. Groups of more than TOGETHER contexts are
    split by the text next to what they have in common, in halves of what is open, until the common text is a whole
    window: about log2(least) steps, whatever the groups' sizes, and only for rows of such groups.
    """
    rows = cut(rows.select(F.col("h").alias("g1"), F.lit(0).cast("long").alias("g2"), "h", "c1", "c2", "l", "r", "doc_id", "twice", "text", F.lit(0).alias("el"), F.lit(0).alias("er"), "n"), "contexts")
    out = _compare(rows.filter(F.col("n") <= TOGETHER), width, least)
    large = cut(_against_pivots(rows.filter(F.col("n") > TOGETHER), width, least), "large-groups")
    out = out.unionByName(large.filter(~F.col("twice") & F.col("before").isNotNull()).select("h", "c1", "c2", "l", "r", "before", "behind"))
    large = large.filter(f"size(filter(cover, c -> c.lo <= greatest(0, {least - width} - r) and c.hi >= least({least - width}, l))) < 2")
    while not large.isEmpty():
        parts = cut(_split(large, width, least), "parts")
        sizes = parts.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("twice").alias("some"), F.min("twice").alias("all"))
        sizes = sizes.filter("(lo <> hi or some) and n > 1 and not all").select("g1", "g2", "n")
        parts = cut(attach_groups(parts, sizes, ["g1", "g2"], "n"), "sized-parts")
        whole = F.col("el") + F.col("er") == least - width
        out = out.unionByName(parts.filter(whole & ~F.col("twice")).select("h", "c1", "c2", "l", "r", F.col("el").alias("before"), (F.col("er") + width).alias("behind")))
        out = out.unionByName(_compare(parts.filter(~whole & (F.col("n") <= TOGETHER)), width, least))
        large = parts.filter(~whole & (F.col("n") > TOGETHER))
    return out


def merged(pieces: DataFrame) -> DataFrame:
    """Maximal runs (doc_id, span_from, span_to) of the union of pieces (doc_id, lo, hi)."""
    ordered = Window.partitionBy("doc_id").orderBy("lo")
    reach_ = F.max("hi").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    starts = pieces.withColumn("starts", (reach_.isNull() | (F.col("lo") > reach_)).cast("int"))
    runs = starts.withColumn("run", F.sum("starts").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("doc_id", "run").agg(F.min("lo").alias("span_from"), F.max("hi").alias("span_to"))
    return spans.select("doc_id", F.col("span_from").cast("long").alias("span_from"), F.col("span_to").cast("long").alias("span_to"))


def shared_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, span_from, span_to): the maximal runs of characters that lie in a stretch of at least `least` characters
    standing verbatim in another document; positions count Unicode characters, span_to is exclusive.

    `docs`: doc_id long, text string; other columns are ignored. A doc_id on several rows is one document, so a stretch
    repeated between its rows is no case. Null, empty and short texts share nothing; copies of one text by any number of
    documents are each shared whole. Characters compare by code point.

    The texts are scanned three times: for their anchors, for the surroundings of anchors in two documents, and for the
    text of those surroundings that don't repeat as a whole. No step's number of scans grows with the texts.
    """
    if least < 2:
        raise ValueError("least must be 2 or more")
    width = (least + 1) // 2
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text").filter((F.length("text") >= least) & F.col("doc_id").isNotNull())
    every = cut(_anchors(docs, width, least), "anchors")
    groups = every.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi").select("h", "n")
    shared = attach_groups(every, groups, ["h"], "n").drop("n")
    placed = cut(_surroundings(docs, shared, width, least), "surroundings")

    context = ["h", "c1", "c2", "l", "r"]
    first = F.min(F.struct("doc_id", "row", "at")).alias("first")
    alike = cut(placed.groupBy(*context).agg(first, F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).withColumn("twice", F.col("first.doc_id") != F.col("hi")), "alike")
    whole = attach_groups(placed, alike.filter("twice").select(*context, "n"), context, "n").select("doc_id", (F.col("at") - F.col("l")).alias("lo"), (F.col("at") + width + F.col("r")).alias("hi"))

    open_groups = alike.groupBy("h").agg(F.min("twice").alias("settled"), F.count(F.lit(1)).alias("n")).filter("not settled and n > 1").select("h", "n")
    asked = attach_groups(alike.select(*context, "first", "twice"), open_groups, ["h"], "n").select(*context, "first.*", "twice", "n")
    edges = _edges(_with_text(docs, asked, width), width, least)
    # contexts of one document: their places are bounded by its length
    partly = placed.join(edges, context).select("doc_id", (F.col("at") - F.col("before")).alias("lo"), (F.col("at") + F.col("behind")).alias("hi"))
    return merged(whole.unionByName(partly))


def shared_shares(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every document with its length, shared characters and their share (0 for empty texts)."""
    n = spans.groupBy("doc_id").agg(F.sum(F.col("span_to") - F.col("span_from")).alias("n_shared"), F.count(F.lit(1)).alias("n_spans"))
    lengths = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    zero = F.lit(0).cast("long")
    return lengths.join(n, "doc_id", "left").select(
        "doc_id", "n_chars", F.coalesce("n_shared", zero).alias("n_shared"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.when(F.col("n_chars") > 0, F.round(F.coalesce("n_shared", zero) / F.col("n_chars"), 6)).otherwise(0.0).alias("share"),
    )
