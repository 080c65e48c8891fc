"""SQL for DuckDB that computes what the queries compute, built from the same fixed values."""

from __future__ import annotations

from ..functions import patterns as P
from ..functions.text import BUCKETS, OUTSIDE, OUTSIDE_DIGIT, OUTSIDE_WORD, SPACE, any_of


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def squash(c: str) -> str:
    return f"trim(regexp_replace({c}, {q(SPACE)}, ' ', 'g'), ' ')"


def folded(title: str, text: str) -> str:
    b = squash(f"lower(coalesce({title}, '') || ' ' || coalesce({text}, ''))")
    for pattern, by in ((OUTSIDE_DIGIT, "9"), (OUTSIDE_WORD, "q"), (OUTSIDE, "~")):
        b = f"regexp_replace({b}, {q(pattern)}, '{by}', 'g')"
    return b


def has(c: str, patterns: list[str] | str) -> str:
    return f"regexp_matches({c}, {q(patterns if isinstance(patterns, str) else any_of(patterns))})"


def hit(c: str, bucket: str) -> str:
    return f"({has(c, P.FIT[bucket])} AND NOT {has(c, P.VETOES[bucket])})"


def labelled(source: str, title: str, text: str, keep: str = "*") -> str:
    """Common table expressions ending in `lab`: the source's rows with label (and blob b)."""
    h = [f"CAST({hit('b', x)} AS INT) AS h{k}" for k, x in enumerate(BUCKETS)]
    cases = " ".join(f"WHEN h{k} = 1 THEN '{x}'" for k, x in enumerate(BUCKETS))
    return f"""bl AS (SELECT {keep}, {folded(title, text)} AS b FROM {source}),
hits AS (SELECT *, {', '.join(h)} FROM bl),
lab AS (SELECT *, CASE WHEN h0 + h1 + h2 = 0 THEN 'none' WHEN h0 + h1 + h2 > 1 THEN 'ambiguous' {cases} END AS label FROM hits)"""


def first_pattern(c: str, bucket: str) -> str:
    whens = " ".join(f"WHEN {has(c, p)} THEN {k}" for k, p in enumerate(P.FIT[bucket]))
    return f"CASE {whens} END"


SCORE = "CASE label WHEN 'ran_small' THEN -1.0 WHEN 'true_to_size' THEN 0.0 WHEN 'ran_large' THEN 1.0 END"
YEAR = "year(make_timestamp(CASE WHEN ts_ms > 100000000000 THEN ts_ms * 1000 ELSE ts_ms * 1000000 END))"
IN_BUCKETS = "label IN ('ran_small', 'true_to_size', 'ran_large')"


def leaf_first(segs: str, rules: dict[str, str]) -> str:
    n = " + ".join(f"CAST({has('x', p)} AS INT)" for p in rules.values())
    cases = " ".join(f"WHEN {has('x', p)} THEN '{k}'" for k, p in rules.items())
    return f"list_filter(list_transform(list_reverse({segs}), lambda x: CASE WHEN {n} <> 1 THEN NULL {cases} END), lambda x: x IS NOT NULL)[1]"


def _gradient(segs: str) -> str:
    jeans, tee = has("x", P.GRADIENT_JEANS), has("x", P.GRADIENT_TEE)
    shirt = has(f"regexp_replace(x, {q(P.GRADIENT_TEE_STRIP)}, ' ', 'g')", P.GRADIENT_SHIRT)
    one = f"CASE WHEN CAST({jeans} AS INT) + CAST({tee} AS INT) + CAST({shirt} AS INT) <> 1 THEN NULL WHEN {jeans} THEN 'jeans_trousers' WHEN {tee} THEN 'tshirt' ELSE 'shirt' END"
    return f"list_filter(list_transform(list_reverse({segs}), lambda x: {one}), lambda x: x IS NOT NULL)[1]"


_ROOTS = ", ".join(q(r) for r in P.ROOTS)
#: `tax`: metadata with segs, path, gender, half, gradient; `idx`: the style index, one row per parent.
TAXONOMY = f"""
sg AS (SELECT *, list_transform(list_filter(coalesce(categories, []), lambda x: x IS NOT NULL AND x <> ''), lambda x: lower({squash('x')})) AS segs FROM metadata),
gs AS (SELECT *, list_filter(segs, lambda x: x NOT IN ({_ROOTS})) AS garment, array_to_string(segs, ' | ') AS path FROM sg),
tx AS (SELECT *, CASE WHEN {has('path', P.CHILD)} THEN 'children_excluded' WHEN {has('path', P.MEN)} AND {has('path', P.WOMEN)} THEN 'ambiguous'
       WHEN {has('path', P.MEN)} THEN 'men' WHEN {has('path', P.WOMEN)} THEN 'women' WHEN {has('path', P.UNISEX)} THEN 'unisex' ELSE 'unknown' END AS gender,
       coalesce({leaf_first('garment', P.HALF)}, 'unknown') AS half, {_gradient('garment')} AS gr0 FROM gs),
tax AS (SELECT *, CASE WHEN half <> 'excluded' THEN gr0 END AS gradient FROM tx),
idx AS (SELECT parent_asin, gender, half, gradient, path, {squash("coalesce(title, '')")} AS item_title, coalesce(garment[-1], '(none)') AS category,
               coalesce(nullif(trim(store), ''), '(unnamed)') AS store
        FROM tax WHERE gender IN ('men', 'women') AND half IN ('upper', 'lower') AND parent_asin <> ''
        QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY item_id DESC) = 1)
"""
#: Labels of all reviews and the style index: `lab` and `idx`.
REVIEWS = f"WITH {labelled('review', 'title', 'text')}, {TAXONOMY}"
#: `obs`: reviews joined to the index.
JOINED = f"""{REVIEWS}, obs AS (SELECT l.review_id, l.asin, l.parent_asin, l.user_id, coalesce(l.verified_purchase, false) AS verified, {YEAR} AS yr,
        l.rating, l.b, l.label, {SCORE} AS score, i.gender, i.half, i.gradient, i.path, i.item_title, i.category, i.store
        FROM lab l JOIN idx i ON l.parent_asin = i.parent_asin)"""
#: `fin`: labelled observations inside the window and verified.
WINDOW_FROM = 2019
FINAL = f"{JOINED}, fin AS (SELECT * FROM obs WHERE {IN_BUCKETS} AND yr >= {WINDOW_FROM} AND verified)"
