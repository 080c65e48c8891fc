"""Queries of the text problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table
from . import canon, copies, forms, leaks, mixture, spans


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Review titles and texts that aren't in their consistent form."""
    return forms.changed_values(spread(table(spark, d, "review")), "review_id", ["title", "text"]).select("review_id", "fld")


def p3_consistent(spark: SparkSession, d: str) -> DataFrame:
    """Every review with title and text in their consistent form."""
    r = spread(table(spark, d, "review")).select("review_id", "title", "text")
    return forms.with_consistent_form(r, {"title": "title", "text": "text"})


def _records(spark: SparkSession, d: str) -> DataFrame:
    review = spread(table(spark, d, "review")).select(F.col("review_id").alias("id"), *copies.FIELDS)
    return copies.consistent(review.unionByName(copies.parsed_lines(table(spark, d, "review_feed"), "line_id", "payload")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each copied record with the first of its group."""
    return copies.copies(_records(spark, d))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """One record per group, with its number of copies, by the same rule; texts of signs only compare by their signs."""
    return copies.counted(_records(spark, d))


def p4_worded(spark: SparkSession, d: str) -> DataFrame:
    """The same with words kept apart and marks inside numbers kept, so 1.5 and 15 differ."""
    return copies.counted(_records(spark, d), copies.spaced)


P4_SQL = r"""
WITH f AS (SELECT line_id id, payload FROM review_feed WHERE CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END),
rec AS (SELECT review_id id, user_id, asin, text FROM review
        UNION ALL SELECT id, payload->>'$.user_id', payload->>'$.asin', payload->>'$.text' FROM f),
bare AS (SELECT id, regexp_replace(lower(upper(coalesce(user_id, ''))), '[^\p{L}\p{N}]+', '', 'g') u,
                regexp_replace(lower(upper(coalesce(asin, ''))), '[^\p{L}\p{N}]+', '', 'g') a,
                regexp_replace(lower(upper(coalesce(text, ''))), '[^\p{L}\p{N}]+', '', 'g') t, trim(regexp_replace(coalesce(text, ''), '[\s\x{A0}]+', ' ', 'g')) s FROM rec),
g AS (SELECT u, a, t, min(id) first_id FROM bare WHERE t <> '' GROUP BY 1, 2, 3),
n AS (SELECT min(id) first_id, count(*) n_copies, false AS collided FROM bare GROUP BY u, a, t, CASE WHEN t = '' THEN s END)
"""

ATTRS = ["brand", "color", "material"]


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """Every typed brand, color and material with the entry of the reference list that is meant, or -1."""
    typed = canon.object_values(table(spark, d, "metadata"), "item_id", "details", ATTRS)
    return canon.map_values(typed, table(spark, d, "canon_ref"), "item_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """p5_values without the values that are already a canonical name."""
    names = table(spark, d, "canon_ref").select("attr", F.col("canonical").alias("value")).distinct()
    return p5_values(spark, d).join(names, ["attr", "value"], "left_anti").select("item_id", "attr", "canon_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with 12 or more consecutive words of a held-out item."""
    return leaks.leaked_items(spread(table(spark, d, "documents")), table(spark, d, "eval_item"))


def p6_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    """Leaks and paraphrases of held-out items with the evidence for each."""
    return leaks.paraphrased_items(spread(table(spark, d, "documents")), table(spark, d, "eval_item"))


#: The upper level of the mixture's tree.
DOMAINS = {
    "review_thread": "buyers", "qa_forum": "buyers", "returns_log": "buyers",
    "item_page": "shop", "retail_copy": "shop", "lookbook": "shop",
    "size_guide": "guidance", "coder_note": "guidance", "stylist_mail": "guidance",
}


def _mixed(spark: SparkSession, d: str, total: str = "supply"):
    sized = mixture.sized_documents(spread(table(spark, d, "documents")))
    targets = table(spark, d, "mix_target")
    plan = mixture.plan_mixture(sized, targets, DOMAINS, total)
    return sized, targets, plan, mixture.select_documents(sized, plan)


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture with their tokens and how often each appears; total: all tokens of targeted sources."""
    return _mixed(spark, d)[3]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source in that mixture."""
    sized, targets, plan, chosen = _mixed(spark, d)
    return mixture.mixture_shares(sized, chosen, targets, plan, DOMAINS)


def p7_exact_shares(spark: SparkSession, d: str) -> DataFrame:
    """The same for the largest total at which every source with documents can reach its share."""
    sized, targets, plan, chosen = _mixed(spark, d, "exact")
    return mixture.mixture_shares(sized, chosen, targets, plan, DOMAINS)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Maximal runs of characters shared with another document in stretches of 300 or more."""
    return spans.shared_spans(spread(table(spark, d, "documents")).select("doc_id", "text"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Every document with how much of it is shared."""
    docs = spread(table(spark, d, "documents")).select("doc_id", "text")
    return spans.shared_shares(docs, spans.shared_spans(docs))


QUERIES = {"p3_found": p3_found, "p3_consistent": p3_consistent, "p4_found": p4_found, "p4_records": p4_records, "p4_worded": p4_worded, "p5_found": p5_found, "p5_values": p5_values, "p6_found": p6_found, "p6_paraphrases": p6_paraphrases, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p7_exact_shares": p7_exact_shares, "p8_found": p8_found, "p8_shares": p8_shares}

_PICTURE = r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]\x{FE0F}?[\x{1F3FB}-\x{1F3FF}]?"
_OTHER = r"\p{Cyrillic}\p{Greek}\p{Armenian}"
#: Another way to tell: pictures are taken out first, then each kind of disguise is looked for by itself.
P3_SQL = f"""
WITH v AS (SELECT review_id, 'title' AS fld, title AS t FROM review UNION ALL SELECT review_id, 'text', text FROM review),
w AS (SELECT review_id, fld, regexp_replace(t, '{_PICTURE}(\\x{{200D}}{_PICTURE})*', '.', 'g') AS t FROM v)
SELECT review_id, fld FROM w WHERE nfc_normalize(t) <> t OR regexp_matches(t, '[\\x{{FF01}}-\\x{{FF5E}}\\x{{FB00}}-\\x{{FB06}}]')
OR regexp_matches(t, '\\p{{Cf}}|\\x{{FE0F}}|[\\x00-\\x08\\x0e-\\x1f\\x7f]') OR regexp_matches(replace(t, ' ', ''), '\\p{{Zs}}')
OR regexp_matches(t, '\\p{{Latin}}\\p{{L}}*[{_OTHER}]|[{_OTHER}]\\p{{L}}*\\p{{Latin}}')"""

P6_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_item),
dg AS (SELECT doc_id, md5(array_to_string(w[p : p + 11], ' ')) AS g FROM dw, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS p) WHERE len(w) >= 12),
ig AS (SELECT item_id, md5(array_to_string(w[p : p + 11], ' ')) AS g FROM iw, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS p) WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)).replace("＇", "")
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "")


def _p3_form(t: str) -> str:
    """SQL for the consistent form of t: outside pictures one replacement after the other, then look-alikes word by word."""
    plain = f"translate(x, '{_WIDE}', '{_NARROW}')"
    for k, joined in enumerate(["ff", "fi", "fl", "ffi", "ffl", "st", "st"]):
        plain = f"replace({plain}, '{chr(0xFB00 + k)}', '{joined}')"
    plain = f"regexp_replace({plain}, '\\p{{Cf}}|\\x{{FE0F}}|\\x{{FE0E}}|\\x{{034F}}|[\\x00-\\x08\\x0e-\\x1f\\x7f]', '', 'g')"
    plain = f"nfc_normalize(regexp_replace({plain}, '\\p{{Zs}}', ' ', 'g'))"
    parts = f"regexp_extract_all({t}, '(?s){_PICTURE}(?:\\x{{200D}}{_PICTURE})*|[^\\x{{1F1E6}}-\\x{{1F1FF}}\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]+')"
    clean = f"array_to_string(list_transform({parts}, lambda x: CASE WHEN regexp_matches(x, '^{_PICTURE}') THEN x ELSE {plain} END), '')"
    look, like = "".join(forms.LOOK_ALIKES), "".join(forms.LOOK_ALIKES.values())
    word = f"CASE WHEN regexp_matches(y, '\\p{{Latin}}') AND regexp_matches(y, '[{_OTHER}]') THEN translate(y, '{look}', '{like}') ELSE y END"
    return f"array_to_string(list_transform(regexp_extract_all({clean}, '(?s)[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'), lambda y: {word}), '')"


#: All pairs of distinct values and names instead of prefixes; added words by taking each word away in turn.
P5_SQL = r"""
WITH obj AS (SELECT item_id, details FROM metadata WHERE CASE WHEN json_valid(details) THEN json_type(details) = 'OBJECT' ELSE false END),
kv AS (SELECT item_id, regexp_replace(lower(regexp_replace(e.key, '^[\s\x{A0}]+|[\s\x{A0}:]+$', '', 'g')), '\s+', ' ', 'g') AS attr, e.value->>'$' AS value, row_number() OVER (PARTITION BY item_id) AS place
       FROM obj, LATERAL (SELECT * FROM json_each(obj.details)) e),
typed AS (SELECT item_id, attr, value FROM kv WHERE attr IN ('brand', 'color', 'material') AND regexp_replace(value, '[\s\x{A0}]+', '', 'g') <> ''
          QUALIFY row_number() OVER (PARTITION BY item_id, attr ORDER BY place) = 1),
val AS (SELECT attr, value, regexp_extract_all(lower(strip_accents(value)), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT attr, value FROM typed)),
form AS (SELECT DISTINCT canon_id, attr, regexp_extract_all(lower(strip_accents(f)), '[\p{L}\p{N}]+') AS w FROM (SELECT canon_id, attr, unnest(list_append(coalesce(aliases, []), canonical)) AS f FROM canon_ref)),
gone AS (SELECT attr, unnest(w) AS word, list_sort(list_distinct(w)) AS s FROM val WHERE len(w) BETWEEN 2 AND 12),
added AS (SELECT g.attr, g.word FROM gone g JOIN form f ON g.attr = f.attr AND list_filter(g.s, lambda x: x <> g.word) = list_sort(list_distinct(f.w)) GROUP BY g.attr, g.word HAVING count(DISTINCT canon_id) >= 3),
extra AS (SELECT attr, list(word) AS words FROM added a WHERE NOT EXISTS (SELECT 1 FROM form f WHERE f.attr = a.attr AND list_contains(f.w, a.word)) GROUP BY attr),
cut AS (SELECT v.attr, v.value, v.w, list_filter(v.w, lambda x: NOT list_contains(coalesce(e.words, []), x)) AS k FROM val v LEFT JOIN extra e ON v.attr = e.attr),
bare AS (SELECT attr, value, CASE WHEN len(k) > 0 THEN k ELSE w END AS w FROM cut),
vt AS (SELECT attr, value, w, array_to_string(w, '') AS t, list_distinct(flatten(list_transform(w, lambda x: list_transform(range(1, len(x) + 2), lambda i: substr('_' || x || '_', i, 2))))) AS g FROM bare WHERE len(w) > 0),
ft AS (SELECT canon_id, attr, w, array_to_string(w, '') AS t, list_distinct(flatten(list_transform(w, lambda x: list_transform(range(1, len(x) + 2), lambda i: substr('_' || x || '_', i, 2))))) AS g FROM form WHERE len(w) > 0),
met AS (SELECT v.attr, v.value, v.t AS vt, f.t AS ft, f.w AS fw, canon_id, len(list_intersect(v.g, f.g)) AS c, len(v.g) + len(f.g) AS b FROM vt v JOIN ft f ON v.attr = f.attr),
near AS (SELECT *, c / (b - c) AS j FROM met WHERE c / (b - c) >= 1 / 3),
turn AS (SELECT *, array_to_string(list_concat(fw[i:], fw[:i - 1]), '') AS o FROM (SELECT *, unnest(range(1, len(fw) + 1)) AS i FROM near)),
diff AS (SELECT attr, value, vt, ft, canon_id, j, min(CASE WHEN levenshtein(vt, o) = 2 AND list_sort(string_split(vt, '')) = list_sort(string_split(o, '')) THEN 1 ELSE levenshtein(vt, o) END) / greatest(length(vt), length(ft)) AS share FROM turn GROUP BY attr, value, vt, ft, canon_id, j),
best AS (SELECT attr, value, CASE WHEN share <= 0.25 AND (regexp_replace(ft, '\P{N}', '', 'g') = '' OR regexp_replace(ft, '\P{N}', '', 'g') = regexp_replace(vt, '\P{N}', '', 'g')) THEN canon_id ELSE -1 END AS canon_id
         FROM diff QUALIFY row_number() OVER (PARTITION BY attr, value ORDER BY j DESC, share, canon_id) = 1)
SELECT t.item_id, t.attr, {value}coalesce(b.canon_id, -1) AS canon_id FROM typed t LEFT JOIN best b ON t.attr = b.attr AND t.value = b.value
"""

P8_SQL = """
WITH g AS (SELECT doc_id, p, md5(substr(text, p, 300)) AS h FROM documents, LATERAL (SELECT unnest(range(1, length(text) - 298)) AS p) WHERE length(text) >= 300),
s AS (SELECT h FROM g GROUP BY 1 HAVING min(doc_id) <> max(doc_id)), k AS (SELECT doc_id, p - 1 AS lo, p + 299 AS hi FROM g WHERE h IN (SELECT h FROM s)),
b AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY doc_id ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS starts FROM k),
r AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY lo) AS run FROM b),
sp AS (SELECT doc_id, min(lo) AS span_from, max(hi) AS span_to FROM r GROUP BY doc_id, run)
"""

ORACLE = {
    "p5_values": P5_SQL.replace("{value}", "t.value, "),
    "p5_found": P5_SQL.replace("{value}", "") + " WHERE NOT EXISTS (SELECT 1 FROM canon_ref c WHERE c.attr = t.attr AND c.canonical = t.value)",
    "p3_found": P3_SQL,
    "p3_consistent": f"SELECT review_id, {_p3_form('title')} AS title, {_p3_form('text')} AS text FROM review",
    "p6_found": P6_SQL,
    "p8_found": P8_SQL + "SELECT doc_id, span_from, span_to FROM sp",
    "p8_shares": P8_SQL + """SELECT d.doc_id, length(text) AS n_chars, coalesce(sum(span_to - span_from), 0) AS n_shared, count(span_to) AS n_spans,
CASE WHEN length(text) > 0 THEN round(coalesce(sum(span_to - span_from), 0) / length(text), 6) ELSE 0.0 END AS share FROM documents d LEFT JOIN sp ON d.doc_id = sp.doc_id GROUP BY d.doc_id, text""",
    "p4_found": P4_SQL + "SELECT g.first_id, b.id AS copy_id FROM bare b JOIN g ON b.u = g.u AND b.a = g.a AND b.t = g.t WHERE b.id <> g.first_id",
    "p4_records": P4_SQL + "SELECT first_id, n_copies, collided FROM n",
}
