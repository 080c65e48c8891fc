"""Values typed by hand mapped to the entries of a reference list, by a prefix-filtered set-similarity join.

A value's tokens are the pairs of letters of its words, so neither order nor separators of the words matter. Words that
sellers add to whatever name are told from the data: they stand beside the whole name of several entries. Tokens are
ordered by how rare they are in values and reference together; two values can only reach the wanted Jaccard similarity
if their prefixes of rare tokens meet, so only those are joined. Length and position of the meeting tokens rule out most
pairs, Jaccard is then computed exactly, and the pair with the highest is kept. It is the entry meant unless more letters
differ than typing explains.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cuts import cut
from ..operators.skew import HOT_PARTS, attach_groups

#: Jaccard similarity of letter pairs that a candidate must reach.
SIMILARITY = 1 / 3
#: Letters that may differ, as a share of the longer form, for the most similar candidate to be taken. Two letters that
#: only changed places count as one.
MAX_DIFFERING = 0.25
#: A word that stands beside the whole name of so many entries, and in no entry of the attribute, was added.
ADDED_TO = 3
#: Parts that the values with a hot token are spread over.
SALTS = 32

#: Accented Latin letters and their base letter, by rule from the Unicode data.
_ACCENTED = {c: b for c in map(chr, range(0xC0, 0x250)) if (b := unicodedata.normalize("NFD", c)[0]) != c and b.isascii()}


def words(value: Column) -> Column:
    """The value's words, runs of letters and digits: lower case, no accents."""
    flat = F.translate(value, "".join(_ACCENTED), "".join(_ACCENTED.values()))
    flat = F.regexp_replace(F.lower(flat), r"\p{M}+", "")
    return F.filter(F.split(F.regexp_replace(flat, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def letter_pairs(ws: Column) -> Column:
    """Distinct pairs of neighbouring letters of each word, its edges counting as a letter."""
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("_"), w, F.lit("_")), i, F.lit(2)))
    return F.array_distinct(F.flatten(F.transform(ws, pairs)))


def turned(ws: Column) -> Column:
    """The words written together, starting at each of them in turn."""
    n = F.size(ws)
    start = lambda i: F.array_join(F.concat(F.slice(ws, i, n), F.slice(ws, F.lit(1), i - 1)), "")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), start)).otherwise(F.array().cast("array<string>"))


def differing(a: Column, b: Column) -> Column:
    """Edit distance of two words, 1 where only two letters changed places."""
    letters = lambda x: F.array_sort(F.split(x, ""))
    d = F.levenshtein(a, b)
    return F.when((d == 2) & (letters(a) == letters(b)), F.lit(1)).otherwise(d)


def object_values(df: DataFrame, key: str, details: str, attrs: list[str]) -> DataFrame:
    """(key, attr, value) of the wanted attributes of JSON objects kept as text.

    Keys compare trimmed, in lower case and without trailing colons; of several spellings in one object the first
    non-blank one counts. Null, cut-off and other text than an object gives no row, nor does a null or blank value.
    """
    text = F.regexp_replace(details, r"^\s+|\s+$", "")
    whole = df.filter(text.rlike(r"(?s)^\{.*\}$")).select(F.col(key), F.from_json(F.col(details), "map<string,string>", {"allowSingleQuotes": "false"}).alias("m"))
    spelt = lambda k: F.regexp_replace(F.lower(F.regexp_replace(k, r"(?U)^[\s]+|[\s:]+$", "")), r"\s+", " ")
    entries = F.filter(F.map_entries("m"), lambda e: (F.length(F.regexp_replace(F.coalesce(e["value"], F.lit("")), r"(?U)\s+", "")) > 0))
    named = whole.select(key, F.transform(entries, lambda e: F.struct(spelt(e["key"]).alias("k"), e["value"].alias("v"))).alias("kv"))

    def first(attr: str) -> Column:
        return F.struct(F.lit(attr).alias("attr"), F.get(F.filter("kv", lambda e: e["k"] == attr), F.lit(0))["v"].alias("value"))

    each = F.explode(F.array(*map(first, attrs))).alias("x")
    return named.select(key, each).select(key, "x.attr", "x.value").filter("value is not null")


def added_words(values: DataFrame, forms: DataFrame) -> DataFrame:
    """(attr, word) of the words that are added to names: with the word taken away, values are the whole name of ADDED_TO
    or more entries, and no name of the attribute has the word.

    `values`: attr, ws; `forms`: attr, canon_id, ws. Values longer than the longest name and a word are not looked at.
    """
    as_set = lambda: F.array_sort(F.array_distinct("ws"))
    longest = forms.agg(F.coalesce(F.max(F.size(F.array_distinct("ws"))), F.lit(0)).alias("longest"))
    sets = values.select("attr", as_set().alias("s")).crossJoin(F.broadcast(longest)).filter("size(s) between 2 and longest + 1").select("attr", "s").distinct()
    without = sets.select("attr", F.explode("s").alias("word"), "s").withColumn("name", F.array_join(F.array_except("s", F.array("word")), " "))
    names = forms.select("attr", "canon_id", F.array_join(as_set(), " ").alias("name")).filter("name <> ''").distinct()
    beside = without.join(names, ["attr", "name"]).groupBy("attr", "word").agg(F.countDistinct("canon_id").alias("n")).filter(F.col("n") >= ADDED_TO)
    own = forms.select("attr", F.explode("ws").alias("word")).distinct()
    return beside.select("attr", "word").join(own, ["attr", "word"], "left_anti")


def _without_added(values: DataFrame, added: DataFrame) -> DataFrame:
    """`values` (attr, value, ws) with the added words left out of ws, unless nothing else is there."""
    each = values.select("attr", "value", F.posexplode("ws").alias("at", "word")).join(added, ["attr", "word"], "left_anti")
    kept = each.groupBy("attr", "value").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("kept"))
    return values.join(kept, ["attr", "value"], "left").select("attr", "value", F.coalesce(F.transform("kept", lambda k: k["word"]), F.col("ws")).alias("ws"))


def _ordered(sets: DataFrame, rarity: DataFrame) -> DataFrame:
    """(side, id, attr, n, tokens from rare to frequent) of token sets."""
    t = sets.select("side", "id", "attr", F.explode("tokens").alias("token")).join(rarity, ["attr", "token"])
    by_rarity = F.array_sort(F.collect_list(F.struct("freq", "token")))
    return t.groupBy("side", "id", "attr").agg(F.transform(by_rarity, lambda s: s["token"]).alias("tokens")).withColumn("n", F.size("tokens"))


def similar_pairs(values: DataFrame, reference: DataFrame, least: float) -> DataFrame:
    """(value_id, ref_id, jaccard) of all pairs of an attribute with Jaccard similarity of at least `least`.

    Both sides: id, attr, tokens (distinct strings). Sets without a token match nothing. No pair is lost: a set's prefix
    of n - ceil(least * n) + 1 rarest tokens meets the other's whenever the similarity is reached.
    """
    both = values.select(F.lit("v").alias("side"), "id", "attr", "tokens").unionByName(reference.select(F.lit("r").alias("side"), "id", "attr", "tokens"))
    rarity = both.select("attr", F.explode("tokens").alias("token")).groupBy("attr", "token").agg(F.count(F.lit(1)).alias("freq"))
    sets = _ordered(both, rarity)
    reach = lambda n: F.ceil(n * F.lit(least) - F.lit(1e-9))
    prefix = sets.select("side", "id", "attr", "n", F.posexplode(F.slice("tokens", F.lit(1), (F.col("n") - reach(F.col("n")) + 1).cast("int"))).alias("pos", "token"))
    v = prefix.filter("side = 'v'").select(F.col("id").alias("value_id"), "attr", "token", F.col("n").alias("vn"), F.col("pos").alias("vp"))
    r = prefix.filter("side = 'r'").select(F.col("id").alias("ref_id"), "attr", "token", F.col("n").alias("rn"), F.col("pos").alias("rp"))
    lengths = (F.col("vn") >= F.col("rn") * F.lit(least) - 1e-9) & (F.col("rn") >= F.col("vn") * F.lit(least) - 1e-9)
    # a token that many values have in their prefix is spread over several tasks, with the reference's side repeated
    sizes = v.groupBy("attr", "token").agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"))
    hot = sizes.crossJoin(F.broadcast(total)).filter(F.col("_n") * HOT_PARTS >= F.col("_total")).select("attr", "token", F.lit(SALTS).alias("_salts"))
    salts = lambda: F.coalesce("_salts", F.lit(1))
    few = F.broadcast(hot)  # at most HOT_PARTS tokens
    v = v.join(few, ["attr", "token"], "left").withColumn("_salt", F.pmod(F.xxhash64("value_id"), salts()).cast("int")).drop("_salts")
    r = r.join(few, ["attr", "token"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts() - 1))).drop("_salts")
    met = v.join(r, ["attr", "token", "_salt"]).filter(lengths)
    pairs = met.groupBy("value_id", "ref_id", "vn", "rn").agg(F.count(F.lit(1)).alias("common"), F.max("vp").alias("vp"), F.max("rp").alias("rp"))
    most = F.col("common") + F.least(F.col("vn") - F.col("vp"), F.col("rn") - F.col("rp")) - 1
    need = F.ceil((F.col("vn") + F.col("rn")) * F.lit(least / (1 + least)) - F.lit(1e-9))
    # the sets themselves are fetched for the pairs that are left only
    left = pairs.filter(most >= need).join(values.select(F.col("id").alias("value_id"), F.col("tokens").alias("vt")), "value_id").join(reference.select(F.col("id").alias("ref_id"), F.col("tokens").alias("rt")), "ref_id")
    shared = F.size(F.array_intersect("vt", "rt"))
    return left.withColumn("jaccard", shared / (F.col("vn") + F.col("rn") - shared)).filter(F.col("jaccard") >= least).select("value_id", "ref_id", "jaccard")


def reference_forms(ref: DataFrame) -> DataFrame:
    """(canon_id, attr, form) of each entry: its canonical name and its aliases."""
    forms = F.explode(F.array_union(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form")
    return ref.select("canon_id", "attr", forms).filter("form is not null")


def digits(ws: Column) -> Column:
    return F.regexp_replace(F.array_join(ws, ""), r"[^\p{N}]+", "")


def best_entries(values: DataFrame, ref: DataFrame, least: float = SIMILARITY, max_differing: float = MAX_DIFFERING) -> DataFrame:
    """`values` (attr, value; distinct) with canon_id, -1 where no entry is meant, jaccard and differing letters.

    The entry with the highest Jaccard similarity is kept; of equal ones that with fewest differing letters, then the
    smallest canon_id. It is meant if at most `max_differing` of the letters differ, and if the value has the digits of a
    name that has some. Values without a word are unmatched, and so are all values of an attribute without entries.
    """
    v = cut(values.select("attr", "value", words(F.col("value")).alias("ws")), "typed-words")
    forms = reference_forms(ref).select("canon_id", "attr", words(F.col("form")).alias("ws"))
    v = _without_added(v, added_words(v, forms)).withColumn("plain", F.array_join("ws", " "))
    v = cut(v.withColumn("id", F.concat_ws("\x1f", "attr", "plain")), "plain-words")
    asked = v.filter("plain <> ''").groupBy("id", "attr").agg(F.first("ws").alias("ws")).withColumn("tokens", letter_pairs(F.col("ws")))
    r = forms.withColumn("id", F.concat_ws("\x1f", "attr", F.array_join("ws", " "), F.col("canon_id").cast("string")))
    r = r.groupBy("id", "attr", "canon_id").agg(F.first("ws").alias("rws")).withColumn("tokens", letter_pairs(F.col("rws")))
    pairs = similar_pairs(asked, r, least)
    scored = pairs.join(asked.select(F.col("id").alias("value_id"), "ws"), "value_id").join(r.select(F.col("id").alias("ref_id"), "canon_id", "rws"), "ref_id")
    typed = F.array_join("ws", "")
    differ = F.array_min(F.transform(turned(F.col("rws")), lambda f: differing(typed, f)))
    share = differ / F.greatest(F.length(typed), F.length(F.array_join("rws", "")), F.lit(1))
    meant = (share <= max_differing) & ((digits(F.col("rws")) == "") | (digits(F.col("rws")) == digits(F.col("ws"))))
    scored = scored.select("value_id", (-F.col("jaccard")).alias("far"), share.alias("share"), "canon_id", meant.alias("meant"))
    best = scored.groupBy("value_id").agg(F.min(F.struct("far", "share", "canon_id", "meant")).alias("b"))
    found = best.select(F.col("value_id").alias("id"), F.when(F.col("b.meant"), F.col("b.canon_id")).alias("canon_id"), (-F.col("b.far")).alias("jaccard"), F.col("b.share").alias("share"))
    return v.select("attr", "value", "id").join(found, "id", "left").select("attr", "value", F.coalesce("canon_id", F.lit(-1).cast("long")).alias("canon_id"), "jaccard", "share")


def map_values(rows: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    """(key, attr, value, canon_id) of every row: its attr's entry, -1 where the list has none.

    Distinct values are matched once, however many rows hold them. Rows of an attribute the list doesn't have are
    unmatched; rows without a value or an attribute have nothing to map and don't come out.
    """
    rows = cut(rows.select(key, "attr", "value"), "typed")
    groups = rows.groupBy("attr", "value").agg(F.count(F.lit(1)).alias("n_rows"))
    matched = best_entries(groups.select("attr", "value"), ref)
    groups = cut(groups.join(matched.select("attr", "value", "canon_id"), ["attr", "value"]), "matched")
    return attach_groups(rows, groups, ["attr", "value"], "n_rows").select(key, "attr", "value", "canon_id")
