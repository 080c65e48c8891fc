"""Sizes typed into an item's details, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import let, squash


def details_map(details: Column) -> Column:
    """The entries of a details object kept as JSON text, null for anything else."""
    whole = F.regexp_replace(details, r"^\s+|\s+$", "").rlike(r"(?s)^\{.*\}$")
    return F.when(whole, F.from_json(details, "map<string,string>", {"allowSingleQuotes": "false"}))


def flat_keys(details: Column) -> Column:
    """(key, value) of a details map with keys squashed, in lower case and without trailing colons.

    Of keys that are equal then the first one's place and the last one's value count.
    """
    flat = lambda k: F.rtrim(F.lower(squash(k)), F.lit(":"))
    all_ = F.transform(F.map_entries(details), lambda e: F.struct(flat(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(all_, lambda e: e["key"]))
    return F.transform(names, lambda n: F.struct(n.alias("key"), F.element_at(F.filter(all_, lambda e: e["key"] == n), -1)["value"].alias("value")))


def size_entry(flat: Column) -> Column:
    """Struct rule, key, value of the size entry: the key `size`, else the first that names size and isn't excluded."""
    strict = F.get(F.filter(flat, lambda e: e["key"] == "size"), F.lit(0))
    loose = F.get(F.filter(flat, lambda e: e["key"].rlike(P.SIZE_KEY) & ~e["key"].rlike(P.NO_SIZE_KEY)), F.lit(0))
    as_ = lambda e, rule: F.struct(F.lit(rule).alias("rule"), e["key"].alias("key"), e["value"].alias("value"))
    return F.when(strict.isNotNull(), as_(strict, "strict")).when(loose.isNotNull(), as_(loose, "loose"))


def normal_size(raw: Column) -> Column:
    """Struct size, reason: the size if it can be told without guessing, and which way it was told or why not."""
    return let(F.struct(raw.alias("raw"), F.lower(squash(raw)).alias("value")), lambda x: let(_candidate(x["value"]), lambda c: _told(x["raw"], x["value"], c)))


def _candidate(value: Column) -> Column:
    """The value without a gloss in brackets at its end and without signs around it."""
    stripped = F.trim(F.regexp_replace(value, r"\s*\([^)]*\)\s*$", ""))
    return F.btrim(F.when(stripped != "", stripped).otherwise(value), F.lit(" .,-/"))


def _told(raw: Column, value: Column, cand: Column) -> Column:
    ladder = F.create_map(*[F.lit(x) for kv in P.ITEM_LADDER.items() for x in kv])
    tails = [F.when(cand.startswith(p), F.element_at(ladder, F.trim(F.substring(cand, len(p) + 1, 1000)))) for p in P.SIZE_PREFIXES]
    waist = F.concat(F.lit("W"), F.regexp_extract(cand, P.WAIST_INSEAM, 1), F.lit("xL"), F.regexp_extract(cand, P.WAIST_INSEAM, 2))
    number = F.concat(F.lit("NUM"), F.regexp_extract(cand, P.PLAIN_NUMERIC, 1))
    of = lambda size, reason: F.struct(size.cast("string").alias("size"), F.lit(reason).alias("reason"))
    none = F.lit(None)
    return let(
        F.coalesce(F.element_at(ladder, cand), *tails),
        lambda alpha: F.when(raw.isNull(), of(none, "absent")).when(value == "", of(none, "empty")).when(cand.rlike(P.ONE_SIZE), of(none, "one_size"))
        .when(alpha.isNotNull(), of(alpha, "alpha")).when(cand.rlike(P.WAIST_INSEAM), of(waist, "waist_inseam"))
        .when(cand.rlike(P.PLAIN_NUMERIC), of(number, "numeric")).otherwise(of(none, "unmapped")),
    )
