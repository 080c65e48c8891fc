"""Records that are the same but for spacing, letter case, punctuation, the characters used or the order of their fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cuts import cut
from ..operators.skew import attach_groups
from . import forms

FIELDS = ("user_id", "asin", "text")


def _one_case(value: Column) -> Column:
    """Going over upper case makes letters equal whose case pairs meet only there, such as the dotless i. The step between
    the two also keeps the optimizer from taking the lower case of the upper case for the lower case."""
    return F.lower(F.translate(F.upper(F.coalesce(value, F.lit(""))), "İ", "I"))


def bare(value: Column) -> Column:
    """Letters and digits of a value without regard to case; null counts as empty."""
    return F.regexp_replace(_one_case(value), r"[^\p{L}\p{N}]+", "")


def spaced(value: Column) -> Column:
    """Words and numbers of a value without regard to case, one space between them; null counts as empty.

    A point, comma, colon, slash or hyphen between two digits stays, so 1.5 is neither 15 nor 1 5. Marks on letters stay.
    """
    kept = F.regexp_replace(_one_case(value), r"(?<=\p{N})([.,:/\-])(?=\p{N})", "\x01$1\x01")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r"(?<!\x01)[^\p{L}\p{M}\p{N}\x01]+(?!\x01)", " "), "\x01", ""))


def signs(value: Column) -> Column:
    """A value without letters and digits: its signs, with one space for any white space."""
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " "))


def parsed_lines(df: DataFrame, line_id: str, payload: str) -> DataFrame:
    """Records (id, user_id, asin, text) of JSON lines, whatever the order of their fields; incomplete lines give none.

    A complete line is one JSON object. Null lines, other JSON and lines with an object cut off give no record.
    """
    read = F.from_json(F.col(payload), ", ".join(f"{f} string" for f in FIELDS) + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    whole = F.trim(F.regexp_replace(payload, r"[\r\n\t]", " ")).rlike(r"(?s)^\{.*\}$")
    return df.filter(whole).select(F.col(line_id).alias("id"), read.alias("r")).filter("r is not null and r._broken is null").select("id", *[f"r.{f}" for f in FIELDS])


def consistent(records: DataFrame) -> DataFrame:
    """The records with every field in its consistent characters: widths, accents, spaces, look-alikes."""
    return forms.with_consistent_form(records.select("id", *FIELDS), {f: f for f in FIELDS})


def fingerprints(records: DataFrame, form: Callable[[Column], Column] = bare) -> DataFrame:
    """(id, print, check, worded) of every record; worded: its text has a letter or digit.

    `print` is a 128-bit hash of the fields in the form, `check` an independent 64-bit one, and both look at whether there
    are words: texts of signs only compare by their signs. Null and empty texts are equal.
    """
    text = form(F.col("text"))
    c = records.select("id", form(F.col("user_id")).alias("user_id"), form(F.col("asin")).alias("asin"), text.alias("text"), F.col("text").alias("_raw"))
    worded = F.col("text") != ""
    whole = [F.col("user_id"), F.col("asin"), F.when(worded, F.col("text")).otherwise(signs(F.col("_raw"))), worded.cast("string")]
    return c.select("id", F.unhex(F.md5(F.concat_ws("\x1f", *whole))).alias("print"), F.xxhash64(*whole).alias("check"), worded.alias("worded"))


def copy_groups(prints: DataFrame, least: int = 1) -> DataFrame:
    """One row per group of `least` or more: print, check, first_id (the smallest), n_copies, worded and collided.

    Counts are combined before the shuffle, by print alone, and written once. A print with different checks is a collision:
    where there is one, its records are counted again by print and check, so they are kept apart, and `collided` tells.
    `prints` may be read twice: pass a written table.
    """
    figures = [F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"), F.max("worded").alias("worded")]
    by_print = cut(prints.groupBy("print").agg(F.min("check").alias("check"), F.max("check").alias("_last"), *figures).filter(F.col("n_copies") >= least), "copy-groups")
    collided = by_print.filter(F.col("check") != F.col("_last")).select("print")
    one = by_print.filter(F.col("check") == F.col("_last")).drop("_last").withColumn("collided", F.lit(False))
    if collided.isEmpty():
        return one
    apart = prints.join(collided, "print").groupBy("print", "check").agg(*figures).filter(F.col("n_copies") >= least)
    return one.unionByName(apart.withColumn("collided", F.lit(True)))


def counted(records: DataFrame, form: Callable[[Column], Column] = bare) -> DataFrame:
    """(first_id, n_copies, collided) of every group of records that are the same in the form; an empty table gives none."""
    return copy_groups(cut(fingerprints(records, form), "prints")).select("first_id", "n_copies", "collided")


def copies(records: DataFrame, form: Callable[[Column], Column] = bare) -> DataFrame:
    """(first_id, copy_id): each record of a group but its first, whatever the group's size.

    Records whose text has no letter or digit are no copies of each other.
    """
    prints = cut(fingerprints(records, form), "prints").filter("worded")
    groups = copy_groups(prints, 2).select("print", "check", "first_id", "n_copies")
    return attach_groups(prints, groups, ["print", "check"], "n_copies").filter("id <> first_id").select("first_id", F.col("id").alias("copy_id"))
