"""Gender, body half and garment class read from category paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import squash


def segments(categories: Column) -> Column:
    """The path's segments in lower case and squashed; null and empty entries don't count, a null path is empty."""
    some = F.filter(F.coalesce(categories, F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != ""))
    return F.transform(some, lambda c: F.lower(squash(c)))


def garment_segments(segs: Column) -> Column:
    """Segments that aren't roots of the tree, in order, repeats kept."""
    return F.filter(segs, lambda s: ~s.isin(P.ROOTS))


def gender(path: Column) -> Column:
    """Whom a joined path is for; children come before everything else."""
    men, women = path.rlike(P.MEN), path.rlike(P.WOMEN)
    return F.when(path.rlike(P.CHILD), "children_excluded").when(men & women, "ambiguous").when(men, "men").when(women, "women").when(path.rlike(P.UNISEX), "unisex").otherwise("unknown")


def leaf_first(segs: Column, rules: dict[str, str]) -> Column:
    """The rule of the last segment that exactly one rule matches, null if there is none."""

    def one(seg: Column) -> Column:
        hit = {name: seg.rlike(p) for name, p in rules.items()}
        n = sum((h.cast("int") for h in hit.values()), F.lit(0))
        found = F.when(n != 1, F.lit(None).cast("string"))
        for name, h in hit.items():
            found = found.when(h, name)
        return found

    return F.get(F.filter(F.transform(F.reverse(segs), one), lambda x: x.isNotNull()), F.lit(0))


def half(garment: Column) -> Column:
    """upper, lower, excluded or unknown."""
    return F.coalesce(leaf_first(garment, P.HALF), F.lit("unknown"))


def gradient(garment: Column) -> Column:
    """tshirt, shirt or jeans_trousers of the last segment naming exactly one; null for excluded halves and without one."""

    def one(seg: Column) -> Column:
        jeans, tee = seg.rlike(P.GRADIENT_JEANS), seg.rlike(P.GRADIENT_TEE)
        shirt = F.regexp_replace(seg, P.GRADIENT_TEE_STRIP, " ").rlike(P.GRADIENT_SHIRT)
        n = jeans.cast("int") + tee.cast("int") + shirt.cast("int")
        return F.when(n != 1, F.lit(None).cast("string")).when(jeans, "jeans_trousers").when(tee, "tshirt").otherwise("shirt")

    first = F.get(F.filter(F.transform(F.reverse(garment), one), lambda x: x.isNotNull()), F.lit(0))
    return F.when(half(garment) != "excluded", first)


def in_scope(gender_: Column, half_: Column) -> Column:
    return gender_.isin("men", "women") & half_.isin("upper", "lower")


def corpus_half(corpus: Column, category: Column) -> Column:
    """Body half of a category of the two fit corpora, unknown where it names none."""
    closet = F.lit("unknown")
    for name, h in P.CORPUS_HALF["closet"].items():
        closet = F.when(category == name, h).otherwise(closet)
    rentals = F.lit("unknown")
    for h, names in P.CORPUS_HALF["rentals"].items():
        rentals = F.when(category.isin(names), h).otherwise(rentals)
    return F.when(corpus == "closet", closet).when(corpus == "rentals", rentals).otherwise("unknown")


def retail_scope(has_block: Column, gender_: Column, category: Column) -> Column:
    """Why a shop's page is left out, or `keep`. Null and empty fields are missing; values compare as they are written."""
    g, c = F.coalesce(gender_, F.lit("")), F.coalesce(category, F.lit(""))
    wanted = [name for names in P.RETAIL_HALF.values() for name in names]
    return (
        F.when(~F.coalesce(has_block, F.lit(False)), "no-metadata-block")
        .when(g == "", "missing-gender")
        .when(~g.isin(P.RETAIL_ADULTS), F.concat(F.lit("non-adult-gender:"), g))
        .when(c == "", "missing-category")
        .when(~c.isin(wanted), F.concat(F.lit("off-category:"), c))
        .otherwise("keep")
    )


def retail_half(category: Column) -> Column:
    """upper, lower or other of a shop's category."""
    out = F.lit("other")
    for h, names in P.RETAIL_HALF.items():
        out = F.when(category.isin(names), h).otherwise(out)
    return out
