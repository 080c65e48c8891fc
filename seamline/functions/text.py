"""Labels read from review text: fit, buyer and size pairs, as column expressions.

Matching is done on a folded text: lower case, white space squashed, letters outside ASCII replaced by one letter that no
pattern names, other such characters by a sign that none names. Patterns then mean the same in every regex dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

#: White space as text comparisons see it, for Java and for RE2.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
OUTSIDE_DIGIT, OUTSIDE_WORD, OUTSIDE = r"[^\x00-\x7F\P{Nd}]", r"[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]", r"[^\x00-\x7F]"
BUCKETS = list(P.FIT)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it and wherever the result is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squash(text: Column) -> Column:
    """The text with each run of white space as one space, none at its ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def blob(title: Column, text: Column) -> Column:
    """Title and text in lower case and squashed; null counts as empty."""
    return squash(F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))))


def folded(text: Column) -> Column:
    """The text as patterns see it; plain ASCII text is left alone."""
    return let(text, _folded)


def _folded(text: Column) -> Column:
    ascii_ = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, OUTSIDE_DIGIT, "9"), OUTSIDE_WORD, "q"), OUTSIDE, "~")
    return F.when(text.rlike(OUTSIDE), ascii_).otherwise(text)


def _one_branch(pattern: str) -> bool:
    depth, k = 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "|" and not depth:
            return False
        k += 1
    return True


def any_of(patterns: list[str]) -> str:
    """One pattern for all. Where all start at a word's edge, the edge is tested once per place, before any of them."""
    if all(p.startswith(r"\b") and _one_branch(p) for p in patterns):
        return r"\b(?:" + "|".join(p[2:] for p in patterns) + ")"
    return "|".join(f"(?:{p})" for p in patterns)


def bucket_hit(text: Column, bucket: str) -> Column:
    """Whether a bucket's pattern is in a folded text and no veto is."""
    return text.rlike(any_of(P.FIT[bucket])) & ~text.rlike(any_of(P.VETOES[bucket]))


def label_of(title: Column, text: Column) -> Column:
    """The fit label of a review."""
    return let(folded(blob(title, text)), fit_label)


def fit_label(text: Column) -> Column:
    """The bucket of a folded text if exactly one is hit, `ambiguous` for several, `none` for none."""
    code = sum((bucket_hit(text, b).cast("int") * (1 << k) for k, b in enumerate(BUCKETS)), F.lit(1))
    of = [[b for k, b in enumerate(BUCKETS) if bits >> k & 1] for bits in range(1 << len(BUCKETS))]
    return F.element_at(F.array(*[F.lit(x[0] if len(x) == 1 else "ambiguous" if x else "none") for x in of]), code)


def first_pattern(text: Column, bucket: str) -> Column:
    """Number of the first of the bucket's patterns that is in a folded text, null where a veto is or none matches."""
    first = F.when(~bucket_hit(text, bucket), F.lit(None))
    for k, p in enumerate(P.FIT[bucket]):
        first = first.when(text.rlike(p), k)
    return first


def pattern_hits(text: Column) -> Column:
    """Array of (bucket, pattern number) of the buckets that a folded text hits."""
    each = [F.struct(F.lit(b).alias("bucket"), first_pattern(text, b).cast("int").alias("pattern")) for b in BUCKETS]
    return F.filter(F.array(*each), lambda h: h["pattern"].isNotNull())


def score(label: Column) -> Column:
    """-1, 0 or 1 for a bucket, null for other labels."""
    s = F.lit(None).cast("double")
    for b, v in P.SCORES.items():
        s = F.when(label == b, F.lit(v)).otherwise(s)
    return s


def is_advice(bucket: Column, pattern: Column) -> Column:
    """Whether a bucket's pattern is advice on which size to order."""
    hit = F.lit(False)
    for b, ps in P.FIT.items():
        hit = hit | ((bucket == b) & pattern.isin([k for k, p in enumerate(ps) if p in P.ADVICE]))
    return F.coalesce(hit, F.lit(False))


def buyer_flags(text: Column, garment_gender: Column | None = None) -> Column:
    """Struct third_party, cross_gender, stated_gender, stated_mismatch, suspect of a folded text."""
    third, cross = text.rlike(any_of(P.THIRD_PARTY)), text.rlike(any_of(P.CROSS_GENDER))
    woman, man = text.rlike(any_of(P.SELF_WOMAN)), text.rlike(any_of(P.SELF_MAN))
    stated = F.when(woman & ~man, "women").when(man & ~woman, "men")
    other = F.lit(False) if garment_gender is None else F.coalesce(garment_gender.isin("men", "women") & (stated != garment_gender), F.lit(False))
    return F.struct(third.alias("third_party"), cross.alias("cross_gender"), stated.alias("stated_gender"), other.alias("stated_mismatch"), (third | cross | other).alias("suspect"))


def own_purchase(text: Column) -> Column:
    """Nothing in a folded text says that another person wears it."""
    return ~(text.rlike(any_of(P.THIRD_PARTY)) | text.rlike(any_of(P.CROSS_GENDER)))


#: Longest spellings first, so that none hides a longer one.
SIZE = "(" + "|".join(re.escape(s) for s in sorted(P.TEXT_LADDER, key=len, reverse=True)) + ")"


def sized(pattern: str) -> str:
    return pattern.replace("{size}", SIZE).replace("{no}", P.NOT_A_SIZE)


def _steps(text: Column, patterns: list[str]) -> Column:
    ladder = F.create_map(*[F.lit(x) for kv in P.TEXT_LADDER.items() for x in kv])
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(sized(p)), F.lit(1)) for p in patterns]))
    return F.array_distinct(F.transform(found, lambda s: F.element_at(ladder, s)))


def size_pair(text: Column) -> Column:
    """Struct usual, bought, deviation of a folded text, null unless each names exactly one step of the letter ladder
    and no number size or choice of sizes is in the text."""
    first = lambda steps: F.get(steps, F.lit(0))

    def pair(s: Column) -> Column:
        u, b = s["usual"], s["bought"]
        clear = (F.size(u) == 1) & (F.size(b) == 1) & ~text.rlike(P.NUMBER_SIZE) & ~text.rlike(sized(P.EITHER_SIZE))
        return F.when(clear, F.struct(first(u).alias("usual"), first(b).alias("bought"), (first(b) - first(u)).alias("deviation")))

    return let(F.struct(_steps(text, P.USUAL).alias("usual"), _steps(text, P.BOUGHT).alias("bought")), pair)


def talks_size(text: Column) -> Column:
    """The text has one of the words without which no size pair is looked for."""
    return text.contains(P.SIZE_TALK[0]) | text.contains(P.SIZE_TALK[1]) | text.contains(P.SIZE_TALK[2])


def snippet(title: Column, text: Column, pattern: Column, width: int = 110) -> Column:
    """The text around the first match of a pattern, `width` / 2 characters to each side; the text's start without one."""
    whole = squash(F.concat(F.coalesce(title, F.lit("")), F.lit(" || "), F.coalesce(text, F.lit(""))))
    low = F.lower(whole)
    at = F.regexp_instr(low, pattern)
    n = F.length(F.regexp_substr(low, pattern))
    start = F.greatest(at - 1 - width // 2, F.lit(0))
    end = F.least(at - 1 + n + width // 2, F.length(whole))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(whole, start + 1, end - start), F.when(end < F.length(whole), "...").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(whole, 1, width))


def review_hash(user: Column, asin: Column, stamp: Column) -> Column:
    """16 hex digits that stand for a review; a null field is written None."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.substring(F.sha2(F.concat(part(user), F.lit("|"), part(asin), F.lit("|"), part(stamp)), 256), 1, 16)


def epoch_year(value: Column) -> Column:
    """UTC year of seconds or, beyond 1e11, milliseconds; null for what is no number."""
    v = value.try_cast("double")
    seconds = F.when(v > 1e11, v / 1000).otherwise(v)
    return F.when(seconds.between(-62135596800, 253402300799), F.year(F.timestamp_seconds(F.floor(seconds))))


def uniform(text: Column) -> Column:
    """A number in [0, 1) that depends on the text alone, the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
