"""One consistent form for text that looks the same but is written with different characters.

A transducer is compiled once from the Unicode data: a trie over code points that gives the longest match within a
grapheme cluster. One pass over the clusters of a text replaces widths, joined letter forms, accents apart from their
letter, spaces and invisible characters. Look-alikes, letters of another alphabet with or without an accent, are in the
same trie with a second form that holds inside Latin words only. They come from the Unicode confusables that the JVM's
ICU library has, and from a small fixed table of letters that only readers confuse.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters of other alphabets that look like a Latin letter. They hold without the Unicode confusables, too.
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Һ": "H",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d",
    "һ": "h", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ү": "y", "к": "k", "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j", "γ": "y",
    "τ": "t", "ε": "e", "η": "n", "ω": "w", "ά": "á", "έ": "é", "ί": "í", "ό": "ó", "ύ": "ú",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "Օ": "O", "Տ": "S",
}

# Invisible code points outside category Cf.
INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0]
# Code points of category Cf that are drawn.
DRAWN = [0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD]
#: Decompositions that only change a character's drawing.
DRAWING_TAGS = ("<wide>", "<narrow>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>")

#: Alphabets whose letters stand in for Latin ones.
ALPHABETS = ["Cyrillic", "Greek", "Armenian", "Cherokee", "Coptic", "Georgian", "Lisu"]

ZWNJ, ZWJ, VS15, VS16 = "‌", "‍", "︎", "️"


LATIN = "in a Latin word"
_alphabet = regex.compile("[" + "".join(rf"\p{{{a}}}" for a in ALPHABETS) + "]")
_is_latin = regex.compile(r"\p{Latin}")
_known: dict[str, dict[str, str]] = {}


class MappingConflict(ValueError):
    """Two rules give one sequence different forms, or a form would itself be rewritten."""


def rules() -> Iterable[tuple[str, str, str]]:
    """(rule, sequence, form) of every context-free rewriting, derived from the Unicode data of this Python."""
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Cs", "Co"):
            continue
        if kind == "Zs":
            yield "space", ch, " "
            continue
        if (kind == "Cf" and cp not in DRAWN) or cp in INVISIBLE or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or (kind == "Cc" and cp != 0x85):
            yield "invisible", ch, ""
            continue
        parts = unicodedata.decomposition(ch).split()
        if not parts:
            continue
        if parts[0] in DRAWING_TAGS:
            yield "width", ch, unicodedata.normalize("NFKC", ch)
        elif parts[0] == "<compat>" and kind[0] == "L":
            form = unicodedata.normalize("NFKC", ch)
            if len(form) > 1 and all(unicodedata.category(x)[0] in "LM" for x in form):
                yield "joined", ch, form
        elif parts[0][0] != "<":
            form = unicodedata.normalize("NFC", ch)
            if form != ch:  # such as the Kelvin sign
                yield "accent", ch, form
            if form == ch and len(parts) == 2:
                yield "accent", unicodedata.normalize("NFD", ch), ch
    for cp in (*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F):
        yield "invisible", chr(cp), ""


def confusables(spark: SparkSession) -> dict[str, str]:
    """Letters of ALPHABETS that have the same skeleton as a Latin letter in the Unicode confusables, and that letter, of
    the same case where both cases look alike. Empty where the JVM has no ICU library."""
    if "confusables" not in _known:
        letters = [ch for ch in map(chr, range(0x80, 0x20000)) if unicodedata.category(ch)[0] == "L" and _alphabet.match(ch)]
        latin = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B))]
        try:
            checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
            skeletons = checker.getSkeleton("\n".join(latin + letters)).split("\n")
        except Exception:  # noqa: BLE001 - another JVM may come without the library
            skeletons = []
        of_latin: dict[str, list[str]] = {}
        for ch, skeleton in zip(latin, skeletons, strict=False):
            of_latin.setdefault(skeleton, []).append(ch)
        _known["confusables"] = {
            ch: next((x for x in of_latin[sk] if x.isupper() != ch.islower()), of_latin[sk][0])
            for ch, sk in zip(letters, skeletons[len(latin) :], strict=False) if sk in of_latin
        }
    return _known["confusables"]


def look_alike_rules(table: dict[str, str]) -> Iterable[tuple[str, str, str]]:
    """(rule, sequence, form) of look-alikes, alone and with each accent that the Latin letter can bear, however it is
    spelled."""
    accents: dict[str, list[tuple[str, str]]] = {}
    for cp in range(0xC0, 0x1F00):
        parts = unicodedata.decomposition(chr(cp)).split()
        if len(parts) == 2 and parts[0][0] != "<" and (base := chr(int(parts[0], 16))).isascii():
            accents.setdefault(base, []).append((chr(int(parts[1], 16)), chr(cp)))
    for ch, latin in table.items():
        yield "look-alike", ch, latin
        for mark, whole in accents.get(latin, []):
            yield "look-alike", ch + mark, whole
            if len(one := unicodedata.normalize("NFC", ch + mark)) == 1 and one not in table:
                yield "look-alike", one, whole


def compile_trie(entries: Iterable[tuple[str, str, str]]) -> dict:
    """The trie of all sequences; a node's form is under the key "", its form inside a Latin word under LATIN.

    Raises MappingConflict where two rules give a sequence different forms, where a form would itself be rewritten, or
    where a look-alike is a Latin letter already.
    """
    forms: dict[str, dict[str, str]] = {"": {}, LATIN: {}}
    for rule, seq, form in entries:
        where = forms[LATIN if rule == "look-alike" else ""]
        if where.setdefault(seq, form) != form:
            raise MappingConflict(f"{rule}: {seq!r} becomes both {where[seq]!r} and {form!r}")
        if rule == "look-alike" and _is_latin.match(seq):
            raise MappingConflict(f"{seq!r} is Latin")
    for kind, where in forms.items():
        for seq, form in where.items():
            again = "".join(forms[""].get(x, forms[LATIN].get(x, x) if kind else x) for x in form)
            if again != form:
                raise MappingConflict(f"{seq!r} becomes {form!r}, which becomes {again!r}")
    trie: dict = {}
    for kind, where in forms.items():
        for seq, form in where.items():
            node = trie
            for ch in seq:
                node = node.setdefault(ch, {})
            node[kind] = form
    return trie


def clusterwise(cluster: str, trie: dict, latin: bool = False) -> str:
    """The cluster with every longest match replaced; look-alikes, too, inside a Latin word."""
    out, i, n = [], 0, len(cluster)
    while i < n:
        node, j, found, to = trie, i, None, i + 1
        while j < n and (node := node.get(cluster[j])) is not None:
            j += 1
            form = node.get(LATIN) if latin else None
            if form is None:
                form = node.get("")
            if form is not None:
                found, to = form, j
        out.append(cluster[i] if found is None else found)
        i = to
    return "".join(out)


class Transducer:
    """consistent(text) gives the text's one form; a text in that form comes back unchanged."""

    #: The code points that may need a look; the JVM tests it too, so it is written for both dialects.
    SUSPECT = r"[^\t\n\x0b\x0c\r\x20-\x7e]"

    def __init__(self, more: dict[str, str] | None = None):
        self.table = (more or {}) | LOOK_ALIKES
        self.trie = compile_trie([*rules(), *look_alike_rules(self.table)])
        # stretches of clusters that hold at least one suspect; plain text between them is never touched
        self.stretch = regex.compile(r"(?:[\p{L}\p{M}]|\p{Cf})*[^\t\n\x0b\x0c\r\x20-\x7e](?:[^\t\n\x0b\x0c\r\x20-\x7e]|[\p{L}\p{M}])*")
        self.cluster = regex.compile(r"\X")
        self.emoji = regex.compile(r"[\p{Extended_Pictographic}\p{Regional_Indicator}⃣]|[0-9#*]️")
        self.joined_script = regex.compile(r"[\p{Arabic}\p{Syriac}\p{Mongolian}\p{Nko}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Myanmar}\p{Tibetan}]")
        self.letter = regex.compile(r"[\p{L}\p{M}]")
        self.mark = regex.compile(r"\p{M}")
        self.latin = _is_latin
        self.other = regex.compile(rf"(?=\p{{L}}){_alphabet.pattern}")
        self.word = regex.compile(r"[\p{L}\p{M}]+")

    def _cluster(self, c: str, latin: bool = False) -> str:
        if len(c) == 1 and " " <= c <= "~":
            return c
        if self.emoji.search(c):
            tags = c[0] == "\U0001f3f4"  # flags spelled with tag characters
            kept = "".join(x for x in c if x in (ZWJ, VS15, VS16) or tags and "\U000e0020" <= x <= "\U000e007f" or self.trie.get(x, {}).get("") != "")
            return kept.rstrip(ZWJ)  # a joiner that joins nothing is no part of the emoji
        tail = ""
        if c[-1] in (ZWNJ, ZWJ) and self.joined_script.match(c):
            c, tail = c[:-1], c[-1]  # such joiners are spelling there
        done = clusterwise(c, self.trie, latin)
        if len(done) > 1:
            whole = unicodedata.normalize("NFC", done)  # marks in another order, or two on one letter
            done = whole
        return done + tail

    def _others(self, word: str) -> tuple[int, int]:
        """Letters that are Latin or look like it, none without a Latin one, and letters of other alphabets that don't."""
        others = self.other.findall(word)
        strange = sum(clusterwise(x, self.trie, True) == x for x in others)
        own = len(self.latin.findall(word))
        return (own + len(others) - strange if own else 0), strange

    def _in_latin_words(self, clusters: list[str]) -> list[bool]:
        """For each cluster whether it is part of a Latin word, one with at least twice as many letters that are or look
        Latin as others; invisible characters don't end a word. Replacing look-alikes doesn't change the figures."""
        belongs = lambda x: self.letter.match(x) or self.trie.get(x, {}).get("") == ""
        out, k = [False] * len(clusters), 0
        while k < len(clusters):
            to = k
            while to < len(clusters) and belongs(clusters[to][0]):
                to += 1
                if not all(map(belongs, clusters[to - 1])):
                    break  # such as a skin tone behind a letter
            if to > k:
                own, strange = self._others("".join(clusterwise(c, self.trie) for c in clusters[k:to]))
                out[k:to] = [own > 0 and own >= 2 * strange] * (to - k)
            k = max(to, k + 1)
        return out

    def _stretch(self, m) -> str:
        text = m.group()
        clusters = self.cluster.findall(text)
        latin = self._in_latin_words(clusters) if self.other.search(text) else [False] * len(clusters)
        done = "".join(map(self._cluster, clusters, latin))
        # a mark may have met its letter only now that what stood between them is gone
        return unicodedata.normalize("NFC", done) if self.mark.search(done) else done

    def unmapped(self, text: str | None) -> bool:
        """Whether a word with at least as many Latin letters holds one of another alphabet that has no look-alike."""
        return bool(text and self.other.search(text) and any(0 < strange <= own for own, strange in map(self._others, self.word.findall(text))))

    def consistent(self, text: str | None) -> str | None:
        """None stays None, an empty text empty."""
        if not text:
            return text
        return self.stretch.sub(self._stretch, text)


_made: dict[int, Transducer] = {}


def transducer(more: dict[str, str] | None = None) -> Transducer:
    """This process's compiled transducer for a table of further look-alikes."""
    key = hash(frozenset((more or {}).items()))
    if key not in _made:
        _made[key] = Transducer(more)
    return _made[key]


def with_consistent_form(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """`df` with one more column for each entry source -> result, holding the source's text in its consistent form.

    Null stays null and an empty text empty; texts without a suspect character never leave the JVM. Other columns stay
    as they are; a result column that is already there is replaced.
    """

    more = confusables(df.sparkSession)

    @F.pandas_udf("string")
    def form(s):
        return s.map(transducer(more).consistent, na_action="ignore")

    for source, result in columns.items():
        c = F.col(source)
        df = df.withColumn(result, F.coalesce(form(F.when(c.rlike(Transducer.SUSPECT), c)), c))
    return df


def changed_values(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, fld) of each text value that isn't in its consistent form, with the form. Nulls and empty texts are none.

    Values with a letter of another alphabet inside a Latin word come out in any case; one without a look-alike stays.
    """
    more = confusables(df.sparkSession)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("fld"), F.col(c).alias("value")) for c in columns])).alias("x")
    suspects = df.select(F.col(key), each).select(F.col(key).alias("key"), "x.fld", "x.value").filter(F.col("value").rlike(Transducer.SUSPECT))

    def changed(batches):
        for b in batches:
            old = b.column("value").to_pylist()
            one = transducer(more)
            new = [one.consistent(v) for v in old]
            found = [a != b or one.unmapped(b) for a, b in zip(old, new, strict=True)]
            yield b.append_column("form", pa.array(new, pa.string())).filter(pa.array(found, pa.bool_())).select(["key", "fld", "form"])

    kind = df.schema[key].dataType.simpleString()
    return suspects.mapInArrow(changed, f"key {kind}, fld string, form string").select(F.col("key").alias(key), "fld", "form")
