"""Text expressions shared by the operators, all of built-in functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_WORD = r"[^\p{L}\p{N}_]+"
# Words without content, English and Vietnamese.
STOP_WORDS = ("the", "a", "an", "of", "to", "in", "on", "for", "and", "or", "is", "are", "was", "be", "do", "does", "how", "what", "which", "who", "when", "where", "why", "can", "may", "it", "with", "from", "by", "at", "as", "là", "và", "của", "có", "không", "cho", "các", "những", "một", "thì", "khi", "nào", "gì", "ở", "được", "trong", "với")
# Headings of back matter.
BACK_MATTER = r"(?iu)^\s*(?:\d+(?:\.\d+)*\.?\s+)?(?:references|bibliography|works cited|acknowledge?ments|tài liệu tham khảo|lời cảm ơn)\s*$"


def _folding() -> dict[int, str]:
    """Letters that are one letter with marks, and what they fold to; marks alone fold to nothing."""
    out = {ord("đ"): "d"}
    for code in range(0xC0, 0xFFFF):
        c = chr(code)
        if unicodedata.combining(c):
            out[code] = ""
        elif (plain := "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))) != c and len(plain) == 1:
            out[code] = plain
    return out


FOLDING = _folding()
_KEPT = sorted(c for c in FOLDING if FOLDING[c])
# Arguments of translate; letters beyond the end of the second are dropped.
FOLDED = ("".join(map(chr, _KEPT)) + "".join(chr(c) for c in FOLDING if not FOLDING[c]), "".join(FOLDING[c] for c in _KEPT))


def fold(col: Column) -> Column:
    """Small letters without marks; đ becomes d, ß becomes ss."""
    low = F.lower(col)
    return F.when(low.rlike(r"[^\x00-\x7f]"), F.translate(F.replace(low, F.lit("ß"), F.lit("ss")), *FOLDED)).otherwise(low)


def tokens(col: Column) -> Column:
    """Folded words longer than one letter, repeats kept."""
    return F.filter(F.split(fold(col), NON_WORD), lambda t: F.length(t) > 1)


def content_words(col: Column) -> Column:
    """Distinct words of two letters or more that are no stop words."""
    words = F.filter(F.split(F.lower(col), NON_WORD), lambda t: F.length(t) > 1)
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in STOP_WORDS]))


def token_estimate(col: Column) -> Column:
    return F.floor(F.length(col) / 4)


def slug(col: Column) -> Column:
    s = F.regexp_replace(F.lower(F.regexp_replace(fold(col), "[^a-zA-Z0-9]+", "-")), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, 60), "-+$", "")
    return F.when(s == "", "untitled").otherwise(s)


def one_line(col: Column, cap: int = 120) -> Column:
    """The first sentence of a text without its first heading, blanks joined, cut to the cap."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(col, r"^\s*#{1,6} [^\n]*\n?", ""), r"\s+", " "))
    return F.substring(F.regexp_extract(bare, r"^(.*?[.!?。](?= |$)|.*)", 1), 1, cap)


def figures(col: Column) -> Column:
    """Numbers of a text, each with its unit; single digits without unit are left out."""
    found = F.regexp_extract_all(col, F.lit(r"([0-9]+(?:[.,][0-9]+)*(?: ?(?:%|kg|g|km|cm|mm|m|h|min))?)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: F.length(x) > 1))


def grams(col: Column, n: int = 12) -> Column:
    """The runs of n characters of a text; none if it is shorter."""
    return F.when(F.length(col) >= n, F.transform(F.sequence(F.lit(1), F.length(col) - n + 1), lambda i: F.substr(col, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
