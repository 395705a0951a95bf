"""Language of a text: script first, then naive Bayes over letter groups, fitted on labelled documents.

The fit uses at most FIT_ROWS labelled rows for each language, a documented bound; letters lose their marks first, so
that text typed without them keeps its language.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeline.functions.text import FOLDING

FIT_ROWS = 300
LATIN = ("en", "vi", "de", "fr", "es")
# A script that settles the language.
SCRIPTS = (("ja", regex.compile(r"[\p{Hiragana}\p{Katakana}]")), ("ko", regex.compile(r"\p{Hangul}")), ("zh", regex.compile(r"\p{Han}")), ("th", regex.compile(r"\p{Thai}")), ("hi", regex.compile(r"\p{Devanagari}")), ("ar", regex.compile(r"\p{Arabic}")), ("ru", regex.compile(r"\p{Cyrillic}")), ("latin", regex.compile(r"\p{Latin}")))
BEYOND_LATIN = regex.compile(r"[^\u0000-\u024f\u0300-\u036f\u1e00-\u1eff\u2000-\u206f\u20a0-\u20cf\u2200-\u22ff\u2700-\u27bf]")
# Latin text without combining marks or fraction and superscript digits: there [^\W\d_] is \p{L}, which the faster module knows.
LATIN_TEXT = re.compile(r"[\x00-\x7f\xa0\xab\xbb\xbf-\u024f\u1e00-\u1eff\u2010-\u2027\u2030-\u205e]*\Z")
LETTERS = regex.compile(r"[\p{L}\p{M}]+")


@lru_cache(maxsize=200_000)
def fold_word(word: str) -> str:
    return fold(word)


def fold(text: str) -> str:
    return text.lower() if text.isascii() else text.lower().replace("ß", "ss").translate(FOLDING)


def features(text: str) -> Counter:
    out: Counter = Counter()
    for word in LETTERS.findall(fold(text)):
        out[f" {word} "] += 1
        w = f" {word} "
        for i in range(len(w) - 2):
            out[w[i : i + 3]] += 1
    return out


def script_of(text: str) -> tuple[str | None, float]:
    """The script most letters are in, and its share; kana make the Chinese characters beside them Japanese."""
    counts = {name: len(p.findall(text)) for name, p in SCRIPTS}
    if counts["ja"] * 6 >= counts["zh"]:
        counts["ja"] += counts.pop("zh") if counts["ja"] else 0
    counts = {k: v * (2.5 if k in ("ja", "zh", "ko") else 1) for k, v in counts.items()}
    total = sum(counts.values())
    if not total:
        return None, 0.0
    best = max(counts, key=counts.get)
    return best, counts[best] / total


def fit(documents: DataFrame) -> Weights:
    """Log weights of letter groups for the languages in Latin letters, from documents(text, lang)."""
    label = F.regexp_extract(F.lower(F.trim("lang")), r"^([a-z]{2})(?:[-_].*)?$", 1)
    rows = documents.select(label.alias("lang"), "text", F.xxhash64("text").alias("h")).where(F.col("lang").isin(*LATIN) & (F.length("text") > 40))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= FIT_ROWS)
    counts = {lang: Counter() for lang in LATIN}
    for row in rows.select("lang", "text").toLocalIterator():
        if script_of(row["text"])[0] == "latin":
            counts[row["lang"]].update(features(row["text"]))
    known = {f for lang in LATIN for f, n in counts[lang].items() if n >= 2}
    weights = Weights()
    totals = {lang: sum(counts[lang].values()) + 0.5 * len(known) + 1 for lang in LATIN}
    for f in known:
        weights[f] = tuple(math.log((counts[lang][f] + 0.5) / totals[lang]) for lang in LATIN)
    return weights


class Weights(dict):
    """Log weights of a fit, with the summed weights of words already met: they come again and again."""

    def __init__(self, *args) -> None:
        super().__init__(*args)
        self.scores: dict[str, tuple[int, tuple[float, ...]]] = {}

    def __reduce__(self):
        return Weights, (dict(self),)

    def of(self, word: str) -> tuple[int, tuple[float, ...]]:
        """Known features of a word and their summed weights."""
        got = self.scores.get(word)
        if got is None:
            score, n = [0.0] * len(LATIN), 0
            for f, c in features(word).items():
                w = self.get(f)
                if w:
                    n += c
                    for i in range(len(LATIN)):
                        score[i] += c * w[i]
            if len(self.scores) > 200_000:
                self.scores.clear()
            got = self.scores[word] = (n, tuple(score))
        return got


def detect(text: str, weights: Weights) -> tuple[str | None, float]:
    """(language, margin per feature); no language for texts without letters or with an even mixture."""
    script, share = script_of(text) if BEYOND_LATIN.search(text) else (("latin", 1.0) if any(map(str.isalpha, text)) else (None, 0.0))
    if script is None or share < 0.5:
        return None, 0.0
    if script != "latin":
        return script, share
    score, n = [0.0] * len(LATIN), 0
    for word in LETTERS.findall(text):
        known, parts = weights.of(word)
        n += known
        for i in range(len(LATIN)):
            score[i] += parts[i]
    if not n:
        return None, 0.0
    order = sorted(range(len(LATIN)), key=lambda i: -score[i])
    return LATIN[order[0]], (score[order[0]] - score[order[1]]) / n
