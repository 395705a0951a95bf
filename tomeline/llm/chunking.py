"""Splitting oversized items at natural boundaries.

A token is four characters, rounded down. Separators form a hierarchy: section, paragraph, sentence, word,
character; each level is tried on the stretch that the level above could not cut. Pieces are packed greedily to the
limit and each starts with exactly the last overlap of the piece before it, so dropping that overlap and joining
gives back the text.

Undefined cases: a null text has no size and is never split; a null key keeps its row; rows repeated with the same
key and text count once; an overlap above half the limit is lowered to half; an empty table gives no piece.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FENCE = re.compile(r"^[ \t]*(```|~~~)", re.M)
HEADING = re.compile(r"^#{1,6}[ \t]", re.M)
PARAGRAPH = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*")
SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？।])[”’」』）]*\s*|(?:\r\n|\r|\n)+")
WORD = re.compile(r"\s+")
LEVELS = ("section", "paragraph", "sentence", "word", "character", "end")
LEAST_FILL = 0.25  # a section or paragraph cut must fill this share of the room, else a lower level cuts later


def _section_starts(text: str) -> list[int]:
    fences = [m.start() for m in FENCE.finditer(text)]
    return [p for m in HEADING.finditer(text) if (p := m.start()) and bisect_right(fences, p) % 2 == 0]


def _cut(text: str, least: int, most: int, marks: list[list[int]], level: int = 0) -> tuple[int, int]:
    """The last boundary in (least, most] of the highest level that has one."""
    if level == len(marks):
        at = most
        while at > least + 1 and (unicodedata.combining(text[at]) or text[at] == "‍" or text[at - 1] == "‍" or (text[at - 1] == "\r" and text[at] == "\n")):
            at -= 1
        return at if at > least + 1 else most, level
    floor = least + (int(LEAST_FILL * (most - least)) if level < 2 else 0)
    k = bisect_right(marks[level], most)
    if k and marks[level][k - 1] > floor:
        return marks[level][k - 1], level
    return _cut(text, least, most, marks, level + 1)


def split_text(text: str, max_tokens: int, overlap_tokens: int) -> list[tuple[int, int, str]]:
    """(start, end, level of the cut) of each piece; one whole piece if the text fits."""
    room = 4 * max_tokens + 3
    overlap = min(4 * overlap_tokens, room // 2)
    if len(text) <= room:
        return [(0, len(text), "end")]
    marks = [_section_starts(text), [m.end() for m in PARAGRAPH.finditer(text)], [m.end() for m in SENTENCE.finditer(text)], [m.end() for m in WORD.finditer(text)]]
    out, start, done = [], 0, 0
    while len(text) - start > room:
        end, level = _cut(text, done, start + room, marks)
        out.append((start, end, LEVELS[level]))
        done, start = end, max(0, end - overlap)
    return [*out, (start, len(text), "end")]


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for src, key, text, most, overlap in zip(batch["src"], batch["item_key"], batch["text"], batch["max_tokens"], batch["overlap_tokens"], strict=True):
            for i, (a, b, level) in enumerate(split_text(text, int(most), int(overlap))):
                rows.append((src, key, i, a, b, (b - a) // 4, level, text[a:b]))
        yield pd.DataFrame(rows, columns=["src", "item_key", "piece", "start_pos", "end_pos", "tokens", "cut_at", "text"])


def split_oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """items(src, item_key, text), limits(item, max_tokens, overlap_tokens) -> the pieces of every item above its limit.

    limits has one row for each kind of item, so it is broadcast; texts shuffle only if they are oversized.
    """
    limit = F.broadcast(limits.select(F.col("item").alias("src"), "max_tokens", "overlap_tokens"))
    over = items.select("src", "item_key", "text").join(limit, "src").where(F.floor(F.length("text") / 4) > F.col("max_tokens"))
    once = over.withColumn("h", F.xxhash64("text")).dropDuplicates(["src", "item_key", "h"]).drop("h")
    return once.mapInPandas(_pieces, "src string, item_key string, piece int, start_pos int, end_pos int, tokens int, cut_at string, text string")
