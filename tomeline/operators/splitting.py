"""Documents cut into pages along their headings, and the passages of a page that answer a question.

Null texts have no pages and no passages; the bodies of a text's pages, put together, are the text; a page stays longer
than the limit only where it has neither headings nor paragraphs to cut at, or is back matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeline.functions.text import BACK_MATTER, content_words
from tomeline.session import cut, shuffle_width

LIMIT, SLICE, LEAST = 8_000, 2_400, 40  # characters: of a page, of a slice without headings, below which a page joins the one before
LINE = re.compile(r"[^\n]*\n?")
FENCE = re.compile(r"\s*(?:```|~~~)")
HEADING = re.compile(r"(#{1,6})[ \t]+(\S.*)")
GAP = re.compile(r"\n[ \t]*\r?\n\s*")
BACK = re.compile(BACK_MATTER.replace("(?iu)", ""), re.I)

Piece = tuple[str, str]  # title, body


def _headings(text: str, title: str) -> list[tuple[int, int, str]]:
    """(offset, level, heading) outside code fences, without the document's own title and headings that are mere
    furniture (four times or more and two fifths of their level)."""
    found, at, inside = [], 0, False
    for line in LINE.findall(text):
        if FENCE.match(line):
            inside = not inside
        elif not inside and (m := HEADING.match(line)):
            found.append((at, len(m[1]), m[2].strip().rstrip("#").strip(" *_`")))
        at += len(line)
    level, repeat = Counter(h[1] for h in found), Counter(h[1:] for h in found)
    return [h for h in found if h[2] != title and not (repeat[h[1:]] >= 4 and repeat[h[1:]] >= 0.4 * level[h[1]])]


def _by_size(title: str, body: str) -> list[Piece]:
    cuts, last = [0], 0
    for m in GAP.finditer(body):
        if m.end() - last >= SLICE and m.end() < len(body):
            cuts.append(last := m.end())
    slices = [body[a:b] for a, b in zip(cuts, [*cuts[1:], len(body)])]
    return [(title, body)] if len(slices) < 2 else [(f"{title} ({i}/{len(slices)})", s) for i, s in enumerate(slices, 1)]


def _cut(title: str, body: str, whole: bool) -> list[Piece]:
    if BACK.match(title) or not whole and len(body) <= LIMIT:
        return [(title, body)]
    heads = [h for h in _headings(body, title) if whole or h[0] > 0]
    counts = Counter(level for _, level, _ in heads)
    if not heads:
        return _by_size(title, body) if len(body) > LIMIT else [(title, body)]
    level = min((n for n, c in counts.items() if c >= 2), default=min(counts))
    at = [h for h in heads if h[1] == level]
    pieces = [(title, body[: at[0][0]])] if at[0][0] else []
    pieces += [(h[2], body[h[0] : end]) for h, end in zip(at, [*(h[0] for h in at[1:]), len(body)])]
    return [p for t, b in pieces for p in _cut(t, b, False)]


def split_text(title: str, text: str, whole: bool) -> list[tuple[str, str, bool]]:
    """(title, body, indexable) of the pages of a text."""
    out: list[Piece] = []
    for t, b in _cut(title, text, whole):
        if out and len(b) < LEAST and not BACK.match(t) and not BACK.match(out[-1][0]):
            out[-1] = (out[-1][0], out[-1][1] + b)
        else:
            out.append((t, b))
    return [(t, b, not BACK.match(t)) for t, b in out]


def split_pages(df: DataFrame, key: str, title: str, text: str, whole: bool) -> DataFrame:
    """key, ord, title, body, indexable. whole: cut at the topmost headings even a text within the limit (a document);
    otherwise only texts beyond the limit are cut (an existing page). Works row by row, without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, *p) for k, t, x in zip(b["k"], b["t"], b["x"]) for i, p in enumerate(split_text(t, x, whole))]
            yield pd.DataFrame(rows, columns=[key, "ord", "title", "body", "indexable"])

    source = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.coalesce(F.col(title), F.lit("")).alias("t"), F.col(text).alias("x"))
    return source.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, ord long, title string, body string, indexable boolean")


def passages(questions: DataFrame, candidates: DataFrame, k: int = 3, alike: float = 0.7, least: int = 12, pages: DataFrame | None = None) -> DataFrame:
    """qid, page_id, place, passage: the k lines of each candidate page that hold most words of the question, in the order
    of hits and then of the text; a line too much like one already taken (shared share of words) is passed over.

    questions(qid, query), candidates(qid, page_id) with pages(page_id, markdown), or candidates(qid, page_id, markdown).
    Headings and lines under least characters are no passages. The lines of pages are cut into words once a page and written;
    questions go to the page in even parts and its lines are weighed within the row, so neither texts nor lines follow the
    question through a shuffle."""
    asked = questions.select("qid", content_words(F.col("query")).alias("need")).where(F.size("need") > 0).groupBy("qid").agg(F.collect_list("need").alias("needs"))
    met = candidates.join(asked, "qid")
    lines = F.transform(F.split("markdown", r"\s*\n\s*|(?<=[.!?。])\s+"), lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    lines = F.filter(lines, lambda x: (F.length(x["line"]) >= least) & ~x["line"].rlike(r"^#{1,6} "))
    worded = F.transform(lines, lambda x: F.struct(x["i"].alias("i"), x["line"].alias("line"), content_words(x["line"]).alias("words")))
    if pages is not None:
        text = cut(pages.where("markdown is not null").select("page_id", worded.alias("lines")), "lines")
        met = met.repartition(shuffle_width(met.sparkSession), "page_id").join(text, "page_id")
    else:
        met = met.where("markdown is not null").select("qid", "page_id", "needs", worded.alias("lines"))
    hits = F.flatten(F.transform("needs", lambda need: F.transform("lines", lambda x: F.struct((-F.size(F.array_intersect(x["words"], need))).alias("h"), x["i"].alias("i"), x["line"].alias("line"), x["words"].alias("words")))))
    ordered = met.select("qid", "page_id", F.array_sort(F.filter(hits, lambda x: x["h"] < 0)).alias("l"))
    near = lambda a, b: F.size(F.array_intersect(a["words"], b["words"])) >= alike * F.size(F.array_union(a["words"], b["words"]))
    empty = F.expr("cast(array() as array<struct<h:int,i:int,line:string,words:array<string>>>)")
    kept = F.aggregate("l", empty, lambda acc, x: F.when((F.size(acc) < k) & ~F.exists(acc, lambda y: near(x, y)), F.concat(acc, F.array(x))).otherwise(acc))
    return ordered.select("qid", "page_id", F.posexplode(kept).alias("place", "p")).select("qid", "page_id", (F.col("place") + 1).cast("long").alias("place"), F.col("p.line").alias("passage"))
