"""Sections of pages, coverage of question parts and greedy covers.

Null texts have no sections and no words; repeated rows count once; empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeline.functions.text import content_words

# Words that join the parts of a question.
PART_BREAK = r"(?iu)\s*(?:[;?—]|\b(?:and|or|but|versus|vs|as well as)\b|(?<=\s)(?:còn|và|hoặc)(?=\s))\s*"


def heading_sections(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, ord, title, body: a page cut before each heading that lies outside a code fence; what precedes the first
    heading is section 0 with the title (opening). Pages are exploded to lines and numbered by running sums."""
    lines = pages.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("i", "line"))
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    marked = lines.withColumn("inside", F.sum(fence.cast("int")).over(w) % 2 == 1)
    heading = ~F.col("inside") & F.col("line").rlike(r"^#{1,6} \S")
    numbered = marked.withColumns({"heading": heading, "ord": F.sum(heading.cast("int")).over(w)})
    title = F.max(F.when(F.col("heading"), F.trim(F.regexp_replace("line", r"^#+ |\s+#+\s*$", ""))))
    out = numbered.groupBy(key, "ord").agg(F.coalesce(title, F.lit("(opening)")).alias("title"), F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"))
    return out.select(key, "ord", "title", F.array_join(F.col("l.line"), "\n").alias("body")).where("ord > 0 or trim(body) <> ''")


def question_parts(queries: DataFrame, query: str = "query") -> DataFrame:
    """qid, part, words: parts with at least two content words; the whole question if none has."""
    parts = F.filter(F.transform(F.split(query, PART_BREAK), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    exploded = queries.select("qid", F.col(query).alias("q"), F.posexplode_outer(parts).alias("part", "t")).withColumn("words", content_words(F.col("t")))
    good = exploded.where(F.size("words") >= 2).select("qid", "part", "words")
    whole = queries.join(good.select("qid"), "qid", "left_anti").select("qid", F.lit(0).alias("part"), content_words(F.col(query)).alias("words"))
    return good.unionByName(whole.where(F.size("words") > 0))


def coverage(parts: DataFrame, candidates: DataFrame) -> DataFrame:
    """qid, part, page_id: candidate pages (qid, page_id, words) holding at least half of the words of a part."""
    joined = parts.join(candidates.withColumnRenamed("words", "has"), "qid")
    return joined.where(2 * F.size(F.array_intersect("words", "has")) >= F.size("words")).select("qid", "part", "page_id")


def covered_pages(parts: DataFrame, ranks: DataFrame, pages: DataFrame) -> DataFrame:
    """coverage() of ranks(qid, page_id) and pages(page_id, words): the parts go to the pages, so the words of a page are
    not carried along with each question that ranks it."""
    met = parts.join(ranks.select("qid", "page_id"), "qid").join(pages.select("page_id", F.col("words").alias("has")), "page_id")
    return met.where(2 * F.size(F.array_intersect("words", "has")) >= F.size("words")).select("qid", "part", "page_id")


def greedy_cover(covered: DataFrame, ranks: DataFrame, steps: int = 3) -> DataFrame:
    """qid, page_id, step: each step takes the page that covers most parts still open; ties go to the better rank."""
    taken, open_parts = None, covered
    for step in range(1, steps + 1):
        gain = open_parts.groupBy("qid", "page_id").agg(F.count("*").alias("gain")).join(ranks, ["qid", "page_id"])
        best = gain.groupBy("qid").agg(F.min_by("page_id", F.struct(-F.col("gain"), "rank")).alias("page_id")).withColumn("step", F.lit(step).cast("long"))
        taken = best if taken is None else taken.unionByName(best)
        closed = open_parts.join(best.select("qid", "page_id"), ["qid", "page_id"], "left_semi").select("qid", "part")
        open_parts = open_parts.join(closed, ["qid", "part"], "left_anti")
    return taken
