"""Search inside candidate pages, picks of named sections, and titles and paths resolved to what they resemble.

Null texts hold nothing; ties go to the earlier place and then the smaller name; empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeline.functions.text import content_words, token_estimate


def relevant_sections(questions: DataFrame, candidates: DataFrame, sections: DataFrame, k: int = 3) -> DataFrame:
    """qid, page_id, ord, title, place: the k titled sections of each candidate page that share most content words with
    the question, weighed within the row of question and page. questions(qid, query), candidates(qid, page_id), sections(page_id, ord, title, body)."""
    need = questions.select("qid", content_words(F.col("query")).alias("need")).where(F.size("need") > 0).groupBy("qid").agg(F.collect_list("need").alias("needs"))
    bodies = sections.where("trim(title) <> ''").select("page_id", F.struct("ord", "title", content_words(F.col("body")).alias("has")).alias("s")).groupBy("page_id").agg(F.collect_list("s").alias("sections"))
    shared = lambda need: F.transform("sections", lambda x: F.struct((-F.size(F.array_intersect(need, x["has"]))).alias("h"), x["ord"].alias("ord"), x["title"].alias("title")))
    met = candidates.join(need, "qid").join(bodies, "page_id").withColumn("hits", F.flatten(F.transform("needs", lambda need: shared(need))))
    best = met.select("qid", "page_id", F.slice(F.array_sort(F.filter("hits", lambda x: x["h"] < 0)), 1, k).alias("best"))
    return best.select("qid", "page_id", F.posexplode("best").alias("at", "b")).select("qid", "page_id", "b.ord", "b.title", (F.col("at") + 1).alias("place"))


def picked_sections(candidates: DataFrame, wanted: DataFrame, sections: DataFrame, budget: int = 4_000) -> DataFrame:
    """qid, page_id, ord, tokens: the sections of the wanted titles (any case) in the order of the page, up to the first
    that passes the budget, the first of all always; the whole page where no title fits.

    candidates(qid, page_id), wanted(qid, page_id, title), sections(page_id, ord, title, body)."""
    key = F.lower(F.trim("title"))
    parts = candidates.join(sections.where("body is not null").select("page_id", "ord", key.alias("key"), token_estimate(F.col("body")).alias("tokens")), "page_id")
    asked = wanted.select("qid", "page_id", key.alias("key")).where("key <> ''").distinct().withColumn("named", F.lit(True))
    marked = parts.join(asked, ["qid", "page_id", "key"], "left").withColumn("named", F.coalesce("named", F.lit(False)))
    page = Window.partitionBy("qid", "page_id")
    chosen = marked.withColumn("any", F.bool_or("named").over(page)).where("named or not any")
    w = page.orderBy("ord", "key").rowsBetween(Window.unboundedPreceding, 0)
    summed = chosen.withColumns({"upto": F.sum("tokens").over(w), "i": F.count("*").over(w)})
    return summed.where((F.col("i") == 1) | (F.col("upto") <= budget)).select("qid", "page_id", "ord", "tokens")


def find_in_candidates(patterns: DataFrame, candidates: DataFrame, sections: DataFrame, limit: int = 40) -> DataFrame:
    """qid, page_id, ord, line, place: for each section of a candidate page its first line (of three characters or more)
    that holds the literal pattern in any case; the first so many by rank of the page and order of the section.

    patterns(qid, pattern), candidates(qid, page_id, rank), sections(page_id, ord, body)."""
    asked = patterns.select("qid", F.lower("pattern").alias("p")).where("trim(p) <> ''")
    # a section's lines stay together until one is chosen, and only pages that are candidates are read
    hits = candidates.join(asked, "qid").join(sections.select("page_id", "ord", "body"), "page_id").where(F.contains(F.lower("body"), F.col("p")))
    lines = F.transform(F.split("body", "\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    found = hits.withColumn("line", F.try_element_at(F.filter(lines, lambda x: (F.length(x) >= 3) & F.contains(F.lower(x), F.col("p"))), F.lit(1))).where("line is not null")
    short = F.when(F.length("line") > 200, F.concat(F.rtrim(F.substring("line", 1, 199)), F.lit("…"))).otherwise(F.col("line"))
    w = Window.partitionBy("qid").orderBy("rank", "page_id", "ord", "line")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("qid", "page_id", "ord", short.alias("line"), "place")


def closest_titles(asked: DataFrame, titles: DataFrame, floor: float = 0.6) -> DataFrame:
    """asked, title, score: the title most like each asked one: 1 if equal, 0.95 if one begins with the other, else one
    less the share of edits; nothing below the floor. A stated set of asked titles meets all titles."""
    a = asked.select(F.lower(F.trim("asked")).alias("asked")).where("asked <> ''").distinct()
    t = titles.select(F.lower(F.trim("title")).alias("title")).where("title <> ''").distinct()
    # a title asked as it stands is found by equality, which nothing beats; only the others meet all titles
    same = a.join(t, a["asked"] == t["title"]).select("asked", "title", F.lit(1.0).alias("score"))
    a = a.join(t, a["asked"] == t["title"], "left_anti")
    longer = F.greatest(F.length("asked"), F.length("title"))
    # titles whose lengths alone put them below the floor never meet
    near = (F.least(F.length("asked"), F.length("title")) >= floor * longer) | F.startswith("title", "asked") | F.startswith("asked", "title")
    like = F.when(F.startswith("title", "asked") | F.startswith("asked", "title"), 0.95).otherwise(1 - F.levenshtein("asked", "title") / longer)
    met = a.join(t, near).withColumn("score", F.round(like, 6)).where(F.col("score") >= floor)
    closest = met.groupBy("asked").agg(F.min(F.struct((-F.col("score")).alias("m"), "title")).alias("b")).select("asked", "b.title", (-F.col("b.m")).alias("score"))
    return same.unionByName(closest)


def closest_paths(asked: DataFrame, paths: DataFrame, parting: str = " ▸ ") -> DataFrame:
    """asked, path: the first path that equals what was asked, ends with it, or whose leaf it ends with.

    All three are equalities of endings: every path is offered under each of its own endings at a title, and under its
    leaf to what ends with a title; no pair of strings is compared."""
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, parting))), lambda i: F.array_join(F.slice(F.split(c, parting), i, 1_000), parting))
    a = asked.select(F.lower(F.trim(F.regexp_replace(F.trim("asked"), '^"+|"+$', ""))).alias("asked")).where("asked <> ''").distinct()
    p = paths.select(F.lower("path").alias("path")).where("path <> ''").distinct()
    under = p.select("path", F.explode(ends(F.col("path"))).alias("end"))
    whole = a.join(under, a["asked"] == under["end"]).select("asked", "path")
    leaf = p.select("path", F.element_at(F.split("path", parting), -1).alias("end"))
    tail = a.select("asked", F.element_at(F.split("asked", parting), -1).alias("end")).join(leaf, "end").select("asked", "path")
    return whole.unionByName(tail).groupBy("asked").agg(F.min("path").alias("path"))


def placed_in_time(events: DataFrame, time: str, key: str) -> DataFrame:
    """events with idx (from 0) and n: the place of each in the order of time and key. Days are counted first, so that
    only the rows of one day are ordered together; rows without time come first."""
    day = F.coalesce(F.to_date(time).cast("string"), F.lit(""))
    days = events.groupBy(day.alias("day")).agg(F.count("*").alias("c"))
    before = days.withColumns({"before": F.sum("c").over(Window.orderBy("day")) - F.col("c"), "n": F.sum("c").over(Window.partitionBy())}).select("day", "before", "n")  # a row a day
    inside = F.row_number().over(Window.partitionBy("day").orderBy(F.asc_nulls_first(time), key))
    return events.withColumn("day", day).join(before, "day").withColumn("idx", F.col("before") + inside - 1).drop("day", "before")


def bucket(parts: int = 8):
    """The bucket (from 0) of place idx among n that are cut at floor(i * n / parts); none below two."""
    size = F.least(F.lit(parts).cast("long"), F.col("n"))
    guess = F.floor(F.col("idx") * size / F.col("n"))
    at = lambda i: F.floor(i * F.col("n") / size)
    return F.when(F.col("n") >= 2, F.when(at(guess + 1) <= F.col("idx"), guess + 1).when(at(guess) > F.col("idx"), guess - 1).otherwise(guess))
