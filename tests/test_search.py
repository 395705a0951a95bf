"""Search inside candidates, resolution, ordering in time and reports on hand-made cases."""

import random

from pyspark.sql import functions as F

from tomeline.functions import text as T
from tomeline.operators import lexical, metrics, resolve, retrieval
from tomeline.streaming import log


def rows(df):
    return sorted(tuple(r) for r in df.collect())


SECTIONS = [("p", 0, "Rent", "The rent of the mill is due in May."), ("p", 1, "Boats", "Boats lie by\n  the old mill  \nall day. Mill!"), ("p", 2, " ", "mill rent boats"), ("p", 3, "Rent", None), ("q", 0, "Gone", "Nothing here")]


def sections(spark):
    return spark.createDataFrame(SECTIONS, "page_id string, ord int, title string, body string")


def test_relevant_and_picked_sections(spark):
    asked = spark.createDataFrame([(1, "When is the mill rent due?"), (2, None), (3, "zzz qqq")], "qid long, query string")
    pages = spark.createDataFrame([(1, "p"), (1, "q"), (2, "p"), (3, "p")], "qid long, page_id string")
    found = resolve.relevant_sections(asked, pages, sections(spark), 2)
    assert rows(found) == [(1, "p", 0, "Rent", 1), (1, "p", 1, "Boats", 2)]
    wanted = spark.createDataFrame([(1, "p", " BOATS"), (3, "p", "no such title")], "qid long, page_id string, title string")
    picked = resolve.picked_sections(pages, wanted, sections(spark), budget=9)
    assert [(r["qid"], r["page_id"], r["ord"]) for r in picked.orderBy("qid", "page_id", "ord").collect()] == [(1, "p", 1), (1, "q", 0), (2, "p", 0), (3, "p", 0)]


def test_lines_in_candidates(spark):
    patterns = spark.createDataFrame([(1, "MILL"), (2, " "), (3, None), (4, "m.ll")], "qid long, pattern string")
    pages = spark.createDataFrame([(q, "p", 1) for q in (1, 2, 3, 4)], "qid long, page_id string, rank int")
    got = resolve.find_in_candidates(patterns, pages, sections(spark), limit=2)
    assert rows(got) == [(1, "p", 0, "The rent of the mill is due in May.", 1), (1, "p", 1, "the old mill", 2)]


def test_closest_titles_and_paths(spark):
    titles = spark.createDataFrame([("The Mill",), ("The Millpond",), ("Boats",), (None,), ("",)], "title string")
    asked = spark.createDataFrame([("the mill",), ("The Mil",), ("Bouts",), ("xyz",), (None,)], "asked string")
    assert rows(resolve.closest_titles(asked, titles)) == [("bouts", "boats", 0.8), ("the mil", "the mill", 0.95), ("the mill", "the mill", 1.0)]
    paths = spark.createDataFrame([("Home ▸ Water ▸ Mill",), ("Home ▸ Mill",), (None,)], "path string")
    asked = spark.createDataFrame([('"Water ▸ Mill"',), ("Far ▸ Mill",), ("Home",), (None,)], "asked string")
    assert rows(resolve.closest_paths(asked, paths)) == [("far ▸ mill", "home ▸ mill"), ("water ▸ mill", "home ▸ mill")]


def test_buckets_equal_the_rule(spark):
    for n in (1, 2, 5, 8, 9, 30):
        df = spark.range(n).select(F.col("id"), F.timestamp_seconds(F.when(F.col("id") % 7 < 6, F.col("id") * 40_000)).alias("t"))
        got = {r["id"]: (r["idx"], r["b"]) for r in resolve.placed_in_time(df, "t", "id").withColumn("b", resolve.bucket()).collect()}
        order = sorted(range(n), key=lambda i: (i % 7 < 6, i * 40_000 if i % 7 < 6 else 0, i))
        parts = min(8, n)
        for idx, i in enumerate(order):
            want = None if n < 2 else max(b for b in range(parts) if b * n // parts <= idx)
            assert got[i] == (idx, want)


def test_conformal_threshold_over_ranges(spark):
    random.seed(4)
    values = [round(random.random(), 4) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "required double")
    for alpha in (0.1, 0.25, 0.9):
        at = -(-(len(values) + 1) * (1 - alpha) // 1)
        assert retrieval.conformal_threshold(df, alpha).first()[0] == sorted(values)[int(at) - 1]
    assert retrieval.conformal_threshold(df.limit(0), 0.1).first()[0] == float("inf")


def test_stratified_sample_of_a_hot_kind(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") < 3900, "hot").when(F.col("id") < 3999, "cold").alias("kind"))
    got = dict(rows(metrics.stratified(df.where("kind is not null"), "kind", "id", 40, 7).groupBy("kind").count()))
    assert got == {"hot": 39, "cold": 1}


def test_a_word_that_stands_everywhere_is_scored_in_slices(spark):
    docs = spark.createDataFrame([(f"d{i}", "mill " * (i % 3 + 1) + f"word{i}") for i in range(50)] + [("e", None), ("f", "")], "id string, body string")
    asked = spark.createDataFrame([(1, "mill word7"), (2, None), (3, "nowhere")], "qid long, query string")
    got = lexical.bm25(asked, docs, "id", "body", 100)
    assert got.count() == 50 and got.orderBy("rank").first()["doc"] == "d7"
    assert lexical.corpus_stats(lexical.postings(docs, "id", "body")).first()["n_docs"] == 52


def test_one_line_ends_with_the_first_sentence(spark):
    df = spark.createDataFrame([("# Head\nFirst one. Second",), ("no stop here",), ("",), (None,)], "a string")
    assert [r[0] for r in df.select(T.one_line(F.col("a"))).collect()] == ["First one.", "no stop here", "", None]


def test_folding_reaches_marks_of_their_own(spark):
    df = spark.createDataFrame([("Đầu Tư",), ("Straße",), ("été",), ("ÅNGSTRÖM",), (None,)], "a string")
    assert [r[0] for r in df.select(T.fold(F.col("a"))).collect()] == ["dau tu", "strasse", "ete", "angstrom", None]


def test_windows_of_the_log_over_several_batches(spark, tmp_path):
    day = 86_400
    for batch in ([(1, 0, "answered", 2), (2, 5, "not_found", 1)], [(3, 40 * day, "answered", 1)], [(4, day - 1, "answered", 7)]):
        df = spark.createDataFrame(batch, "id long, s long, status string, hops int").select("id", "status", "hops", F.timestamp_seconds("s").alias("created_at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "log.parquet"))
    got = log.run_windowed_status(spark, str(tmp_path / "log.parquet"), df.schema, files_per_trigger=1)
    assert rows(got.groupBy("status").agg(F.sum("queries"), F.sum("hops"))) == [("answered", 3, 10), ("not_found", 1, 1)]
