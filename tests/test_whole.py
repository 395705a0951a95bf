"""Queries go over every row that can be asked for, not over some of them."""

import pytest

from tomeline.operators import lexical, selection
from tomeline.plans import probe_queries, search_queries  # noqa: F401  register theirs
from tomeline.plans.queries import QUERIES

LOGGED = [(1, "where is the mill and who owns the boat"), (2, "The boat, who owns it and where is the MILL?"), (3, None), (20, "reed pond"), (20, "reed pond"), (41, "zzz"), (None, "mill")]
PAGES = [("a", "# Mill\nThe mill of the old village."), ("b", "# Boat\nA boat that the miller owns."), ("b", "# Boat\nA boat that the miller owns."), ("c", "# Pond\nThe reed by the pond."), ("d", None), (None, "mill boat")]


@pytest.fixture
def logged(spark, tmp_path):
    """A log where one query of four has an id divisible by 20, and pages."""
    spark.createDataFrame(LOGGED, "id long, query string").write.parquet(str(tmp_path / "trajectories.parquet"))
    spark.createDataFrame(PAGES, "page_id string, markdown string").write.parquet(str(tmp_path / "pages.parquet"))
    return str(tmp_path)


def test_bm25_topk_answers_every_logged_query(spark, logged):
    got = QUERIES["bm25_topk"](spark, logged).collect()
    assert sorted({(r["qid"], r["page_id"]) for r in got}) == [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "c"), (20, "c")]
    assert len(got) == 7


def test_bm25_gives_questions_of_the_same_words_the_same_list(spark):
    docs = spark.createDataFrame([("a", "mill boat"), ("b", "pond reed mill"), ("c", "boat boat")], "id string, body string")
    asked = spark.createDataFrame([(1, "mill boat"), (2, "Boat: the mill"), (3, "the mill boat"), (4, " ; ")], "qid long, query string")
    lists = {}
    for r in lexical.bm25(asked, docs, "id", "body", 3).orderBy("rank").collect():
        lists.setdefault(r["qid"], []).append((r["doc"], r["score"], r["rank"]))
    assert set(lists) == {1, 2, 3} and lists[1] == lists[2] == lists[3]
    assert [x[2] for x in lists[1]] == [1, 2, 3] and lists[1][0][0] == "a"


def test_coverage_map_goes_over_the_parts_of_every_logged_query(spark, logged):
    got = {tuple(r) for r in QUERIES["coverage_map"](spark, logged).collect()}
    assert got == {(1, 1, "b"), (2, 0, "b"), (20, 0, "c")}


def test_parts_keep_their_figures(spark):
    asked = spark.createDataFrame([(1, "boat 10 and 17 mills 1")], "qid long, query string")
    assert [(r["part"], r["words"]) for r in selection.question_parts(asked).orderBy("part").collect()] == [(0, ["boat", "10"]), (1, ["17", "mills"])]


def test_relevant_section_titles_go_over_every_logged_query(spark, logged):
    sections = [("a", 1, "Mill", "The mill of the old village."), ("b", 1, "Boat", "A boat that the miller owns."), ("c", 1, "Pond", "The reed by the pond.")]
    spark.createDataFrame(sections, "page_id string, ord int, title string, body string").write.parquet(logged + "/sections.parquet")
    got = {(r["qid"], r["page_id"], r["title"]) for r in QUERIES["relevant_section_titles"](spark, logged).collect()}
    assert got == {(1, "a", "Mill"), (1, "b", "Boat"), (2, "a", "Mill"), (2, "b", "Boat"), (20, "c", "Pond")}


def test_set_cover_goes_over_every_logged_query(spark, logged):
    got = {tuple(r) for r in QUERIES["set_cover"](spark, logged).collect()}
    assert got == {(1, "b", 1), (2, "b", 1), (20, "c", 1)}


def test_question_passages_go_over_every_logged_query(spark, logged):
    got = {(r["qid"], r["page_id"], r["passage"]) for r in QUERIES["question_passages"](spark, logged).collect()}
    mill, boat, pond = ("a", "The mill of the old village."), ("b", "A boat that the miller owns."), ("c", "The reed by the pond.")
    assert got == {(q, *x) for q in (1, 2) for x in (mill, boat)} | {(20, *pond)}


def test_leave_intent_out_page_recall_asks_every_question(spark, tmp_path):
    axis = lambda i: [1.0 if j == i else 0.1 for j in range(64)]
    rows = [(1, "a", 0), (2, "a", 0), (3, "a", 0), (4, "a", 5), (5, "b", 9), (6, "b", 9), (7, "b", 5), (8, "b", 9)]
    spark.createDataFrame([(i, "question", p, "x", axis(x)) for i, p, x in rows], "id long, kind string, page_id string, book_id string, embedding array<float>").write.parquet(str(tmp_path / "questions.parquet"))
    got = QUERIES["leave_intent_out_page_recall"](spark, str(tmp_path)).first()
    assert (got["n"], got["r1"], got["r3"]) == (8, 0.75, 1.0)  # only 4 and 7 lie nearest to the other page
