"""Rows that queries shuffle: what grows with questions times pages must not be written."""

import pytest

from tomeline.operators import lexical, probes, resolve
from tomeline.plans.queries import QUERIES
from tomeline.plans import probe_queries, search_queries  # noqa: F401  register theirs

DATA = "/root/testdata/sf0.01"


def shuffled(spark, make):
    """Rows shuffled, by all stages, while a table is made and read."""
    sc = spark.sparkContext
    bus, store = sc._jsc.sc().listenerBus(), sc._jsc.sc().statusStore()

    def written():
        bus.waitUntilEmpty(10_000)
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    make().write.format("noop").mode("overwrite").save()
    return sum(n for stage, n in written().items() if stage not in before)


def test_bm25_shuffles_no_score_that_is_not_among_the_best(spark):
    docs = spark.createDataFrame([(f"d{i}", "mill boat " * (i % 5 + 1)) for i in range(400)], "id string, body string").coalesce(1)
    asked = spark.createDataFrame([(i, "mill boat") for i in range(100)], "qid long, query string")
    assert shuffled(spark, lambda: lexical.bm25(asked, docs, "id", "body", 3)) < 5_000  # of 40,000 scores


def test_bm25_counts_a_word_once_for_a_question_in_two_rows(spark):
    docs = spark.createDataFrame([("a", "mill boat"), ("b", "pond reed")], "id string, body string")
    once, twice = (spark.createDataFrame([(1, q) for q in rows], "qid long, query string") for rows in (["mill boat"], ["mill", "mill boat"]))
    one, two = (lexical.bm25(x, docs, "id", "body", 3).collect() for x in (once, twice))
    assert one == two


def test_bm25_breaks_ties_across_blocks_by_name(spark):
    names = [f"d{i:03}" for i in range(60)]
    docs = spark.createDataFrame([(n, "mill") for n in reversed(names)], "id string, body string").repartition(7)
    got = lexical.bm25(spark.createDataFrame([(1, "mill"), (2, None)], "qid long, query string"), docs, "id", "body", 4)
    assert [r["doc"] for r in got.orderBy("rank").collect()] == names[:4]


MOST = {"bm25_topk": 15_000, "open_basket": 20_000, "question_passages": 15_000, "rrf_fused": 20_000, "coverage_map": 15_000, "grep_in_candidates": 15_000, "ranking_report": 65_000, "hybrid_topk": 30_000, "complementarity": 30_000, "relevant_section_titles": 15_000, "set_cover": 40_000}


@pytest.mark.parametrize("name", MOST)
def test_rows_shuffled_by_queries(spark, name):
    assert shuffled(spark, lambda: QUERIES[name](spark, DATA)) <= MOST[name]


def test_titles_asked_as_they_stand_do_not_meet_all_titles(spark):
    titles = spark.createDataFrame([("The Mill",), ("The Millpond",), ("Boats",)], "title string")
    asked = spark.createDataFrame([("the mill",), ("Boat",)], "asked string")
    got = resolve.closest_titles(asked, titles)
    assert sorted(map(tuple, got.collect())) == [("boat", "boats", 0.95), ("the mill", "the mill", 1.0)]
    assert "LeftAnti" in got._jdf.queryExecution().optimizedPlan().toString()


def test_vector_search_shuffles_k_groups_of_a_task(spark):
    rows = spark.range(9_000).selectExpr("id", "concat('p', id) as grp", "cast(null as string) as mask", "transform(sequence(1, 8), i -> cast(sin(id * i + i * i) as float)) as embedding").repartition(1)
    asked = rows.where("id % 90 = 0").withColumnRenamed("id", "qid")
    assert shuffled(spark, lambda: probes.masked_topk(asked, rows.coalesce(1), 5)) < 9_100 + 2_000  # rows and queries as given, and lists of at most six groups a query, shuffled twice
