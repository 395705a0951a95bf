"""Core operators on hand-made cases and against independent SQL over the smallest tables."""

import glob
import math
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tomeline.functions import text as T
from tomeline.operators import lexical, metrics, retrieval, selection
from tomeline.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def pool(spark, lists):
    data = [(q, f"p{i}", float(s), i + 1) for q, scores in lists.items() for i, s in enumerate(scores)]
    return spark.createDataFrame(data, "qid long, page_id string, score double, rank int")


def test_max_pool_takes_the_best_row_and_skips_unusable(spark):
    e = "id long, page_id string, embedding array<float>"
    corpus = spark.createDataFrame([(1, "a", [1.0, 0.0, 0.0]), (2, "a", [0.0, 1.0, 0.0]), (3, "b", [0.6, 0.8, 0.0]), (4, "c", None), (5, "c", [0.0, 0.0, 0.0]), (6, "c", [1.0])], e)
    asked = spark.createDataFrame([(9, [0.0, 2.0, 0.0])], "qid long, embedding array<float>")
    got = retrieval.pooled_topk(retrieval.usable(asked, dim=3), retrieval.usable(corpus, dim=3), 5)
    assert [(r["page_id"], round(r["score"], 6), r["row_id"], r["rank"]) for r in got.orderBy("rank").collect()] == [("a", 1.0, 2, 1), ("b", 0.8, 3, 2)]
    assert retrieval.pooled_topk(retrieval.usable(asked, dim=3), retrieval.usable(corpus.limit(0), dim=3), 5).count() == 0


def test_gates(spark):
    p = pool(spark, {1: [0.9, 0.9], 2: [0.9, 0.5], 3: [0.9], 4: [0.4, 0.3]})
    assert {r["qid"] for r in retrieval.margin_gate(p, 0.45, 0.05).collect()} == {2, 3}
    assert retrieval.threshold_gate(p, 0.85).count() == 4


@pytest.mark.parametrize("scores, buffer, share, k", [([0.90, 0.88, 0.87, 0.40, 0.39, 0.38, 0.37, 0.36, 0.35, 0.34], 0, 0.9, 3), ([0.90, 0.88, 0.87, 0.40, 0.39, 0.38, 0.37, 0.36, 0.35, 0.34], 5, 0.9, 8), ([0.9, 0.5, 0.4, 0.0], 0, 0.9, 1), ([0.5], 5, 0.9, 1)])
def test_adaptive_k(spark, scores, buffer, share, k):
    assert rows(retrieval.adaptive_k(pool(spark, {1: scores}), share, buffer)) == [(1, k)]


def test_fusion_counts_ranks_only(spark):
    a, b = pool(spark, {1: [9, 8]}), pool(spark, {1: [1.0, 0.5]}).withColumn("page_id", F.when(F.col("rank") == 1, "p1").otherwise("z"))
    got = [(r["page_id"], r["rank"]) for r in retrieval.fuse([a, b], "page_id", 3).orderBy("rank").collect()]
    assert got == [("p1", 1), ("p0", 2), ("z", 3)]


def test_conformal_threshold(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 10)] + [(None,), (float("inf"),)], "required double")
    assert retrieval.conformal_threshold(df, 0.2).first()[0] == 8.0
    assert math.isinf(retrieval.conformal_threshold(df.limit(2), 0.1).first()[0])


def test_bm25_equals_the_formula(spark):
    docs = {1: "rare common word", 2: "common common filler text", 3: "common", 4: None, 5: "Đầu tư unrelated"}
    df = spark.createDataFrame(list(docs.items()), "page_id long, body string")
    asked = spark.createDataFrame([(7, "Rare common common"), (8, "dau"), (9, None)], "qid long, query string")
    words = {k: [w for w in (v or "").lower().replace("đầu", "dau").replace("tư", "tu").split() if len(w) > 1] for k, v in docs.items()}
    avg = sum(map(len, words.values())) / 5
    want = {}
    for doc, ws in words.items():
        s = 0.0
        for t in ("rare", "common"):
            df_t = sum(t in w for w in words.values())
            tf = ws.count(t)
            s += math.log(1 + (5 - df_t + 0.5) / (df_t + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avg)) if tf else 0
        if s:
            want[doc] = round(s, 5)
    got = lexical.bm25(asked, df, "page_id", "body", 10).collect()
    assert {r["doc"]: round(r["score"], 5) for r in got if r["qid"] == 7} == want
    assert [r["doc"] for r in got if r["qid"] == 8] == [5]
    assert {r["doc"] for r in lexical.bm25(asked, df, "page_id", "body", 10, 0.2).collect() if r["qid"] == 7} == {1}


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (1, "b", 3), (2, "y", 1)], "qid long, page_id string, rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "qid long, page_id string")
    ideal = 1 + 1 / math.log2(3)
    assert rows(metrics.ranking_metrics(ranked, gold, "page_id", 10)) == [(1, 1, 1.0, 1, round(1.5 / ideal, 6)), (2, 0, 0.0, 0, 0.0)]


def test_text_functions(spark):
    df = spark.createDataFrame([("Đầu Tư — Straße!", "the cost is 12.5 kg, 3 and 40%"), (None, None), ("!!!", "")], "a string, b string")
    got = df.select(T.slug(F.col("a")).alias("s"), T.fold(F.col("a")).alias("f"), T.figures(F.col("b")).alias("n"), T.token_estimate(F.col("b")).alias("t")).collect()
    assert (got[0]["s"], got[0]["f"], got[0]["n"], got[0]["t"]) == ("dau-tu-strasse", "dau tu — strasse!", ["12.5 kg", "40%"], 7)
    assert got[1]["s"] is None and got[2]["s"] == "untitled"


def test_stratified_keeps_every_kind(spark):
    df = spark.createDataFrame([(i, "rare" if i == 0 else "often") for i in range(100)], "id long, kind string")
    assert rows(metrics.stratified(df, "kind", "id", 10, 1).groupBy("kind").count()) == [("often", 10), ("rare", 1)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    import duckdb

    def plain(v):
        if v is None or v != v:
            return ""
        if isinstance(v, float):
            return f"{v:.5g}"
        return str(list(v)) if isinstance(v, list | tuple) else str(v)

    df = QUERIES[name](spark, DATA)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name in SQL:
        c = duckdb.connect()
        for f in glob.glob(f"{DATA}/*.parquet"):
            c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        rel = c.execute(SQL[name])
        names = [x[0] for x in rel.description]
        want = [tuple(plain(dict(zip(names, r, strict=True))[k]) for k in sorted(names)) for r in rel.fetchall()]
        assert sorted(got) == sorted(want)


def test_core_stands_without_the_training_data_part():
    code = "import sys; sys.modules['tomeline.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k[0] == 'p' and k[1].isdigit() for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_deep_paths_and_long_routes_are_whole(spark, tmp_path):
    spark.createDataFrame([("p", "b", " ▸ ".join(f"n{i}" for i in range(15)))], "page_id string, book_id string, path string").write.parquet(str(tmp_path / "questions.parquet"))
    spark.createDataFrame([(1, [("book", "open", f"t{i}") for i in range(70)])], "id long, route array<struct<kind:string,action:string,title:string>>").write.parquet(str(tmp_path / "trajectories.parquet"))
    assert [QUERIES[q](spark, str(tmp_path)).count() for q in ("tree_rollup", "menu_children", "route_steps")] == [15, 14, 70]


def test_every_title_has_a_slug(spark, tmp_path):
    spark.createDataFrame([("p1", "Refund Policy"), ("p2", "คืนเงิน"), ("p3", "退款"), ("p4", None)], "page_id string, title string").write.parquet(str(tmp_path / "pages.parquet"))
    assert rows(QUERIES["slugs_of_every_title"](spark, str(tmp_path))) == [("p1", "refund-policy"), ("p2", "untitled"), ("p3", "untitled")]


def test_heading_sections_ignore_fences(spark):
    page = "intro\r\n# T\nx\n```\n# no\n```\n## B ##\ny"
    df = spark.createDataFrame([("p", page), ("q", None), ("r", "plain")], "page_id string, markdown string")
    got = [(r["page_id"], r["ord"], r["title"], r["body"]) for r in selection.heading_sections(df, "page_id", "markdown").orderBy("page_id", "ord").collect()]
    assert got == [("p", 0, "(opening)", "intro"), ("p", 1, "T", "# T\nx\n```\n# no\n```"), ("p", 2, "B", "## B ##\ny"), ("r", 0, "(opening)", "plain")]


def test_coverage_and_greedy_cover(spark):
    asked = spark.createDataFrame([(1, "refund policy rules and shipping label size"), (2, None)], "qid long, query string")
    parts = selection.question_parts(asked)
    assert parts.count() == 2
    words = spark.createDataFrame([(1, "a", ["refund", "policy"]), (1, "b", ["shipping", "label", "refund", "rules"]), (1, "c", ["none"])], "qid long, page_id string, words array<string>")
    covered = selection.coverage(parts, words)
    assert rows(covered.groupBy("page_id").count()) == [("a", 1), ("b", 2)]
    ranks = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "qid long, page_id string, rank int")
    assert rows(selection.greedy_cover(covered, ranks)) == [(1, "b", 1)]
