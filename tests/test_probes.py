"""Probes, splitting and file sources against brute force, invariants and small folders."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeline.operators import probes, splitting
from tomeline.plans.probe_queries import base
from tomeline.sources import files


def test_masked_topk_is_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 64)).astype("float32")
    rows = [(i, f"g{i % 7}", None if i % 11 == 0 else f"m{i % 13}", x[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, grp string, mask string, embedding array<float>")
    got = {(r.qid, r.grp): (round(r.score, 6), r.rank, r.own) for r in probes.masked_topk(df.where("id % 5 = 0").withColumnRenamed("id", "qid"), df, 3).collect()}
    u = x.astype("float64") / np.linalg.norm(x.astype("float64"), axis=1, keepdims=True)
    want = {}
    for q in range(0, 60, 5):
        best = {}
        for i, g, m, _ in rows:
            if m is None or rows[q][2] is None or m != rows[q][2]:
                best[g] = max(best.get(g, -2), round(float(u[q] @ u[i]), 9))
        for rank, (g, s) in enumerate(sorted(best.items(), key=lambda t: (-t[1], t[0])), 1):
            if rank <= 3 or g == rows[q][1]:
                want[q, g] = (round(s, 6), min(rank, 4), g == rows[q][1])
    assert got == want


def test_masked_topk_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, grp string, mask string, embedding array<float>")
    assert probes.masked_topk(empty.withColumnRenamed("id", "qid"), empty, 3).count() == 0


def test_foreign_pull_reports_the_page_that_lies_in_another_book(spark):
    axis = lambda i: [1.0 if j == i else 0.1 * (j == 2) for j in range(64)]
    rows = [(1, "a1", "A", axis(0)), (2, "a2", "A", axis(0)), (3, "a3", "A", axis(1)), (4, "b1", "B", axis(1)), (5, "b2", "B", axis(1)), (6, "c1", "C", axis(5))]
    df = spark.createDataFrame(rows, "id long, page_id string, book_id string, embedding array<float>")
    out = probes.foreign_pull(probes.centroids(df, ["page_id", "book_id"]), df).collect()
    assert [(r.page_id, r.book_id, r.best_book) for r in out] == [("a3", "A", "B")]  # the book of one page is left out


def test_separability_goes_over_every_row(spark, tmp_path):
    rng = np.random.default_rng(8)
    books = ["a", "b", "c", "d"]
    x = rng.normal(size=(80, 64)).astype("float32")
    book = [books[i % 3] if i else "d" for i in range(80)]  # d has one row and takes part as a rival only
    spark.createDataFrame([(i, f"p{i % 9}", book[i], x[i].tolist()) for i in range(80)], "id long, page_id string, book_id string, embedding array<float>").write.parquet(str(tmp_path / "questions.parquet"))
    u = x.astype("float64") / np.linalg.norm(x.astype("float64"), axis=1, keepdims=True)
    total = {b: u[[i for i in range(80) if book[i] == b]].sum(0) for b in books}
    cosine = lambda a, b: float(a @ b / np.linalg.norm(b))
    own = {i: cosine(u[i], total[book[i]] - u[i]) for i in range(1, 80)}
    rival = {i: max((cosine(u[i], total[b]), b) for b in books if b != book[i]) for i in own}
    got = {r["id"]: r["own_cosine"] for r in base.QUERIES["own_book_of_every_row"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(own, abs=1e-5)
    n, wins = {r["book_id"]: r["n"] for r in base.QUERIES["book_separability_of_every_row"](spark, str(tmp_path)).collect()}, {}
    assert n == {b: sum(book[i] == b for i in own) for b in "abc"}
    lost = {}
    for i in own:
        if own[i] <= rival[i][0]:
            lost[book[i], rival[i][1]] = lost.get((book[i], rival[i][1]), 0) + 1
        wins[book[i]] = wins.get(book[i], 0) + (own[i] > rival[i][0])
    assert {r["book_id"]: r["wins"] for r in base.QUERIES["book_separability_of_every_row"](spark, str(tmp_path)).collect()} == wins
    worst = sorted(((b, r, c) for (b, r), c in lost.items()), key=lambda t: (-t[2], t[0], t[1]))[:8]
    assert [tuple(r) for r in base.QUERIES["book_confusions_of_every_row"](spark, str(tmp_path)).collect()] == worst


def test_cross_fit_does_not_cover_its_own_outlier(spark):
    rows = [(i, 0.01) for i in range(200)] + [(999, 9.99), (1000, None)]
    out = probes.cross_fit(spark.createDataFrame(rows, "qid long, required double"), 0.1).collect()
    assert sum(r.n for r in out) == 202 and sum(r.covered for r in out) == 200
    assert {r.threshold for r in out} == {0.01}


TEXT = "intro\n\n# One\nbody one is longer than forty characters, surely so\n```\n# not a heading\n```\n# Two\nbody two is longer than forty characters as well\n## References\nkept apart\n"


def test_split_keeps_the_text_and_the_fences():
    out = splitting.split_text("Doc", TEXT, True)
    assert "".join(b for _, b, _ in out) == TEXT
    assert [t for t, *_ in out] == ["Doc", "One", "Two"] and "# not a heading" in out[1][1]
    assert splitting.split_text("Doc", TEXT, False) == [("Doc", TEXT, True)]
    assert splitting.split_text("References", TEXT * 900, False)[0][2] is False


@pytest.mark.parametrize("text", ["", "   ", "x" * 50_000, "para " * 100 + "\n\n" + "word " * 5_000 + "\n\n" + "tail " * 900, "# A\n" + "a b\n\n" * 5_000, "\n".join(f"# h{i}\n" + "text " * 700 for i in range(9))])
@pytest.mark.parametrize("whole", [True, False])
def test_split_is_a_round_trip(text, whole):
    out = splitting.split_text("t", text, whole)
    assert "".join(b for _, b, _ in out) == text
    if "\n" in text and len(text) > splitting.LIMIT:
        assert len(out) > 1


def test_split_pages_skips_null_texts(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "one line"), (2, None, "one line")], "doc_id long, title string, text string")
    assert [(r.doc_id, r.ord, r.body) for r in splitting.split_pages(df, "doc_id", "title", "text", True).collect()] == [(2, 0, "one line")] * 2


def test_passages_take_hits_in_order_and_drop_echoes(spark):
    md = "# Returns of orders\nReturns of orders take ten days.\nReturns of orders take ten days!\nOrders ship from the depot daily.\nNothing here at all."
    q = spark.createDataFrame([(1, "returns of orders"), (2, "the of"), (3, None)], "qid long, query string")
    c = spark.createDataFrame([(1, "p", md), (2, "p", md), (3, "p", None)], "qid long, page_id string, markdown string")
    assert [(r.qid, r.place, r.passage) for r in splitting.passages(q, c).orderBy("place").collect()] == [(1, 1, "Returns of orders take ten days."), (1, 2, "Orders ship from the depot daily.")]


def test_survey_reads_a_folder(spark, tmp_path):
    for name, text in {"Shelf_one/P0_First-book/a.md": "---\ntitle: \"Alpha\"\ndescription: about it\nkeywords: [x, y, , z, u, v, w, q]\n---\nbody\n", "Shelf_one/P0_First-book/b page.md": "# Heading b\ntext", "Lone/c.md": "---\nno end", "d.md": "bare"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    out = {r.file: r for r in files.survey(spark, str(tmp_path)).collect()}
    a, b, c, d = (out[k] for k in ("Shelf_one/P0_First-book/a.md", "Shelf_one/P0_First-book/b page.md", "Lone/c.md", "d.md"))
    assert (a.shelf, a.book, a.priority, a.title, a.one_line, a.keywords, a.body, a.ord) == ("Shelf one", "First book", "P0", "Alpha", "about it", ["x", "y", "z", "u", "v", "w"], "body", 1)
    assert (b.title, b.ord, b.keywords) == ("Heading b", 2, None)
    assert (c.shelf, c.book, c.title, c.body) == (None, "Lone", "C", "---\nno end")
    assert (d.shelf, d.book, d.title) == (None, None, "D")


def test_benchmark_folder_and_cache(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text("\n".join(json.dumps({"_id": str(i), "title": f"t{i}", "text": "same" if i else None}) for i in range(3)))
    (tmp_path / "queries.jsonl").write_text("\n".join(json.dumps({"_id": q, "text": q}) for q in ("a", "b")))
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\na\t1\t2\n")
    corpus, queries, qrels = files.benchmark(spark, str(tmp_path))
    assert sorted(r.text for r in corpus.collect()) == ["t0", "t1 same", "t2 same"]
    assert [tuple(r) for r in queries.collect()] == [("a", "a")] and qrels.first().grade == 2
    kept = corpus.where("doc = '1'").select(F.sha1(F.col("text").cast("binary")).alias("sha"))
    assert sorted(r.doc for r in files.missing_only(corpus, kept, "text").collect()) == ["0", "2"]


def test_write_pages_keeps_every_row(spark, tmp_path):
    df = spark.createDataFrame([(f"p{i}", "hot" if i % 3 else None, "x") for i in range(40)], "page_id string, book_id string, markdown string")
    files.write_pages(df, f"{tmp_path}/pages")
    assert spark.read.parquet(f"{tmp_path}/pages").count() == 40
