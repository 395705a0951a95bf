"""The registered queries over the project's tables, each beside the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeline.functions import text as T
from tomeline.operators import lexical, metrics, probes, retrieval, selection
from tomeline.session import cut, table
from tomeline.streaming import log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


# --- dense retrieval: every twentieth cached question against all catalog rows --------------------------------------
ASKED = """asked AS (SELECT id AS qid, embedding::DOUBLE[] AS e, source_page_ids FROM answer_cache WHERE id % 20 = 0 AND len(embedding) = 64
    AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 AND NOT isnan(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))),
rows_ AS (SELECT id, page_id, book_id, embedding::DOUBLE[] AS e FROM questions WHERE len(embedding) = 64
    AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 AND NOT isnan(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))"""
POOL = f"""WITH {ASKED}, sims AS (SELECT qid, page_id, id, round(list_cosine_similarity(a.e, r.e), 9) AS s FROM asked a, rows_ r),
best AS (SELECT qid, page_id, max(s) AS score FROM sims GROUP BY ALL),
pool AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, page_id) AS rank FROM best QUALIFY rank <= 20)"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.usable(table(spark, d, "answer_cache").where("id % 20 = 0")).withColumnRenamed("id", "qid")


def _pool(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return retrieval.pooled_topk(_asked(spark, d), retrieval.usable(table(spark, d, "questions")), k)


def _scores(df: DataFrame) -> DataFrame:
    return _long(df.select("qid", "page_id", F.round("score", 5).alias("score"), "rank"), "rank")


@query(POOL + " SELECT qid, page_id, round(score, 5) AS score, rank FROM pool WHERE rank <= 10")
def dense_topk_pages(spark, d):
    return _scores(_pool(spark, d, 10))


@query(f"""WITH {ASKED}, sims AS (SELECT qid, book_id, round(list_cosine_similarity(a.e, r.e), 9) AS s FROM asked a, rows_ r WHERE book_id IS NOT NULL),
best AS (SELECT qid, book_id, max(s) AS score FROM sims GROUP BY ALL)
SELECT qid, book_id, round(score, 5) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, book_id) AS rank FROM best QUALIFY rank <= 3""")
def dense_topk_books(spark, d):
    rows = retrieval.usable(table(spark, d, "questions")).where("book_id is not null")
    return _long(retrieval.pooled_topk(_asked(spark, d), rows, 3, "book_id").select("qid", "book_id", F.round("score", 5).alias("score"), "rank"), "rank")


@query(f"""WITH {ASKED}, sims AS (SELECT qid, page_id, round(list_cosine_similarity(a.e, r.e), 9) AS s FROM asked a, rows_ r WHERE page_id IN (SELECT page_id FROM pages WHERE indexable)),
best AS (SELECT qid, page_id, max(s) AS score FROM sims GROUP BY ALL)
SELECT qid, page_id, round(score, 5) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, page_id) AS rank FROM best QUALIFY rank <= 5""")
def dense_topk_within(spark, d):
    allowed = table(spark, d, "pages").where("indexable").select("page_id")
    rows = retrieval.usable(table(spark, d, "questions")).join(allowed, "page_id", "left_semi")
    return _scores(retrieval.pooled_topk(_asked(spark, d), rows, 5))


@query(POOL + " SELECT qid, page_id, round(score, 5) AS score, rank FROM pool WHERE score >= 0.4")
def threshold_gate(spark, d):
    return _scores(retrieval.threshold_gate(_pool(spark, d), 0.4))


@query(POOL + """, over_ AS (SELECT *, score - coalesce(lead(score) OVER (PARTITION BY qid ORDER BY rank), 0) AS lead FROM pool WHERE score >= 0.3)
SELECT qid, page_id, round(score, 5) AS score, round(lead, 5) AS lead FROM over_ WHERE rank = 1 AND lead >= 0.02""")
def margin_gate(spark, d):
    return retrieval.margin_gate(_pool(spark, d), 0.3, 0.02).select("qid", "page_id", F.round("score", 5).alias("score"), F.round("lead", 5).alias("lead"))


GOLD = "gold AS (SELECT DISTINCT qid, unnest(source_page_ids) AS page_id FROM asked)"


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("qid", F.explode("source_page_ids").alias("page_id")).distinct()


@query(POOL + f""", {GOLD}, sized AS (SELECT qid, count(*) AS n FROM gold GROUP BY 1),
hits AS (SELECT qid, count(*) AS tp, sum(1 / log2(rank + 1)) AS dcg FROM pool JOIN gold USING (qid, page_id) WHERE rank <= 10 GROUP BY 1),
ideal AS (SELECT qid, sum(1 / log2(i + 1)) AS best FROM sized, range(1, 11) t(i) WHERE i <= n GROUP BY 1)
SELECT qid, CASE WHEN tp > 0 THEN 1 ELSE 0 END AS hit, round(coalesce(tp, 0) / n, 6) AS recall, CASE WHEN tp = n THEN 1 ELSE 0 END AS allgold, round(coalesce(dcg, 0) / best, 6) AS ndcg
FROM sized LEFT JOIN hits USING (qid) JOIN ideal USING (qid)""")
def ndcg_recall_at_10(spark, d):
    return metrics.ranking_metrics(_pool(spark, d, 10), _gold(spark, d), "page_id", 10)


@query(POOL + """, gaps AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n, score - lead(score) OVER (PARTITION BY qid ORDER BY rank) AS gap FROM pool),
cuts AS (SELECT qid, n, rank FROM gaps WHERE rank <= least(greatest(floor(n * 0.9) - 1, 1), greatest(n - 1, 1)) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(gap, 9) DESC, rank) = 1)
SELECT qid, CAST(greatest(1, least(n, rank + 5)) AS BIGINT) AS k FROM cuts""")
def adaptive_k(spark, d):
    return retrieval.adaptive_k(_pool(spark, d))


REQUIRED = POOL + f""", {GOLD}, below AS (SELECT qid, page_id, max(score) OVER (PARTITION BY qid) - score AS b FROM pool),
required AS (SELECT qid, CASE WHEN count(*) FILTER (b IS NULL) = 0 THEN round(max(b), 9) END AS required FROM gold LEFT JOIN below USING (qid, page_id) GROUP BY 1)"""


@query(REQUIRED + " SELECT qid, round(required, 5) AS required FROM required")
def required_margin(spark, d):
    return metrics.required_margin(_pool(spark, d), _gold(spark, d), "page_id").select("qid", F.round("required", 5).alias("required"))


@query(REQUIRED + """, ok AS (SELECT required, row_number() OVER (ORDER BY required) AS i, count(*) OVER () AS n FROM required WHERE required IS NOT NULL)
SELECT round(coalesce(min(required) FILTER (i >= ceil((n + 1) * 0.9)), 'inf'::DOUBLE), 5) AS threshold FROM ok""")
def conformal_threshold(spark, d):
    return retrieval.conformal_threshold(metrics.required_margin(_pool(spark, d), _gold(spark, d), "page_id"), 0.1).select(F.round("threshold", 5).alias("threshold"))


@query(POOL + """, gates(kind, g) AS (VALUES ('threshold', 0.5), ('threshold', 0.6), ('threshold', 0.7), ('margin', 0.0), ('margin', 0.02), ('margin', 0.05), ('margin', 0.08)),
top AS (SELECT qid, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2 FROM pool GROUP BY 1)
SELECT kind, CAST(g AS DOUBLE) AS gate, count(*) AS asked, count(*) FILTER (CASE WHEN kind = 'threshold' THEN s1 >= g ELSE s1 - coalesce(s2, 0) >= g END) AS fires FROM top, gates GROUP BY ALL""")
def gate_table(spark, d):
    gates = spark.createDataFrame([("threshold", 0.5), ("threshold", 0.6), ("threshold", 0.7), ("margin", 0.0), ("margin", 0.02), ("margin", 0.05), ("margin", 0.08)], "kind string, gate double")
    top = _pool(spark, d).groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"))
    fires = F.when(F.col("kind") == "threshold", F.col("s1") >= F.col("gate")).otherwise(F.col("s1") - F.coalesce("s2", F.lit(0.0)) >= F.col("gate"))
    return top.join(F.broadcast(gates)).groupBy("kind", "gate").agg(F.count("*").alias("asked"), F.count_if(fires).alias("fires"))


# --- lexical retrieval: logged queries (all of them, or every twentieth) against all pages -----------------------------
def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where("page_id is not null").groupBy("page_id").agg(F.min("markdown").alias("markdown"))


def _lexical(spark: SparkSession, d: str, rare: float | None = None, k: int = 10, which: str = "id % 20 = 0") -> DataFrame:
    asked = table(spark, d, "trajectories").where(which).select(F.col("id").alias("qid"), "query").distinct()
    return lexical.bm25(asked, _bodies(spark, d), "page_id", "markdown", k, rare).withColumnRenamed("doc", "page_id")


def fold_sql(x: str) -> str:
    return f"translate(replace(lower({x}), 'ß', 'ss'), '{T.FOLDED[0]}', '{T.FOLDED[1]}')"


def bm25_sql(name: str, asked: str, docs: str, k: int, rare: float | None = None) -> str:
    """Common table expressions ending in {name}(qid, doc, score, rank); asked(qid, query), docs(doc, body)."""
    words = lambda x: f"list_filter(regexp_split_to_array({fold_sql(x)}, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1)"
    few = f" WHERE df <= greatest(1, floor(n_docs * {rare}))" if rare else ""
    return f"""{name}_w AS (SELECT doc, coalesce({words("body")}, []) AS t FROM ({docs})), {name}_n AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM {name}_w),
{name}_p AS (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, len(t) AS dl, unnest(t) AS term FROM {name}_w) GROUP BY ALL),
{name}_d AS (SELECT term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf, avgdl FROM (SELECT term, count(*) AS df FROM {name}_p GROUP BY 1), {name}_n{few}),
{name}_q AS (SELECT DISTINCT qid, unnest({words("query")}) AS term FROM ({asked})),
{name}_s AS (SELECT qid, doc, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM {name}_q JOIN {name}_d USING (term) JOIN {name}_p USING (term) GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM {name}_s WHERE score > 0 QUALIFY rank <= {k})"""


LOGGED = "SELECT DISTINCT id AS qid, query FROM trajectories WHERE id % 20 = 0"
EVERY, EVERY_LOGGED = "id is not null", "SELECT DISTINCT id AS qid, query FROM trajectories WHERE id IS NOT NULL"
BODIES = "SELECT page_id AS doc, min(markdown) AS body FROM pages WHERE page_id IS NOT NULL GROUP BY 1"
TITLES = "SELECT page_id AS doc, min(title) AS body FROM pages WHERE page_id IS NOT NULL GROUP BY 1"


@query("WITH " + bm25_sql("b", EVERY_LOGGED, BODIES, 10) + " SELECT qid, doc AS page_id, round(score, 4) AS score FROM b")
def bm25_topk(spark, d):
    """The ten best pages of every logged query; the half is judged on the double, as the SQL does."""
    return _lexical(spark, d, which=EVERY).select("qid", "page_id", (F.floor(F.col("score") * 10_000 + 0.5) / 10_000).alias("score"))


@query("WITH " + bm25_sql("b", LOGGED, BODIES, 10, 0.01) + " SELECT qid, doc AS page_id, round(score, 4) AS score FROM b")
def bm25_rare_gate(spark, d):
    return _lexical(spark, d, 0.01).select("qid", "page_id", F.round("score", 4).alias("score"))


@query("WITH " + bm25_sql("b", LOGGED, BODIES, 10) + " SELECT n_docs, round(avgdl, 4) AS avgdl FROM b_n")
def corpus_stats(spark, d):
    return lexical.corpus_stats(lexical.postings(_bodies(spark, d), "page_id", "markdown")).select("n_docs", F.round("avgdl", 4).alias("avgdl"))


def fused_sql(name: str, lists: tuple[str, ...], k: int) -> str:
    parts = " UNION ALL ".join(f"SELECT qid, page_id, 1.0 / (60 + rank) AS part FROM ({x})" for x in lists)
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, page_id) AS rank FROM (SELECT qid, page_id, round(sum(part), 9) AS score FROM ({parts}) GROUP BY ALL) QUALIFY rank <= {k})"


@query("WITH " + bm25_sql("b", LOGGED, BODIES, 20) + ", " + bm25_sql("t", LOGGED, TITLES, 20) + ", " + fused_sql("f", ("SELECT qid, doc AS page_id, rank FROM b", "SELECT qid, doc AS page_id, rank FROM t"), 10) + " SELECT qid, page_id, round(score, 6) AS score, rank FROM f")
def rrf_fused(spark, d):
    """Two lists for each twentieth logged query: BM25 over pages and BM25 over page titles."""
    asked = table(spark, d, "trajectories").where("id % 20 = 0").select(F.col("id").alias("qid"), "query").distinct()
    titles = table(spark, d, "pages").where("page_id is not null").groupBy("page_id").agg(F.min("title").alias("title"))
    by_title = lexical.bm25(asked, titles, "page_id", "title", 20).withColumnRenamed("doc", "page_id")
    return _long(retrieval.fuse([_lexical(spark, d, k=20), by_title], "page_id", 10).select("qid", "page_id", F.round("score", 6).alias("score"), "rank"), "rank")


# --- text ----------------------------------------------------------------------------------------------------------
STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(f"""SELECT id, list_sort(list_filter(list_distinct(list_filter(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 1)), lambda x: x NOT IN ({STOPS}))) AS words
FROM answer_cache WHERE query IS NOT NULL""")
def content_words(spark, d):
    return table(spark, d, "answer_cache").where("query is not null").select("id", F.array_sort(T.content_words(F.col("query"))).alias("words"))


@query("""SELECT page_id, trim(both '-' from regexp_replace(regexp_replace(translate(strip_accents(lower(title)), 'đß', 'ds'), '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[:60]) AS slug
FROM (SELECT DISTINCT page_id, title FROM pages WHERE title IS NOT NULL AND regexp_matches(strip_accents(title), '[a-zA-Z0-9]'))""")
def page_slugs(spark, d):
    pages = table(spark, d, "pages").select("page_id", "title").where("title is not null").distinct()
    return pages.where(T.fold(F.col("title")).rlike("[a-z0-9]")).select("page_id", T.slug(F.col("title")).alias("slug"))


@query("""SELECT page_id, coalesce(nullif(trim(both '-' from regexp_replace(regexp_replace(translate(strip_accents(lower(title)), 'đß', 'ds'), '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[:60]), ''), 'untitled') AS slug
FROM (SELECT DISTINCT page_id, title FROM pages WHERE title IS NOT NULL)""")
def slugs_of_every_title(spark, d):
    """The same for every page with a title; one without Latin letters or digits is untitled."""
    return table(spark, d, "pages").select("page_id", "title").where("title is not null").distinct().select("page_id", T.slug(F.col("title")).alias("slug"))


@query("""SELECT page_id, ord, length(body) // 4 AS tokens, regexp_matches(title, '(?i)^\\s*(?:\\d+(?:\\.\\d+)*\\.?\\s+)?(?:references|bibliography|works cited|acknowledge?ments|tài liệu tham khảo|lời cảm ơn)\\s*$') AS back_matter
FROM (SELECT DISTINCT * FROM sections)""")
def section_sizes(spark, d):
    s = table(spark, d, "sections").distinct()
    return _long(s.select("page_id", "ord", T.token_estimate(F.col("body")).alias("tokens"), F.col("title").rlike(T.BACK_MATTER).alias("back_matter")), "tokens")


@query("""WITH s AS (SELECT DISTINCT page_id, ord, title, body FROM sections), c AS (SELECT *, length(body) // 4 AS tokens, sum(length(body) // 4) OVER (PARTITION BY page_id ORDER BY ord, title, body ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY page_id ORDER BY ord, title, body) AS i FROM s WHERE body IS NOT NULL)
SELECT page_id, ord, CAST(tokens AS BIGINT) AS tokens FROM c WHERE i = 1 OR upto <= 4000""")
def budget_sections(spark, d):
    """The sections of a page from the start while they fit 4,000 tokens; the first always."""
    s = table(spark, d, "sections").where("body is not null").select("page_id", "ord", "title", "body").distinct().withColumn("tokens", T.token_estimate(F.col("body")))
    w = Window.partitionBy("page_id").orderBy("ord", "title", "body")
    kept = s.withColumns({"i": F.row_number().over(w), "upto": F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return _long(kept.where("i = 1 or upto <= 4000").select("page_id", "ord", "tokens"), "tokens")


@query("""WITH f AS (SELECT id, text, gold_answer, list_filter(list_distinct(regexp_extract_all(text, '([0-9]+(?:[.,][0-9]+)*(?: ?(?:%|kg|g|km|cm|mm|m|h|min))?)', 1)), lambda x: length(x) > 1) AS found FROM (SELECT DISTINCT id, text, gold_answer, query FROM outcomes) WHERE text IS NOT NULL)
SELECT id, list_sort(list_filter(found, lambda x: NOT contains(coalesce(gold_answer, ''), x))) AS invented FROM f WHERE len(list_filter(found, lambda x: NOT contains(coalesce(gold_answer, ''), x))) > 0""")
def invented_figures(spark, d):
    rows = table(spark, d, "outcomes").where("text is not null").select("id", "text", "gold_answer", "query").distinct()
    evidence = F.coalesce("gold_answer", F.lit(""))
    out = rows.select("id", F.array_sort(F.filter(T.figures(F.col("text")), lambda x: ~F.contains(evidence, x))).alias("invented"))
    return out.where(F.size("invented") > 0)


@query("""WITH p AS (SELECT DISTINCT c.id, regexp_replace(lower(c.query), '\\s', '', 'g') AS q, regexp_replace(lower(c.answer), '\\s', '', 'g') AS a FROM answer_cache c WHERE c.query IS NOT NULL AND c.answer IS NOT NULL),
g AS (SELECT id, q, a, unnest(range(1, length(q) - 10)) AS i FROM p WHERE length(q) >= 12)
SELECT id, round(count(*) FILTER (contains(a, substring(q, CAST(i AS BIGINT), 12))) / count(*), 6) AS grounded FROM g GROUP BY id""")
def grounding_ngrams(spark, d):
    """Share of a query's runs of twelve characters that its answer holds."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"\s", "")
    rows = table(spark, d, "answer_cache").where("query is not null and answer is not null").select("id", bare("query").alias("q"), bare("answer").alias("a")).distinct()
    g = rows.where(F.length("q") >= 12).withColumn("g", T.grams(F.col("q")))
    return g.select("id", F.round(F.size(F.filter("g", lambda x: F.contains(F.col("a"), x))) / F.size("g"), 6).alias("grounded"))


# --- the tree ------------------------------------------------------------------------------------------------------
PATHS = "paths AS (SELECT DISTINCT page_id, book_id, string_split(path, ' ▸ ') AS p FROM questions WHERE path IS NOT NULL AND path <> '')"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "questions").where("path is not null and path <> ''").select("page_id", "book_id", "path").distinct()
    return rows.withColumn("p", F.split("path", " ▸ "))


@query(f"WITH {PATHS} SELECT array_to_string(p[1:i], ' ▸ ') AS node, i AS level, count(DISTINCT page_id) AS n_pages, count(DISTINCT book_id) AS n_books FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM paths) GROUP BY ALL")
def tree_rollup(spark, d):
    up = _paths(spark, d).select("page_id", "book_id", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("level"))
    node = F.array_join(F.slice("p", F.lit(1), F.col("level")), " ▸ ")
    return _long(up.groupBy(node.alias("node"), "level").agg(F.countDistinct("page_id").alias("n_pages"), F.countDistinct("book_id").alias("n_books")), "level")


@query(f"WITH {PATHS} SELECT array_to_string(p[1:i - 1], ' ▸ ') AS parent, p[i] AS child, count(DISTINCT page_id) AS n_pages FROM (SELECT *, unnest(range(2, len(p) + 1)) AS i FROM paths) GROUP BY ALL")
def menu_children(spark, d):
    up = _paths(spark, d).where(F.size("p") >= 2).select("page_id", "p", F.explode(F.sequence(F.lit(2), F.size("p"))).alias("i"))
    return up.groupBy(F.array_join(F.slice("p", F.lit(1), F.col("i") - 1), " ▸ ").alias("parent"), F.element_at("p", F.col("i")).alias("child")).agg(F.countDistinct("page_id").alias("n_pages"))


@query(f"WITH {PATHS} SELECT CASE WHEN len(p) >= 3 THEN array_to_string(p[1:len(p) - 2], ' ▸ ') ELSE '(root)' END AS shelf, count(DISTINCT page_id) AS n_pages FROM paths GROUP BY 1")
def shelf_keys(spark, d):
    shelf = F.when(F.size("p") >= 3, F.expr("array_join(slice(p, 1, greatest(size(p) - 2, 1)), ' ▸ ')")).otherwise("(root)")
    return _paths(spark, d).groupBy(shelf.alias("shelf")).agg(F.countDistinct("page_id").alias("n_pages"))


@query("SELECT kind, lang, count(*) AS n_rows, count(DISTINCT page_id) AS n_pages, count(*) FILTER (len(embedding) = 64) AS usable FROM questions GROUP BY ALL")
def catalog_stats(spark, d):
    return table(spark, d, "questions").groupBy("kind", "lang").agg(F.count("*").alias("n_rows"), F.countDistinct("page_id").alias("n_pages"), F.count_if(F.size("embedding") == 64).alias("usable"))


@query("SELECT DISTINCT q.page_id FROM questions q WHERE q.page_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pages p WHERE p.page_id = q.page_id AND p.indexable)")
def stale_catalog_pages(spark, d):
    live = table(spark, d, "pages").where("indexable").select("page_id")
    return table(spark, d, "questions").select("page_id").where("page_id is not null").distinct().join(live, "page_id", "left_anti")


@query("""WITH r AS (SELECT id, page_id, lang, kind, (row_number() OVER (PARTITION BY page_id ORDER BY id) - 1) // 2 AS intent FROM questions WHERE kind = 'question')
SELECT page_id, count(DISTINCT intent) AS intents, count(*) AS n_rows FROM r GROUP BY 1""")
def intent_pairs(spark, d):
    r = table(spark, d, "questions").where("kind = 'question'").select("page_id", F.floor((F.row_number().over(Window.partitionBy("page_id").orderBy("id")) - 1) / 2).alias("intent"))
    return r.groupBy("page_id").agg(F.countDistinct("intent").alias("intents"), F.count("*").alias("n_rows"))


# --- logs, conversations and the answer cache ----------------------------------------------------------------------
LOG = "log AS (SELECT DISTINCT id, query, status, confidence, page_ids, path, hops, backtracks, reason, indexed, created_at FROM trajectories)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "trajectories").select("id", "query", "status", "confidence", "page_ids", "path", "hops", "backtracks", "reason", "indexed", "created_at").distinct()


@query(f"WITH {LOG} SELECT status, count(*) AS n FROM log GROUP BY 1")
def status_counts(spark, d):
    return _log(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {LOG} SELECT count(*) AS queries, count(*) FILTER (status = 'answered') AS answered, count(*) FILTER (status = 'not_found') AS not_found, round(avg(hops) FILTER (status = 'answered'), 6) AS avg_hops FROM log")
def log_kpis(spark, d):
    answered = F.col("status") == "answered"
    return _log(spark, d).agg(F.count("*").alias("queries"), F.count_if(answered).alias("answered"), F.count_if(F.col("status") == "not_found").alias("not_found"), F.round(F.avg(F.when(answered, F.col("hops"))), 6).alias("avg_hops"))


@query(f"WITH {LOG} SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS queries, count(*) FILTER (status = 'answered') AS answered, CAST(sum(hops) AS BIGINT) AS hops FROM log GROUP BY 1")
def daily_trend(spark, d):
    return _log(spark, d).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("queries"), F.count_if(F.col("status") == "answered").alias("answered"), F.sum("hops").alias("hops"))


@query(f"WITH {LOG} SELECT id, query, reason FROM log WHERE status = 'not_found' ORDER BY id DESC LIMIT 50")
def recent_failures(spark, d):
    return _log(spark, d).where("status = 'not_found'").select("id", "query", "reason").orderBy(F.desc("id")).limit(50)


@query(f"WITH {LOG}, c AS (SELECT * FROM log WHERE status = 'answered' AND NOT indexed ORDER BY id LIMIT 400) SELECT id, query, page_ids[1] AS page_id FROM c WHERE len(page_ids) = 1 ORDER BY id LIMIT 100")
def harvest_candidates(spark, d):
    first = _log(spark, d).where("status = 'answered' and not indexed").orderBy("id").limit(400)
    return first.where(F.size("page_ids") == 1).orderBy("id").limit(100).select("id", "query", F.element_at("page_ids", 1).alias("page_id"))


@query(f"WITH {LOG} SELECT p AS page_id, count(*) AS visits, count(DISTINCT id) AS queries FROM (SELECT id, unnest(page_ids) AS p FROM log) GROUP BY 1")
def page_visits(spark, d):
    return _log(spark, d).select("id", F.explode("page_ids").alias("page_id")).groupBy("page_id").agg(F.count("*").alias("visits"), F.countDistinct("id").alias("queries"))


@query("SELECT id, i AS step, r.action AS action, r.kind AS kind, r.title AS title FROM (SELECT id, unnest(route) AS r, unnest(range(1, len(route) + 1)) AS i FROM (SELECT DISTINCT id, route FROM trajectories))")
def route_steps(spark, d):
    steps = table(spark, d, "trajectories").select("id", "route").distinct().select("id", F.posexplode("route").alias("pos", "r"))
    return steps.select("id", (F.col("pos") + 1).cast("long").alias("step"), F.col("r.action").alias("action"), F.col("r.kind").alias("kind"), F.col("r.title").alias("title"))


MSG = "m AS (SELECT DISTINCT id, conversation_id, turn, role, text FROM messages)"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("id", "conversation_id", "turn", "role", "text").distinct()


@query(f"""WITH {MSG}, c AS (SELECT DISTINCT id, title, pinned, pinned_at, updated_at FROM conversations), n AS (SELECT conversation_id, count(*) AS n FROM m GROUP BY 1)
SELECT c.id, title, coalesce(n, 0) AS messages FROM c LEFT JOIN n ON c.id = conversation_id ORDER BY pinned DESC NULLS LAST, pinned_at DESC NULLS LAST, updated_at DESC NULLS LAST, c.id DESC LIMIT 50""")
def conversation_list(spark, d):
    c = table(spark, d, "conversations").select("id", "title", "pinned", "pinned_at", "updated_at").distinct()
    n = _messages(spark, d).groupBy(F.col("conversation_id").alias("id")).agg(F.count("*").alias("n"))
    order = [F.desc_nulls_last(x) for x in ("pinned", "pinned_at", "updated_at", "id")]
    return c.join(n, "id", "left").orderBy(*order).limit(50).select("id", "title", F.coalesce("n", F.lit(0)).alias("messages"))


@query(f"WITH {MSG} SELECT conversation_id, id, turn FROM m WHERE conversation_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC NULLS LAST, id DESC) <= 6")
def conversation_last_6(spark, d):
    w = Window.partitionBy("conversation_id").orderBy(F.desc_nulls_last("turn"), F.desc("id"))
    return _messages(spark, d).where("conversation_id is not null").withColumn("r", F.row_number().over(w)).where("r <= 6").select("conversation_id", "id", "turn")


@query(f"WITH {MSG} SELECT conversation_id, CAST(coalesce(max(turn), -1) + 1 AS BIGINT) AS next_turn FROM m GROUP BY 1")
def next_turn(spark, d):
    return _long(_messages(spark, d).groupBy("conversation_id").agg((F.coalesce(F.max("turn"), F.lit(-1)) + 1).alias("next_turn")), "next_turn")


@query("WITH c AS (SELECT DISTINCT id, pinned, pinned_at FROM conversations WHERE pinned) SELECT id, row_number() OVER (ORDER BY pinned_at DESC NULLS LAST, id DESC) AS place FROM c QUALIFY place <= 5")
def pinned_top_5(spark, d):
    c = table(spark, d, "conversations").where("pinned").select("id", "pinned", "pinned_at").distinct().orderBy(F.desc_nulls_last("pinned_at"), F.desc("id")).limit(5)
    return _long(c.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("pinned_at"), F.desc("id")))).select("id", "place"), "place")


@query("SELECT id, query, hits FROM answer_cache ORDER BY hits DESC NULLS LAST, id DESC LIMIT 100")
def cache_list(spark, d):
    return table(spark, d, "answer_cache").orderBy(F.desc_nulls_last("hits"), F.desc("id")).limit(100).select("id", "query", "hits")


@query("""SELECT id, CASE lower(trim(confidence)) WHEN 'low' THEN 0 WHEN 'high' THEN 2 ELSE 1 END AS rank FROM answer_cache
WHERE answer IS NOT NULL AND len(citations) > 0 AND CASE lower(trim(confidence)) WHEN 'low' THEN 0 WHEN 'high' THEN 2 ELSE 1 END >= 1""")
def cache_eligible(spark, d):
    level = F.lower(F.trim("confidence"))
    c = table(spark, d, "answer_cache").withColumn("rank", F.when(level == "low", 0).when(level == "high", 2).otherwise(1).cast("int"))
    return c.where((F.size("citations") > 0) & F.col("answer").isNotNull() & (F.col("rank") >= 1)).select("id", "rank")


@query("""SELECT DISTINCT id FROM (SELECT id, unnest(source_page_ids) AS page_id FROM answer_cache WHERE NOT curated) WHERE page_id IN (SELECT page_id FROM pages WHERE NOT indexable)""")
def cache_invalidate(spark, d):
    changed = table(spark, d, "pages").where("not indexable").select("page_id")
    return table(spark, d, "answer_cache").where("not curated").select("id", F.explode("source_page_ids").alias("page_id")).join(changed, "page_id", "left_semi").select("id").distinct()


@query(f"""WITH {ASKED}, cache AS (SELECT id, embedding::DOUBLE[] AS e FROM answer_cache WHERE enabled AND len(embedding) = 64 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 AND NOT isnan(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))),
logged AS (SELECT id AS qid, embedding::DOUBLE[] AS e FROM questions WHERE id % 20 = 0 AND len(embedding) = 64 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 AND NOT isnan(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))
SELECT qid, CAST(id AS VARCHAR) AS hit, round(s, 5) AS score FROM (SELECT qid, id, round(list_cosine_similarity(l.e, c.e), 9) AS s FROM logged l, cache c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, CAST(id AS VARCHAR)) = 1) WHERE s >= 0.4""")
def cache_lookup(spark, d):
    asked = retrieval.usable(table(spark, d, "questions").where("id % 20 = 0")).withColumnRenamed("id", "qid")
    cache = retrieval.usable(table(spark, d, "answer_cache").where("enabled")).withColumn("hit", F.col("id").cast("string"))
    top = retrieval.pooled_topk(asked, cache, 1, "hit")
    return retrieval.threshold_gate(top, 0.4).select("qid", "hit", F.round("score", 5).alias("score"))


# --- evaluation reports --------------------------------------------------------------------------------------------
OUT = "o AS (SELECT DISTINCT * FROM outcomes)"


@query(f"""WITH {OUT} SELECT coalesce(kind, 'all') AS kind, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(avg(said_not_found::INT), 6) AS not_found_rate, round(avg(pages), 6) AS avg_pages, CAST(sum(input_tokens) AS BIGINT) AS input_tokens
FROM o GROUP BY GROUPING SETS ((kind), ())""")
def outcome_report(spark, d):
    o = table(spark, d, "outcomes").distinct().groupingSets([["kind"], []], "kind")
    return o.agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"), F.round(F.avg(F.col("said_not_found").cast("int")), 6).alias("not_found_rate"), F.round(F.avg("pages"), 6).alias("avg_pages"), F.sum("input_tokens").alias("input_tokens")
    ).withColumn("kind", F.coalesce("kind", F.lit("all")))


@query(f"""WITH {OUT} SELECT kind, count(*) FILTER (kind = 'null_query' AND said_not_found) AS honest, count(*) FILTER (kind <> 'null_query' AND said_not_found) AS coward, count(*) FILTER (correct IS NULL) AS unscored FROM o GROUP BY 1""")
def honesty_report(spark, d):
    null_kind = F.col("kind") == "null_query"
    return table(spark, d, "outcomes").distinct().groupBy("kind").agg(F.count_if(null_kind & F.col("said_not_found")).alias("honest"), F.count_if(~null_kind & F.col("said_not_found")).alias("coward"), F.count_if(F.col("correct").isNull()).alias("unscored"))


@query(f"WITH {OUT} SELECT confidence, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(input_tokens * 0.3 + coalesce(output_tokens, 0) * 2.5) / 1000000, 6) AS usd FROM o GROUP BY 1")
def token_meter(spark, d):
    usd = F.round(F.sum(F.col("input_tokens") * 0.3 + F.coalesce("output_tokens", F.lit(0)) * 2.5) / 1_000_000, 6)
    return table(spark, d, "outcomes").distinct().groupBy("confidence").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), usd.alias("usd"))


@query(f"""WITH {OUT}, n AS (SELECT count(*) AS n FROM o), k AS (SELECT kind, greatest(1, round(200 * count(*) / any_value(n))) AS share FROM o, n GROUP BY 1)
SELECT id, kind FROM o JOIN k USING (kind) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY md5(CAST(id AS VARCHAR) || '#13'), id) <= share""")
def stratified_sample(spark, d):
    return metrics.stratified(table(spark, d, "outcomes").distinct(), "kind", "id", 200, 13).select("id", "kind")


@query("SELECT lower(trim(source)) AS source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (text IS NULL OR trim(text) = '') AS blank FROM documents GROUP BY 1")
def document_sources(spark, d):
    return table(spark, d, "documents").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("blank"))


@query("SELECT text, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def document_copies(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy("text").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


# --- selection -----------------------------------------------------------------------------------------------------
@query(r"""WITH p AS (SELECT page_id, string_split(regexp_replace(min(markdown), '\r\n?', chr(10), 'g'), chr(10)) AS x FROM pages WHERE page_id IS NOT NULL GROUP BY 1),
l AS (SELECT page_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS i FROM p),
f AS (SELECT *, sum(regexp_matches(line, '^\s*(```|~~~)')::INT) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) % 2 = 1 AS inside FROM l),
h AS (SELECT *, NOT inside AND regexp_matches(line, '^#{1,6} \S') AS heading FROM f),
o AS (SELECT *, sum(heading::INT) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS ord FROM h)
SELECT page_id, CAST(ord AS BIGINT) AS ord, coalesce(max(trim(regexp_replace(line, '^#+ |\s+#+\s*$', '', 'g'))) FILTER (heading), '(opening)') AS title, string_agg(line, chr(10) ORDER BY i) AS body
FROM o GROUP BY page_id, ord HAVING ord > 0 OR trim(string_agg(line, chr(10) ORDER BY i)) <> ''""")
def heading_sections(spark, d):
    return _long(selection.heading_sections(_bodies(spark, d), "page_id", "markdown"), "ord")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "trajectories").where(f"{EVERY} and query is not null").select(F.col("id").alias("qid"), "query").distinct()
    return selection.question_parts(asked)


def _covered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ranks = cut(_lexical(spark, d, which=EVERY).select("qid", "page_id", "rank"), "ranks")
    words = _bodies(spark, d).select("page_id", T.content_words(F.col("markdown")).alias("words"))
    return selection.covered_pages(_parts(spark, d), ranks, words), ranks


def words_sql(x: str) -> str:
    return f"list_filter(list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1)), lambda w: w NOT IN ({STOPS}))"


PARTS = f"""asked AS ({EVERY_LOGGED} AND query IS NOT NULL),
split AS (SELECT qid, query, list_filter(list_transform(regexp_split_to_array(regexp_replace(query, '(?i)\\s(còn|và|hoặc)\\s', ' ; ', 'g'), '(?i)\\s*(?:[;?—]|\\b(?:and|or|but|versus|vs|as well as)\\b)\\s*'), lambda x: trim(x)), lambda x: length(x) > 0) AS x FROM asked),
piece AS (SELECT qid, unnest(x) AS t, unnest(range(0, len(x))) AS part FROM split),
good AS (SELECT qid, part, {words_sql("t")} AS words FROM piece WHERE len({words_sql("t")}) >= 2),
parts AS (SELECT * FROM good UNION ALL SELECT qid, 0, {words_sql("query")} FROM asked WHERE qid NOT IN (SELECT qid FROM good) AND len({words_sql("query")}) > 0),
has AS (SELECT doc AS page_id, {words_sql("body")} AS words FROM ({BODIES})),"""


@query("WITH " + PARTS + bm25_sql("b", EVERY_LOGGED, BODIES, 10) + """
SELECT qid, CAST(part AS INT) AS part, page_id FROM parts JOIN b USING (qid) JOIN has ON has.page_id = b.doc WHERE 2 * len(list_intersect(parts.words, has.words)) >= len(parts.words)""")
def coverage_map(spark, d):
    """The parts of every logged query and those of its ten best pages that cover them."""
    return _covered(spark, d)[0]


@query()
def set_cover(spark, d):
    """Three of its ten best pages for every logged query, each the one that covers most parts still open."""
    covered, ranks = _covered(spark, d)
    return selection.greedy_cover(cut(covered, "covered"), ranks)


# --- containers of vectors -----------------------------------------------------------------------------------------
UNIT = """rows_ AS (SELECT id, page_id, book_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM questions WHERE book_id IS NOT NULL AND len(embedding) = 64
    AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 AND NOT isnan(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))),
unit AS (SELECT id, page_id, book_id, i, e[CAST(i AS BIGINT)] / n AS x FROM rows_, range(1, 65) t(i)),
books AS (SELECT book_id, i, sum(x) AS s, count(*) AS c FROM unit GROUP BY ALL)"""


def _unit(spark: SparkSession, d: str) -> DataFrame:
    rows = retrieval.usable(table(spark, d, "questions").where("book_id is not null"))
    return rows.select("id", "page_id", "book_id", probes.unit(F.col("embedding")).alias("u"))


@query(f"WITH {UNIT} SELECT book_id, max(c) AS n_rows, round(sqrt(sum((s / c) * (s / c))), 6) AS tightness FROM books GROUP BY 1")
def book_tightness(spark, d):
    """Length of the mean unit vector of each book: 1 if all its rows point one way."""
    sums = _unit(spark, d).select("book_id", F.posexplode("u").alias("i", "x")).groupBy("book_id", "i").agg(F.avg("x").alias("m"), F.count("*").alias("c"))
    return sums.groupBy("book_id").agg(F.max("c").alias("n_rows"), F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 6).alias("tightness"))


@query(f"WITH {UNIT} SELECT id, u.book_id, round(sum(x * (s - x)) / sqrt(sum((s - x) * (s - x))), 5) AS own_cosine FROM unit u JOIN books b ON u.book_id = b.book_id AND u.i = b.i WHERE c > 1 AND id % 20 = 0 GROUP BY ALL")
def leave_one_out_own_book(spark, d):
    """Cosine of every twentieth row with the centroid of its book without that row; books of one row are skipped."""
    return _own_cosine(spark, d, "id % 20 = 0")


@query()
def own_book_of_every_row(spark, d):
    """The same for every row; without SQL, tested by brute force."""
    return _own_cosine(spark, d, "true")


def _own_cosine(spark: SparkSession, d: str, asked: str) -> DataFrame:
    unit = _unit(spark, d)
    sums = unit.select("book_id", F.posexplode("u").alias("i", "x")).groupBy("book_id", "i").agg(F.sum("x").alias("s"), F.count("*").alias("c"))
    centroid = sums.groupBy("book_id").agg(F.max("c").alias("c"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda t: t["s"]).alias("s")).where("c > 1")
    joined = unit.where(asked).join(centroid, "book_id").withColumn("rest", F.zip_with("s", "u", lambda a, b: a - b))
    dot = F.aggregate(F.zip_with("u", "rest", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate("rest", F.lit(0.0), lambda a, x: a + x * x))
    return joined.select("id", "book_id", F.round(F.try_divide(dot, norm), 5).alias("own_cosine"))


# --- the log as a stream -------------------------------------------------------------------------------------------
@query("SELECT date_trunc('day', created_at) AS start, status, count(*) AS queries, CAST(sum(hops) AS BIGINT) AS hops FROM trajectories GROUP BY ALL")
def streamed_status(spark, d):
    log_table = table(spark, d, "trajectories")
    return log.run_windowed_status(spark, f"{d}/trajectories.parquet", log_table.schema).withColumn("start", F.col("start").cast("timestamp_ntz"))
