"""Registered probes of the catalog, reports on selections, document splitting and upkeep of the stores, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeline.functions import text as T
from tomeline.operators import metrics, probes, retrieval, splitting
from tomeline.plans import queries as base
from tomeline.plans.queries import LOG, MSG, PATHS, POOL, REQUIRED, UNIT, _gold, _lexical, _log, _long, _messages, _pool, query
from tomeline.session import cut, table

GOLD = base.GOLD
GOOD = "len(embedding) = 64 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 AND NOT isnan(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))"


# --- recall with the asker's own intent left out --------------------------------------------------------------------
def _loi_sql(level: str, which: str) -> str:
    return f"""WITH r AS (SELECT *, page_id || '#' || ((row_number() OVER (PARTITION BY page_id ORDER BY id) - 1) // 2) AS mask FROM questions WHERE kind = 'question' AND page_id IS NOT NULL),
g AS (SELECT id, {level} AS grp, mask, embedding::DOUBLE[] AS e FROM r WHERE {level} IS NOT NULL AND {GOOD}),
best AS (SELECT q.id AS qid, g.grp, g.grp = q.grp AS own, max(round(list_cosine_similarity(q.e, g.e), 9)) AS s FROM g q JOIN g ON q.mask <> g.mask WHERE q.{which} GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, grp) AS rank FROM best),
one AS (SELECT qid, count(*) AS n, min(rank) FILTER (own) AS place FROM ranked GROUP BY 1 HAVING count(*) >= 2)
SELECT count(*) AS n, {", ".join(f"round(avg((coalesce(place, 1000000) <= {k})::INT), 6) AS r{k}" for k in (1, 3, 5, 10, 20))} FROM one"""


def _loi(spark: SparkSession, d: str, level: str, which: str) -> DataFrame:
    rows = table(spark, d, "questions").where("kind = 'question' and page_id is not null")
    intent = F.floor((F.row_number().over(Window.partitionBy("page_id").orderBy("id")) - 1) / 2)
    rows = rows.withColumn("mask", F.concat("page_id", F.lit("#"), intent.cast("string"))).where(F.col(level).isNotNull())
    rows = retrieval.usable(rows).select("id", F.col(level).alias("grp"), "mask", "embedding")
    asked = rows.where(which).withColumnRenamed("id", "qid")
    return probes.recall_at(probes.masked_topk(asked, rows, 20), (1, 3, 5, 10, 20))


@query(_loi_sql("page_id", "id IS NOT NULL"))
def leave_intent_out_page_recall(spark, d):
    """Every question asks."""
    return _loi(spark, d, "page_id", base.EVERY)


@query(_loi_sql("book_id", "id % 20 = 0"))
def leave_intent_out_book_recall(spark, d):
    return _loi(spark, d, "book_id", "id % 20 = 0")


# --- separability of books ------------------------------------------------------------------------------------------
RACE = UNIT + """, own AS (SELECT id, u.book_id, round(sum(x * (s - x)) / sqrt(sum((s - x) * (s - x))), 6) AS own FROM unit u JOIN books b ON u.book_id = b.book_id AND u.i = b.i WHERE c > 1 AND id % 20 = 0 GROUP BY ALL),
other AS (SELECT id, b.book_id AS rival, round(sum(x * s) / sqrt(sum(s * s)), 6) AS s FROM unit u JOIN books b ON u.book_id <> b.book_id AND u.i = b.i WHERE id % 20 = 0 GROUP BY ALL),
top AS (SELECT id, rival, s FROM other QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, rival) = 1),
race AS (SELECT own.id, book_id, own, rival, s FROM own JOIN top USING (id) WHERE NOT isnan(own))"""


def _race(spark: SparkSession, d: str, which: str = "id % 20 = 0") -> DataFrame:
    """id, book_id, own, rival, s: cosine of each row asked for with its book's centroid without it, and the best other."""
    rows = retrieval.usable(table(spark, d, "questions").where("book_id is not null"))
    sums = cut(probes.centroids(rows, ["book_id"]), "books")
    asked = rows.where(which).withColumn("u", probes.unit(F.col("embedding")))
    rest = asked.join(sums.where("n > 1").select("book_id", F.col("embedding").alias("s")), "book_id").withColumn("rest", F.zip_with("s", "u", lambda a, b: a - b))
    dot = F.aggregate(F.zip_with("u", "rest", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate("rest", F.lit(0.0), lambda a, x: a + x * x))
    own = rest.select("id", "book_id", F.round(F.try_divide(dot, norm), 6).alias("own")).where("own is not null")
    near = retrieval.pooled_topk(asked.withColumnRenamed("id", "qid"), sums.withColumn("id", F.xxhash64("book_id")), 3, "book_id")
    near = near.select(F.col("qid").alias("id"), F.col("book_id").alias("rival"), F.round("score", 6).alias("s"))
    best = own.join(near, "id").where("rival <> book_id").groupBy("id", "book_id", "own").agg(F.min(F.struct((-F.col("s")).alias("m"), "rival")).alias("b"))
    return best.select("id", "book_id", "own", F.col("b.rival").alias("rival"), (-F.col("b.m")).alias("s"))


@query(f"WITH {RACE} SELECT book_id, count(*) AS n, count(*) FILTER (own > s) AS wins, round(avg(own - s), 3) AS margin FROM race GROUP BY 1")
def book_separability(spark, d):
    return _separability(_race(spark, d))


@query()
def book_separability_of_every_row(spark, d):
    """The same over all rows; without SQL, tested by brute force."""
    return _separability(_race(spark, d, "true"))


def _separability(race: DataFrame) -> DataFrame:
    return race.groupBy("book_id").agg(F.count("*").alias("n"), F.count_if(F.col("own") > F.col("s")).alias("wins"), F.round(F.avg(F.col("own") - F.col("s")), 3).alias("margin"))


@query(f"WITH {RACE} SELECT book_id, rival, count(*) AS n FROM race WHERE own <= s GROUP BY ALL ORDER BY n DESC, book_id, rival LIMIT 8")
def book_confusions(spark, d):
    return _confusions(_race(spark, d))


@query()
def book_confusions_of_every_row(spark, d):
    """The same over all rows; without SQL, tested by brute force."""
    return _confusions(_race(spark, d, "true"))


def _confusions(race: DataFrame) -> DataFrame:
    return race.where("own <= s").groupBy("book_id", "rival").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "book_id", "rival").limit(8)


# --- pages that another book pulls ----------------------------------------------------------------------------------
PULL = UNIT + """, cents AS (SELECT page_id, book_id, i, sum(x) AS s FROM unit WHERE page_id IS NOT NULL GROUP BY ALL),
cent AS (SELECT page_id, book_id, list(s ORDER BY i) AS e FROM cents GROUP BY ALL),
best AS (SELECT c.page_id, c.book_id, r.book_id AS b, max(round(list_cosine_similarity(c.e, r.e), 9)) AS s FROM cent c JOIN rows_ r ON r.page_id IS DISTINCT FROM c.page_id GROUP BY ALL),
own AS (SELECT page_id, book_id, s AS own_score FROM best WHERE b = book_id),
other AS (SELECT page_id, book_id, b AS best_book, s AS best_score FROM best WHERE b <> book_id QUALIFY row_number() OVER (PARTITION BY page_id, book_id ORDER BY s DESC, b) = 1),
pull AS (SELECT page_id, book_id, best_book, own_score, best_score FROM own JOIN other USING (page_id, book_id) WHERE best_score > own_score)"""


def _pull(spark: SparkSession, d: str) -> DataFrame:
    rows = retrieval.usable(table(spark, d, "questions").where("book_id is not null"))
    return probes.foreign_pull(probes.centroids(rows.where("page_id is not null"), ["page_id", "book_id"]), rows)


@query(f"WITH {PULL} SELECT page_id, book_id, best_book, round(best_score - own_score, 5) AS delta FROM pull")
def misshelved_pages(spark, d):
    return _pull(spark, d).select("page_id", "book_id", "best_book", F.round(F.col("best_score") - F.col("own_score"), 5).alias("delta"))


@query(f"WITH {PULL}, t AS (SELECT book_id, best_book, count(*) AS n FROM pull GROUP BY ALL) SELECT a.book_id AS one, a.best_book AS two, a.n AS taken_by_two, b.n AS taken_by_one FROM t a JOIN t b ON a.book_id = b.best_book AND a.best_book = b.book_id WHERE a.book_id < a.best_book")
def mutual_theft(spark, d):
    t = cut(_pull(spark, d).groupBy("book_id", "best_book").agg(F.count("*").alias("n")), "theft")
    back = t.select(F.col("book_id").alias("best_book"), F.col("best_book").alias("book_id"), F.col("n").alias("taken_by_one"))
    return t.where("book_id < best_book").join(back, ["book_id", "best_book"]).select(F.col("book_id").alias("one"), F.col("best_book").alias("two"), F.col("n").alias("taken_by_two"), "taken_by_one")


@query(f"""WITH {PATHS}, {PULL}, place AS (SELECT book_id, min(p[1]) AS domain, min(array_to_string(p[1:greatest(len(p) - 2, 1)], ' ▸ ')) AS shelf FROM paths WHERE book_id IS NOT NULL GROUP BY 1),
x AS (SELECT page_id, best_book, round(best_score - own_score, 5) AS delta FROM pull JOIN place a USING (book_id) JOIN place b ON best_book = b.book_id WHERE a.domain = b.domain AND a.shelf <> b.shelf AND round(best_score - own_score, 5) >= 0.03)
SELECT best_book, page_id, delta FROM x QUALIFY row_number() OVER (PARTITION BY best_book ORDER BY delta DESC, page_id) <= 3""")
def cross_links(spark, d):
    """Up to three pages a book that it should name: pulled to it from another shelf of its domain by 0.03 or more."""
    shelf = F.array_join(F.slice("p", F.lit(1), F.greatest(F.size("p") - 2, F.lit(1))), " ▸ ")
    place = base._paths(spark, d).where("book_id is not null").groupBy("book_id").agg(F.min(F.element_at("p", 1)).alias("domain"), F.min(shelf).alias("shelf"))
    target = place.select(F.col("book_id").alias("best_book"), F.col("domain").alias("to_domain"), F.col("shelf").alias("to_shelf"))
    x = _pull(spark, d).withColumn("delta", F.round(F.col("best_score") - F.col("own_score"), 5)).where("delta >= 0.03").join(place, "book_id").join(target, "best_book").where("domain = to_domain and shelf <> to_shelf")
    w = Window.partitionBy("best_book").orderBy(F.desc("delta"), "page_id")
    return x.withColumn("r", F.row_number().over(w)).where("r <= 3").select("best_book", "page_id", "delta")


# --- baskets --------------------------------------------------------------------------------------------------------
@query(REQUIRED + """, f AS (SELECT qid, ('0x' || substr(md5(CAST(qid AS VARCHAR)), 1, 6))::BIGINT % 5 AS fold, round(required, 6) AS required FROM required),
o AS (SELECT t.fold, f.required, row_number() OVER (PARTITION BY t.fold ORDER BY f.required) AS i, count(*) OVER (PARTITION BY t.fold) AS n FROM f JOIN (SELECT DISTINCT fold FROM f) t ON t.fold <> f.fold WHERE f.required IS NOT NULL),
th AS (SELECT fold, min(required) AS threshold FROM o WHERE i >= ceil((n + 1) * 0.9) GROUP BY 1)
SELECT fold, count(*) AS n, round(coalesce(any_value(threshold), 'inf'::DOUBLE), 5) AS threshold, count(*) FILTER (required <= coalesce(threshold, 'inf'::DOUBLE) + 1e-12) AS covered FROM f LEFT JOIN th USING (fold) GROUP BY 1""")
def cross_fit_coverage(spark, d):
    return probes.cross_fit(metrics.required_margin(_pool(spark, d), _gold(spark, d), "page_id"), 0.1).withColumn("threshold", F.round("threshold", 5))


@query(POOL + f""", {GOLD}, arms(arm, basket) AS (VALUES ('basket 3', 3), ('basket 5', 5), ('basket 10', 10)),
one AS (SELECT arm, qid, count(DISTINCT g.page_id) AS n_gold, count(p.page_id) AS reachable, count(*) FILTER (p.rank <= basket) AS tp FROM gold g CROSS JOIN arms LEFT JOIN pool p USING (qid, page_id) GROUP BY ALL),
taken AS (SELECT arm, qid, count(*) FILTER (rank <= basket) AS taken FROM pool, arms GROUP BY ALL),
conf AS (SELECT id AS qid, coalesce(lower(trim(confidence)), 'none') AS confidence FROM answer_cache)
SELECT arm, coalesce(confidence, 'all') AS confidence, count(*) AS n, round(avg((tp > 0)::INT), 6) AS hit, round(avg(tp / n_gold), 6) AS coverage, round(avg((tp = n_gold)::INT), 6) AS allgold, round(avg(tp / reachable) FILTER (reachable > 0), 6) AS retention, round(avg(reachable / n_gold), 6) AS ceiling, round(avg(tp / taken), 6) AS precision
FROM one JOIN taken USING (arm, qid) JOIN conf USING (qid) GROUP BY GROUPING SETS ((arm, confidence), (arm))""")
def selection_report(spark, d):
    """Baskets of the first 3, 5 and 10 pages against the sources of the cached answers, by confidence and in all."""
    pool = cut(_pool(spark, d).select("qid", "page_id", "rank"), "pool")
    arms = F.explode(F.array(*[F.lit(k) for k in (3, 5, 10)]))
    within = F.count_if(F.col("rank") <= F.col("basket"))
    one = _gold(spark, d).join(pool, ["qid", "page_id"], "left").withColumn("basket", arms).groupBy("basket", "qid").agg(F.count("*").alias("n_gold"), F.count("rank").alias("reachable"), within.alias("tp"))
    taken = pool.withColumn("basket", arms).groupBy("basket", "qid").agg(within.alias("taken"))
    conf = table(spark, d, "answer_cache").select(F.col("id").alias("qid"), F.coalesce(F.lower(F.trim("confidence")), F.lit("none")).alias("confidence"))
    rows = one.join(taken, ["basket", "qid"]).join(conf, "qid").withColumn("arm", F.concat(F.lit("basket "), F.col("basket").cast("string")))
    mean = lambda x, name: F.round(F.avg(x), 6).alias(name)
    tp, gold = F.col("tp"), F.col("n_gold")
    return rows.groupingSets([["arm", "confidence"], ["arm"]], "arm", "confidence").agg(
        F.count("*").alias("n"), mean((tp > 0).cast("int"), "hit"), mean(tp / gold, "coverage"), mean((tp == gold).cast("int"), "allgold"), mean(F.try_divide(tp, F.col("reachable")), "retention"), mean(F.col("reachable") / gold, "ceiling"), mean(F.try_divide(tp, F.col("taken")), "precision")
    ).withColumn("confidence", F.coalesce("confidence", F.lit("all")))


@query(POOL + f""", {GOLD}, {base.bm25_sql("b", "SELECT id AS qid, query FROM answer_cache WHERE id % 20 = 0", base.BODIES, 20)},
found AS (SELECT g.qid, (p.page_id IS NOT NULL)::INT AS dense, (b.doc IS NOT NULL)::INT AS lexical FROM gold g LEFT JOIN pool p ON p.qid = g.qid AND p.page_id = g.page_id LEFT JOIN b ON b.qid = g.qid AND b.doc = g.page_id),
one AS (SELECT qid, count(*) AS gold, sum(dense) AS dense, sum(lexical) AS lexical, count(*) FILTER (dense = 0 AND lexical = 1) AS only_ FROM found GROUP BY 1)
SELECT CAST(sum(gold) AS BIGINT) AS gold, CAST(sum(dense) AS BIGINT) AS dense, CAST(sum(lexical) AS BIGINT) AS lexical, CAST(sum(only_) AS BIGINT) AS lexical_only, count(*) FILTER (dense = 0) AS blind, count(*) FILTER (dense = 0 AND lexical > 0) AS rescued FROM one""")
def complementarity(spark, d):
    """Sources of cached answers that the dense list finds, that BM25 finds, and that only BM25 finds; and the questions
    the dense list misses altogether that BM25 rescues."""
    dense, gold = _pool(spark, d).select("qid", "page_id", F.lit(1).alias("dense")), _gold(spark, d)
    docs = base._bodies(spark, d)
    asked = table(spark, d, "answer_cache").where("id % 20 = 0").select(F.col("id").alias("qid"), "query")
    words = base.lexical.bm25(asked, docs, "page_id", "markdown", 20).select("qid", F.col("doc").alias("page_id"), F.lit(1).alias("lexical"))
    found = gold.join(dense, ["qid", "page_id"], "left").join(words, ["qid", "page_id"], "left").fillna(0, ["dense", "lexical"])
    by_query = found.groupBy("qid").agg(F.count("*").alias("gold"), F.sum("dense").alias("dense"), F.sum("lexical").alias("lexical"), F.count_if((F.col("dense") == 0) & (F.col("lexical") == 1)).alias("only"))
    blind = F.col("dense") == 0
    return by_query.agg(F.sum("gold").alias("gold"), F.sum("dense").alias("dense"), F.sum("lexical").alias("lexical"), F.sum("only").alias("lexical_only"), F.count_if(blind).alias("blind"), F.count_if(blind & (F.col("lexical") > 0)).alias("rescued"))


@query(POOL + f""", title AS (SELECT page_id, min(title) AS title, min(length(markdown) // 4) AS tokens FROM pages GROUP BY 1), place AS (SELECT page_id, min(path) AS path FROM questions WHERE path <> '' GROUP BY 1)
SELECT qid, page_id, rank, title, path, CAST(tokens AS BIGINT) AS tokens FROM pool JOIN title USING (page_id) JOIN place USING (page_id) WHERE rank <= 10""")
def page_cards(spark, d):
    """The cards of the first ten pages of each question: title, path and tokens; hits without page or path fall out."""
    title = table(spark, d, "pages").groupBy("page_id").agg(F.min("title").alias("title"), F.min(T.token_estimate(F.col("markdown"))).alias("tokens"))
    place = table(spark, d, "questions").where("path <> ''").groupBy("page_id").agg(F.min("path").alias("path"))
    return _long(_pool(spark, d).where("rank <= 10").join(title, "page_id").join(place, "page_id").select("qid", "page_id", "rank", "title", "path", "tokens"), "rank", "tokens")


# --- splitting ------------------------------------------------------------------------------------------------------
@query()
def document_pages(spark, d):
    docs = table(spark, d, "documents")
    return splitting.split_pages(docs, "doc_id", "title", "text", True)


@query()
def bounded_pages(spark, d):
    pages = table(spark, d, "pages").where("page_id is not null").groupBy("page_id").agg(F.min(F.struct("title", "markdown")).alias("p")).select("page_id", "p.title", "p.markdown")
    return splitting.split_pages(pages, "page_id", "title", "markdown", False)


@query()
def question_passages(spark, d):
    """The lines of its three best pages that answer every logged query."""
    ranks = _lexical(spark, d, k=3, which=base.EVERY).select("qid", "page_id")
    asked = table(spark, d, "trajectories").where(f"{base.EVERY} and query is not null").select(F.col("id").alias("qid"), "query").distinct()
    pages = table(spark, d, "pages").where("page_id is not null").groupBy("page_id").agg(F.min("markdown").alias("markdown"))
    return splitting.passages(asked, ranks, 3, pages=pages)


@query("""WITH p AS (SELECT DISTINCT page_id, title, markdown FROM pages WHERE page_id IS NOT NULL AND markdown IS NOT NULL), s AS (SELECT DISTINCT page_id, ord, title, body FROM sections WHERE page_id IS NOT NULL AND body IS NOT NULL)
SELECT 'text' AS arm, page_id, -1 AS ord, CAST(least(length(concat_ws(chr(10) || chr(10), title, markdown)), 8000) AS BIGINT) AS chars FROM p
UNION ALL SELECT 'sections', page_id, ord, CAST(least(length(concat_ws(chr(10) || chr(10), title, body)), 8000) AS BIGINT) FROM s""")
def index_arms(spark, d):
    """The rows of the text and section indexes with the length of what would be embedded, 8,000 characters at most."""
    size = lambda body: F.least(F.length(F.concat_ws("\n\n", "title", body)), F.lit(8_000)).cast("long").alias("chars")
    p = table(spark, d, "pages").where("page_id is not null and markdown is not null").select("page_id", "title", "markdown").distinct()
    s = table(spark, d, "sections").where("page_id is not null and body is not null").select("page_id", "ord", "title", "body").distinct()
    return p.select(F.lit("text").alias("arm"), "page_id", F.lit(-1).alias("ord"), size("markdown")).unionByName(s.select(F.lit("sections").alias("arm"), "page_id", "ord", size("body")))


# --- upkeep of the stores -------------------------------------------------------------------------------------------
@query(f"""WITH {MSG}, w AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC NULLS LAST, id DESC) AS back FROM m WHERE conversation_id IS NOT NULL)
SELECT conversation_id, string_agg(coalesce(lower(trim(role)), '?') || ': ' || substr(coalesce(text, ''), 1, 400), chr(10) ORDER BY back DESC) AS history FROM w WHERE back <= 6 GROUP BY 1""")
def follow_up_history(spark, d):
    """What a follow-up question is read with: the last six turns in order, 400 characters of each."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc_nulls_last("turn"), F.desc("id"))
    last = _messages(spark, d).where("conversation_id is not null").withColumn("back", F.row_number().over(w)).where("back <= 6")
    line = F.concat(F.coalesce(F.lower(F.trim("role")), F.lit("?")), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, 400))
    return last.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("b"), line.alias("line")))).alias("l")).select("conversation_id", F.array_join("l.line", "\n").alias("history"))


@query(f"""WITH {LOG}, c AS (SELECT * FROM log WHERE status = 'answered' AND NOT indexed ORDER BY id LIMIT 400), taken AS (SELECT id FROM c WHERE len(page_ids) = 1 ORDER BY id LIMIT 100)
SELECT id, indexed OR id IN (SELECT id FROM taken) AS indexed FROM log""")
def log_marked(spark, d):
    """The log rewritten after a harvest: the rows taken count as indexed."""
    taken = base.harvest_candidates(spark, d).select("id", F.lit(True).alias("taken"))
    return _log(spark, d).join(taken, "id", "left").select("id", (F.col("indexed") | F.coalesce("taken", F.lit(False))).alias("indexed"))


@query("""WITH s AS (SELECT DISTINCT book_id, lower(trim(s.title)) AS title FROM sections s JOIN (SELECT DISTINCT page_id, book_id FROM pages) p USING (page_id) WHERE trim(s.title) <> '' AND book_id IS NOT NULL)
SELECT book_id, title FROM s WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.book_id = s.book_id AND lower(trim(p.title)) = s.title)""")
def new_titles(spark, d):
    """Section titles that no page of the book bears yet: what a repeated import would add."""
    key = F.lower(F.trim("title")).alias("title")
    pages = table(spark, d, "pages")
    s = table(spark, d, "sections").where("trim(title) <> ''").select("page_id", key).join(pages.where("book_id is not null").select("page_id", "book_id").distinct(), "page_id").select("book_id", "title").distinct()
    return s.join(pages.select("book_id", key), ["book_id", "title"], "left_anti")


@query("""SELECT hour(created_at) AS hour, kind, count(*) AS n FROM trajectories, LATERAL (SELECT unnest(list_filter(list_transform(route, lambda r: r.kind), lambda k: k IS NOT NULL)) AS kind) GROUP BY ALL""")
def route_kinds_by_hour(spark, d):
    steps = table(spark, d, "trajectories").select(F.hour("created_at").cast("long").alias("hour"), F.explode("route").alias("r"))
    return steps.where("r.kind is not null").groupBy("hour", F.col("r.kind").alias("kind")).agg(F.count("*").alias("n"))
