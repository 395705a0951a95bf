"""Registered queries of hybrid search, of search inside candidate pages, of resolution and of reports over arms, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeline.functions import text as T
from tomeline.operators import lexical, resolve, retrieval
from tomeline.plans import queries as base
from tomeline.plans.queries import BODIES, EVERY, EVERY_LOGGED, GOLD, LOG, LOGGED, PATHS, POOL, _bodies, _gold, _lexical, _log, _long, _pool, bm25_sql, fused_sql, query, words_sql
from tomeline.session import cut, table

CACHED = "SELECT id AS qid, query FROM answer_cache WHERE id % 20 = 0"


# --- hybrid search ---------------------------------------------------------------------------------------------------
def _cached(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "answer_cache").where("id % 20 = 0").select(F.col("id").alias("qid"), "query")


def _hybrid(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Dense and BM25 lists of 2 k pages for each twentieth cached question, fused by rank; a question that one of them
    cannot answer keeps the other's order."""
    words = lexical.bm25(_cached(spark, d), _bodies(spark, d), "page_id", "markdown", 2 * k).withColumnRenamed("doc", "page_id")
    return retrieval.fuse([_pool(spark, d, 2 * k), words], "page_id", k)


HYBRID = POOL + ", " + bm25_sql("b", CACHED, BODIES, 20) + ", " + fused_sql("f", ("SELECT qid, page_id, rank FROM pool", "SELECT qid, doc AS page_id, rank FROM b"), 10)


@query(HYBRID + " SELECT qid, page_id, round(score, 6) AS score, rank FROM f")
def hybrid_topk(spark, d):
    return _long(_hybrid(spark, d, 10).select("qid", "page_id", F.round("score", 6).alias("score"), "rank"), "rank")


DEEP = POOL.replace("rank <= 20", "rank <= 200")


@query(DEEP + ", " + bm25_sql("b", CACHED, BODIES, 200) + ", " + fused_sql("f", ("SELECT qid, page_id, rank FROM pool", "SELECT qid, doc AS page_id, rank FROM b"), 100) + f""", {GOLD},
ranked AS (SELECT 'dense' AS arm, qid, page_id, rank FROM pool WHERE rank <= 100 UNION ALL SELECT 'lexical', qid, doc, rank FROM b WHERE rank <= 100 UNION ALL SELECT 'hybrid', qid, page_id, rank FROM f),
ks(k) AS (VALUES (1), (3), (10), (100)), arms(arm) AS (VALUES ('dense'), ('lexical'), ('hybrid')), sized AS (SELECT qid, count(*) AS n FROM gold GROUP BY 1),
hits AS (SELECT arm, k, qid, count(*) AS tp, sum(1 / log2(rank + 1)) AS dcg FROM ranked JOIN gold USING (qid, page_id), ks WHERE rank <= k GROUP BY ALL),
ideal AS (SELECT k, qid, n, sum(1 / log2(i + 1)) AS best FROM (SELECT *, unnest(range(1, least(n, k) + 1)) AS i FROM sized, ks) GROUP BY ALL)
SELECT arm, k, count(*) AS n, round(avg(coalesce(dcg, 0) / best), 5) AS ndcg, round(avg(coalesce(tp, 0) / n), 5) AS recall, round(avg((coalesce(tp, 0) > 0)::INT), 5) AS hit FROM ideal CROSS JOIN arms LEFT JOIN hits USING (arm, k, qid) GROUP BY ALL""")
def ranking_report(spark, d):
    """Means of nDCG, recall and hits at 1, 3, 10 and 100 of the dense, the lexical and the fused list."""
    dense = cut(_pool(spark, d, 200).select("qid", "page_id", "rank"), "dense")
    words = cut(lexical.bm25(_cached(spark, d), _bodies(spark, d), "page_id", "markdown", 200).select("qid", F.col("doc").alias("page_id"), "rank"), "lexical")
    fused = retrieval.fuse([dense, words], "page_id", 100)
    arms = {"dense": dense, "lexical": words, "hybrid": fused}
    ranked = None
    for name, one in arms.items():
        part = one.where("rank <= 100").select(F.lit(name).alias("arm"), "qid", "page_id", "rank")
        ranked = part if ranked is None else ranked.unionByName(part)
    gold = cut(_gold(spark, d), "gold")
    levels = F.explode(F.array(*[F.lit(k) for k in (1, 3, 10, 100)])).alias("k")
    names = F.explode(F.array(*[F.lit(a) for a in arms])).alias("arm")
    hits = ranked.join(gold, ["qid", "page_id"]).select("*", levels).where("rank <= k").groupBy("arm", "k", "qid").agg(F.count("*").alias("tp"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    sized = gold.groupBy("qid").agg(F.count("*").alias("size")).select("*", levels).select("*", names)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("size", "k").cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    one = sized.join(hits, ["arm", "k", "qid"], "left").withColumns({"tp": F.coalesce("tp", F.lit(0)), "dcg": F.coalesce("dcg", F.lit(0.0)), "best": ideal})
    mean = lambda x, name: F.round(F.avg(x), 5).alias(name)
    return one.groupBy("arm", "k").agg(F.count("*").alias("n"), mean(F.col("dcg") / F.col("best"), "ndcg"), mean(F.col("tp") / F.col("size"), "recall"), mean((F.col("tp") > 0).cast("int"), "hit"))


# --- inside candidate pages ------------------------------------------------------------------------------------------
SECTION = "sec AS (SELECT DISTINCT page_id, ord, title, body FROM sections WHERE page_id IS NOT NULL)"


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").where("page_id is not null").select("page_id", "ord", "title", "body").distinct()


def _asked(spark: SparkSession, d: str, which: str = "id % 20 = 0") -> DataFrame:
    return table(spark, d, "trajectories").where(f"{which} and query is not null").select(F.col("id").alias("qid"), "query").distinct()


def relevant_sql(logged: str) -> str:
    return "WITH " + bm25_sql("b", logged, BODIES, 3) + f""", {SECTION}, asked AS ({logged} AND query IS NOT NULL),
hit AS (SELECT qid, page_id, ord, title, len(list_intersect({words_sql("query")}, {words_sql("body")})) AS hits FROM b JOIN asked USING (qid) JOIN sec ON page_id = doc WHERE trim(title) <> '' AND body IS NOT NULL),
rel AS (SELECT qid, page_id, ord, title, row_number() OVER (PARTITION BY qid, page_id ORDER BY hits DESC, ord, title) AS place FROM hit WHERE hits > 0 QUALIFY place <= 3)"""


@query(relevant_sql(EVERY_LOGGED) + " SELECT qid, page_id, ord, title, place FROM rel")
def relevant_section_titles(spark, d):
    """The titles of the sections of its three best pages that bear on every logged query."""
    found = resolve.relevant_sections(_asked(spark, d, EVERY), _lexical(spark, d, k=3, which=EVERY).select("qid", "page_id"), _sections(spark, d))
    return _long(found, "place")


@query(relevant_sql(LOGGED) + """, part AS (SELECT b.qid, sec.page_id, sec.ord, lower(trim(sec.title)) AS key, length(sec.body) // 4 AS tokens FROM b JOIN sec ON sec.page_id = b.doc WHERE sec.body IS NOT NULL),
mark AS (SELECT *, EXISTS (SELECT 1 FROM rel r WHERE r.qid = part.qid AND r.page_id = part.page_id AND lower(trim(r.title)) = part.key) AS named FROM part),
chosen AS (SELECT *, bool_or(named) OVER (PARTITION BY qid, page_id) AS found_any FROM mark),
run AS (SELECT *, sum(tokens) OVER w AS upto, count(*) OVER w AS i FROM chosen WHERE named OR NOT found_any WINDOW w AS (PARTITION BY qid, page_id ORDER BY ord, key ROWS UNBOUNDED PRECEDING))
SELECT qid, page_id, ord, CAST(tokens AS BIGINT) AS tokens FROM run WHERE i = 1 OR upto <= 4000""")
def open_basket(spark, d):
    """The sections read for each twentieth logged query: the relevant ones of its three best pages within 4,000 tokens."""
    pages = cut(_lexical(spark, d, k=3).select("qid", "page_id"), "basket")
    sections = _sections(spark, d)
    wanted = resolve.relevant_sections(_asked(spark, d), pages, sections)
    return _long(resolve.picked_sections(pages, wanted, sections), "tokens")


@query("WITH " + bm25_sql("b", LOGGED, BODIES, 10) + f""", {SECTION}, asked AS ({LOGGED} AND query IS NOT NULL),
pat AS (SELECT qid, list_sort({words_sql("query")})[1] AS p FROM asked),
hit AS (SELECT b.qid, b.rank, sec.page_id, sec.ord, list_filter(list_transform(regexp_split_to_array(sec.body, '\\r\\n|\\r|\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 3 AND contains(lower(x), p))[1] AS line FROM b JOIN pat USING (qid) JOIN sec ON sec.page_id = b.doc WHERE p IS NOT NULL)
SELECT qid, page_id, ord, CASE WHEN length(line) > 200 THEN rtrim(line[:199]) || '…' ELSE line END AS line, row_number() OVER (PARTITION BY qid ORDER BY rank, page_id, ord, line) AS place FROM hit WHERE line IS NOT NULL QUALIFY place <= 40""")
def grep_in_candidates(spark, d):
    """The first content word (by the alphabet) of each twentieth logged query, looked up in the sections of its ten best pages."""
    word = F.try_element_at(F.array_sort(T.content_words(F.col("query"))), F.lit(1))
    patterns = _asked(spark, d).select("qid", word.alias("pattern")).where("pattern is not null")
    return _long(resolve.find_in_candidates(patterns, _lexical(spark, d).select("qid", "page_id", "rank"), _sections(spark, d)), "place")


# --- titles and paths ------------------------------------------------------------------------------------------------
STEPS = "(SELECT DISTINCT unnest(list_transform(route, lambda r: r.title)) AS x FROM trajectories WHERE id % 20 = 0)"


def _route_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "trajectories").where("id % 20 = 0").select(F.explode("route.title").alias("asked")).distinct()


@query(f"""WITH a AS (SELECT DISTINCT lower(trim(x)) AS asked FROM {STEPS} WHERE trim(x) <> ''), t AS (SELECT DISTINCT lower(trim(title)) AS title FROM pages WHERE trim(title) <> ''),
m AS (SELECT asked, title, round(CASE WHEN asked = title THEN 1 WHEN starts_with(title, asked) OR starts_with(asked, title) THEN 0.95 ELSE 1 - levenshtein(asked, title) / greatest(length(asked), length(title)) END, 6) AS score FROM a, t)
SELECT asked, title, CAST(score AS DOUBLE) AS score FROM m WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY asked ORDER BY score DESC, title) = 1""")
def resolved_titles(spark, d):
    """The page title most like each title on the routes of every twentieth logged query."""
    return resolve.closest_titles(_route_titles(spark, d), table(spark, d, "pages").select("title"))


@query(f"""WITH a AS (SELECT DISTINCT lower(trim(regexp_replace(trim(x), '^"+|"+$', '', 'g'))) AS asked FROM (SELECT path AS x FROM trajectories WHERE id % 20 = 0 UNION ALL SELECT x FROM {STEPS})),
p AS (SELECT DISTINCT lower(path) AS path FROM questions WHERE path <> ''),
e AS (SELECT path, array_to_string(string_split(path, ' ▸ ')[i:], ' ▸ ') AS tail FROM (SELECT path, unnest(range(1, len(string_split(path, ' ▸ ')) + 1)) AS i FROM p))
SELECT asked, min(path) AS path FROM (SELECT asked, path FROM a JOIN e ON asked = tail UNION ALL SELECT asked, path FROM a JOIN p ON string_split(asked, ' ▸ ')[-1] = string_split(path, ' ▸ ')[-1]) WHERE asked <> '' GROUP BY 1""")
def resolved_paths(spark, d):
    """The path that each path or title logged with every twentieth query stands for."""
    logged = table(spark, d, "trajectories").where("id % 20 = 0").select(F.col("path").alias("asked"))
    return resolve.closest_paths(logged.unionByName(_route_titles(spark, d)), table(spark, d, "questions").select("path"))


@query(f"WITH {PATHS}, x AS (SELECT DISTINCT page_id, book_id, CASE WHEN len(p) >= 3 THEN array_to_string(p[1:len(p) - 2], ' ▸ ') ELSE '(root)' END AS shelf, p[-1] AS leaf FROM paths) SELECT shelf, count(*) AS entries, CAST(sum(length(leaf) // 4) AS BIGINT) AS tokens, count(*) > 60 OR sum(length(leaf) // 4) > 6000 AS too_wide FROM x GROUP BY 1")
def shelf_menus(spark, d):
    """Entries and tokens of the menu of each shelf, and whether it is too wide to be shown."""
    shelf = F.when(F.size("p") >= 3, F.expr("array_join(slice(p, 1, greatest(size(p) - 2, 1)), ' ▸ ')")).otherwise("(root)")
    x = base._paths(spark, d).select("page_id", "book_id", shelf.alias("shelf"), F.element_at("p", -1).alias("leaf")).distinct()
    out = x.groupBy("shelf").agg(F.count("*").alias("entries"), F.sum(T.token_estimate(F.col("leaf"))).alias("tokens"))
    return out.withColumn("too_wide", (F.col("entries") > 60) | (F.col("tokens") > 6000))


@query("""WITH p AS (SELECT page_id, min(markdown) AS m FROM pages WHERE page_id IS NOT NULL AND markdown IS NOT NULL GROUP BY 1)
SELECT page_id, substring(regexp_extract(trim(regexp_replace(regexp_replace(m, '^\\s*#{1,6} [^\\n]*\\n?', ''), '\\s+', ' ', 'g')), '^(.*?[.!?。](?: |$)|.*)', 1), 1, 120) AS line FROM p""".replace("AS line", "AS raw_line").replace("SELECT page_id, substring", "SELECT page_id, rtrim(substring").replace("1, 120) AS raw_line", "1, 120)) AS line"))
def page_one_liners(spark, d):
    """The first sentence of each page, without its heading, 120 characters at most."""
    pages = _bodies(spark, d).where("markdown is not null")
    return pages.select("page_id", F.rtrim(T.one_line(F.col("markdown"))).alias("line"))


@query("""WITH c AS (SELECT conversation_id, turn, id, unnest(citations) AS c, unnest(range(1, len(citations) + 1)) AS i FROM (SELECT DISTINCT conversation_id, turn, id, citations FROM messages WHERE conversation_id IS NOT NULL))
SELECT conversation_id, c.page_id AS page_id, row_number() OVER (PARTITION BY conversation_id ORDER BY coalesce(turn, 1000000000), id, i) AS place FROM c WHERE c.page_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conversation_id, c.page_id ORDER BY coalesce(turn, 1000000000), id, i) = 1""".replace("row_number() OVER (PARTITION BY conversation_id ORDER BY coalesce(turn, 1000000000), id, i) AS place", "turn, i"))
def first_citations(spark, d):
    """The pages that each conversation cites, each where it is cited first."""
    c = table(spark, d, "messages").where("conversation_id is not null").select("conversation_id", "turn", "id", "citations").distinct()
    c = c.select("conversation_id", "turn", "id", F.posexplode("citations").alias("pos", "c")).select("conversation_id", "turn", "id", (F.col("pos") + 1).cast("long").alias("i"), F.col("c.page_id").alias("page_id"))
    order = [F.coalesce("turn", F.lit(1_000_000_000)), "id", "i"]
    return retrieval.first_seen(c.where("page_id is not null"), ["conversation_id", "page_id"], order).select("conversation_id", "page_id", "turn", "i")


# --- logs and evaluation ---------------------------------------------------------------------------------------------
@query(f"""WITH {LOG}, o AS (SELECT *, row_number() OVER (ORDER BY created_at NULLS FIRST, id) - 1 AS idx, count(*) OVER () AS n FROM log), b AS (SELECT *, (SELECT max(i) FROM range(0, 8) t(i) WHERE i < least(8, o.n) AND (i * o.n) // least(8, o.n) <= o.idx) AS bucket FROM o WHERE n >= 2)
SELECT bucket, count(*) AS n, round(100.0 * avg((status = 'answered')::INT), 2) AS answered, round(avg(hops) FILTER (status = 'answered'), 2) AS hops FROM b GROUP BY 1""".replace("avg((status = 'answered')::INT)", "avg(coalesce(status = 'answered', false)::INT)"))
def trend_buckets(spark, d):
    """Eight runs of the log, equal in number of rows: share answered, and mean hops of the answered."""
    placed = resolve.placed_in_time(_log(spark, d), "created_at", "id").withColumn("bucket", resolve.bucket().cast("long")).where("bucket is not null")
    answered = F.coalesce(F.col("status") == "answered", F.lit(False))
    return placed.groupBy("bucket").agg(F.count("*").alias("n"), F.round(100.0 * F.avg(answered.cast("int")), 2).alias("answered"), F.round(F.avg(F.when(answered, F.col("hops"))), 2).alias("hops"))


NORM = "regexp_replace(lower({0}), '\\s', '', 'g')"


@query(f"""WITH o AS (SELECT DISTINCT id, query, gold_answer, text FROM outcomes WHERE gold_answer IS NOT NULL AND text IS NOT NULL), x AS (SELECT id, {NORM.format("gold_answer")} AS q, {NORM.format("text")} AS a FROM o),
g AS (SELECT id, q, a, CASE WHEN length(q) >= 12 THEN list_transform(range(1, length(q) - 10), lambda i: substring(q, i, 12)) ELSE [] END AS grams FROM x)
SELECT id, length(q) >= 10 AND (contains(a, q) OR (len(grams) > 0 AND len(list_filter(grams, lambda x: contains(a, x))) >= 0.5 * len(grams))) AS grounded FROM g""")
def quotes_grounded(spark, d):
    """Whether the gold answer of each outcome stands in the answer given: whole, or half of its runs of twelve characters."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"\s", "")
    rows = table(spark, d, "outcomes").where("gold_answer is not null and text is not null").select("id", "query", "gold_answer", "text").distinct()
    g = rows.select("id", bare("gold_answer").alias("q"), bare("text").alias("a")).withColumn("g", T.grams(F.col("q")))
    held = F.size(F.filter("g", lambda x: F.contains(F.col("a"), x)))
    return g.select("id", ((F.length("q") >= 10) & (F.contains("a", F.col("q")) | (F.size("g") > 0) & (held >= 0.5 * F.size("g")))).alias("grounded"))


@query("""WITH o AS (SELECT DISTINCT * FROM outcomes), r AS (SELECT *, CASE lower(trim(confidence)) WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS level FROM o)
SELECT floor_level, count(*) AS n, count(*) FILTER (level >= floor_level AND length(trim(coalesce(text, ''))) >= 2) AS given, count(*) FILTER (level >= floor_level AND length(trim(coalesce(text, ''))) >= 2 AND correct) AS right_ones FROM r, (SELECT unnest([0, 1, 2]) AS floor_level) GROUP BY 1""")
def confidence_floors(spark, d):
    """Answers that pass each floor of confidence and are no mere blanks, and the right ones among them."""
    level = F.lower(F.trim("confidence"))
    o = table(spark, d, "outcomes").distinct().withColumn("level", F.when(level == "high", 2).when(level == "medium", 1).otherwise(0)).withColumn("floor_level", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    given = (F.col("level") >= F.col("floor_level")) & (F.length(F.trim(F.coalesce("text", F.lit("")))) >= 2)
    return o.groupBy("floor_level").agg(F.count("*").alias("n"), F.count_if(given).alias("given"), F.count_if(given & F.col("correct")).alias("right_ones"))


@query("""SELECT id, page_id, lang FROM questions WHERE kind = 'question' AND lang IN ('en', 'vi') AND page_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY md5(CAST(id AS VARCHAR) || '#13'), id) = 1""")
def eval_cases(spark, d):
    """One question in English or Vietnamese for each page, in hash order."""
    rows = table(spark, d, "questions").where("kind = 'question' and lang in ('en', 'vi') and page_id is not null").select("id", "page_id", "lang")
    return retrieval.first_seen(rows, ["page_id"], [F.md5(F.concat(F.col("id").cast("string"), F.lit("#13")).cast("binary")), "id"])
