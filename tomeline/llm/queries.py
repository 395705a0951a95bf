"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeline.llm import chunking, conversations, knn, mixing, packing, pairs, pii, sentences, tokens
from tomeline.session import cut, table


P5_SQL = """
    WITH m AS (
        SELECT DISTINCT conversation_id, turn, text,
            CASE WHEN lower(trim(role)) IN ('user', 'human', 'reader') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'bot', 'librarian') THEN 'assistant' END AS speaker
        FROM messages WHERE conversation_id IS NOT NULL),
    v AS (
        SELECT *, coalesce(regexp_replace(text, '[\\s\u200b\u200c\u200d\u2060\ufeff\u00ad\u00a0\u3000\u2000-\u200a\u202f\u205f\u1680\u2028\u2029\u0085]', '', 'g'), '') <> '' AS seen FROM m),
    w AS (
        SELECT *, lead(speaker) OVER o AS next_speaker, lead(seen) OVER o AS next_seen, row_number() OVER o AS pos
        FROM v WINDOW o AS (PARTITION BY conversation_id ORDER BY turn NULLS LAST, speaker, text)),
    c AS (
        SELECT conversation_id, bool_or(seen) AS visible,
            bool_or(turn IS NULL OR turn < 0 OR speaker IS NULL) OR count(*) <> count(DISTINCT turn) OR min(turn) <> 0 OR max(turn) + 1 <> count(*)
                OR bool_or(pos = 1 AND coalesce(speaker, '') <> 'user') OR bool_or(speaker = 'assistant' AND coalesce(next_speaker, '') = 'assistant') AS broken,
            bool_or(speaker = 'user' AND NOT (coalesce(next_speaker, '') = 'assistant' AND coalesce(next_seen, false))) AS no_reply
        FROM w GROUP BY 1),
    k AS (SELECT DISTINCT id FROM conversations WHERE id IS NOT NULL),
    r AS (
        SELECT coalesce(conversation_id, id) AS conversation_id,
            CASE WHEN NOT coalesce(visible, false) THEN 'empty' WHEN id IS NULL OR coalesce(broken, true) THEN 'broken' WHEN no_reply THEN 'missing_reply' END AS reason
        FROM c FULL JOIN k ON conversation_id = id)
    SELECT * FROM r WHERE reason IS NOT NULL"""


P5_TURNS = P5_SQL.replace("SELECT * FROM r WHERE reason IS NOT NULL", "SELECT conversation_id, turn, speaker, text FROM m JOIN r USING (conversation_id) WHERE reason IS NULL")
P4_VECTORS = " UNION ALL ".join(f"SELECT '{t}' AS src, id, embedding::DOUBLE[] AS e FROM {t} WHERE len(embedding) > 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 AND NOT isnan(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))" for t in ("questions", "answer_cache"))


# --- 4: most similar vectors -------------------------------------------------------------------------------------
def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Both tables in one id space: id * 2 + table."""
    both = [table(spark, d, t).select((F.col("id") * 2 + i).alias("nid"), F.lit(i).alias("space"), "embedding") for i, t in enumerate(("questions", "answer_cache"))]
    return knn.pack_vectors(both[0].unionByName(both[1]), "nid", "embedding", "space")


def _src(col: str) -> F.Column:
    return F.when(F.pmod(F.col(col), F.lit(2)) == 0, "questions").otherwise("answer_cache")


def _row_id(col: str) -> F.Column:
    return F.expr(f"({col} - pmod({col}, 2)) div 2")


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """src, id, rank, other, cosine: the 10 nearest of every usable vector."""
    near = knn.nearest(*knn.neighbour_graph(_vectors(spark, d)))
    return near.select(_src("id").alias("src"), _row_id("id").alias("id"), F.col("rank").cast("long").alias("rank"), _row_id("other").alias("other"), F.round("cosine", 5).alias("cosine"))


def p4_search(spark: SparkSession, d: str) -> DataFrame:
    """src, id, rank, other, cosine: greedy graph search for every row whose id is divisible by 20; copies included."""
    packed = cut(_vectors(spark, d), "packed")
    graph, copies = knn.neighbour_graph(packed, keep_vectors=True)
    asked = packed.where("((nid - pmod(nid, 2)) div 2) % 20 = 0")
    start = asked.select("nid").join(copies, "nid", "left").select("nid", F.coalesce("rep", "nid").alias("rep"))
    homes = start.join(graph.select(F.col("nid").alias("rep"), "home"), "rep").select("nid", "home")
    found = knn.with_copies(knn.search(asked, graph, homes), asked, copies)
    return found.select(_src("qid").alias("src"), _row_id("qid").alias("id"), F.col("rank").cast("long").alias("rank"), _row_id("nid").alias("other"), F.round("sim", 5).alias("cosine"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = knn.nearest(*knn.neighbour_graph(_vectors(spark, d)), floor=0.95)
    pair = near.select(_src("id").alias("src"), _row_id("id").alias("x"), _row_id("other").alias("y"))
    return pair.select("src", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


# --- 1: broken pairs ---------------------------------------------------------------------------------------------
def p1_defects(spark: SparkSession, d: str) -> DataFrame:
    """src, row_id, defects: every defect of a pair, as text in order."""
    cache = table(spark, d, "answer_cache").select(F.lit("answer_cache").alias("src"), F.col("id").alias("row_id"), "query", "answer", F.lit(None).cast("boolean").alias("not_found"))
    outcomes = table(spark, d, "outcomes").select(F.lit("outcomes").alias("src"), F.col("id").alias("row_id"), "query", F.col("text").alias("answer"), F.col("said_not_found").alias("not_found"))
    return pairs.find_defects(cache.unionByName(outcomes.distinct()), table(spark, d, "documents")).withColumn("defects", F.array_join("defects", ","))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_defects(spark, d).select("src", "row_id", F.element_at(F.split("defects", ","), 1).alias("defect")).distinct()


# --- 2: personal information -------------------------------------------------------------------------------------
def _free_texts(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.lit(t).alias("src"), F.col("id").cast("string").alias("row_key"), F.col(c).alias("text")) for t, c in (("messages", "text"), ("trajectories", "query"), ("conversations", "title"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """src, row_key, clean_text of every text."""
    return pii.redact(_free_texts(spark, d)).select("src", "row_key", "clean_text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = pii.redact(_free_texts(spark, d)).select("src", "row_key", F.explode("found").alias("f"))
    return found.select("src", "row_key", F.col("f.pii_type").alias("pii_type"), F.col("f.occ").alias("occ")).distinct()


# --- 3: oversized items ------------------------------------------------------------------------------------------
def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.lit("pages").alias("src"), F.col("page_id").alias("item_key"), F.col("markdown").alias("text"))
    sections = table(spark, d, "sections").select(F.lit("sections").alias("src"), F.concat("page_id", F.lit("#"), F.col("ord").cast("string")).alias("item_key"), F.col("body").alias("text"))
    return chunking.split_oversized(pages.unionByName(sections), table(spark, d, "size_limits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).select("src", "item_key").distinct()


# --- 5: conversations --------------------------------------------------------------------------------------------
def _blocks(spark: SparkSession, d: str) -> DataFrame:
    messages = table(spark, d, "messages")
    return conversations.stream_blocks(spark, f"{d}/messages.parquet", messages.schema)


def p5_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The kept conversations, one row a turn."""
    blocks = _blocks(spark, d)
    return conversations.rebuilt(blocks, conversations.judge(blocks, table(spark, d, "conversations")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.judge(_blocks(spark, d), table(spark, d, "conversations")).where("reason is not null")


# --- 6: containers -----------------------------------------------------------------------------------------------
def _sizes(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return cut(tokens.with_tokens(table(spark, d, "documents"), ["doc_id", *more], "text"), "sizes")


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """spec, container, item (doc_id), part, start_token, n_tokens, capacity."""
    return packing.pack_items(_sizes(spark, d).withColumnRenamed("doc_id", "item"), table(spark, d, "pack_specs"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and the share of their room that is used, by spec."""
    used = p6_packed(spark, d).groupBy("spec", "container", "capacity").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return used.groupBy("spec").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.round(F.sum("used") / F.sum("capacity"), 4).alias("fill"))


# --- 7: mixture --------------------------------------------------------------------------------------------------
def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d, "source"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d, "source"), table(spark, d, "mix_targets"))[1]


# --- 8: sentences ------------------------------------------------------------------------------------------------
def p8_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_sentences(spark, d).select("doc_id", "end_pos")


# --- invariants: each counts what breaks a promise, and its SQL says there is none --------------------------------
def p3_joined(spark: SparkSession, d: str) -> DataFrame:
    """src, item_key, chars: the pieces of each item put together without their overlaps; as long as the item itself."""
    w = Window.partitionBy("src", "item_key").orderBy("piece")
    pieces = p3_pieces(spark, d).select("src", "item_key", (F.col("end_pos") - F.coalesce(F.lag("end_pos").over(w), F.lit(0))).alias("own"))
    return pieces.groupBy("src", "item_key").agg(F.sum("own").cast("long").alias("chars"))


def p4_violations(spark: SparkSession, d: str) -> DataFrame:
    """Lists that are longer than ten, have gaps, name themselves or a row twice, or do not fall; usable rows without list."""
    near = cut(p4_neighbours(spark, d), "near")
    w = Window.partitionBy("src", "id").orderBy("rank")
    one = near.withColumn("rise", F.col("cosine") > F.lag("cosine").over(w) + 1e-9).groupBy("src", "id").agg(
        F.count("*").alias("n"), F.max("rank").alias("last"), F.countDistinct("other").alias("others"), F.count_if(F.col("other") == F.col("id")).alias("itself"), F.count_if(F.expr("rise")).alias("rises")
    )
    return one.groupBy("src").agg(
        F.count("*").alias("lists"), F.count_if(F.expr("n > 10 or last <> n")).alias("gaps"), F.count_if(F.expr("others <> n")).alias("repeats"), F.sum("itself").alias("itself"), F.sum("rises").alias("rises")
    )


def p6_violations(spark: SparkSession, d: str) -> DataFrame:
    """spec, and how many containers are too full, items are missing, not whole though they fit, or differ in size."""
    sizes = _sizes(spark, d).withColumnRenamed("doc_id", "item")
    packed = cut(packing.pack_items(sizes, table(spark, d, "pack_specs")), "packed")
    full = packed.groupBy("spec", "container", "capacity").agg(F.sum("n_tokens").alias("used")).groupBy("spec").agg(F.count_if(F.expr("used > capacity")).alias("too_full"))
    items = packed.groupBy("spec", "item").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("parts"), F.max("capacity").alias("capacity"))
    placed = sizes.join(items, "item", "left").groupBy("spec").agg(F.count("*").alias("items"), F.count_if(F.expr("placed <> n_tokens")).alias("changed"), F.count_if(F.expr("parts > 1 and n_tokens <= capacity")).alias("divided"))
    return placed.join(full, "spec").select("spec", "items", "too_full", "changed", "divided")


def p7_violations(spark: SparkSession, d: str) -> DataFrame:
    """source: uses of a document beyond max_repeats, of foreign sources, and tokens used beyond the budget."""
    mixture, report = mixing.mix(_sizes(spark, d, "source"), table(spark, d, "mix_targets"))
    uses = mixture.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.countDistinct("epoch").alias("epochs"))
    caps = report.select("source", "max_repeats", (F.col("used_tokens") > F.col("budget_tokens")).cast("long").alias("over_budget"))
    return caps.join(uses, "source", "left").groupBy("source").agg(F.count_if(F.expr("uses > max_repeats")).alias("over_repeats"), F.count_if(F.expr("uses <> epochs")).alias("twice_an_epoch"), F.max("over_budget").alias("over_budget"))


def p8_covered(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, chars: the visible characters of the sentences of each text; as many as the text has."""
    bare = F.length(F.regexp_replace("sentence", r"[\s\x{a0}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]", ""))
    return p8_sentences(spark, d).groupBy("doc_id").agg(F.sum(bare).cast("long").alias("chars"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": """
            SELECT DISTINCT 'pages' AS src, page_id AS item_key FROM pages, size_limits WHERE item = 'pages' AND length(markdown) // 4 > max_tokens
            UNION ALL
            SELECT DISTINCT 'sections', page_id || '#' || ord FROM sections, size_limits WHERE item = 'sections' AND length(body) // 4 > max_tokens""",
        "p5_found": P5_SQL,
        "p3_joined": """
            SELECT 'pages' AS src, page_id AS item_key, max(length(markdown)) AS chars FROM pages, size_limits WHERE item = 'pages' AND length(markdown) // 4 > max_tokens GROUP BY 2
            UNION ALL
            SELECT 'sections', page_id || '#' || ord, max(length(body)) FROM sections, size_limits WHERE item = 'sections' AND length(body) // 4 > max_tokens GROUP BY 2""",
        "p4_found": f"""
            WITH v AS ({P4_VECTORS}), s AS (SELECT a.src, a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.src = b.src AND a.id <> b.id AND len(a.e) = len(b.e)),
            near AS (SELECT src, a, b, s FROM s QUALIFY row_number() OVER (PARTITION BY src, a ORDER BY round(s, 5) DESC, b) <= 10)
            SELECT DISTINCT src, least(a, b) AS id_a, greatest(a, b) AS id_b FROM near WHERE s >= 0.95""",
        "p4_violations": f"SELECT src, count(*) AS lists, 0::BIGINT AS gaps, 0::BIGINT AS repeats, 0::BIGINT AS itself, 0::BIGINT AS rises FROM ({P4_VECTORS}) GROUP BY 1",
        "p5_conversations": P5_TURNS,
        "p6_violations": "SELECT DISTINCT spec, (SELECT count(*) FROM documents) AS items, 0::BIGINT AS too_full, 0::BIGINT AS changed, 0::BIGINT AS divided FROM pack_specs WHERE capacity_tokens >= 1",
        "p7_violations": "SELECT lower(trim(source)) AS source, 0::BIGINT AS over_repeats, 0::BIGINT AS twice_an_epoch, 0::BIGINT AS over_budget FROM mix_targets",
        "p8_covered": """
            SELECT doc_id, length(regexp_replace(text, '[\\s\\x{a0}\\x{85}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{0b}\\x{1c}-\\x{1f}]', '', 'g')) AS chars
            FROM documents WHERE trim(text) <> '' AND regexp_replace(text, '[\\s\\x{a0}\\x{3000}\\x{2000}-\\x{200a}\\x{202f}]', '', 'g') <> ''""",
    }
