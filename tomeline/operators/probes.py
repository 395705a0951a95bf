"""Probes of how well vectors keep pages and books apart, and thresholds fitted across folds.

Unusable vectors take no part; a row never meets rows that share its mask; ties go to the smaller name; empty inputs give
empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeline.operators import retrieval


def masked_topk(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """qid, grp, score, own, rank: the k groups whose best row is nearest to each query, and the query's own group.

    queries(qid, grp, mask, embedding), corpus(id, grp, mask, embedding). A row of the query's mask is no candidate. The
    own group comes out wherever it stands; its rank is exact up to k and k + 1 beyond.
    """
    asked = retrieval.blocks(queries, "qid", "grp", "embedding", retrieval.BLOCK_QUERIES, "mask")
    rows = retrieval.blocks(corpus.where("grp is not null"), "id", "grp", "embedding", retrieval.BLOCK_ROWS, "mask")
    best = retrieval.nearest_groups(asked, rows, k, with_own=True).groupBy("qid", "grp", "own").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.least(F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "grp")), F.lit(k + 1)))
    return ranked.where((F.col("rank") <= k) | F.col("own"))


def recall_at(ranked: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """n and the share of queries whose own group stands among the first k; queries with one ranked group are left out."""
    one = ranked.groupBy("qid").agg(F.count("*").alias("groups"), F.min(F.when(F.col("own"), F.col("rank"))).alias("at")).where("groups >= 2")
    return one.agg(F.count("*").alias("n"), *[F.round(F.avg((F.coalesce("at", F.lit(1 << 30)) <= k).cast("int")), 6).alias(f"r{k}") for k in ks])


def unit(vec: Column) -> Column:
    """The vector at length one; its length is bound once, not computed anew for each place."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.element_at(F.transform(F.array(norm), lambda n: F.transform(vec, lambda x: F.try_divide(x.cast("double"), n))), 1)


def centroids(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, embedding: the sum of the unit vectors of each group; its direction is the centroid's.

    Summed by place, so a hot group is added up in parts before the shuffle."""
    parts = rows.select(*keys, F.posexplode(unit(F.col("embedding"))).alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return parts.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda t: t["s"]).alias("embedding"))


def foreign_pull(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """page_id, book_id, best_book, own_score, best_score: pages whose centroid lies nearer to a row of another book than
    to any row of the own book outside the page. Pages without such a row (books of one page) are left out."""
    keyed = pages.withColumn("qid", F.xxhash64("page_id", "book_id"))
    ranked = masked_topk(keyed.select("qid", F.col("book_id").alias("grp"), F.col("page_id").alias("mask"), "embedding"), rows.select("id", F.col("book_id").alias("grp"), F.col("page_id").alias("mask"), "embedding"), 2)
    other = F.when(~F.col("own"), F.struct((-F.col("score")).alias("s"), "grp"))
    top = ranked.groupBy("qid").agg(F.max(F.when(F.col("own"), F.col("score"))).alias("own_score"), F.min(other).alias("o"))
    top = top.select("qid", "own_score", F.col("o.grp").alias("best_book"), (-F.col("o.s")).alias("best_score")).where("best_score > own_score")
    return keyed.select("qid", "page_id", "book_id").join(top, "qid").drop("qid")


def cross_fit(required: DataFrame, alpha: float, folds: int = 5) -> DataFrame:
    """fold, n, threshold, covered: for each fold the ceil((n + 1)(1 - alpha))-th smallest margin of the other folds and
    how many of its own margins lie within it. A null margin is never covered and fits nothing.

    Folds come from a hash of the query, so they are balanced in expectation. Margins count at six places: their running
    sums go over value counts, at most two million rows a fold whatever the number of queries."""
    fold = F.conv(F.substring(F.md5(F.col("qid").cast("string").cast("binary")), 1, 6), 16, 10).cast("long") % folds
    r = required.select("qid", fold.alias("fold"), F.round("required", 6).alias("required"))
    counts = r.where("required is not null").groupBy("fold", "required").agg(F.count("*").alias("c"))
    others = counts.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("to <> fold").groupBy(F.col("to").cast("long").alias("fold"), "required").agg(F.sum("c").alias("c"))
    w = Window.partitionBy("fold")
    ranked = others.withColumns({"upto": F.sum("c").over(w.orderBy("required").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(w)})
    fitted = ranked.where(F.col("upto") >= F.ceil((F.col("n") + 1) * (1 - alpha))).groupBy("fold").agg(F.min("required").alias("threshold"))
    whole = r.join(F.broadcast(fitted), "fold", "left").withColumn("threshold", F.coalesce("threshold", F.lit(float("inf"))))  # one row a fold
    return whole.groupBy("fold").agg(F.count("*").alias("n"), F.first("threshold").alias("threshold"), F.count_if(F.col("required") <= F.col("threshold") + 1e-12).alias("covered"))
