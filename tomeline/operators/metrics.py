"""Quality of ranked lists against gold sets, and reports over outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranking_metrics(ranked: DataFrame, gold: DataFrame, key: str, k: int) -> DataFrame:
    """qid, hit, recall, coverage, allgold, ndcg at k; ranked(qid, key, rank), gold(qid, key) without repeats."""
    size = gold.groupBy("qid").agg(F.count("*").alias("n_gold"))
    found = ranked.where(F.col("rank") <= k).join(gold, ["qid", key]).groupBy("qid").agg(F.count("*").alias("tp"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    tp = F.coalesce("tp", F.lit(0))
    return size.join(found, "qid", "left").select(
        "qid",
        (tp > 0).cast("long").alias("hit"),
        F.round(tp / F.col("n_gold"), 6).alias("recall"),
        (tp == F.col("n_gold")).cast("long").alias("allgold"),
        F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"),
    )


def required_margin(ranked: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """qid, required: how far the worst gold item lies below the best score; null if a gold item is not in the list."""
    top = ranked.withColumn("below", F.max("score").over(Window.partitionBy("qid")) - F.col("score"))
    joined = gold.join(top, ["qid", key], "left")
    worst = joined.groupBy("qid").agg(F.max("below").alias("worst"), F.count_if(F.col("below").isNull()).alias("absent"))
    return worst.select("qid", F.when(F.col("absent") == 0, F.round("worst", 9)).alias("required"))


def stratified(df: DataFrame, kind: str, key: str, limit: int, seed: int) -> DataFrame:
    """A sample whose kinds keep their share: max(1, round(limit * n_kind / n)) rows of each, in hash order."""
    total = df.agg(F.count("*").alias("n"))
    sized = df.groupBy(kind).agg(F.count("*").alias("n_kind")).join(F.broadcast(total))
    share = sized.select(kind, F.greatest(F.lit(1), F.round(F.lit(limit) * F.col("n_kind") / F.col("n"))).cast("long").alias("share"))
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")).cast("binary"))
    # no kind takes more than the limit: the first so many of each of its slices hold them all, whatever its size
    sliced = df.withColumns({"o": order, "slice": F.pmod(F.xxhash64(key), F.lit(64))})
    few = sliced.withColumn("r", F.row_number().over(Window.partitionBy(kind, "slice").orderBy("o", key))).where(F.col("r") <= max(1, limit)).drop("r", "slice")
    ranked = few.join(F.broadcast(share), kind).withColumn("r", F.row_number().over(Window.partitionBy(kind).orderBy("o", key)))
    return ranked.where(F.col("r") <= F.col("share")).drop("r", "share", "o")
