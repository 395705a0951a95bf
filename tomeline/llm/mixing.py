"""Mixing sources to target weights.

Every document gets a hash-random key; within each source the documents are ordered by it in key ranges, prefix sums
of tokens run over the ranges and inside each, and the source is cut where its budget is reached, after as many
repeats as its cap allows. The document that straddles the cut is left out; what room it leaves goes to the next
documents in key order that fit, in PASSES more rounds of the same sums.

Undefined cases: a source is compared trimmed and in lower case, and one without target gives nothing; a target
without documents reaches share 0 and the others share the total in proportion; documents without tokens are not
used; a document id that is repeated counts once for each row; an empty table gives an empty mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeline.session import cut

RANGE_ROWS = 20_000
PASSES = 3


def _running(docs: DataFrame) -> DataFrame:
    """docs(source, range, key, doc_id, n_tokens) with upto: the tokens of its source up to each in key order."""
    by_range = docs.groupBy("source", "range").agg(F.sum("n_tokens").alias("tokens"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = by_range.withColumn("before", F.sum("tokens").over(earlier)).select("source", "range", F.coalesce("before", F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return docs.join(before, ["source", "range"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside)).drop("before")


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """sizes(doc_id, source, n_tokens), targets(source, target_share, max_repeats) -> (mixture, report).

    mixture: doc_id, source, epoch (from 1), n_tokens. report: source, target_share, max_repeats, available_tokens,
    budget_tokens, used_tokens, actual_share, epochs. Without total_tokens the mixture is the largest that keeps
    every share under its cap on repeats.
    """
    spark = sizes.sparkSession
    clean = F.lower(F.trim("source"))
    goal = targets.select(clean.alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("long").alias("max_repeats"))
    docs = sizes.select("doc_id", clean.alias("source"), F.col("n_tokens").cast("long").alias("n_tokens")).where("n_tokens > 0").join(F.broadcast(goal.select("source")), "source", "left_semi")
    docs = docs.withColumn("key", F.xxhash64("doc_id", F.lit(seed)))
    # the sources are those of the targets: a handful of rows
    stock = {r["source"]: r for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    plan, present = [], [g for g in goal.collect() if g["source"] in stock]
    weight = sum(g["target_share"] for g in present) or 1.0
    fits = min((stock[g["source"]]["tokens"] * g["max_repeats"] * weight / g["target_share"] for g in present if g["target_share"] > 0), default=0.0)
    total = fits if total_tokens is None else min(float(total_tokens), fits)
    for g in present:
        s = stock[g["source"]]
        plan.append((g["source"], int(total * g["target_share"] / weight), s["tokens"], max(1, s["docs"] // RANGE_ROWS)))
    budget = F.broadcast(spark.createDataFrame(plan, "source string, budget long, stock long, ranges long"))
    placed = docs.join(budget, "source").withColumn("range", F.floor((F.col("key") / F.lit(2.0**64) + F.lit(0.5)) * F.col("ranges")))
    summed = _running(placed)
    # epoch e takes the document while (e - 1) * stock + upto stays within the budget
    times = F.when(F.col("budget") >= F.col("upto"), F.expr("(budget - upto) div stock") + 1).otherwise(0)
    caps = F.broadcast(spark.createDataFrame([(g["source"], int(g["max_repeats"])) for g in present], "source string, cap long"))
    taken = cut(summed.withColumn("times", times).drop("upto").join(caps, "source").withColumn("row", F.monotonically_increasing_id()), "taken")
    for _ in range(PASSES):
        spent = taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("spent"), F.max("times").alias("most"))  # a row a source
        left = taken.join(F.broadcast(spent), "source").withColumn("left", F.col("budget") - F.col("spent")).drop("spent")
        fits = (F.col("n_tokens") <= F.col("left")) & (F.col("times") < F.least("cap", F.greatest("most", F.lit(1))))
        more = _running(left.where(fits)).where("upto <= left").select("source", "row", F.lit(1).cast("long").alias("more"))
        taken = cut(taken.join(more, ["source", "row"], "left").withColumn("times", F.col("times") + F.coalesce("more", F.lit(0))).drop("more"), "taken")
    used = taken.where("times > 0")
    mixture = used.select("doc_id", "source", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("epoch"), "n_tokens")
    reached = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("used_tokens"), F.max("times").alias("epochs"))
    all_used = reached.agg(F.sum("used_tokens").alias("all"))
    report = goal.join(F.broadcast(spark.createDataFrame(plan, "source string, budget_tokens long, available_tokens long, r long").drop("r")), "source", "left").join(reached, "source", "left").crossJoin(all_used)
    report = report.select(
        "source",
        "target_share",
        "max_repeats",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("available_tokens", "budget_tokens", "used_tokens")],
        F.coalesce(F.round(F.col("used_tokens") / F.col("all"), 6), F.lit(0.0)).alias("actual_share"),
        F.coalesce("epochs", F.lit(0)).alias("epochs"),
    )
    return mixture, report
