"""Rebuilding conversations from message rows with keyed streaming state.

Rows stream in any order, over any number of micro-batches. State is keyed by conversation and block of BLOCK_TURNS turns,
as session windows over event time: each key buffers its rows, late ones too, until the watermark passes its last event
by the idle gap (timeout) or a closing heartbeat moves the watermark past everything (closure). The stream then orders
and checks the turns of the block and emits them with its facts; a join over the blocks of a conversation gives the
verdict. Rows whose turn or speaker can't be read are only counted, so no flood of them grows a state. Rows that come
after the watermark are no longer taken by the stream; they are added to their blocks afterwards.

Undefined cases: rows of the same conversation, turn, speaker and text count once; rows without conversation_id
belong to no conversation and are left out; a null, blank or invisible text is no visible text; a null or negative
turn and a role outside ROLES cannot be read; a row without event time takes the time it was loaded, else the earliest;
an empty table gives every listed conversation as empty. A state holds the different rows of its thousand turns: where
one turn number comes with very many different texts, they all lie in one state.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tomeline.session import cut, drop_path, scratch_path

# The spellings of the two speakers.
ROLES = {"user": "user", "human": "user", "reader": "user", "assistant": "assistant", "bot": "assistant", "librarian": "assistant"}
INVISIBLE = r"[\s\u200b\u200c\u200d\u2060\ufeff\u00ad\u00a0\u3000\u2000-\u200a\u202f\u205f\u1680\u2028\u2029\u0085]"
BLOCK_TURNS = 1_000
ROW = "struct<turn:int,speaker:string,text:string,seen:boolean>"
BLOCKS = f"conversation_id string, block long, rows array<{ROW}>, unreadable long, visible boolean"


def message_rows(messages: DataFrame) -> DataFrame:
    """conversation_id, block, row (null where turn or speaker can't be read), visible, event_time."""
    role = F.lower(F.trim(F.col("role")))
    speaker = F.coalesce(*[F.when(role == k, v) for k, v in ROLES.items()])
    seen = F.coalesce(F.regexp_replace("text", INVISIBLE, "") != "", F.lit(False))
    loaded = F.col("loaded_at") if "loaded_at" in messages.columns else F.lit(None)
    readable = (F.col("turn") >= 0) & speaker.isNotNull()
    return messages.where("conversation_id is not null").select(
        "conversation_id",
        F.when(readable, F.floor(F.col("turn") / BLOCK_TURNS)).otherwise(-1).cast("long").alias("block"),
        F.when(readable, F.struct(F.col("turn").cast("int").alias("turn"), speaker.alias("speaker"), "text", seen.alias("seen"))).alias("row"),
        seen.alias("visible"),
        F.coalesce(F.col("created_at"), loaded, F.lit("1970-01-02").cast("timestamp")).cast("timestamp").alias("event_time"),
    )


def in_blocks(rows: DataFrame, *more: Column) -> DataFrame:
    """The rows of each block, each once; more is the session where rows stream."""
    blocks = rows.groupBy("conversation_id", "block", *more).agg(F.collect_set("row").alias("rows"), F.count_if(F.col("row").isNull()).alias("unreadable"), F.bool_or("visible").alias("visible"))
    return blocks.select("conversation_id", "block", F.array_sort("rows").alias("rows"), "unreadable", "visible")


def with_facts(blocks: DataFrame) -> DataFrame:
    """Blocks with what the verdict on their conversation needs."""
    pairs = F.arrays_zip(F.col("rows").alias("a"), F.slice("rows", 2, F.size("rows")).alias("b"))
    end = F.element_at("rows", -1)
    some = F.size("rows") > 0
    first = F.when(some, F.element_at("rows", 1))
    follows = lambda p, who: p["b"].isNotNull() & (p["a"]["speaker"] == who)
    return blocks.select(
        "*",
        (F.size("rows") + F.col("unreadable")).alias("n"),
        (F.col("unreadable") == 0).alias("readable"),
        F.size(F.array_distinct("rows.turn")).cast("long").alias("distinct_turns"),
        F.coalesce(first["turn"], F.lit(-1)).alias("low"),
        F.coalesce(F.when(some, end)["turn"], F.lit(-1)).alias("high"),
        first["speaker"].alias("first_speaker"),
        first["seen"].alias("first_visible"),
        F.when(some, end)["speaker"].alias("last_speaker"),
        F.exists(pairs, lambda p: follows(p, "assistant") & (p["b"]["speaker"] == "assistant")).alias("two_assistants"),
        F.exists(pairs, lambda p: follows(p, "user") & ~((p["b"]["speaker"] == "assistant") & p["b"]["seen"])).alias("no_reply"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """One row for each block: what came in several sessions or too late is put together again."""
    again = parts.groupBy("conversation_id", "block").agg(F.count("*").alias("c")).where("c > 1").select("conversation_id", "block")
    split = parts.join(again, ["conversation_id", "block"], "left_semi").groupBy("conversation_id", "block")
    whole = split.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("rows")))).alias("rows"), F.sum("unreadable").alias("unreadable"), F.bool_or("visible").alias("visible"))
    return parts.join(again, ["conversation_id", "block"], "left_anti").unionByName(with_facts(whole).select(*parts.columns))


def stream_blocks(spark: SparkSession, path: str, schema: StructType, idle: timedelta = timedelta(days=30), delay: timedelta = timedelta(days=30), files_per_trigger: int | None = None) -> DataFrame:
    """Run the message files under path through the keyed state; gives a row for each block.

    A block closes when nothing came for idle; delay is how late a row may come and still be taken by the stream.
    """
    base = scratch_path(spark, "conversations")
    beats = f"{base}/heartbeats"
    beat = message_rows(spark.createDataFrame([], schema)).schema
    spark.createDataFrame([], beat).write.parquet(beats)
    dropped = 0

    def run() -> None:
        nonlocal dropped
        reader = spark.readStream.schema(schema)
        # as a pattern, the path may be a folder or a single file
        messages = (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(f"{path[:-1]}[{path[-1]}]")
        closing = spark.readStream.schema(beat).parquet(beats)
        rows = message_rows(messages).unionByName(closing).withWatermark("event_time", f"{int(delay.total_seconds())} seconds")
        kept = with_facts(in_blocks(rows, F.session_window("event_time", f"{int(idle.total_seconds())} seconds")))
        query = kept.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/progress").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        dropped += sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])

    run()
    # Closure: a heartbeat beyond every event; the restarted stream then times every open block out.
    close = spark.range(1).select(F.lit("").alias("conversation_id"), F.lit(-2).cast("long").alias("block"), F.lit(None).cast(beat["row"].dataType).alias("row"), F.lit(False).alias("visible"), F.lit("2200-01-01").cast("timestamp").alias("event_time"))
    close.write.mode("append").parquet(beats)
    run()
    drop_path(spark, f"{base}/progress")
    blocks = spark.read.schema(with_facts(spark.createDataFrame([], BLOCKS)).schema).parquet(f"{base}/out").where("block <> -2")
    if dropped:
        came = spark.read.schema(schema).parquet(path)
        known = blocks.select("conversation_id", F.explode("rows").alias("row"))
        rows = message_rows(came)
        late = rows.where("row is not null").join(known, (rows["conversation_id"] == known["conversation_id"]) & rows["row"].eqNullSafe(known["row"]), "left_anti")
        blocks = blocks.unionByName(with_facts(in_blocks(late.unionByName(rows.where("row is null")))))
    return merged(cut(blocks, "blocks") if dropped else blocks)


def judge(blocks: DataFrame, listed: DataFrame) -> DataFrame:
    """conversation_id, reason (null: kept): the first that fits of empty, broken, missing_reply.

    Conversations of either table come out; listed(id) may hold repeated and null ids.
    """
    order = Window.partitionBy("conversation_id").orderBy("block")
    edge = blocks.drop("rows").withColumns(
        {"before": F.lag("last_speaker").over(order), "is_first": F.row_number().over(order) == 1, "is_last": F.lead("block").over(order).isNull()}
    )
    reply = (F.col("first_speaker") == "assistant") & F.col("first_visible")
    seen = edge.groupBy("conversation_id").agg(
        F.bool_or("visible").alias("visible"),
        (
            F.bool_or(~F.col("readable"))
            | (F.sum("n") != F.sum("distinct_turns"))
            | (F.min("low") != 0)
            | (F.max("high") + 1 != F.sum("n"))
            | F.bool_or(F.col("is_first") & ~F.col("first_speaker").eqNullSafe("user"))
            | F.bool_or("two_assistants")
            | F.bool_or(F.coalesce((F.col("before") == "assistant") & (F.col("first_speaker") == "assistant"), F.lit(False)))
        ).alias("broken"),
        (
            F.bool_or("no_reply")
            | F.bool_or(F.coalesce((F.col("before") == "user") & ~reply, F.lit(False)))
            | F.bool_or(F.col("is_last") & F.col("last_speaker").eqNullSafe("user"))
        ).alias("no_reply"),
    )
    known = listed.select(F.col("id").alias("conversation_id")).where("conversation_id is not null").distinct().withColumn("listed", F.lit(True))
    both = seen.join(known, "conversation_id", "full")
    reason = (
        F.when(~F.coalesce("visible", F.lit(False)), "empty").when(F.col("listed").isNull() | F.col("broken"), "broken").when(F.col("no_reply"), "missing_reply")
    )
    return both.select("conversation_id", reason.alias("reason"))


def rebuilt(blocks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """conversation_id, turn, speaker, text of every kept conversation, one row a turn."""
    kept = verdicts.where("reason is null").select("conversation_id")
    rows = blocks.join(kept, "conversation_id", "left_semi").select("conversation_id", F.explode("rows").alias("m"))
    return rows.select("conversation_id", "m.turn", "m.speaker", "m.text")
