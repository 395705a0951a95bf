"""The query log as a stream: counts by status over event-time windows with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tomeline.session import scratch_path


def windowed_status(log: DataFrame, window: str = "1 day", late: str = "60 days") -> DataFrame:
    """start, status, queries, hops of each window; works on a static table and on a stream.

    Rows later than the watermark are dropped by a stream; late must therefore exceed the lateness of the source.
    """
    timed = log.withWatermark("created_at", late) if log.isStreaming else log
    out = timed.groupBy(F.window("created_at", window).alias("w"), "status").agg(F.count("*").alias("queries"), F.sum("hops").alias("hops"))
    return out.select(F.col("w.start").alias("start"), "status", "queries", "hops")


def run_windowed_status(spark: SparkSession, path: str, schema: StructType, window: str = "1 day", late: str = "60 days", files_per_trigger: int | None = None) -> DataFrame:
    """Run the stream over what is there and read its windows back.

    Windows come out once the watermark has passed them, and their state goes; those still open at the end are closed by
    a heartbeat beyond every event.
    """
    base = scratch_path(spark, "log")
    beats = f"{base}/heartbeats"
    spark.createDataFrame([], schema).write.parquet(beats)

    def run() -> None:
        # the last character in brackets makes the path a pattern, which may be a folder or a single file
        reader = spark.readStream.schema(schema)
        rows = (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(f"{path[:-1]}[{path[-1]}]")
        source = rows.unionByName(spark.readStream.schema(schema).parquet(beats)).withColumn("created_at", F.col("created_at").cast("timestamp"))
        query = windowed_status(source, window, late).writeStream.format("parquet").option("path", f"{base}/out").outputMode("append").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    beat = spark.range(1).select(*[(F.lit("2200-01-01").cast("timestamp").cast(f.dataType) if f.name == "created_at" else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])
    beat.write.mode("append").parquet(beats)
    run()
    done = spark.read.schema("start timestamp, status string, queries long, hops long").parquet(f"{base}/out")
    return done.where("start < timestamp '2199-01-01'")
