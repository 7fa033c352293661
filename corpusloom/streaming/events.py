"""Progress events as a stream, and server-sent event frames. An extension: the library's queries are batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(folder)


def per_window(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and mean value by window and type; events later than the watermark are left out."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("window.start", "event_type", "n", "mean")


def publish(frame: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch under its own folder, so that a batch that runs again overwrites itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return frame.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parse_frames(lines: DataFrame) -> DataFrame:
    """stream, frame, event, data of stream, n, line: frames end at blank lines, comment lines count for nothing."""
    from pyspark.sql import Window

    order = Window.partitionBy("stream").orderBy("n")
    rows = lines.withColumn("frame", F.sum(F.when(F.col("line") == "", 1).otherwise(0)).over(order)).where(~F.col("line").startswith(":") & (F.col("line") != ""))
    field = lambda name: F.when(F.col("line").startswith(name + ":"), F.regexp_replace("line", f"^{name}: ?", ""))
    data = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(field("data").isNotNull(), F.struct("n", field("data").alias("d"))))), lambda x: x["d"]), "\n")
    return rows.groupBy("stream", "frame").agg(F.coalesce(F.max(field("event")), F.lit("message")).alias("event"), data.alias("data"))


def first_token(events: DataFrame) -> DataFrame:
    """stream, first_event_ms, first_token_ms of stream, event, elapsed_ms."""
    return events.groupBy("stream").agg(F.min("elapsed_ms").alias("first_event_ms"), F.min(F.when(F.col("event") == "generation_delta", F.col("elapsed_ms"))).alias("first_token_ms"))
