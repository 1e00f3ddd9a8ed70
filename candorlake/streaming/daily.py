"""Daily counts of a stream of reviews or events, and bursts found batch by batch. An extension: the batch
operators need none of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from candorlake.operators import temporal


def event_stream(spark: SparkSession, folder: str, files: str = "events*.parquet") -> DataFrame:
    """Events as a stream of the files of a folder; times as timestamps, which watermarks need."""
    schema = spark.read.parquet(f"{folder}/{files}").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(stream: DataFrame, entity: str, ts: str = "ts", late: str = "2 days") -> DataFrame:
    """(entity, day, n) in windows of a day; rows later than ``late`` are left out."""
    rows = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), entity).agg(F.count("*").alias("n"))
    return rows.select(entity, F.to_date("window.start").alias("day"), "n")


def burst_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, entity: str, ts: str = "ts") -> StreamingQuery:
    """Runs the burst rule over all daily counts so far whenever some change."""

    def each(batch: DataFrame, number: int) -> None:
        counts = batch.select(F.col(entity).alias("place"), "day", F.col("n").alias("review_count"))
        sink(temporal.bursts(temporal.calendar(counts)), number)

    return daily_counts(stream, entity, ts).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(each).start()
