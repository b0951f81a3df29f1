"""Serving as a stream: requests come in micro-batches, each is searched as one batch of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def request_stream(spark: SparkSession, path: str, schema: str = "qid BIGINT, qvec ARRAY<DOUBLE>", files: int = 4) -> DataFrame:
    """Requests that arrive as Parquet files, at most ``files`` in a batch (back-pressure)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def serve(requests: DataFrame, search: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Search each micro-batch and write its answers once, by the number of the batch."""

    def answer(batch: DataFrame, number: int) -> None:
        search(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def throughput(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Requests in each window of time; as a stream, windows close once ``late`` has passed."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("requests")).select(F.col("w.start").alias("start"), "requests")
