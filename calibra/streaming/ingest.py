"""Checkpointed ingestion and windowed results with Structured Streaming.

The checkpoint takes the place of cursor files: after an interruption a query goes on from its last committed batch,
and rows seen twice are told by their key within the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.sources.chunks import CHUNK_ROWS, ChunkStore
from calibra.sources.sinks import insert_absent


def file_stream(spark: SparkSession, path: str, schema, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def ingest(stream: DataFrame, target: str, checkpoint: str, keys: list[str], event_time: str = "ts", late: str = "1 hour"):
    """Appends each key's first row to Parquet; runs until what is there has been read, and may be run again."""
    once = stream.withColumn("_at", F.col(event_time).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(keys).drop("_at")
    query = once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert_absent(stream: DataFrame, target: str, checkpoint: str, key: str, after: Callable[[int], None] = lambda k: None):
    """Appends rows whose key isn't stored yet: exact across any delay, by an anti-join a batch."""

    def batch(df: DataFrame, k: int) -> None:
        insert_absent(df, target, key)
        after(k)

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert_chunks(stream: DataFrame, folder: str, name: str, checkpoint: str, key: str, rows: int = CHUNK_ROWS):
    """Appends rows whose key isn't stored yet to a chunked store, which reads the keys of those chunks only that may hold one.
    A batch that comes again after an interruption adds nothing, as its keys are there."""
    store = ChunkStore(stream.sparkSession, folder, name, key, rows)
    query = stream.writeStream.foreachBatch(lambda df, _: store.append(df) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def tumbling_counts(stream: DataFrame, event_time: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    timed = stream.withColumn("_at", F.col(event_time).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", width).alias("w")).agg(F.count(F.lit(1)).alias("n")).selectExpr("w.start AS window_start", "n")


def cumulative_counts(stream: DataFrame, key: str) -> DataFrame:
    """Totals so far; for complete or update mode."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def run_to_table(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a streaming aggregate over what is there into an in-memory table, for tests and small results."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
