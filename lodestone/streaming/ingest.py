"""Incremental ingestion and windowed counts with Structured Streaming.

The same functions run on a stream or on a static table; state is bounded by watermarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def parquet_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def new_documents(stream: DataFrame, checksum: str, at: str, late: str = "1 day") -> DataFrame:
    """Each checksum once within the watermark: repeated uploads are dropped, state older than ``late`` is forgotten."""
    if stream.isStreaming:
        return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([checksum])
    return stream.dropDuplicates([checksum])


def tumbling_counts(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    e = events.withColumn("at", F.col(at).cast("timestamp"))
    e = e.withWatermark("at", late) if e.isStreaming else e
    return e.groupBy(F.window("at", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sliding_counts(events: DataFrame, at: str, key: str, width: str = "2 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    e = events.withColumn("at", F.col(at).cast("timestamp"))
    e = e.withWatermark("at", late) if e.isStreaming else e
    return e.groupBy(F.window("at", width, step).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def session_counts(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    e = events.withColumn("at", F.col(at).cast("timestamp"))
    e = e.withWatermark("at", late) if e.isStreaming else e
    return e.groupBy(F.session_window("at", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def start_upsert(stream: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Write a stream into a parquet table, each key once, restartable from its checkpoint."""
    from lodestone.sources.writers import insert_or_ignore

    def batch(df: DataFrame, _: int) -> None:
        insert_or_ignore(df, path, key)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
