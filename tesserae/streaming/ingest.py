"""Incremental ingestion as a stream: new Parquet files of documents become commits of the store."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest_stream(spark: SparkSession, source: str, schema: str, checkpoint: str, write: Callable[[DataFrame, int], None], *, files_a_batch: int = 64) -> StreamingQuery:
    """Reads each new file once and hands batches ``(rows with hash, batch id)`` to ``write``,
    which must be idempotent by batch id. Runs until what is there is read."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    hashed = rows.withColumn("hash", F.sha2("text", 256))
    return hashed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_documents(engine, collection: str, source: str, schema: str, checkpoint: str, *, name: str = "documents", files_a_batch: int = 64) -> StreamingQuery:
    """Ingests new Parquet files of documents ``(path, text, ...)`` into a collection of the engine's
    warehouse, exactly once: Spark gives a batch the same number and rows when it repeats one, and
    the warehouse passes over a number that it has committed. Runs until what is there is read."""
    rows = engine.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    each = rows.writeStream.queryName(f"ingest-{name}-{uuid.uuid4().hex[:8]}").foreachBatch(lambda batch, n: engine.ingest_batch(collection, batch, name, n))
    return each.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(spark: SparkSession, source: str, schema: str, *, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events by window and type with a watermark, for a live index of activity."""
    events = spark.readStream.schema(schema).parquet(source)
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
