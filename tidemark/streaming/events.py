"""Structured Streaming forms: windowed events with a watermark, and indexing of changed files.

These extend the batch operators to growing inputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, schema: str, glob: str = "*.parquet") -> DataFrame:
    """A stream of the Parquet files that appear under path."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)


def _timed(events: DataFrame) -> DataFrame:
    """Event time with a zone, as watermarks need it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total; events more than late behind are left out."""
    out = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    out = out.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, session_start, n of runs of events with no gap as long as gap."""
    out = _timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")


def index_changed(files: DataFrame, index: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Runs index on every new (path, content) of a file stream, each once, and stops when all there is has been seen."""
    fresh = files.withColumn("hash", F.left(F.sha2("content", 256), F.lit(16))).dropDuplicates(["path", "hash"])
    return (
        fresh.writeStream.foreachBatch(lambda batch, _: index(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
