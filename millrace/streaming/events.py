"""Event streams: windows with a bound on lateness, sessions, files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def windowed(events: DataFrame, *, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: list[str] | None = None, time: str = "ts", value: str = "value") -> DataFrame:
    """start, keys, n, total of each window; state goes once the watermark has passed. Works on batches, too."""
    t = F.col(time).cast("timestamp")
    w = F.window("ts_", size, slide) if slide else F.window("ts_", size)
    g = events.withColumn("ts_", t).withWatermark("ts_", late).groupBy(w.alias("w"), *(by or []))
    return g.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *(by or []), "n", "total")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "10 minutes", user: str = "user_id", time: str = "ts") -> DataFrame:
    """user, start, end, n: runs of events without a gap."""
    g = events.withColumn("ts_", F.col(time).cast("timestamp")).withWatermark("ts_", late).groupBy(F.session_window("ts_", gap).alias("w"), F.col(user))
    return g.agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Every batch to ``sink`` with its number: a sink that writes by number is safe to repeat."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
