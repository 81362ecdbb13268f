"""Windows over event time; each function takes a batch or a stream of events (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.lineage import shared_folder


def watermarked(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay) if events.isStreaming else events


def windowed(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of tumbling or sliding windows."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return watermarked(events).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, start, stop, n) of runs of a user's events without a gap."""
    return watermarked(events).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def deduplicated(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def enriched(events: DataFrame, customers: DataFrame) -> DataFrame:
    """Stream-static join."""
    return events.join(customers, events["user_id"] == customers["c_custkey"]).select("event_id", "user_id", "c_mktsegment", "value")


def paired(views: DataFrame, purchases: DataFrame, within: str = "1 hour") -> DataFrame:
    """Interval join of two streams: purchases of a user within a time after a view."""
    v = watermarked(views).select(F.col("event_id").alias("view_id"), F.col("user_id").alias("v_user"), F.col("ts").alias("v_ts"))
    p = watermarked(purchases).select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("p_user"), F.col("ts").alias("p_ts"))
    return v.join(p, F.expr(f"v_user = p_user AND p_ts >= v_ts AND p_ts <= v_ts + INTERVAL {within}")).select("view_id", "purchase_id")


def run_once(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything that is there now through the stream into files of the shared folder; of a complete result the last state."""
    root = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    write = "overwrite" if mode == "complete" else "append"
    # A batch that is tried again after a failure has a file for its number already, and replaces it.
    keep = lambda df, n: df.write.mode("overwrite").parquet(f"{root}/rows/{'all' if write == 'overwrite' else f'batch={n}'}")
    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{root}/rows")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A file source wants a folder or a pattern; an event time has to be a timestamp.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
