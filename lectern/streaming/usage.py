"""Structured Streaming forms of what the service does as rows arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_usage(usage: DataFrame, zone: str = "UTC", late: str = "1 day") -> DataFrame:
    """Tokens and calls per local day and user; days follow the zone's clock changes.

    The watermark is on the day's beginning, and a day is 25 hours at most, so that a row may come ``late`` after its day's end.
    """
    day = F.to_date(F.convert_timezone(None, F.lit(zone), F.col("ts")))  # whatever the session's zone
    begins = F.timestamp_seconds(F.unix_date(day).cast("long") * 86_400)
    rows = usage.withColumns({"day": day, "_begins": begins}).withWatermark("_begins", f"{late} 25 hours")
    return rows.groupBy("_begins", "day", "user_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls")).drop("_begins")


def once_per_token(requests: DataFrame, ttl: str = "5 minutes") -> DataFrame:
    """The first request with each token id (site_id, jti); ids are forgotten after their time."""
    return requests.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["site_id", "jti"])


def once_per_message(messages: DataFrame, late: str = "1 hour") -> DataFrame:
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["conversation_id", "client_msg_id"])


def run_available(stream: DataFrame, path: str, key: list[str]) -> DataFrame:
    """All that is there now, as the latest row of each ``key``: every micro-batch writes the rows that it changed as Parquet below ``path``.

    Update mode, so a watermark bounds the state; nothing is held by the driver. A batch that runs
    again overwrites its own folder.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(schema.add("batch", "long")).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    values = [c for c in stream.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*key, "v.*")


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str = "30 seconds"):
    """Hands every micro-batch to ``apply`` (an upsert of a snapshot, a job queue step)."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
