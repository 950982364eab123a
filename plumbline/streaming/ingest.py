"""Structured Streaming: vectors into a table, and request figures by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.table import VectorTable, conform


def ingest(stream: DataFrame, table: VectorTable, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Upsert each micro-batch as a new version. Replaying a batch after a failure writes the same rows again, so the
    table ends up the same; rows need an id for that."""

    def merge(batch: DataFrame, _: int) -> None:
        rows = conform(batch.where("id is not null and vector is not null"))
        if not rows.isEmpty():
            table.insert(rows)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def endpoint(path):
    """A path with ids and numbers as :id."""
    uuid = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    return F.regexp_replace(F.regexp_replace(path, f"/{uuid}", "/:id"), r"/[0-9]+(?=/|$)", "/:id")


def figures(requests: DataFrame, latency: str, failed, *by) -> DataFrame:
    """Requests, failures, success rate and latencies per group; for tables and streams alike."""
    return requests.groupBy(*by).agg(
        F.count("*").alias("requests"), F.sum(failed.cast("int")).cast("bigint").alias("failures"), F.round(1 - F.sum(failed.cast("int")) / F.count("*"), 6).alias("success_rate"),
        F.round(F.avg(latency), 6).alias("avg_latency"), F.min(latency).alias("min_latency"), F.max(latency).alias("max_latency"),
    )


def windowed_figures(events: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Figures per window and event type of an events stream (ts, event_type, value); what is later than ``late`` is dropped."""
    timed = events.withWatermark("ts", late)
    return figures(timed, "value", F.col("event_type") == "error", F.window("ts", every), "event_type")


def rate_limited(events: DataFrame, per_minute: int, late: str = "10 minutes") -> DataFrame:
    """(window, user_id, requests, refused): what a limit of ``per_minute`` requests a user would refuse."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "user_id").agg(F.count("*").alias("requests"))
    return counted.withColumn("refused", F.greatest(F.lit(0), F.col("requests") - per_minute))
