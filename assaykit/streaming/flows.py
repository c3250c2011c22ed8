"""Structured Streaming: daily usage, report states, caches that expire, reports that arrive as files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import usage_columns


def table_stream(spark: SparkSession, path: str, like: DataFrame, per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def usage_daily_stream(calls: DataFrame, keys: list[str], at: str = "ts", late: str = "1 day", tokens: str = "tokens", cached: str = "cached") -> DataFrame:
    """Daily usage over a stream; a day is final once the watermark is past its end. Same columns as the batch operator."""
    day = F.window(at, "1 day")
    paid = ~F.col(cached)
    found = calls.withWatermark(at, late).groupBy(*keys, day).agg(
        F.count("*").alias("requests"), F.count_if(paid).alias("calls"), F.count_if(F.col(cached)).alias("cache_hits"),
        F.coalesce(F.sum(F.when(paid, F.col(tokens))), F.lit(0)).cast("long").alias("tokens"),
    )
    return usage_columns(found.select(*keys, F.to_date("window.start").alias("day"), "requests", "calls", "cache_hits", "tokens"))


def latest_status(changes: DataFrame, report: str, at: str, status: str) -> DataFrame:
    """Current state of each report, for a stream (update mode) or a batch."""
    return changes.groupBy(report).agg(F.max_by(status, at).alias(status), F.max(at).alias(at))


def healed_status(status: Column, children: Column, confidence: Column) -> tuple[Column, Column]:
    """Pending or processing reports with children are processed; a missing confidence follows their number."""
    healed = status.isin("pending", "processing") & (children > 0)
    guess = F.least(F.lit(0.95), 0.5 + 0.05 * children)
    return F.when(healed, "processed").otherwise(status), F.when(healed & (F.coalesce(confidence, F.lit(0.0)) == 0), guess).otherwise(confidence)


def fresh(entries: DataFrame, made: str, now: Column, days: int) -> DataFrame:
    """Cache entries that haven't expired: an entry goes once it is older than ``days``."""
    return entries.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(made).cast("timestamp")) <= days * 86_400_000_000)


def first_in_period(events: DataFrame, keys: list[str], at: str, period: str) -> DataFrame:
    """The first event of each key; keys are forgotten after the watermark, so state stays bounded."""
    return events.withWatermark(at, period).dropDuplicatesWithinWatermark(keys)


def ingest(stream: DataFrame, process: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str) -> StreamingQuery:
    """Process what arrives and append it to ``target``; a batch that runs again replaces its own rows only."""

    def batch(df: DataFrame, number: int) -> None:
        process(df.dropDuplicates([key])).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
