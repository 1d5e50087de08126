"""Streaming token counters and idempotent bulk loads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counters(events: DataFrame, ts: str = "ts", tokens: str = "tokens", late: str = "1 hour") -> DataFrame:
    """(period_start, tokens, requests) per UTC day over a stream; a day's state goes once the watermark has passed it."""
    w = F.window(F.col(ts), "1 day")
    out = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(w).agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("requests"))
    return out.select(F.col("window.start").alias("period_start"), "tokens", "requests")


def monthly_from_daily(daily: DataFrame) -> DataFrame:
    """Months are summed from finished days in batch: a streaming window cannot have a calendar month's length."""
    return daily.groupBy(F.date_trunc("month", "period_start").alias("period_start")).agg(F.sum("tokens").alias("tokens"), F.sum("requests").alias("requests"))


def bulk_load(stream: DataFrame, write: Callable[[DataFrame], None], checkpoint: str):
    """Runs the stream's waiting data through `write` (a merge by id, so a batch that is run again changes nothing), then stops."""
    return stream.writeStream.foreachBatch(lambda df, epoch: write(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, checkpoint: str, path: str, mode: str = "append"):
    """Writes what is waiting as Parquet, then stops."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
