"""Token budgets and usage over the events, in batch and as a stream."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import usage
from fathom.plans.registry import query, table
from fathom.sources import keyvalue, scratch
from fathom.streaming import usage as streaming

_EVENTS = "e AS (SELECT event_id, ts, floor(value * 100)::BIGINT AS tokens, user_id FROM events)"
_LIMIT = 200_000


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "user_id", F.floor(F.col("value") * 100).cast("long").alias("tokens"))


@query("usage_daily", f"WITH {_EVENTS} SELECT date_trunc('day', ts)::TIMESTAMP AS period_start, sum(tokens)::BIGINT AS tokens, count(*) AS requests FROM e GROUP BY 1")
def usage_daily(spark: SparkSession, d: str) -> DataFrame:
    return usage.per_period(_events(spark, d), "day")


@query("usage_monthly", f"WITH {_EVENTS} SELECT date_trunc('month', ts)::TIMESTAMP AS period_start, user_id, sum(tokens)::BIGINT AS tokens, count(*) AS requests FROM e GROUP BY 1, 2")
def usage_monthly(spark: SparkSession, d: str) -> DataFrame:
    return usage.per_period(_events(spark, d), "month", "ts", "tokens", "user_id")


@query("budget_reject_running", f"WITH {_EVENTS}, r AS (SELECT event_id, coalesce(sum(tokens) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used_before FROM e) SELECT event_id, used_before, used_before < {_LIMIT} AS allowed FROM r")
def budget_reject_running(spark: SparkSession, d: str) -> DataFrame:
    out = usage.admit(_events(spark, d), _LIMIT)
    return out.select("event_id", F.col("used_before").cast("long").alias("used_before"), "allowed")


@query("budget_remaining", f"WITH {_EVENTS} SELECT date_trunc('day', ts)::TIMESTAMP AS period_start, greatest({_LIMIT} - sum(tokens), 0)::BIGINT AS remaining, sum(tokens) >= {_LIMIT} AS exhausted FROM e GROUP BY 1")
def budget_remaining(spark: SparkSession, d: str) -> DataFrame:
    days = usage.per_period(_events(spark, d), "day")
    return days.select("period_start", usage.remaining(_LIMIT, F.col("tokens")).alias("remaining"), usage.exhausted(_LIMIT, F.col("tokens")).alias("exhausted"))


@query("usage_report", f"WITH {_EVENTS} SELECT 'month' AS period, coalesce(sum(tokens), 0)::BIGINT AS tokens, greatest(9000000 - coalesce(sum(tokens), 0), 0)::BIGINT AS remaining, coalesce(sum(tokens), 0) >= 9000000 AS exhausted FROM e WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'")
def usage_report(spark: SparkSession, d: str) -> DataFrame:
    return usage.report(_events(spark, d), "month", datetime(2024, 1, 17, 12), 9_000_000).select("period", "tokens", "remaining", "exhausted")


@query("stream_usage_daily", f"WITH {_EVENTS} SELECT date_trunc('day', ts)::TIMESTAMP AS period_start, sum(tokens)::BIGINT AS tokens, count(*) AS requests FROM e GROUP BY 1")
def stream_usage_daily(spark: SparkSession, d: str) -> DataFrame:
    """The same counters from a stream over the events, in complete mode."""
    src = f"{d}/events.parquet"
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    rows = stream.select("event_id", "ts", "user_id", F.floor(F.col("value") * 100).cast("long").alias("tokens"))
    place = scratch.new_folder(spark, "stream-usage")
    days = streaming.daily_counters(rows)
    write = lambda df, epoch: df.write.mode("overwrite").parquet(f"{place}/days")
    days.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(days.schema).parquet(f"{place}/days")


_NOW = "2024-01-20 12:00:00"
_LIVE = f"""WITH {_EVENTS}, c AS (
    SELECT 'day' AS period, date_trunc('day', ts)::TIMESTAMP AS period_start, min(ts) AS first_written, sum(tokens)::BIGINT AS tokens FROM e WHERE ts <= TIMESTAMP '{_NOW}' GROUP BY 2
    UNION ALL SELECT 'month', date_trunc('month', ts)::TIMESTAMP, min(ts), sum(tokens)::BIGINT FROM e WHERE ts <= TIMESTAMP '{_NOW}' GROUP BY 2)
SELECT period, period_start, tokens FROM c WHERE first_written + CASE period WHEN 'day' THEN INTERVAL 48 HOUR ELSE INTERVAL 1488 HOUR END > TIMESTAMP '{_NOW}'"""


@query("live_counters", _LIVE)
def live_counters(spark: SparkSession, d: str) -> DataFrame:
    """Daily and monthly counters as of a moment; those that have outlived their time are gone."""
    now = F.lit(_NOW).cast("timestamp")
    events = _events(spark, d).where(F.col("ts") <= now)
    parts = [
        events.groupBy(F.lit(period).alias("period"), F.date_trunc(period, "ts").alias("period_start")).agg(F.min("ts").alias("first_written"), F.sum("tokens").alias("tokens"))
        for period in ("day", "month")
    ]
    return usage.live_counters(parts[0].unionByName(parts[1]), now).select("period", "period_start", "tokens")


@query(
    "key_values",
    f"""WITH {_EVENTS}, f AS (SELECT user_id, min(ts) AS first FROM e WHERE ts <= TIMESTAMP '{_NOW}' GROUP BY user_id)
    SELECT e.user_id::VARCHAR AS key, sum(tokens)::VARCHAR AS value FROM e JOIN f USING (user_id)
    WHERE ts <= TIMESTAMP '{_NOW}' AND (first + INTERVAL 5 DAY > TIMESTAMP '{_NOW}' OR ts >= first + INTERVAL 5 DAY) GROUP BY 1""",
)
def key_values(spark: SparkSession, d: str) -> DataFrame:
    """A counter for each user that lives five days from its first event; later events start it anew."""
    events = _events(spark, d).select(F.col("user_id").cast("string").alias("key"), F.col("tokens").cast("string").alias("value"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    added = events.select("key", F.lit("incr").alias("op"), "value", "at", "seq", F.lit(None).cast("timestamp").alias("expires"))
    first = events.groupBy("key").agg(F.min("at").alias("at"))
    dated = first.select("key", F.lit("expire").alias("op"), F.lit(None).cast("string").alias("value"), "at", F.lit(1 << 62).alias("seq"), (F.col("at") + F.make_dt_interval(F.lit(5))).alias("expires"))
    return keyvalue.live(added.unionByName(dated), F.lit(_NOW).cast("timestamp")).select("key", "value")
