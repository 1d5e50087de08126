"""Token budgets and usage reports per UTC day and month."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_period(events: DataFrame, period: str, ts: str = "ts", tokens: str = "tokens", *by: str) -> DataFrame:
    """(period_start, ..., tokens, requests); period is day or month."""
    return events.groupBy(F.date_trunc(period, F.col(ts)).alias("period_start"), *by).agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("requests"))


def remaining(limit: Column | int, used: Column) -> Column:
    """-1 where there is no limit (0), else what is left, at least 0."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    return F.when(limit == 0, F.lit(-1)).otherwise(F.greatest(limit - used, F.lit(0)))


def exhausted(limit: Column | int, used: Column) -> Column:
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    return (limit > 0) & (used >= limit)


def admit(events: DataFrame, limit: int, period: str = "day", ts: str = "ts", tokens: str = "tokens", order: str = "event_id", action: str = "reject") -> DataFrame:
    """Adds used_before and allowed: whether a request came before its period's budget was used up.

    Requests are taken in order of time, and count whether or not they are allowed when action is warn; a limit of 0
    means none. With `reject`, refused requests use nothing: since all after the first refusal are refused until the
    period ends, the sum up to the first one decides for all.
    """
    # Running sums within a second, and over the seconds of a period, of which there is a fixed number: no task sorts a day.
    at = events.withColumns({"__p": F.date_trunc(period, F.col(ts)), "__s": F.date_trunc("second", F.col(ts))})
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seconds = at.groupBy("__p", "__s").agg(F.sum(tokens).alias("__n")).withColumn("__before", before(Window.partitionBy("__p").orderBy("__s")))
    at = at.withColumn("__n", F.col(tokens)).withColumn("__within", before(Window.partitionBy("__p", "__s").orderBy(ts, order)))
    out = at.join(seconds.drop("__n"), ["__p", "__s"]).withColumn("used_before", (F.col("__before") + F.col("__within")).cast("double"))
    out = out.select(*events.columns, "used_before")
    over = exhausted(limit, F.col("used_before"))
    return out.withColumn("allowed", F.lit(True) if action == "warn" else ~over).withColumn("over_budget", over)


def report(events: DataFrame, period: str, now: datetime, limit: int, ts: str = "ts", tokens: str = "tokens") -> DataFrame:
    """One row: period, its bounds, tokens used, limit, remaining, exhausted and resets_at.

    `total` has no bounds and reports the month's counters: no others are kept.
    """
    now = now.astimezone(UTC) if now.tzinfo else now
    day = datetime(now.year, now.month, now.day)
    month = datetime(now.year, now.month, 1)
    following = datetime(now.year + now.month // 12, now.month % 12 + 1, 1)
    if period == "day":
        start, end = day, datetime.fromordinal(day.toordinal() + 1)
    elif period in ("month", "total"):
        start, end = month, following
    else:
        raise ValueError("period is day, month or total")
    used = events.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end))).agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"))
    bounds = [F.lit(None if period == "total" else x).cast("timestamp") for x in (start, end)]
    return used.select(
        F.lit(period).alias("period"), bounds[0].alias("start"), bounds[1].alias("end"), F.lit(0).alias("requests"), "tokens",
        F.lit(limit).alias("limit"), remaining(limit, F.col("tokens")).alias("remaining"), exhausted(limit, F.col("tokens")).alias("exhausted"), F.lit(end).alias("resets_at"),
    )


#: How long counters are kept, in hours.
DAILY_TTL, MONTHLY_TTL = 48, 62 * 24


def live_counters(counters: DataFrame, now: Column) -> DataFrame:
    """Counters (period, period_start, first_written, tokens) that have not outlived their time, counted from their first write."""
    hours = F.when(F.col("period") == "day", F.lit(DAILY_TTL)).otherwise(F.lit(MONTHLY_TTL))
    return counters.where(F.col("first_written") + F.make_interval(hours=hours) > now)
