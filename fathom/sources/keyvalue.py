"""Keys with values, counters and times to live, as a log of changes on Parquet."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "key string, op string, value string, at timestamp, seq long, expires timestamp"
#: Entries of the log, about, beyond which compact() is worth a call; reading folds the entries of a key in order.
COMPACT_AT = 1000


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


class KeyValues:
    """get, set, incr and expire-if-not-set over a folder. Changes are appended; the last of a key's entries by time count."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._seq = spark, path.rstrip("/"), 0

    def _append(self, key: str, op: str, value: str | None, at: datetime | None, expires: datetime | None) -> None:
        self._seq += 1
        row = [(key, op, value, at or _now(), self._seq, expires)]
        self.spark.createDataFrame(row, LOG).coalesce(1).write.mode("append").parquet(self.path)

    def _log(self) -> DataFrame:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(self.path)

    def set(self, key: str, value: str, ttl: timedelta | None = None, at: datetime | None = None) -> None:
        """Puts a value in place of what there was, with a new time to live or none."""
        at = at or _now()
        self._append(key, "set", str(value), at, at + ttl if ttl else None)

    def incr(self, key: str, by: int = 1, at: datetime | None = None) -> int:
        """Adds to a counter, which starts at 0; its time to live stays. Concurrent calls add up, in any order."""
        self._append(key, "incr", str(int(by)), at, None)
        return int(self.get(key, at) or 0)

    def expire_if_unset(self, key: str, ttl: timedelta, at: datetime | None = None) -> None:
        """Gives a key that has none a time to live."""
        at = at or _now()
        self._append(key, "expire", None, at, at + ttl)

    def get(self, key: str, at: datetime | None = None) -> str | None:
        row = live(self._log().where(F.col("key") == key), F.lit(at or _now())).first()
        return row["value"] if row else None

    def all(self, at: datetime | None = None) -> DataFrame:
        """Rows (key, value, expires) of all keys that live."""
        return live(self._log(), F.lit(at or _now()))

    def compact(self, at: datetime | None = None) -> None:
        """Replaces the log by one entry per living key. Not for use beside other writers."""
        at = at or _now()
        place = f"{self.path}-{uuid.uuid4().hex}"
        kept = self.all(at).select("key", F.lit("set").alias("op"), "value", F.lit(at).alias("at"), F.lit(0).cast("long").alias("seq"), "expires")
        kept.write.parquet(place)
        self.spark.read.schema(LOG).parquet(place).write.mode("overwrite").parquet(self.path)


def live(log: DataFrame, now: Column) -> DataFrame:
    """Folds each key's entries in order of time: an entry that comes after the key has expired finds nothing there."""
    entries = log.where(F.col("at") <= now).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "op", "value", "expires"))).alias("e"))
    start = F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("timestamp").alias("expires"))

    def step(s: Column, e: Column) -> Column:
        gone = F.coalesce(s["expires"] <= e["at"], F.lit(False))
        value, expires = F.when(~gone, s["value"]), F.when(~gone, s["expires"])
        put = F.struct(e["value"].alias("value"), e["expires"].alias("expires"))
        added = F.struct((F.coalesce(value.cast("bigint"), F.lit(0)) + e["value"].cast("bigint")).cast("string").alias("value"), expires.alias("expires"))
        dated = F.struct(value.alias("value"), F.when(value.isNotNull(), F.coalesce(expires, e["expires"])).alias("expires"))
        return F.when(e["op"] == "set", put).when(e["op"] == "incr", added).otherwise(dated)

    out = entries.select("key", F.aggregate("e", start, step).alias("s")).select("key", "s.value", "s.expires")
    return out.where(F.col("value").isNotNull() & F.coalesce(F.col("expires") > now, F.lit(True)))
