"""URL filtering by dated lists: each capture is judged by the entries in force when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a time bucket: captures meet only intervals that touch their bucket.
BUCKET_DAYS = 32
#: Characters of the longest host name, which has room for half as many labels: longer strings match by themselves and by their
#: ends of this length.
MOST_HOST = 253
_DAY = 86400


def host(url: Column) -> Column:
    """The lower-cased host of an absolute URL, without user, port and final dot; null if there is none."""
    found = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    bare = F.regexp_replace(found, r"\.$", "")
    return F.when(bare != "", bare)


def lookups(name: Column) -> Column:
    """The host and its parent domains, by labels."""
    labels = F.split(name, r"\.")
    most = MOST_HOST // 2 + 1
    tail = F.slice(labels, F.greatest(F.lit(1), F.size(labels) - (most - 1)), F.lit(most))
    up = F.transform(F.sequence(F.lit(1), F.size(tail)), lambda i: F.array_join(F.slice(tail, i, F.size(tail)), "."))
    return F.array_union(F.array(name), F.filter(up, lambda d: F.length(d) <= MOST_HOST))


def validity(entries: DataFrame) -> DataFrame:
    """From entries (domain, listed, action `add` or `remove`): rows (domain, since, until) in which a domain is listed.

    Entries of one domain and instant count once, and a removal beats an addition. `until` is exclusive and null while
    the entry stands. A second addition changes nothing, nor does a removal of what is not listed.
    """
    name = F.regexp_replace(F.lower(F.trim("domain")), r"^\.+|\.+$", "")
    e = entries.select(name.alias("domain"), F.col("listed").cast("timestamp").alias("listed"), (F.lower("action") == "add").alias("on"))
    e = e.where("domain != '' and listed is not null and `on` is not null").groupBy("domain", "listed").agg(F.min("on").alias("on"))
    w = Window.partitionBy("domain").orderBy("listed")
    changes = e.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False))).where("`on` != was")
    return changes.withColumn("until", F.lead("listed").over(w)).where("`on`").select("domain", F.col("listed").alias("since"), "until")


def _bucket(t: Column) -> Column:
    return F.floor(t.cast("long") / (BUCKET_DAYS * _DAY))


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """One row per capture: id, url, fetched, host, blocked, matched_domain (the longest listed one), listed_since.

    List entries become validity intervals; a capture is joined to those of its host and parent domains that hold at its
    fetch time (since <= fetched < until). The join is on domain and time bucket, so a domain with a long history, or
    one that most captures share, is never met in full by each capture, and Spark can split its hot keys.

    Null or unparsable URLs and null times match nothing and are not blocked; captures that agree in id, URL and time
    share one row; an empty list blocks nothing; an empty table gives no rows. Other columns are ignored.
    """
    c = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).cast("timestamp").alias("fetched")).distinct()
    c = c.withColumn("host", host(F.col("url")))
    last = captures.agg(F.max(F.col(time_col).cast("timestamp"))).first()[0]
    intervals = validity(entries)
    if last is not None:
        end = F.least(F.coalesce(F.col("until"), F.lit(last)), F.lit(last))
        spans = F.when(F.col("since") <= F.lit(last), F.sequence(_bucket(F.col("since")), F.greatest(_bucket(F.col("since")), _bucket(end))))
        intervals = intervals.withColumn("bucket", F.explode(spans))
    else:
        intervals = intervals.withColumn("bucket", F.lit(0).cast("long")).where("false")
    asked = c.where("host is not null and fetched is not null").withColumns({"domain": F.explode(lookups(F.col("host"))), "bucket": _bucket(F.col("fetched"))})
    met = asked.join(intervals, ["domain", "bucket"]).where("since <= fetched and (until is null or fetched < until)")
    best = F.max(F.struct(F.length("domain").alias("n"), F.col("domain"), F.col("since")))
    met = met.groupBy("id", "url", "fetched").agg(best.alias("best")).withColumn("hit", F.lit(True))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"m.{k}")) for k in ("id", "url", "fetched")]
    out = c.alias("c").join(met.alias("m"), same[0] & same[1] & same[2], "left")
    return out.select(
        F.col("c.id").alias(id_col), F.col("c.url").alias(url_col), F.col("c.fetched").alias(time_col), F.col("c.host").alias("host"),
        F.coalesce("hit", F.lit(False)).alias("blocked"), F.col("best.domain").alias("matched_domain"), F.col("best.since").alias("listed_since"),
    )
