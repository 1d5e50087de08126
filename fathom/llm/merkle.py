"""WARC fixity audit: Merkle trees over records and ordered ranges of byte offsets, compared from the roots down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.runtime import few, materialize

#: A node of the lowest level holds the records that start in 2^RANGE_BITS bytes, one of a higher level 2^FANOUT_BITS nodes.
RANGE_BITS, FANOUT_BITS = 16, 6
_HEX = 8


def warc_record(uri: str = "url", payload: str = "html", kind: str = "resource") -> Column:
    """The record's bytes as text: header lines, then the payload. Null fields have no header line, so null differs from empty."""
    crlf = "\r\n"
    head = F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: {kind}{crlf}"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.col(uri), F.lit(crlf)), F.lit("")),
        F.coalesce(F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string"), F.lit(crlf)), F.lit("")),
    )
    return F.concat(head, F.lit(crlf), F.coalesce(F.col(payload), F.lit("")), F.lit(crlf * 2))


def record_digests(archive: DataFrame, number: str, record: Column) -> DataFrame:
    """Rows (number, bytes, digest): the length and a SHA-256 for each record number.

    Records that share a number are summed as a multiset, word by word of their own SHA-256, in partial aggregates: any
    number of repeats costs one row per map task.
    """
    d = archive.where(F.col(number).isNotNull()).select(F.col(number).cast("long").alias("number"), F.octet_length(record).cast("long").alias("bytes"), F.sha2(record, 256).alias("d"))
    words = [F.sum(F.conv(F.substring("d", _HEX * i + 1, _HEX), 16, 10).cast("long")).alias(f"w{i}") for i in range(8)]
    summed = d.groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), *words)
    return summed.select("number", "bytes", F.sha2(F.concat_ws(":", "n", *[f"w{i}" for i in range(8)]), 256).alias("digest"))


def positions(records: DataFrame) -> DataFrame:
    """Rows (number, at, offset) from records (replica, number, bytes): where each record stands, in order of the numbers.

    offset counts the bytes of the first replica's records before it; `at` also those of records that only the second
    one has, so that every record has room of its own. Numbers are sorted by ranges, and each range starts where the
    lengths of those before it end: no task sorts more than a range.
    """
    spark = records.sparkSession
    own = F.max(F.when(F.col("replica") == 0, F.col("bytes")))
    every = records.groupBy("number").agg(F.coalesce(own, F.max("bytes")).alias("room"), F.coalesce(own, F.lit(0)).alias("bytes"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = materialize(every.repartitionByRange(ranges, "number").withColumn("range", F.spark_partition_id()), "fixity-ranges")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = every.groupBy("range").agg(F.sum("room").alias("room"), F.sum("bytes").alias("bytes"))  # one row per range
    sums = materialize(sums.select("range", *[before(c, Window.orderBy("range")).alias(f"{c}0") for c in ("room", "bytes")]), "fixity-starts")
    w = Window.partitionBy("range").orderBy("number")
    placed = every.select("range", "number", before("room", w).alias("room"), before("bytes", w).alias("bytes")).join(few(sums), "range")
    return placed.select("number", (F.col("room0") + F.col("room")).alias("at"), (F.col("bytes0") + F.col("bytes")).alias("offset"))


def _parents(level: DataFrame, bits: int) -> DataFrame:
    """A node has at most 2^FANOUT_BITS children, or as many records as start in a range."""
    kids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat(x["node"].cast("string"), F.lit("="), x["digest"])), ";")
    return level.groupBy("replica", F.shiftright("node", bits).alias("up")).agg(F.sha2(kids, 256).alias("digest")).select("replica", F.col("up").alias("node"), "digest")


def _differing(level: DataFrame, under: DataFrame | None, bits: int, *keep: str) -> DataFrame:
    """Nodes whose digests differ between the replicas, among the children of the given nodes only."""
    if under is not None:
        level = level.withColumn("up", F.shiftright("node", bits)).join(under.select(F.col("node").alias("up")), "up", "left_semi")
    side = [F.max(F.when(F.col("replica") == r, F.col("digest"))).alias(f"digest_{r}") for r in (0, 1)]
    return level.groupBy("node", *keep).agg(*side).where("not (digest_0 <=> digest_1)")


def audit(first: DataFrame, second: DataFrame, number: str = "page_id", record: Column | None = None) -> DataFrame:
    """Where two replicas of an archive differ: rows (number, status, offset, range_start, range_end, first_digest, second_digest).

    status is `altered`, `missing` (only in the first) or `extra` (only in the second). Records stand in order of their
    numbers; offset is the byte of the first archive at which the record starts, or would start. Records are hashed, the
    records that start in one range of 2^RANGE_BITS bytes into a node, and nodes level by level into a root for each
    replica. Then roots are compared, and only children of differing nodes further down; equal replicas compare a root
    and read nothing further. range_start and range_end (exclusive) bound the lowest node above the record.

    Both trees use one layout: a record has the place that it has in the first archive, and records that only the second
    one has are given room between. So a lost, longer or added record spoils no digest but those above it.

    Records without a number are not audited; records that share a number are compared as a multiset; null and empty
    fields differ; two empty archives give no rows. Other columns are ignored.
    """
    record = warc_record() if record is None else record
    both = [record_digests(x, number, record).select(F.lit(r).alias("replica"), "number", "bytes", "digest") for r, x in enumerate((first, second))]
    records = materialize(reduce(DataFrame.unionByName, both), "fixity-records")
    place = materialize(positions(records), "fixity-positions")
    records = records.join(place, "number").select("replica", F.col("at").alias("node"), "offset", "number", "digest")
    records = materialize(records, "fixity-0")
    last = records.agg(F.max("node")).first()[0] or 0
    levels, bits = [_parents(records, RANGE_BITS)], RANGE_BITS
    levels[0] = materialize(levels[0], "fixity-1")
    while last >> bits:
        levels.append(materialize(_parents(levels[-1], FANOUT_BITS), f"fixity-{len(levels) + 1}"))
        bits += FANOUT_BITS
    bad = None
    for level in reversed(levels):
        bad = materialize(_differing(level, bad, FANOUT_BITS), "fixity-bad")
        if bad.isEmpty():
            break
    found = _differing(records, bad, RANGE_BITS, "offset", "number")
    start = F.shiftleft(F.shiftright("node", RANGE_BITS), RANGE_BITS)
    status = F.when(F.col("digest_1").isNull(), "missing").when(F.col("digest_0").isNull(), "extra").otherwise("altered")
    return found.select(
        F.col("number").alias(number), status.alias("status"), "offset", start.alias("range_start"), (start + (1 << RANGE_BITS)).alias("range_end"),
        F.col("digest_0").alias("first_digest"), F.col("digest_1").alias("second_digest"),
    )
