"""What the operators share: written intermediate tables and bounded Arrow batches."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.sources.scratch import shared_dir

#: Documents, and bytes, that one Arrow batch holds at most, but for single longer documents.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
BATCH_CONF, BYTES_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: With this setting a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Keys that are broadcast at most, after they were counted; more are joined by a shuffle.
FEW_KEYS = 500_000

#: The white space that ends a word: the byte 0x20 and the bytes 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once into the shared folder and read it back: cuts lineage and survives lost executors.

    Shuffle files behind it are not needed any more and go at once; the table's own go when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fathom-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP_CONF)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP_CONF, before)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small enough for batches of long documents."""
    if int(spark.conf.get(BATCH_CONF)) > rows:
        spark.conf.set(BATCH_CONF, str(rows))
    if _bytes(spark.conf.get(BYTES_CONF)) > BATCH_BYTES:
        spark.conf.set(BYTES_CONF, str(BATCH_BYTES))


def _bytes(size: str) -> int:
    """Bytes of a size as Spark writes it; the unbounded -1 counts as more than any."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", size.strip().lower()).groups()
    return 1 << 62 if int(number) < 0 else int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def few(keys: DataFrame) -> DataFrame:
    """Written keys for a join: marked for broadcast if they were counted and are FEW_KEYS at most, else as they are."""
    return F.broadcast(keys) if keys.count() <= FEW_KEYS else keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """The id; for a row without one a number above 2^62 drawn from its text, so that the row can be referred to as well."""
    drawn = F.shiftrightunsigned(F.xxhash64(F.col(text_col)), 2).bitwiseOR(F.lit(1 << 62))
    return F.coalesce(F.col(id_col), drawn.cast(docs.schema[id_col].dataType))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
