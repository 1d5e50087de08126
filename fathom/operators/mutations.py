"""Writing documents as relational transforms: old rows and changes give new rows, with a status for each change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.model import MAX_CONTENT_BYTES, MAX_ID, RESERVED_IDS, Collection

DOC = ["id", "content", "tags", "numerics", "vector", "revision"]


def _map(col: Column, value: str) -> Column:
    return F.coalesce(col, F.from_json(F.lit("{}"), f"map<string,{value}>"))


def last_of_each(changes: DataFrame, order_col: str | None = None) -> DataFrame:
    """One change per id: the last by order_col. Without one, ids must be unique."""
    if order_col is None:
        return changes
    best = changes.groupBy("id").agg(F.max_by(F.struct(*[c for c in changes.columns if c != "id"]), order_col).alias("c"))
    return best.select("id", "c.*")


def upsert_replace(old: DataFrame, new: DataFrame) -> DataFrame:
    """New documents take the place of old ones with their ids, fields and all."""
    return old.join(new.select("id"), "id", "left_anti").select(DOC).unionByName(new.select(DOC))


def upsert_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """New documents' fields are put over old ones'; fields that only the old document has survive."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, "id", "full_outer")
    merged = lambda c, kind: F.map_concat(F.map_filter(_map(F.col(f"o.{c}"), kind), lambda k, v: ~F.array_contains(F.map_keys(_map(F.col(f"n.{c}"), kind)), k)), _map(F.col(f"n.{c}"), kind))
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    return both.select("id", pick("content"), merged("tags", "string").alias("tags"), merged("numerics", "double").alias("numerics"), pick("vector"), pick("revision"))


def created(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (id, created): whether a new document's id was not there before."""
    return new.select("id").join(old.select("id", F.lit(False).alias("__f")), "id", "left").select("id", F.coalesce("__f", F.lit(True)).alias("created"))


def patch(old: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches (id, content, tags, numerics; vector where content changed) over old documents: null content or maps change
    nothing, and a null value in a map removes that key. Patches of unknown ids change nothing."""
    o, p = old.alias("o"), patches.alias("p")
    both = o.join(p, "id", "left")

    def put(c: str, kind: str) -> Column:
        change = _map(F.col(f"p.{c}"), kind)
        rest = F.map_filter(_map(F.col(f"o.{c}"), kind), lambda k, v: ~F.array_contains(F.map_keys(change), k))
        return F.map_concat(rest, F.map_filter(change, lambda k, v: v.isNotNull()))

    vector = F.coalesce(F.col("p.vector"), F.col("o.vector")) if "vector" in patches.columns else F.col("o.vector")
    return both.select("id", F.coalesce(F.col("p.content"), F.col("o.content")).alias("content"), put("tags", "string").alias("tags"), put("numerics", "double").alias("numerics"), vector.alias("vector"), F.col("o.revision").alias("revision"))


def patch_status(old: DataFrame, patches: DataFrame) -> DataFrame:
    """(id, status, error_code, error): unknown ids and empty patches are errors."""
    known = old.select("id", F.lit(True).alias("__f"))
    empty = F.coalesce(F.col("content"), F.lit("")) == ""
    for c in ("tags", "numerics"):
        empty &= F.coalesce(F.size(c), F.lit(0)) <= 0
    code = F.when(F.coalesce(empty, F.lit(True)), "validation_failed").when(F.col("__f").isNull(), "document_not_found")
    return _status(patches.join(known, "id", "left"), code)


def delete(old: DataFrame, ids: DataFrame) -> DataFrame:
    return old.join(ids.select("id"), "id", "left_anti")


def delete_status(old: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, status, error_code, error) for each asked id."""
    known = old.select("id", F.lit(True).alias("__f"))
    return _status(ids.select("id").join(known, "id", "left"), F.when(F.col("__f").isNull(), "document_not_found"))


def _status(df: DataFrame, code: Column) -> DataFrame:
    out = df.withColumn("error_code", code)
    text = {"document_not_found": "document not found", "validation_failed": "validation failed", "invalid_schema": "invalid schema"}
    message = F.lit(None).cast("string")
    for k, v in text.items():
        message = F.when(F.col("error_code") == k, v).otherwise(message)
    return out.select("id", F.when(F.col("error_code").isNull(), "ok").otherwise("error").alias("status"), "error_code", message.alias("error"))


def problem(collection: Collection) -> Column:
    """The error code of a document, null if it is sound: id, content, and each field's kind.

    A tag key declared as numeric is an error; a numeric key must be declared as numeric; undeclared tags may be stored.
    """
    numeric = F.array(*map(F.lit, collection.names("numeric")))
    bad_id = ~F.col("id").rlike("^[a-zA-Z0-9_-]+$") | (F.octet_length("id") > MAX_ID) | F.col("id").isin(*RESERVED_IDS) | F.col("id").isNull()
    size = F.octet_length(F.coalesce("content", F.lit("")))
    bad_tag = F.arrays_overlap(F.map_keys(_map(F.col("tags"), "string")), numeric)
    bad_number = F.size(F.array_except(F.map_keys(_map(F.col("numerics"), "double")), numeric)) > 0
    return (
        F.when(bad_id, "validation_failed")
        .when((size == 0) | (size > MAX_CONTENT_BYTES), "validation_failed")
        .when(F.coalesce(bad_tag, F.lit(False)) | F.coalesce(bad_number, F.lit(False)), "invalid_schema")
    )


def validate(docs: DataFrame, collection: Collection) -> tuple[DataFrame, DataFrame]:
    """Sound documents, and the status of all."""
    checked = docs.withColumn("__p", problem(collection))
    return checked.where("__p is null").drop("__p"), _status(checked, F.col("__p"))


def summary(status: DataFrame) -> DataFrame:
    """One row (succeeded, failed)."""
    return status.agg(F.count_if(F.col("status") == "ok").alias("succeeded"), F.count_if(F.col("status") == "error").alias("failed"))


# Reading by key and in pages.


def point_get(df: DataFrame, id_, id_col: str = "id") -> DataFrame:
    """The row with an id; the predicate reaches the Parquet scan."""
    return df.where(F.col(id_col) == F.lit(id_)).limit(1)


def prefix_scan(df: DataFrame, prefix: str, id_col: str = "id") -> DataFrame:
    """Rows whose id starts with a prefix, in order of id; the predicate reaches the Parquet scan."""
    return (df.where(F.col(id_col).startswith(prefix)) if prefix else df).orderBy(id_col)


def query_list(df: DataFrame, condition: Column | None = None, offset: int = 0, limit: int = 20, id_col: str = "id") -> DataFrame:
    """A page, by offset, of the rows that meet a condition, in order of id."""
    return page_offset(df if condition is None else df.where(condition), offset, limit, id_col)


def multi_get(df: DataFrame, ids: list, id_col: str = "id") -> DataFrame:
    """Rows in the order of the asked ids, with pos; missing ids give a row of nulls, repeated ones repeat."""
    kind = dict(df.dtypes)[id_col]
    asked = df.sparkSession.createDataFrame(list(enumerate(ids)), f"pos int, `{id_col}` {kind}")
    hit = df.where(F.col(id_col).isin(list(set(ids))))
    return asked.join(hit, id_col, "left").orderBy("pos")


def exists(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return ids.join(df.select(id_col), id_col, "left_semi")


def page(df: DataFrame, cursor: str | None = None, limit: int = 20, id_col: str = "id") -> tuple[DataFrame, Column]:
    """Rows after the cursor (the last id of the page before) in order of id, and the sort key. Takes limit rows: ask for one more to know whether there are more."""
    rows = df if cursor is None else df.where(F.col(id_col) > F.lit(cursor))
    return rows.orderBy(id_col).limit(limit), F.col(id_col)


def page_offset(df: DataFrame, offset: int, limit: int, id_col: str = "id") -> DataFrame:
    return df.orderBy(id_col).offset(offset).limit(limit)


def numbered(changes: DataFrame) -> DataFrame:
    """Adds position, the order in which the rows of a local batch came."""
    return changes.withColumn("position", F.monotonically_increasing_id())


def latest_by(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__r = 1").drop("__r")
