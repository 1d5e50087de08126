"""Exact deduplication by a 128-bit content hash, with the bytes compared inside each group."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.runtime import SPACE, few, materialize, text_or_empty


def normalized(col: str = "text") -> Column:
    """The text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(col), SPACE, " ")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by a 128-bit hash of the normalised text, in partial aggregates of hashes and ids. Only the texts of
    groups with two rows or more are looked at again: the smallest and the largest text of each are compared byte by
    byte, and only where both are the same text are all its rows equal. Groups in which they differ (hash collisions) are
    split by the text itself. Texts are merged in each map task before a shuffle, so a group of copies costs one text per
    task, and rows meet their group in a join whose hot keys Spark can split.

    Null texts count as empty and equal to empty ones; an empty table gives no rows; repeated rows of one id share
    one verdict (`kept` says that the row carries the smallest id of its group; group_size counts rows); rows whose
    id is null are kept only if their whole group has none (keep_id is then null). Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalized(text_col).alias("t"))
    hashed = rows.select("id", "t", content_hash(F.col("t")).alias("h"))
    groups = hashed.groupBy("h").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups, "exact")
    several = materialize(groups.where("group_size > 1").select("h"), "exact-several")
    texts = hashed.join(few(several), "h", "left_semi").groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    collided = materialize(texts.where("lo != hi").select("h"), "exact-collided")
    ids = hashed.select("id", "h", F.sha2("t", 256).alias("text_sha256"))
    if collided.isEmpty():
        sound = ids.join(groups, "h")
    else:
        sound = ids.join(materialize(groups.join(collided, "h", "left_anti"), "exact-sound"), "h")
        apart = hashed.join(collided, "h", "left_semi")
        by_text = apart.groupBy("h", "t").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        sound = sound.unionByName(
            apart.join(by_text, ["h", "t"]).select("h", "id", F.sha2("t", 256).alias("text_sha256"), "keep_id", "group_size")
        )
    return sound.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns: that with the smallest id, or any if none has an id.

    Rows that share an id are judged by their own texts. Of rows that share both, the first in order of their columns
    stays (columns that have no order do not count); they are merged in each map task before they are shuffled.
    """
    verdict = exact_groups(docs, id_col, text_col)
    verdict = verdict.groupBy(F.col(id_col).alias("__id"), F.unhex("text_sha256").alias("__sha"), "kept").agg(F.count(F.lit(1)).alias("__rows"))
    # Most rows stay as they are: only the others' keys meet the table.
    others = materialize(verdict.where("not kept or __rows > 1"), "exact-others")
    found = docs.withColumn("__own", F.unhex(F.sha2(normalized(text_col), 256)))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha"))
    single = found.join(few(others.select("__id", "__sha")), same, "left_anti").select(docs.columns)
    twice = others.where("kept")
    if twice.isEmpty():
        return single
    order = [text_col, *(c for c, kind in docs.dtypes if c != text_col and not re.search("map<|variant", kind))]
    first = F.min_by(F.struct(*docs.columns), F.struct(*order)).alias("__row")
    again = found.join(few(twice.select("__id", "__sha")), same)
    return single.unionByName(again.groupBy("__id", "__sha").agg(first).select("__row.*"))
