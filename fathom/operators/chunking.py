"""Splitting documents into chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import chunk_id, sentences, word_tokens

#: Tokens of a window and the share of them that neighbouring windows repeat.
WINDOW_TOKENS, OVERLAP = 256, 0.10
#: Chunk size and overlap in tokens of the two published set-ups.
PRESETS = {"A": (128, 16), "B": (256, 32)}


def sentence_windows(counts: list[int], window: int = WINDOW_TOKENS, overlap: float = OVERLAP) -> list[tuple[int, int]]:
    """Ranges [start, end) of sentences with these token counts: each window takes sentences while they fit; the next one
    starts far enough back to repeat the overlap, but behind the last start. A sentence over the window is an error."""
    if big := next((c for c in counts if c > window), None):
        raise ValueError(f"a sentence of {big} tokens exceeds the window of {window}")
    repeat, out, start = int(window * overlap + 0.5), [], 0
    while start < len(counts):
        end, size = start, 0
        while end < len(counts) and size + counts[end] <= window:
            size += counts[end]
            end += 1
        out.append((start, end))
        if end == len(counts):
            break
        back, held = end, 0
        while back > start + 1 and held < repeat:
            back -= 1
            held += counts[back]
        start = back
    return out


#: A chunker adds chunks (array<struct<content, tokens>>) and error (null, or why the document could not be cut) to documents.
Chunker = Callable[[DataFrame], DataFrame]


def sentence_chunker(window: int = WINDOW_TOKENS, overlap: float = OVERLAP) -> Chunker:
    return lambda df: window_chunks(df, window=window, overlap=overlap)


def chunker_of(cut: Callable[[str], list[tuple[str, int]]]) -> Chunker:
    """A chunker from a function that cuts one text into (content, tokens) pairs; what it raises becomes that document's error."""

    @F.pandas_udf("struct<chunks: array<struct<content: string, tokens: int>>, error: string>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            rows = []
            for t in series:
                try:
                    rows.append(([{"content": c, "tokens": n} for c, n in cut(t or "")], None))
                except Exception as x:  # a document's own failure is its status, not the batch's
                    rows.append(([], str(x) or type(x).__name__))
            yield pd.DataFrame(rows, columns=["chunks", "error"])

    def chunk(df: DataFrame) -> DataFrame:
        return df.withColumn("__r", run("content")).withColumns({"chunks": F.col("__r.chunks"), "error": F.col("__r.error")}).drop("__r")

    return chunk


_WINDOWS = "array<struct<first: int, past: int, tokens: int>>"


def window_chunks(df: DataFrame, id_col: str = "id", text_col: str = "content", window: int = WINDOW_TOKENS, overlap: float = OVERLAP) -> DataFrame:
    """Adds chunks (array<struct<content, tokens>>) and error. Sentences and their counts are built-in expressions; only
    the greedy walk over the counts, sequential by nature, runs in Python. A sentence over the window gives no chunks
    and an error for that row."""

    @F.pandas_udf(f"struct<windows: {_WINDOWS}, error: string>")
    def walk(counts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in counts:
            rows = []
            for c in series:
                c = [] if c is None else [int(x) for x in c]
                try:
                    rows.append(([{"first": s, "past": e, "tokens": sum(c[s:e])} for s, e in sentence_windows(c, window, overlap)], None))
                except ValueError as x:
                    rows.append(([], str(x)))
            yield pd.DataFrame(rows, columns=["windows", "error"])

    held = df.withColumn("__s", sentences(F.col(text_col)))
    held = held.withColumn("__w", walk(F.transform("__s", word_tokens)))
    whole = F.transform(F.col("__w.windows"), lambda w: F.struct(
        F.array_join(F.slice(F.col("__s"), w["first"] + 1, w["past"] - w["first"]), " ").alias("content"), w["tokens"].alias("tokens")
    ))
    return held.withColumns({"chunks": whole, "error": F.col("__w.error")}).drop("__s", "__w")


def chunk_documents(df: DataFrame, chunks: Column | None = None) -> DataFrame:
    """One row per chunk, from rows with id, content, tags, numerics and an array of chunks.

    Several chunks get ids doc-chunk-0001 and on; a single one, or none, keeps the document's id and whole content. All
    carry parent_doc_id and a chunk_index from 1.
    """
    parts = F.col("chunks") if chunks is None else chunks
    many = F.size(parts) > 1
    whole = F.array(F.struct(F.col("content").alias("content"), F.lit(None).cast("int").alias("tokens")))
    rows = df.select("*", F.posexplode(F.when(many, parts).otherwise(whole)).alias("__i", "__c")).withColumn("__many", many)
    number = F.col("__i") + 1
    tags = F.map_concat(F.coalesce("tags", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.create_map(F.lit("parent_doc_id"), F.col("id")))
    numerics = F.map_concat(F.coalesce("numerics", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))), F.create_map(F.lit("chunk_index"), number.cast("double")))
    return rows.select(
        F.when(F.col("__many"), chunk_id(F.col("id"), number)).otherwise(F.col("id")).alias("id"),
        F.col("__c.content").alias("content"), tags.alias("tags"), numerics.alias("numerics"), F.col("__c.tokens").alias("tokens"),
    )


def fixed_windows(df: DataFrame, size: int, overlap: int, id_col: str = "id", text_col: str = "content", prefix: str = "scifact", special: int = 2) -> DataFrame:
    """Windows of whitespace tokens, special tokens counted into the size: (chunk_id, source_doc_id, chunk_idx, content, token_count).

    Windows start every size - special - overlap tokens, and the one that reaches the end is the last.
    """
    width = size - special
    if not 0 <= overlap < width:
        raise ValueError("the overlap is smaller than the window")
    step = width - overlap
    words = F.filter(F.split(F.trim(text_col), r"\s+"), lambda x: x != "")
    rows = df.select(F.col(id_col).alias("source_doc_id"), words.alias("w")).where(F.size("w") > 0)
    count = F.greatest(F.lit(1), F.ceil((F.size("w") - overlap) / step)).cast("int")
    rows = rows.select("source_doc_id", "w", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_idx"))
    part = F.slice("w", F.col("chunk_idx") * step + 1, F.lit(width))
    return rows.select(
        F.concat(F.lit(f"{prefix}-"), F.col("source_doc_id").cast("string"), F.lit("-c"), F.col("chunk_idx").cast("string")).alias("chunk_id"),
        "source_doc_id", "chunk_idx", F.array_join(part, " ").alias("content"), (F.size(part) + special).alias("token_count"),
    )
