"""Embedding pipeline: instruction, cache, budget, provider; the provider is a column expression or an Arrow batch function."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.embedding import stub_tokens, stub_vector, stub_vector_of
from fathom.model import EmbeddingFailed

#: Texts that a provider gets at once.
SUB_BATCH = 256
EMBEDDED = "struct<embedding: array<float>, prompt_tokens: int, total_tokens: int>"


@dataclass(frozen=True)
class Embedder:
    """A model's name, its vectors for a text column, and for single texts on the driver.

    whole gives vectors and tokens together, where they come from one call; prefix stands before every text.
    """

    model: str
    column: Callable[[Column], Column]
    tokens: Callable[[Column], Column]
    one: Callable[[str], Sequence[float]]
    dim: int
    whole: Callable[[Column], Column] | None = None
    prefix: str = ""

    def struct(self, text: Column) -> Column:
        text = self.full(text)
        if self.whole is not None:
            return self.whole(text)
        n = self.tokens(text)
        return F.struct(self.column(text).cast("array<float>").alias("embedding"), n.alias("prompt_tokens"), n.alias("total_tokens"))

    def full(self, text: Column) -> Column:
        return F.concat(F.lit(self.prefix), text) if self.prefix else text


def stub(dim: int = 64, name: str = "stub") -> Embedder:
    return Embedder(name, lambda t: stub_vector(t, dim), stub_tokens, lambda t: stub_vector_of(t, dim), dim)


def guessed_tokens(text: Column) -> Column:
    """Tokens of a text before a provider has counted them: a quarter of its characters."""
    return F.floor(F.length(text) / 4).cast("int")


def from_batches(model: str, open_client: Callable[[], Callable[[list[str]], list[tuple[list[float], int]]]], dim: int) -> Embedder:
    """An embedder from a function that opens a client in each worker; the client maps at most SUB_BATCH texts to (vector, tokens) pairs."""

    @F.pandas_udf(EMBEDDED)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = open_client()
        for series in texts:
            rows = []
            for i in range(0, len(series), SUB_BATCH):
                part = series.iloc[i : i + SUB_BATCH].tolist()
                got = client(part)
                if len(got) != len(part):
                    raise EmbeddingFailed(f"{len(part)} texts gave {len(got)} vectors")
                rows += [(v, n, n) for v, n in got]
            yield pd.DataFrame(rows, columns=["embedding", "prompt_tokens", "total_tokens"])

    return Embedder(model, lambda t: run(t)["embedding"], guessed_tokens, lambda t: open_client()([t])[0][0], dim, run)


def http_client(url: str, model: str, api_key: str = "", timeout: float = 60.0) -> Callable[[], Callable[[list[str]], list[tuple[list[float], int]]]]:
    """Opens a client of an `/embeddings` service that takes {model, input} and gives {data: [{index, embedding}], usage}; for from_batches.

    Vectors come back in any order and are put in that of the texts by their index; a wrong number of them, an index
    that is missing or given twice, and any HTTP error raise EmbeddingFailed. The tokens of a call are shared out evenly.
    """

    def open_client() -> Callable[[list[str]], list[tuple[list[float], int]]]:
        def call(texts: list[str]) -> list[tuple[list[float], int]]:
            body = json.dumps({"model": model, "input": texts}).encode()
            headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
            try:
                with urllib.request.urlopen(urllib.request.Request(f"{url.rstrip('/')}/embeddings", body, headers), timeout=timeout) as answer:
                    got = json.load(answer)
                vectors = {int(x["index"]): [float(v) for v in x["embedding"]] for x in got["data"]}
            except (OSError, KeyError, TypeError, ValueError) as x:
                raise EmbeddingFailed(f"embedding service: {x}") from x
            if len(got["data"]) != len(texts) or sorted(vectors) != list(range(len(texts))):
                raise EmbeddingFailed(f"{len(texts)} texts gave {len(got['data'])} vectors")
            total = int((got.get("usage") or {}).get("total_tokens", 0))
            share, more = divmod(total, len(texts))
            return [(vectors[i], share + (i < more)) for i in range(len(texts))]

        return call

    return open_client


def local_model(model: str, load: Callable[[], Callable[[list[str]], tuple[Sequence, Sequence]]], dim: int) -> Embedder:
    """An embedder around a model in each worker: load() opens it once, and it maps texts to (token vectors, masks), which are
    averaged over the tokens whose mask is not 0 and brought to length 1."""

    def open_client() -> Callable[[list[str]], list[tuple[list[float], int]]]:
        import numpy as np

        run = load()

        def call(texts: list[str]) -> list[tuple[list[float], int]]:
            out = []
            for tokens, mask in zip(*run(texts), strict=True):
                tokens, mask = np.asarray(tokens, "f8"), np.asarray(mask) != 0
                mean = tokens[mask].mean(0) if mask.any() else np.zeros(dim)
                length = np.sqrt(mean @ mean)
                out.append(((mean / length if length else mean).tolist(), int(mask.sum())))
            return out

        return call

    return from_batches(model, open_client, dim)


def instructed(embedder: Embedder, instruction: str) -> Embedder:
    """The instruction stands before every text, so cache keys know it too."""
    return replace(embedder, prefix=instruction + embedder.prefix, one=lambda t: embedder.one(instruction + t)) if instruction else embedder


def cache_key(text: Column) -> Column:
    return F.sha2(text, 256)


def split_by_cache(texts: DataFrame, cache: DataFrame, model: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct texts that the cache holds (key, text, embedding), and those it lacks (key, text). Keys are model and SHA-256."""
    keyed = texts.select(F.col(text_col).alias("text")).where("text is not null").distinct().withColumn("key", cache_key(F.col("text")))
    own = cache.where(F.col("model") == model).select("key", "embedding").dropDuplicates(["key"])
    return keyed.join(own, "key"), keyed.join(own.select("key"), "key", "left_anti")


def admitted(misses: DataFrame, tokens: Column, left: int, sub_batch: int = SUB_BATCH) -> DataFrame:
    """Adds allowed: texts are taken by sub-batches of about `sub_batch`, in an order drawn from their keys, as long as the tokens
    of those before are fewer than `left`. One row per sub-batch is summed up in order, not one per text."""
    n = max(1, -(-misses.count() // sub_batch))
    dealt = misses.withColumn("__b", F.pmod(F.xxhash64("key"), F.lit(n)))
    sums = dealt.groupBy("__b").agg(F.sum(tokens.cast("long")).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(sums.select("__b", (before < left).alias("allowed")), "__b").drop("__b")


def embed(
    df: DataFrame, embedder: Embedder, text_col: str = "content", cache: DataFrame | None = None, write: Callable[[DataFrame], DataFrame] | None = None, left: int | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """df with columns vector, prompt_tokens and total_tokens, and the new cache rows (model, key, embedding, prompt_tokens, total_tokens).

    Each distinct text is embedded once; a text from the cache costs no tokens. Texts that many rows share cost one
    call, and the join back is on the text's hash, whose hot keys Spark can split. Without a cache no row moves.

    `write` stores the new rows and gives them back as stored, so the model is called once for each, however often the
    results are read; without it, results that are read twice call it twice. With `left`, no more sub-batches are embedded
    than that many tokens allow; the vectors of other rows are null.
    """
    if cache is None:
        out = df.withColumn("__e", embedder.struct(F.col(text_col)))
        return out.select(*df.columns, F.col("__e.embedding").alias("vector"), F.col("__e.prompt_tokens"), F.col("__e.total_tokens")), None
    whole = df.withColumn("__t", embedder.full(F.col(text_col)))
    hits, misses = split_by_cache(whole, cache, embedder.model, "__t")
    if left is not None:
        misses = admitted(misses, embedder.tokens(F.col("text")), left).where("allowed").drop("allowed")
    plain = replace(embedder, prefix="")  # the texts are whole already
    fresh = misses.select("key", plain.struct(F.col("text")).alias("e"))
    fresh = fresh.select(F.lit(embedder.model).alias("model"), "key", "e.embedding", "e.prompt_tokens", "e.total_tokens")
    if write is not None:
        fresh = write(fresh)
    known = hits.select("key", "embedding", F.lit(0).alias("prompt_tokens"), F.lit(0).alias("total_tokens")).unionByName(fresh.drop("model"))
    out = whole.withColumn("__k", cache_key(F.col("__t"))).join(known.withColumnRenamed("key", "__k"), "__k", "left")
    return out.select(*df.columns, F.col("embedding").alias("vector"), "prompt_tokens", "total_tokens"), fresh


def wrong_dimension(df: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector is not of the collection's length."""
    return df.where(F.col("vector").isNotNull() & (F.size("vector") != dim))
