"""Semantic, keyword, hybrid and similar-document search over one collection, as lazy plans."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.model import CandidateWindows, Collection, DocumentNotFound, KeywordSearchUnsupported, Mode, SearchRequest, SimilarRequest
from fathom.operators import bm25, filters, fusion, knn


@dataclass
class Results:
    """hits: the rows to return, best first; total: how many there were before the limit."""

    hits: DataFrame
    before_limit: DataFrame
    limit: int

    @cached_property
    def total(self) -> int:
        return self.before_limit.count()


@dataclass
class Searcher:
    """Plans searches over `docs` (DOC_SCHEMA, further columns allowed as promoted fields).

    embed_query turns the query into a vector on the driver. Every search cuts each branch to some hundred rows before
    anything is ranked in one task, and joins payloads back by id at the end.
    """

    docs: DataFrame
    collection: Collection
    embed_query: Callable[[str], Sequence[float]] | None = None
    windows: CandidateWindows = CandidateWindows()
    keyword_operator: str = "and"
    supports_text: bool = True
    #: Opens the collection's stored postings, if it keeps any; keyword searches then read only their terms.
    keyword_index: Callable[[], bm25.KeywordIndex | None] | None = None

    def search(self, request: SearchRequest) -> Results:
        filters.check_against(request.filters, self.collection)
        pool = filters.apply(self.docs, request.filters)
        window = self.windows.knn(request.top_k, request.limit), self.windows.keyword(request.top_k, request.limit)
        if request.mode is Mode.SEMANTIC:
            chunks = self._semantic(pool, request.query, window[0])
        elif request.mode is Mode.KEYWORD:
            chunks = self._keyword(pool, request.query, window[1])
        else:
            fused = fusion.rrf(self._semantic(pool, request.query, window[0]), self._keyword(pool, request.query, window[1]))
            chunks = fusion.ranked(fused)
        docs = fusion.documents(knn.attach(chunks.select("id", "score", "rank"), self._places(pool), ["parent_doc_id", "chunk_index"]))
        top = fusion.top_documents(docs, request.top_k)
        return self._answer(top, request.min_score, request.limit, request.include_vectors)

    def similar(self, doc_id: str, request: SimilarRequest) -> Results:
        """Nearest others of a stored document; its sibling chunks count as others."""
        filters.check_against(request.filters, self.collection)
        own = self.docs.where((F.col("id") == doc_id) & (F.size("vector") > 0)).select("vector").head()
        if own is None:
            raise DocumentNotFound(doc_id)
        near = knn.knn(filters.apply(self.docs, request.filters), own["vector"], request.top_k + 1).where(F.col("id") != doc_id)
        top = near.orderBy(F.col("score").desc(), "id").limit(request.top_k)
        top = knn.with_rank(top, F.col("score").desc(), "id").select(F.col("id").alias("doc_id"), "score", "rank", F.lit(0.0).alias("chunk_index"), F.col("id").alias("chunk_id"))
        return self._answer(top, request.min_score, request.limit, request.include_vectors)

    def query(self, text: str) -> SearchBuilder:
        return SearchBuilder(self, text)

    def _places(self, pool: DataFrame) -> DataFrame:
        own = pool.columns
        parent = F.col("parent_doc_id") if "parent_doc_id" in own else F.col("tags").getItem("parent_doc_id")
        index = F.col("chunk_index") if "chunk_index" in own else F.col("numerics").getItem("chunk_index")
        return pool.select("id", parent.alias("parent_doc_id"), index.cast("double").alias("chunk_index"))

    def _semantic(self, pool: DataFrame, query: str, window: int) -> DataFrame:
        if self.embed_query is None:
            raise KeywordSearchUnsupported("no embedder is configured for queries")
        near = knn.knn(pool, self.embed_query(query), window)
        return knn.with_rank(near, F.col("score").desc(), "id")

    def _keyword(self, pool: DataFrame, query: str, window: int) -> DataFrame:
        if not self.supports_text:
            raise KeywordSearchUnsupported("the collection has no text search")
        index = self.keyword_index() if self.keyword_index else None
        if index is not None:
            found = index.matches(query, self.keyword_operator, None if pool is self.docs else pool)
        else:
            found = bm25.matches(pool, query, operator=self.keyword_operator, stats_of=self.docs)
        return bm25.keyword_ranked(found, window).select("id", "score", (F.col("rank") + 1).alias("rank"))

    def _answer(self, top: DataFrame, min_score: float, limit: int, vectors: bool) -> Results:
        kept = top.where(F.col("score") >= min_score) if min_score > 0 else top
        order = (F.col("score").desc(), "rank", "chunk_index", "chunk_id")
        cut = kept.orderBy(*order).limit(limit)
        cut = cut.withColumnRenamed("rank", "list_rank")
        payload = ["content", "tags", "numerics", *(["vector"] if vectors else [])]
        hits = self.docs.select(F.col("id").alias("chunk_id"), *payload).join(F.broadcast(cut), "chunk_id")
        hits = hits.orderBy(F.col("score").desc(), "list_rank", "chunk_index", "chunk_id")
        return Results(hits.select(F.col("doc_id").alias("id"), "score", *payload, "chunk_id"), kept, limit)


class SearchBuilder:
    """searcher.query("...").mode("keyword").where("lang", "en").limit(5).do()"""

    def __init__(self, searcher: Searcher, text: str):
        self._searcher, self._text, self._must = searcher, text, []
        self._set: dict = {}

    def mode(self, mode: Mode | str) -> SearchBuilder:
        self._set["mode"] = mode
        return self

    def where(self, key: str, value: str) -> SearchBuilder:
        self._must.append(filters.Match(key, value))
        return self

    def between(self, key: str, **bounds: float) -> SearchBuilder:
        self._must.append(filters.Range(key, **bounds))
        return self

    def limit(self, n: int) -> SearchBuilder:
        self._set["limit"] = n
        return self

    def top_k(self, n: int) -> SearchBuilder:
        self._set["top_k"] = n
        return self

    def min_score(self, score: float) -> SearchBuilder:
        self._set["min_score"] = score
        return self

    def include_vectors(self) -> SearchBuilder:
        self._set["include_vectors"] = True
        return self

    def do(self) -> Results:
        return self._searcher.search(SearchRequest(self._text, filters=filters.Filter(must=tuple(self._must)), **self._set))
