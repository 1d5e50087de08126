"""Collections, documents, search, usage and health behind one object, with per-item results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.model import DOC_SCHEMA, Collection, Config, DocumentNotFound, QuotaExceeded, RevisionConflict, SearchRequest, SimilarRequest, ValidationFailed, VectorDimMismatch, check_content, check_id
from fathom.operators import chunking, mutations, usage
from fathom.operators.embedding import Embedder, cache_key, embed, instructed
from fathom.operators.search import Results, Searcher
from fathom.sources.store import Store


@dataclass
class Engine:
    store: Store
    embedder: Embedder
    config: Config = field(default_factory=Config)
    #: The time by which usage is counted.
    clock: Callable[[], datetime] = lambda: datetime.now(UTC).replace(tzinfo=None)

    def __post_init__(self):
        self._documents = instructed(self.embedder, self.config.document_instruction)
        self._queries = instructed(self.embedder, self.config.query_instruction)

    # Collections.

    def create_collection(self, collection: Collection) -> Collection:
        return self.store.create(collection)

    def ensure_collection(self, collection: Collection) -> Collection:
        return self.store.ensure(collection)

    def get_collection(self, name: str) -> Collection:
        return self.store.get(name)

    def list_collections(self, cursor: str | None = None, limit: int = 0) -> tuple[list[Collection], str | None]:
        """Collections by creation, and the cursor of the next page if there is one."""
        found = self.store.list(cursor, limit + 1 if limit else 0)
        more = limit and len(found) > limit
        return found[:limit] if limit else found, found[limit - 1].name if more else None

    def delete_collection(self, name: str) -> None:
        self.store.drop(name)

    def count(self, name: str) -> int:
        return self.store.count(name)

    def index(self, name: str) -> None:
        """Stores the postings of the collection as it is now; keyword searches read them until it is written to again."""
        self.store.index(name)

    # Embedding: instruction, then budget, then cache, then the model.

    def _vector(self, embedder: Embedder, text: str) -> list[float]:
        key = self.store.spark.range(1).select(cache_key(F.lit(embedder.prefix + text))).first()[0]
        known = self.store.cached().where((F.col("model") == embedder.model) & (F.col("key") == key)).select("embedding").first()
        if known:
            return list(known["embedding"])
        self.check_budget(self.store.usage(), self.clock())
        vector = [float(x) for x in embedder.one(text)]
        n = int(self.store.spark.range(1).select(embedder.tokens(F.lit(embedder.prefix + text))).first()[0])
        row = self.store.spark.createDataFrame([(embedder.model, key, vector, n, n)], "model string, key string, embedding array<float>, prompt_tokens int, total_tokens int")
        self.store.cache(row)
        self.store.used(self.clock(), n)
        return vector

    def _left(self) -> int | None:
        """Tokens that are left under budgets that reject; None without such budgets."""
        if self.config.budget_action != "reject":
            return None
        limits = (("day", self.config.daily_token_limit), ("month", self.config.monthly_token_limit))
        left = [usage.report(self.store.usage(), period, self.clock(), limit).first()["remaining"] for period, limit in limits if limit]
        return min(left, default=None)

    # Documents.

    def upsert(self, name: str, id_: str, content: str, tags: dict[str, str] | None = None, numerics: dict[str, float] | None = None, if_revision: int | None = None) -> bool:
        """Replaces the document; True if it was not there before. With if_revision, only a document at that revision (0: none)."""
        collection = self.store.get(name)
        check_id(id_)
        check_content(content)
        spark = self.store.spark
        row = spark.createDataFrame([(id_, content, tags or {}, _floats(numerics) or {}, None, 1)], DOC_SCHEMA)
        _, status = mutations.validate(row, collection)
        if bad := status.where("status = 'error'").first():
            raise ValidationFailed(bad["error_code"])
        old = self.store.get_document(name, id_).select("revision").first()
        revision = (old["revision"] or 1) if old else 0
        if if_revision is not None and if_revision != revision:
            raise RevisionConflict(revision)
        vector = self._vector(self._documents, content)
        if len(vector) != collection.vector_dim:
            raise VectorDimMismatch(f"{len(vector)} instead of {collection.vector_dim}")
        row = row.withColumns({"vector": F.lit(vector).cast("array<float>"), "revision": F.lit(revision + 1)})
        self.store.upsert(name, row, "replace")
        return old is None

    def batch_upsert(self, name: str, docs: DataFrame, limit: int | None = None) -> DataFrame:
        """Validates all, embeds and merges the sound ones; (id, status, error_code, error) for each. With a limit, a
        larger batch is refused whole.

        Texts that were embedded before cost nothing; new ones are embedded once, stored and counted. Documents for which
        a budget that rejects has no tokens left, or whose vector is not of the collection's length, are errors.
        """
        collection = self.store.get(name)
        if limit is not None and docs.count() > limit:
            raise ValidationFailed(f"a batch has at most {limit} documents")
        good, status = mutations.validate(docs, collection)
        ready, fresh = embed(good, self._documents, cache=self.store.cached(), write=self.store.cache, left=self._left())
        cost = fresh.agg(F.sum("total_tokens").alias("n"), F.count(F.lit(1)).alias("texts")).first()
        if cost["texts"]:
            self.store.used(self.clock(), cost["n"] or 0)
        code = F.when(F.col("vector").isNull(), QuotaExceeded.code).when(F.size("vector") != collection.vector_dim, VectorDimMismatch.code)
        ready = ready.withColumn("__code", code)
        refused = ready.where("__code is not null").groupBy("id").agg(F.first("__code").alias("__code"))
        self.store.upsert(name, ready.where("__code is null").withColumn("revision", F.lit(1)), "merge", "position" if "position" in docs.columns else None)
        told = status.join(refused, "id", "left")
        return told.select(
            "id", F.when(F.col("__code").isNotNull(), "error").otherwise(F.col("status")).alias("status"), F.coalesce("__code", "error_code").alias("error_code"),
            F.coalesce(F.regexp_replace("__code", "_", " "), "error").alias("error"),
        )

    def ingest(self, name: str, docs: DataFrame, window: int = chunking.WINDOW_TOKENS, chunker: chunking.Chunker | None = None) -> DataFrame:
        """Cuts documents (into sentence windows, unless another chunker is given) and merges the chunks; the status of each
        chunk, and of documents that could not be cut."""
        cut = (chunker or chunking.sentence_chunker(window))(docs)
        failed = cut.where("error is not null").select("id", F.lit("error").alias("status"), F.lit("validation_failed").alias("error_code"), "error")
        return self.batch_upsert(name, chunking.chunk_documents(cut.where("error is null")).drop("tokens")).unionByName(failed)

    def patch(self, name: str, id_: str, content: str | None = None, tags: dict | None = None, numerics: dict | None = None) -> dict:
        """Changes what is given; a None value in a map removes that key. The vector is made anew only with new content."""
        if content is None and not tags and not numerics:
            raise ValidationFailed("a patch changes something")
        if content is not None:
            check_content(content)
        if self.store.get_document(name, id_).isEmpty():
            raise DocumentNotFound(id_)
        vector = self._vector(self._documents, content) if content is not None else None
        schema = "id string, content string, tags map<string,string>, numerics map<string,double>, vector array<float>"
        row = self.store.spark.createDataFrame([(id_, content, tags, _floats(numerics), vector)], schema)
        self.store.patch(name, row)
        return self.get(name, id_)

    def get(self, name: str, id_: str) -> dict:
        row = self.store.get_document(name, id_).first()
        if row is None:
            raise DocumentNotFound(id_)
        return row.asDict()

    def page(self, name: str, cursor: str | None = None, limit: int | None = None) -> tuple[list[dict], str | None]:
        """Documents by id, and the cursor of the next page if there is one."""
        n = min(limit or self.config.page_size, 100)
        rows, _ = mutations.page(self.store.read(name), cursor, n + 1)
        got = [r.asDict() for r in rows.collect()]
        return got[:n], got[n - 1]["id"] if len(got) > n else None

    def delete(self, name: str, id_: str) -> None:
        self.get(name, id_)
        self.store.delete(name, self.store.spark.createDataFrame([(id_,)], "id string"))

    def batch_delete(self, name: str, ids: DataFrame) -> DataFrame:
        known = self.store.read(name)
        status = mutations.delete_status(known, ids)
        self.store.delete(name, ids)
        return status

    # Search.

    def searcher(self, name: str) -> Searcher:
        own = lambda text: self._vector(self._queries, text)
        return Searcher(self.store.read(name), self.store.get(name), own, self.config.windows, keyword_index=lambda: self.store.keyword_index(name))

    def search(self, name: str, request: SearchRequest) -> Results:
        return self.searcher(name).search(request)

    def similar(self, name: str, id_: str, request: SimilarRequest | None = None) -> Results:
        return self.searcher(name).similar(id_, request or SimilarRequest())

    # Usage and health.

    def usage(self, period: str = "month") -> dict:
        """Tokens used in the current day or month (`total` reports the month), the limit and what is left."""
        limit = self.config.daily_token_limit if period == "day" else self.config.monthly_token_limit
        return usage.report(self.store.usage(), period, self.clock(), limit).first().asDict()

    def check_budget(self, events: DataFrame, now: datetime) -> None:
        """Raises if a budget that rejects is used up."""
        for period, limit in (("day", self.config.daily_token_limit), ("month", self.config.monthly_token_limit)):
            if limit and self.config.budget_action == "reject" and usage.report(events, period, now, limit).first()["exhausted"]:
                raise QuotaExceeded(period)

    def health(self) -> dict[str, str]:
        checks = {}
        for name, probe in (("store", lambda: self.store.spark.range(1).count()), ("embedder", lambda: self.embedder.one("ping"))):
            try:
                probe()
                checks[name] = "ok"
            except Exception as x:  # any failure is what this reports
                checks[name] = f"error: {x}"[:200]
        return {"status": "ok" if set(checks.values()) == {"ok"} else "degraded", **checks}


def _floats(numbers: dict | None) -> dict | None:
    return {k: None if v is None else float(v) for k, v in numbers.items()} if numbers is not None else None


__all__ = ["Collection", "Engine"]
