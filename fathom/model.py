"""Collections, documents, search requests and their limits; errors carry a code."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

# Limits of names, documents and requests.
NAME = re.compile(r"^[a-zA-Z0-9_-]+$")
MAX_COLLECTION_NAME, MAX_FIELDS, MAX_FIELD_NAME = 64, 64, 64
MAX_ID, MAX_CONTENT_BYTES, MAX_QUERY_BYTES = 256, 163_840, 4096
DEFAULT_DIM = 1024
DEFAULT_TOP_K, MAX_TOP_K, DEFAULT_LIMIT, MAX_LIMIT = 10, 500, 20, 100
MAX_CONDITIONS = 32
DEFAULT_BATCH, DEFAULT_PAGE, MAX_PAGE = 100, 20, 100
RESERVED_IDS = {"search", "collections"}
RESERVED_FIELDS = {"id", "content", "score", "vector"}
SYSTEM_FIELDS = {"parent_doc_id": "tag", "chunk_index": "numeric"}


class EngineError(Exception):
    code = "internal_error"


class ValidationFailed(EngineError):
    code = "validation_failed"


class InvalidSchema(EngineError):
    code = "invalid_schema"


class CollectionNotFound(EngineError):
    code = "collection_not_found"


class CollectionExists(EngineError):
    code = "collection_already_exists"


class DocumentNotFound(EngineError):
    code = "document_not_found"


class VectorDimMismatch(EngineError):
    code = "vector_dim_mismatch"


class QuotaExceeded(EngineError):
    code = "embedding_quota_exceeded"


class EmbeddingFailed(EngineError):
    code = "embedding_provider_error"


class KeywordSearchUnsupported(EngineError):
    code = "keyword_search_not_supported"


class RevisionConflict(EngineError):
    code = "revision_conflict"

    def __init__(self, current: int):
        super().__init__(f"the document is at revision {current}")
        self.current = current


def _bytes(s: str) -> int:
    return len(s.encode())


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # tag or numeric

    def __post_init__(self):
        if not 1 <= _bytes(self.name) <= MAX_FIELD_NAME:
            raise InvalidSchema(f"a field's name has 1 to {MAX_FIELD_NAME} bytes")
        if self.name in RESERVED_FIELDS:
            raise InvalidSchema(f"{self.name} is reserved")
        if self.kind not in ("tag", "numeric"):
            raise InvalidSchema(f"{self.kind} is no kind of field")


@dataclass(frozen=True)
class Collection:
    name: str
    fields: tuple[Field, ...] = ()
    vector_dim: int = DEFAULT_DIM
    created_at: int = 0
    revision: int = 1
    type: str = "text"

    def __post_init__(self):
        if not 1 <= len(self.name) <= MAX_COLLECTION_NAME or not NAME.match(self.name):
            raise InvalidSchema(f"{self.name!r} is no name of a collection")
        if self.type != "text":
            raise InvalidSchema(f"{self.type} collections are not supported")
        if len(self.fields) > MAX_FIELDS:
            raise InvalidSchema(f"over {MAX_FIELDS} fields")
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise InvalidSchema("two fields share a name")
        if clash := SYSTEM_FIELDS.keys() & set(names):
            raise InvalidSchema(f"{sorted(clash)} exist in every collection")
        if self.vector_dim <= 0:
            raise InvalidSchema("vectors need at least one dimension")

    def kind_of(self, name: str) -> str | None:
        return next((f.kind for f in self.fields if f.name == name), SYSTEM_FIELDS.get(name))

    def names(self, kind: str) -> list[str]:
        return [f.name for f in self.fields if f.kind == kind] + [k for k, v in SYSTEM_FIELDS.items() if v == kind]


DOC_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("content", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("numerics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("revision", T.IntegerType()),
])

COLLECTION_SCHEMA = "name string, type string, fields array<struct<name: string, kind: string>>, vector_dim int, created_at bigint, revision int"


def check_id(id_: str) -> None:
    if not 1 <= _bytes(id_) <= MAX_ID or not NAME.match(id_):
        raise ValidationFailed(f"{id_[:40]!r} is no id")
    if id_ in RESERVED_IDS:
        raise ValidationFailed(f"{id_} is reserved")


def check_content(content: str) -> None:
    if not content:
        raise ValidationFailed("content is required")
    if _bytes(content) > MAX_CONTENT_BYTES:
        raise ValidationFailed(f"content has over {MAX_CONTENT_BYTES} bytes")


class Mode(str, Enum):
    SEMANTIC = "semantic"
    KEYWORD = "keyword"
    HYBRID = "hybrid"


def _limits(top_k: int | None, limit: int | None, min_score: float) -> tuple[int, int]:
    k = min(top_k, MAX_TOP_K) if top_k and top_k > 0 else DEFAULT_TOP_K
    n = min(limit, MAX_LIMIT) if limit and limit > 0 else DEFAULT_LIMIT
    if not 0 <= min_score <= 1:
        raise ValidationFailed("min_score lies between 0 and 1")
    return k, min(n, k)


@dataclass
class SearchRequest:
    query: str
    mode: Mode = Mode.HYBRID
    filters: object | None = None
    top_k: int | None = None
    limit: int | None = None
    min_score: float = 0.0
    include_vectors: bool = False

    def __post_init__(self):
        if not self.query:
            raise ValidationFailed("query is required")
        if _bytes(self.query) > MAX_QUERY_BYTES:
            raise ValidationFailed(f"query has over {MAX_QUERY_BYTES} bytes")
        try:
            self.mode = Mode(self.mode)
        except ValueError:
            raise ValidationFailed(f"unsupported search mode: {self.mode}") from None
        self.top_k, self.limit = _limits(self.top_k, self.limit, self.min_score)


@dataclass
class SimilarRequest:
    filters: object | None = None
    top_k: int | None = None
    limit: int | None = None
    min_score: float = 0.0
    include_vectors: bool = False

    def __post_init__(self):
        self.top_k, self.limit = _limits(self.top_k, self.limit, self.min_score)


@dataclass(frozen=True)
class CandidateWindows:
    """How many candidates each branch of a search fetches before chunks become documents."""

    knn_floor: int = 100
    knn_factor: float = 2.0
    keyword_floor: int = 100
    keyword_factor: float = 2.0

    @staticmethod
    def _size(top_k: int, limit: int, floor: int, factor: float) -> int:
        return max(top_k + 1, limit + 1, floor, -int(-top_k * factor // 1))

    def knn(self, top_k: int, limit: int) -> int:
        return self._size(top_k, limit, self.knn_floor, self.knn_factor)

    def keyword(self, top_k: int, limit: int) -> int:
        return self._size(top_k, limit, self.keyword_floor, self.keyword_factor)


@dataclass
class Config:
    """Engine settings with their defaults; from_env fills ${NAME:-default} in a mapping of settings."""

    batch_size: int = DEFAULT_BATCH
    page_size: int = DEFAULT_PAGE
    vector_dim: int = DEFAULT_DIM
    document_instruction: str = ""
    query_instruction: str = ""
    daily_token_limit: int = 0
    monthly_token_limit: int = 0
    budget_action: str = "warn"
    windows: CandidateWindows = field(default_factory=CandidateWindows)

    def __post_init__(self):
        if self.budget_action not in ("warn", "reject"):
            raise ValidationFailed("budget_action is warn or reject")
        if self.batch_size <= 0 or self.vector_dim <= 0 or min(self.daily_token_limit, self.monthly_token_limit) < 0:
            raise ValidationFailed("sizes are positive and limits not negative")

    @classmethod
    def from_mapping(cls, settings: dict, env: dict[str, str]) -> Config:
        def fill(v):
            if not isinstance(v, str):
                return v
            return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: env.get(m[1]) or m[2] or "", v)

        kinds = {k: type(getattr(cls(), k)) for k in cls.__dataclass_fields__ if k != "windows"}
        if strange := set(settings) - set(kinds):
            raise ValidationFailed(f"unknown settings {sorted(strange)}")
        return cls(**{k: kinds[k](fill(v)) for k, v in settings.items()})
