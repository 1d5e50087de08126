"""Typed collections: a dataclass's fields say which is the id, the content, a tag, a numeric or merely stored."""

from __future__ import annotations

from dataclasses import field, fields, is_dataclass
from typing import Any, get_type_hints

from fathom.model import Collection, Field, InvalidSchema
from fathom.operators.search import SearchBuilder
from fathom.service import Engine

ROLES = ("id", "content", "tag", "numeric", "stored")


def role(kind: str, name: str | None = None, **more) -> Any:
    """A dataclass field with a role; name is the stored name, if it differs."""
    if kind not in ROLES:
        raise InvalidSchema(f"{kind} is no role")
    return field(metadata={"role": kind, "name": name}, **more)


class Schema:
    def __init__(self, cls: type):
        if not is_dataclass(cls):
            raise InvalidSchema(f"{cls} is no dataclass")
        hints = get_type_hints(cls)
        self.cls, self.roles, seen = cls, {}, set()
        for f in fields(cls):
            if "role" not in f.metadata:
                continue
            kind, name = f.metadata["role"], f.metadata.get("name") or f.name
            if kind in ("id", "content") and kind in {k for k, _ in self.roles.values()}:
                raise InvalidSchema(f"two fields are the {kind}")
            if name in seen:
                raise InvalidSchema(f"two fields are stored as {name}")
            if kind == "numeric" and hints[f.name] not in (int, float):
                raise InvalidSchema(f"{f.name} is no number")
            seen.add(name)
            self.roles[f.name] = (kind, name)
        if "id" not in {k for k, _ in self.roles.values()}:
            raise InvalidSchema("a field must be the id")

    def collection(self, name: str, dim: int) -> Collection:
        return Collection(name, tuple(Field(n, k) for k, n in self.roles.values() if k in ("tag", "numeric")), dim)

    def to_row(self, item: Any) -> dict:
        out = {"id": "", "content": "", "tags": {}, "numerics": {}}
        for attribute, (kind, name) in self.roles.items():
            value = getattr(item, attribute)
            if kind in ("id", "content"):
                out[kind] = str(value)
            elif kind == "numeric":
                out["numerics"][name] = float(value)
            else:
                out["tags"][name] = str(value)
        return out

    def from_row(self, row: dict) -> Any:
        hints, values = get_type_hints(self.cls), {}
        for attribute, (kind, name) in self.roles.items():
            if kind in ("id", "content"):
                values[attribute] = row[kind]
            else:
                held = (row["numerics" if kind == "numeric" else "tags"] or {}).get(name)
                values[attribute] = hints[attribute](held) if held is not None else None
        return self.cls(**values)


class TypedIndex:
    def __init__(self, engine: Engine, name: str, cls: type):
        self.engine, self.name, self.schema = engine, name, Schema(cls)

    def ensure(self) -> Collection:
        return self.engine.store.ensure(self.schema.collection(self.name, self.engine.embedder.dim))

    def upsert(self, item: Any) -> bool:
        row = self.schema.to_row(item)
        return self.engine.upsert(self.name, row["id"], row["content"], row["tags"], row["numerics"])

    def upsert_batch(self, items: list) -> list[dict]:
        rows = [(i, *self.schema.to_row(x).values()) for i, x in enumerate(items)]
        df = self.engine.store.spark.createDataFrame(rows, "position long, id string, content string, tags map<string,string>, numerics map<string,double>")
        return [r.asDict() for r in self.engine.batch_upsert(self.name, df).collect()]

    def get(self, id_: str) -> Any:
        return self.schema.from_row(self.engine.get(self.name, id_))

    def delete(self, id_: str) -> None:
        self.engine.delete(self.name, id_)

    def count(self) -> int:
        return self.engine.store.count(self.name)

    def search(self, text: str) -> SearchBuilder:
        return self.engine.searcher(self.name).query(text)

    def hits(self, builder: SearchBuilder) -> list[tuple[Any, float]]:
        return [(self.schema.from_row(r.asDict()), r["score"]) for r in builder.do().hits.collect()]
