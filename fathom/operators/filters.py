"""Filter expressions: must, should and must_not lists of conditions, compiled to one predicate."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.model import MAX_CONDITIONS, Collection, InvalidSchema, ValidationFailed


@dataclass(frozen=True)
class Match:
    """A tag equals a string, exactly."""

    key: str
    value: str

    def __post_init__(self):
        if not self.key or not self.value:
            raise ValidationFailed("a match needs a key and a value")

    kind = "tag"


@dataclass(frozen=True)
class Range:
    """A numeric lies within bounds; each side has one bound at most."""

    key: str
    gt: float | None = None
    gte: float | None = None
    lt: float | None = None
    lte: float | None = None

    def __post_init__(self):
        if not self.key:
            raise ValidationFailed("a range needs a key")
        if all(b is None for b in (self.gt, self.gte, self.lt, self.lte)):
            raise ValidationFailed("a range needs a bound")
        if (self.gt is not None and self.gte is not None) or (self.lt is not None and self.lte is not None):
            raise ValidationFailed("a side of a range has one bound")

    kind = "numeric"


Condition = Match | Range


@dataclass(frozen=True)
class Filter:
    must: tuple[Condition, ...] = ()
    should: tuple[Condition, ...] = ()
    must_not: tuple[Condition, ...] = ()

    def __post_init__(self):
        for name in ("must", "should", "must_not"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
            if len(getattr(self, name)) > MAX_CONDITIONS:
                raise ValidationFailed(f"{name} has over {MAX_CONDITIONS} conditions")

    def conditions(self) -> tuple[Condition, ...]:
        return self.must + self.should + self.must_not

    @classmethod
    def parse(cls, spec: dict | None) -> Filter:
        """From {"must": [{"key": ..., "match": ...} or {"key": ..., "range": {...}}], ...}."""

        def one(c: dict) -> Condition:
            if ("match" in c) == ("range" in c):
                raise ValidationFailed("a condition is either a match or a range")
            if "match" in c:
                return Match(c.get("key", ""), c["match"])
            if strange := set(c["range"]) - {"gt", "gte", "lt", "lte"}:
                raise ValidationFailed(f"unknown bounds {sorted(strange)}")
            return Range(c.get("key", ""), **c["range"])

        spec = spec or {}
        if strange := set(spec) - {"must", "should", "must_not"}:
            raise ValidationFailed(f"unknown groups {sorted(strange)}")
        return cls(*(tuple(map(one, spec.get(k) or ())) for k in ("must", "should", "must_not")))


def check_against(spec: Filter | None, collection: Collection) -> None:
    """Every field must exist and be of the condition's kind."""
    for c in spec.conditions() if spec else ():
        kind = collection.kind_of(c.key)
        if kind is None:
            raise InvalidSchema(f"no field {c.key}")
        if kind != c.kind:
            raise InvalidSchema(f"{c.key} is a {kind} field")


def _value(df: DataFrame, c: Condition) -> Column:
    """A column of that name where the field was promoted to one (its predicate reaches the Parquet scan), else the map's entry."""
    if c.key in df.columns:
        return F.col(c.key).cast("string") if c.kind == "tag" and dict(df.dtypes)[c.key] != "string" else F.col(c.key)
    return F.col("tags" if c.kind == "tag" else "numerics").getItem(c.key)


def condition(df: DataFrame, c: Condition) -> Column:
    v = _value(df, c)
    if isinstance(c, Match):
        return v == F.lit(c.value)
    parts = [op for op in (
        v > c.gt if c.gt is not None else None, v >= c.gte if c.gte is not None else None,
        v < c.lt if c.lt is not None else None, v <= c.lte if c.lte is not None else None,
    ) if op is not None]
    return reduce(Column.__and__, parts)


def predicate(df: DataFrame, spec: Filter | None) -> Column:
    """must AND (any of should) AND none of must_not; a document without a field never meets a condition on it."""
    out = F.lit(True)
    if spec is None:
        return out
    for c in spec.must:
        out = out & condition(df, c)
    if spec.should:
        out = out & reduce(Column.__or__, [F.coalesce(condition(df, c), F.lit(False)) for c in spec.should])
    for c in spec.must_not:
        out = out & ~F.coalesce(condition(df, c), F.lit(False))
    return out


def apply(df: DataFrame, spec: Filter | None) -> DataFrame:
    return df.where(predicate(df, spec)) if spec and spec.conditions() else df
