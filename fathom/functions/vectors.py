"""Vector expressions: all in double precision and built-in expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Constant vectors up to this length are written out term by term, which compiles; longer ones use higher-order functions.
UNROLLED = 128


def constant(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once per row, however often the body names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column | Sequence[float]) -> Column:
    if not isinstance(b, Column):
        if len(b) <= UNROLLED:
            out = F.lit(0.0)
            for i, x in enumerate(b):
                out = out + F.get(a, F.lit(i)).cast("double") * F.lit(float(x))
            return out
        b = F.split(F.lit(",".join(repr(float(x)) for x in b)), ",").cast("array<double>")
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column | Sequence[float]) -> Column:
    """Cosine similarity, negative values raised to 0; null where a vector is zero, missing or of another length."""
    if isinstance(b, Column):
        size, length = F.size(b), norm(b)
    else:
        size, length = F.lit(len(b)), F.lit(float(np.sqrt(sum(float(x) * float(x) for x in b))))
    scale = norm(a) * length
    return F.when((F.size(a) == size) & (scale > 0), F.greatest(F.lit(0.0), dot(a, b) / scale))


def inner_product(a: Column, b: Column | Sequence[float]) -> Column:
    return dot(a, b)


def l2_distance(a: Column, b: Column | Sequence[float]) -> Column:
    b = b if isinstance(b, Column) else constant(b)
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def l2_normalize(a: Column) -> Column:
    """The vector divided by its length; a zero vector stays as it is."""
    unit = lambda v, n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return bound(a, lambda v: bound(norm(v), lambda n: unit(v, n)))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """The mean of the token vectors whose mask is not 0, then divided by its length. Null without such a token."""
    used = F.transform(F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda t: t["m"] != 0), lambda t: t["v"])
    total = F.aggregate(F.slice(used, 2, F.greatest(F.size(used) - 1, F.lit(0))), F.transform(F.get(used, F.lit(0)), lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda p, q: p + q.cast("double")))
    return F.when(F.size(used) > 0, l2_normalize(F.transform(total, lambda x: x / F.size(used))))


@F.pandas_udf(T.BinaryType())
def pack(v: pd.Series) -> pd.Series:
    """Little-endian float32 bytes."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack(b: pd.Series) -> pd.Series:
    """Back from bytes; null if their number is not a multiple of 4."""
    return b.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4"))
