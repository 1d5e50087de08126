"""A deterministic stand-in for an embedding model: unit vectors drawn from a text's SHA-256, in built-in expressions."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions.vectors import bound, l2_normalize


def stub_vector(text: Column, dim: int) -> Column:
    """seed = SHA-256(text); block i = SHA-256(seed and i in two bytes) holds eight little-endian 32-bit numbers, scaled to [-1, 1]; unit length."""
    block = lambda seed, i: F.sha2(F.concat(seed, F.unhex(F.lpad(F.hex(i.cast("bigint")), 4, "0"))), 256)
    blocks = bound(F.unhex(F.sha2(text, 256)), lambda seed: F.transform(F.sequence(F.lit(0), F.lit((dim + 7) // 8 - 1)), lambda i: block(seed, i)))
    place = F.sequence(F.lit(0), F.lit(7))

    def number(block: Column, k: Column) -> Column:
        at = lambda b: F.substring(block, k * 8 + 1 + 2 * b, F.lit(2))
        return F.conv(F.concat(at(3), at(2), at(1), at(0)), 16, 10).cast("double") / 4294967295.0 * 2 - 1

    flat = F.flatten(F.transform(blocks, lambda b: F.transform(place, lambda k: number(b, k))))
    return l2_normalize(F.slice(flat, 1, dim))


def stub_vector_of(text: str, dim: int) -> list[float]:
    """The same for a query, on the driver."""
    seed, out = hashlib.sha256(text.encode()).digest(), []
    for i in range((dim + 7) // 8):
        block = hashlib.sha256(seed + i.to_bytes(2, "big")).digest()
        out += [int.from_bytes(block[k : k + 4], "little") / 4294967295.0 * 2 - 1 for k in range(0, 32, 4)]
    out = out[:dim]
    n = math.sqrt(sum(x * x for x in out))
    return [x / n for x in out] if n else out


def stub_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")
