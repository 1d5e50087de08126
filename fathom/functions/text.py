"""Text expressions: tokens, white space, sentences, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What parts tokens: everything but letters and digits.
TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda x: x != "")


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    """Parts that end in . ! or ? (with closing quotes or brackets) before any Unicode white space, or at a blank line; squeezed, none empty."""
    marked = F.regexp_replace(text, r"""(?U)([.!?]["'\)\]}]*)(\s)""", "$1\u0001$2")
    return F.filter(F.transform(F.split(marked, "\u0001|\n\n"), squeeze), lambda x: x != "")


def word_tokens(text: Column) -> Column:
    """Number of words and single marks, and two for the ends: a stand-in for a model's count."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + 2


def chunk_id(doc_id: Column, number: Column) -> Column:
    return F.format_string("%s-chunk-%04d", doc_id, number)


def title_and_text(title: Column, text: Column) -> Column:
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.concat_ws("\n\n", blank(title), blank(text))


def numeric_order(id_: Column) -> list[Column]:
    """Sort keys by which ids that are numbers come in their order, before all others."""
    number = id_.try_cast("bigint")
    return [number.isNull(), number, id_]


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)
