"""Removal of repeated passages: a count-min sketch finds windows that may repeat, and only those are grouped exactly."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.runtime import bounded_batches, few, materialize, text_or_empty

WINDOW = 35
#: Cells of the sketch for each window, at least, and cells of a slice of it (as a power of two), which one task counts at a time.
CELLS, SLICE_BITS = 8, 22
#: Bytes of text of a block of documents, about, and of what is hashed at once.
BLOCK_BYTES, HASH_BYTES = 6 << 20, 1 << 20
#: Rows of one id and one text that are kept as they are; more are one row with their number.
SAME_ROWS = 16

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, (2, 256), dtype="u8") * 2 + 1
_BASE = [int(x) * 2 + 1 for x in _rng.integers(1 << 40, 1 << 62, 4)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2^64, of an odd number and of its inverse."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        out = []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, 1 << 12), x, "u8")
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _spans(x: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice, base: int) -> np.ndarray:
    """Polynomial hashes of x[start:end], the same wherever they stand."""
    p, q = _powers(base, len(x) + 1)
    c = np.zeros(len(x) + 1, "u8")
    np.cumsum(x * p[:-1], out=c[1:])
    return (c[ends] - c[starts]) * q[starts]


def _hashes(texts: pa.BinaryArray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (lanes x words), and the first word of each text (and the end)."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], "i4")[texts.offset : texts.offset + n + 1].astype("i8")
    data = np.frombuffer(texts.buffers()[2], "u1") if texts.buffers()[2] is not None else np.zeros(0, "u1")
    out, counts, i = [], np.zeros(n, "i8"), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + HASH_BYTES, "right")) - 1)
        b = data[offsets[i] : offsets[j]]
        at = offsets[i : j + 1] - offsets[i]
        if len(b):
            space = (b == 32) | ((b - np.uint8(9)) < 5)
            first, last = np.ones(len(b), bool), np.ones(len(b), bool)
            first[1:], last[:-1] = space[:-1], space[1:]
            first[at[:-1][at[:-1] < len(b)]] = True
            last[at[1:][at[1:] > 0] - 1] = True
            starts, ends = np.flatnonzero(~space & first), np.flatnonzero(~space & last) + 1
            counts[i:j] = np.diff(np.searchsorted(starts, at))
            out.append(np.stack([_mix(_spans(_BYTE[k][b], starts, ends, _BASE[k])) for k in range(lanes)]))
        i = j
    return np.concatenate(out, axis=1) if out else np.zeros((lanes, 0), "u8"), np.concatenate([[0], np.cumsum(counts)])


def _windows(texts: pa.BinaryArray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of texts, the first words of all windows, and the windows' 128-bit hashes as pairs."""
    words, begins = _hashes(texts, 2)
    n = words.shape[1]
    inside = np.zeros(n + 1, "i8")
    fits = np.diff(begins) >= window
    np.add.at(inside, begins[:-1][fits], 1)
    np.add.at(inside, begins[1:][fits] - window + 1, -1)
    at = np.flatnonzero(np.cumsum(inside)[: max(0, n - window + 1)] > 0)
    pairs = np.empty(len(at), [("x", "u8"), ("y", "u8")])
    for k, name in enumerate(("x", "y")):
        if len(at):
            pairs[name] = _mix(_spans(words[k], slice(0, n - window + 1), slice(window, n + 1), _BASE[3 - k])[at])
    return begins, at, pairs


_STEP = 0x7FFF


def _coded(cells: np.ndarray, twice: np.ndarray) -> bytes:
    """Ascending cells of a slice and a flag for each, as 16-bit steps: 15 bits of the way from the cell before, the largest of
    which only leads on."""
    q, r = np.divmod(np.diff(cells, prepend=0), _STEP)
    out = np.full(len(cells) + int(q.sum()), _STEP, "<u2")
    out[np.cumsum(q + 1) - 1] = r.astype("u2") | (twice.astype("u2") << np.uint16(15))
    return out.tobytes()


def _decoded(data: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(data, "<u2")
    step = x & np.uint16(_STEP)
    real = step != _STEP
    return np.cumsum(step, dtype="i8")[real], (x >> np.uint16(15))[real] == 1


def _sketch(blocks: DataFrame, bits: int, window: int) -> DataFrame:
    """Rows (block, slice, flags): for the cells that a block's windows fall into, in order, whether the merged sketch counts 2 or more there.

    The sketch has 2^bits cells, as many as the number of windows asks for; no task ever holds it. Each block counts its
    windows by cell, 2 standing for more, and sends its cells by slice; the task of a slice adds up what all blocks sent
    and answers each of them. Counts are those of all windows in a cell: overestimated, never underestimated.
    """
    slice_bits = min(bits, SLICE_BITS)

    def count(key: tuple, table: pa.Table) -> pa.Table:
        cells, n = _cells_of(table, bits, window)
        twice = n > 1
        own, first = np.unique(cells >> np.uint64(slice_bits), return_index=True)
        low = (cells & np.uint64((1 << slice_bits) - 1)).astype("i8")
        parts = [_coded(low[s:e], twice[s:e]) for s, e in zip(first, [*first[1:], len(cells)][: len(first)], strict=True)]
        return pa.table({"slice": pa.array(own.astype("i8")), "block": pa.array(np.full(len(own), key[0].as_py(), "i8")), "cells": pa.array(parts, pa.binary())})

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        counts = np.zeros(1 << slice_bits, "u1")
        sent = [_decoded(c.as_buffer()) for c in table.column("cells")]
        for cells, twice in sent:
            counts[cells] = np.minimum(2, counts[cells] + twice + 1)
        flags = [np.packbits(counts[cells] > 1, bitorder="little").tobytes() for cells, _ in sent]
        return pa.table({"block": table.column("block"), "slice": table.column("slice"), "flags": pa.array(flags, pa.binary()), "cells": pa.array([len(c) for c, _ in sent], pa.int32())})

    sent = blocks.groupBy("block").applyInArrow(count, "slice long, block long, cells binary")
    return sent.groupBy("slice").applyInArrow(merge, "block long, slice long, flags binary, cells int")


def _cells_of(table: pa.Table, bits: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of a block's windows, ascending, and how many windows fall into each; windows of repeated rows count twice."""
    begins, at, pairs = _windows(_text(table), window)
    cells = pairs["x"] >> np.uint64(64 - bits)
    more = _of_repeated(table, begins, at)
    return np.unique(np.concatenate([cells, cells[more]]), return_counts=True)


def _of_repeated(table: pa.Table, begins: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which windows are of rows that stand for several."""
    n = table.column("n").to_numpy()
    return n[np.searchsorted(begins, at, "right") - 1] > 1 if len(at) and (n > 1).any() else np.zeros(len(at), bool)


def _candidates(table: pa.Table, notes: pa.Table, bits: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words of texts, the windows that the sketch lets pass (their first words), their hashes, and which are of repeated rows."""
    begins, at, pairs = _windows(_text(table), window)
    more = _of_repeated(table, begins, at)
    cells, place = np.unique(pairs["x"] >> np.uint64(64 - bits), return_inverse=True)
    notes = notes.sort_by("slice")
    sizes = notes.column("cells").to_pylist()
    flags = [np.unpackbits(np.frombuffer(f.as_buffer(), "u1"), count=n, bitorder="little") for f, n in zip(notes.column("flags"), sizes, strict=True)]
    if sum(sizes) != len(cells):
        raise ValueError("a block's rows have changed between two readings of the table")
    passed = np.concatenate([*flags, np.zeros(0, "u1")]).astype(bool)[place] if len(at) else np.zeros(0, bool)
    return begins, at[passed], pairs[passed], more[passed]


def _unique(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, for each row the place of its pair, and the counts."""
    order = np.lexsort((pairs["y"], pairs["x"]))
    p = pairs[order]
    new = np.ones(len(p), bool)
    new[1:] = p[1:] != p[:-1]
    place = np.empty(len(p), "i8")
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return p[first], place, np.diff([*first, len(p)])


def _text(table: pa.Table) -> pa.BinaryArray:
    c = table.column("text").combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


def _counted(rows: DataFrame) -> DataFrame:
    """Rows (id, text, n): rows of one id and text that are repeated over SAME_ROWS times are merged, in each map task before they are shuffled."""
    mark = rows.select("id", F.xxhash64("id", "text").alias("mark"))
    hot = mark.groupBy("id", "mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SAME_ROWS).select("mark").distinct()
    hot = materialize(hot, "repeat-rows")
    if hot.isEmpty():
        return rows.withColumn("n", F.lit(1).cast("long"))
    rows, hot = rows.withColumn("mark", F.xxhash64("id", "text")), few(hot)
    merged = rows.join(hot, "mark", "left_semi").groupBy("id", "text").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(hot, "mark", "left_anti").select("id", "text", F.lit(1).cast("long").alias("n")).unionByName(merged)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cells: int = CELLS) -> DataFrame:
    """One row per document: id, kept (the words that stay, joined by single spaces), n_words, n_removed.

    A word goes if a window of `window` words that covers it also starts anywhere else, in this or another document;
    all windows are judged on the input.

    1. Documents are dealt into blocks of some MB by hashes of their ids and texts. Each block counts its windows in a
       count-min sketch of at least `cells` cells for each window of the corpus; the sketch lives in slices, to which blocks
       send their counts and which answer with the cells that hold 2 or more. It grows with the input: nothing is
       broadcast, and the share of unique windows that pass is the same at every size.
    2. Windows that pass are merged within their block and grouped by 128-bit hashes over all blocks; a window in two
       blocks or twice in one is repeated. A block holds a window's hash once, so a passage that all documents share costs
       one row per block.
    3. Each block is told which of its windows repeat, by their places in the order of its hashes.

    Null texts have no words; texts shorter than a window lose nothing; copies lose all words that windows cover;
    repeated rows of an id are separate documents; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A window starts at a word, which takes two bytes at least; most words take more.
    bits = max(10, int(total * cells // 4).bit_length())
    key = F.pmod(F.xxhash64("id", "text"), F.lit(total // BLOCK_BYTES + 1))
    blocks = _counted(rows).select(key.alias("block"), "id", F.col("text").cast("binary").alias("text"), "n")
    flags = materialize(_sketch(blocks, bits, window), "repeat-flags")

    def ask(block: tuple, table: pa.Table, notes: pa.Table) -> pa.Table:
        _, _, pairs, more = _candidates(table, notes, bits, window)
        distinct, place, n = _unique(pairs)
        twice = n > 1
        twice[place[more]] = True
        return pa.table({
            "x": distinct["x"].view("i8"), "y": distinct["y"].view("i8"), "block": pa.array(np.full(len(n), block[0].as_py(), "i8")),
            "place": pa.array(np.arange(len(n), dtype="i4")), "twice": pa.array(twice),
        })

    asked = blocks.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(ask, "x long, y long, block long, place int, twice boolean")
    seen = F.count(F.lit(1)).over(Window.partitionBy("x", "y"))
    told = asked.withColumn("seen", seen).where("twice or seen > 1").select("block", "place")
    nothing = F.lit(None)
    told = told.select("block", "place", nothing.cast("long").alias("slice"), nothing.cast("binary").alias("flags"), nothing.cast("int").alias("cells"))
    notes = told.unionByName(flags.select("block", nothing.cast("int").alias("place"), "slice", "flags", "cells"))

    def settle(block: tuple, table: pa.Table, notes: pa.Table) -> pa.Table:
        texts, place_of = _text(table), notes.column("place")
        begins, at, pairs, _ = _candidates(table, notes.filter(pc.is_valid(notes.column("slice"))), bits, window)
        distinct, place, _ = _unique(pairs)
        repeated = np.zeros(len(distinct), bool)
        repeated[place_of.drop_null().to_numpy()] = True
        cover = np.zeros(begins[-1] + window + 1, "i4")
        if len(at):
            gone = at[repeated[place]]
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + window, -1)
        stays = np.cumsum(cover)[: begins[-1]] == 0
        kept, n_kept = [], np.zeros(len(texts), "i8")
        for i, (s, e) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
            words = texts[i].as_buffer().to_pybytes().split()
            mask = stays[s:e]
            n_kept[i] = mask.sum()
            kept.append(b" ".join(words if n_kept[i] == e - s else compress(words, mask.tolist())))
        sizes = np.diff(begins)
        return pa.table({"id": table.column("id"), "kept": pa.array(kept, pa.binary()), "n_words": sizes, "n_removed": sizes - n_kept, "n": table.column("n")})

    kind = dict(rows.dtypes)["id"]
    done = blocks.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(settle, f"id {kind}, kept binary, n_words long, n_removed long, n long")
    done = done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return done.select(F.col("id").alias(id_col), F.col("kept").cast("string").alias("kept"), "n_words", "n_removed")
