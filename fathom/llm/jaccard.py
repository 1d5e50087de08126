"""Near copies by shared word shingles: prefix filtering finds every pair of at least the given similarity, exact counts confirm it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm import simhash
from fathom.llm.components import connected_components
from fathom.llm.runtime import bounded_batches, few, materialize, row_key, text_or_empty

SHINGLE_WORDS = 5
#: Least similarity of a near copy, as a fraction.
NUM, DEN = 4, 5
SEED = 42
#: One document in so many tells which shingles are common, and so many common shingles are told apart at most. Both only
#: settle the order of shingles, on which the work depends but no result.
SAMPLE, COMMON = 16, 500_000
#: Sizes of one band differ by less than this factor, and those of near copies by no more than DEN / NUM: they are in one
#: band or in neighbours.
BAND = 1.26
#: Documents of a crowded shingle that one task holds at most, and bytes of their sets.
BLOCK, BLOCK_BYTES = 512, 8 << 20


def shingles(data: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashes, ascending, of the word shingles of the lower-cased bytes; a shorter text is one shingle, a blank one has none."""
    parts = data.lower().split()
    if not parts:
        return np.empty(0, "i8")
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), "i8", len(parts))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    k = min(words, len(parts))
    ends, digest = (starts + sizes)[k - 1 :], xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=False)], "u8").view("i8"))


def sketch(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of the shingles falls into each cell, as bits of 64-bit words; as many cells as shingles or up to twice as many.

    Two sets differ in at least as many shingles as their sketches in cells. A sketch is folded to half its cells by
    combining its halves.
    """
    cells = max(64, 1 << max(0, len(s) - 1).bit_length())
    odd = np.bincount(s & (cells - 1), minlength=cells) & 1
    return np.packbits(odd.astype("u1"), bitorder="little").view("<i8")


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype("i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, "i8")))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, words: int = SHINGLE_WORDS, common: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Rows (id, n, s, k): the number of distinct shingles, the shingles (with `common` only those of the prefix), and their sketch.

    Shingles are put in one order for all documents, rare ones first. Two sets of similarity NUM / DEN or more share a
    shingle among the first n - ceil(n * NUM / DEN) + 1 of each, whatever the order is.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_buffer().to_pybytes(), words) for x in batch.column(1)]
            sizes = pa.array([len(s) for s in sets], pa.int32())
            cells = _lists([sketch(s) for s in sets])
            if common is not None:
                sets = [_prefix(s, *common) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, _lists(sets), cells], names=["id", "n", "s", "k"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n int, s array<long>, k array<long>")


def _prefix(s: np.ndarray, known: np.ndarray, count: np.ndarray) -> np.ndarray:
    n = len(s)
    if not n:
        return s
    rank = np.zeros(n, "i8")
    if len(known):
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        rank = np.where(known[at] == s, count[at], 0)
    return s[np.lexsort((s, rank))[: n - -(-n * NUM // DEN) + 1]]


def common_shingles(docs: DataFrame, id_col: str, text_col: str, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the shingles that several sampled documents hold."""
    part = docs.where(F.pmod(F.xxhash64(id_col), F.lit(SAMPLE)) == 0)
    held = shingle_sets(part, id_col, text_col, words).select(F.explode("s").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 2")
    held = materialize(held, "jaccard-common")
    least, total = 3, 0
    for r in sorted(held.groupBy(F.least("c", F.lit(10_000)).alias("c")).count().collect(), reverse=True):
        total += r["count"]
        if total > COMMON:
            least = r.c + 1
            break
    rows = held.where(F.col("c") >= least).toArrow()
    h, c = (rows.column(k).to_numpy() for k in range(2))
    order = np.argsort(h)
    return h[order], c[order]


def _near(m: Column, n: Column) -> Column:
    return F.least(m, n) * DEN >= F.greatest(m, n) * NUM


def _differ(x: Column, y: Column) -> Column:
    """Cells in which two sketches differ, the larger one folded once if need be (near sizes need no more)."""
    fold = lambda k, to: F.when(F.size(k) > to, F.zip_with(F.slice(k, 1, to), F.slice(k, to + 1, to), lambda p, q: p.bitwiseXOR(q))).otherwise(k)
    to = F.least(F.size(x), F.size(y))
    return F.aggregate(F.zip_with(fold(x, to), fold(y, to), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)


def _beside(pairs: DataFrame, rows: DataFrame, *cols: str) -> DataFrame:
    """Written pairs (a, b) with columns of the rows of both, as n_a, n_b and so on. Hot ids stay alone in their joins, so Spark can split them."""
    for side in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in cols]), side)
    return pairs


def _confirmed(pairs: DataFrame, sizes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """The written pairs (a, b) of at least the similarity: by their sketches first, then by the whole sets."""
    near = _beside(pairs, sizes, "n", "k").where(_near(F.col("n_a"), F.col("n_b")))
    near = near.where(_differ(F.col("k_a"), F.col("k_b")) * (DEN + NUM) <= (F.col("n_a") + F.col("n_b")) * (DEN - NUM))
    near = materialize(near.select("a", "b"), "jaccard-pairs")
    sets = _whole_sets(docs, near.select(F.explode(F.array("a", "b")).alias("id")), id_col, text_col, words)
    shared = F.size(F.array_intersect("s_a", "s_b"))  # shared / (n_a + n_b - shared) >= NUM / DEN
    return _beside(near, sets, "n", "s").where(shared * (NUM + DEN) >= (F.col("n_a") + F.col("n_b")) * NUM).select("a", "b").distinct()


def _whole_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    asked = materialize(ids.select(F.col("id").alias("__asked")).distinct(), "jaccard-asked")
    part = docs.join(few(asked), F.col(id_col) == F.col("__asked"), "left_semi")
    return materialize(shingle_sets(part, id_col, text_col, words).select("id", "n", "s"), "jaccard-sets")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            new |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[s] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held.clear()
            last = key
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _numpy_lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False) for x in column]


def _plausible(table: pa.Table, sketches: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of the first block the rows of the second (later ones, if it is the same) that may be near copies, in another component."""
    n, comp, own, upper = (table.column(c).to_numpy() for c in ("n", "component", "own", "upper"))
    words = min(map(len, sketches))
    bits = np.stack([np.bitwise_xor.reduce(k.reshape(-1, words), axis=0) for k in sketches]).view("u8")
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    first, second = np.flatnonzero(own == i), np.flatnonzero(own == j)
    step = max(1, (1 << 20) // max(1, len(second) * words))
    for at in range(0, len(first), step):
        x = first[at : at + step]
        differ = np.bitwise_count(bits[x][:, None] ^ bits[second][None]).sum(2, dtype="i8")
        total = n[x][:, None].astype("i8") + n[second][None]
        ok = (differ * (DEN + NUM) <= total * (DEN - NUM)) & (comp[x][:, None] != comp[second][None])
        ok &= np.minimum(n[x][:, None], n[second][None]) * DEN >= np.maximum(n[x][:, None], n[second][None]) * NUM
        ok &= upper[x][:, None] | upper[second][None]  # two of the lower band meet in their own
        if i == j:
            ok &= x[:, None] < second[None]
        for r in np.flatnonzero(ok.any(1)).tolist():
            yield int(x[r]), second[ok[r]]


def _dealt(rows: DataFrame, payload: list[str], shingle_bytes: float) -> DataFrame:
    """Rows (h, id, n, component, ...) by shingle and band of sizes, in blocks that fit a task, each pair of blocks by itself."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(BAND))).cast("int")
    rows = rows.withColumn("u", F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("upper")), F.struct((band + 1).alias("band"), F.lit(False).alias("upper")))))
    rows = rows.select("h", "id", "n", "component", *payload, "u.band", "u.upper")
    # A lower row is only there for the upper ones.
    full = rows.groupBy("h", "band").agg(F.count(F.lit(1)).alias("c"), F.max("upper").alias("any"), F.min("component").alias("p"), F.max("component").alias("q"))
    full = materialize(full.where("any and p != q").select("h", "band", "c"), "jaccard-bands")
    block = F.greatest(F.lit(8.0), F.least(F.lit(float(BLOCK)), BLOCK_BYTES / (F.pow(F.lit(BAND), F.col("band").cast("double")) * shingle_bytes)))
    rows = rows.join(full, ["h", "band"]).withColumn("blocks", F.ceil(F.col("c") / block).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("h", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "upper", "id", "n", "component", *payload)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *_KEY).sortWithinPartitions(*_KEY)


_KEY = ["h", "band", "i", "j"]


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (h, id) that may have a near copy in another component."""
    for table in _groups(batches, _KEY):
        seen = np.zeros(table.num_rows, bool)
        for x, y in _plausible(table, _numpy_lists(table.column("k"))):
            seen[x] = True
            seen[y] = True
        if seen.any():
            yield from table.select(["h", "id"]).filter(pa.array(seen)).to_batches()


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of a spanning forest over components, by whole sets."""
    for table in _groups(batches, _KEY):
        sets, ids = _numpy_lists(table.column("s")), table.column("id").combine_chunks()
        _, tree = np.unique(table.column("component").to_numpy(), return_inverse=True)
        n, a, b = table.column("n").to_numpy(), [], []
        for x, ys in _plausible(table, [sketch(s) for s in sets]):
            for y in ys.tolist():
                if tree[x] != tree[y]:
                    shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if shared * (NUM + DEN) >= (int(n[x]) + int(n[y])) * NUM:
                        tree[tree == tree[y]] = tree[x]
                        a.append(x)
                        b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in (_taken(ids, a), _taken(ids, b))], names=["a", "b"])


def _taken(ids: pa.ChunkedArray | pa.Array, at: list[int]) -> pa.Array:
    out = ids.take(pa.array(at))
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """Links (a, b) of ids that join all documents reachable by steps of at least the similarity, and no others.

    Candidates are the pairs that share a shingle of their prefixes. First each document is held against the smallest and
    the largest id of each of its shingles, which joins groups of copies without looking at all their pairs, and settles
    shingles of up to three documents. Of the other shingles those are left whose documents are in different groups still:
    their documents are compared in blocks, by sketches that rule out most pairs, then by whole sets; tasks give the rows
    concerned, and in the end the links of a spanning forest, never all pairs.

    Rows that share an id are one document, linked by any of its texts. Blank texts and null ids have no links.
    """
    docs = docs.where(F.col(id_col).isNotNull()).select(id_col, text_col)
    kind = dict(docs.dtypes)[id_col]
    common = common_shingles(docs, id_col, text_col, words)
    sets = materialize(shingle_sets(docs, id_col, text_col, words, common), "jaccard-prefixes")
    held = sets.select("id", F.explode("s").alias("h"))
    ends = held.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("c"))
    ends = materialize(ends.where("low != high"), "jaccard-ends")  # shingles of one document go no further
    shared = materialize(held.join(ends, "h"), "jaccard-shared")
    tries = shared.select("id", F.explode(F.array("low", "high")).alias("o")).where("id != o").select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b"))
    sizes = sets.select("id", "n", "k")
    first = materialize(_confirmed(materialize(tries.distinct(), "jaccard-tries"), sizes, docs, id_col, text_col, words), "jaccard-first")

    group = materialize(connected_components(first).select(F.col("node").alias("id"), "component"), "jaccard-groups")
    at = shared.where("c > 3").select("h", "id").join(group, "id", "left").select("h", "id", F.coalesce("component", "id").alias("component"))
    at = materialize(at.distinct(), "jaccard-open")
    mixed = materialize(at.groupBy("h").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p != q").select("h"), "jaccard-mixed")
    at = materialize(at.join(mixed, "h", "left_semi"), "jaccard-open")
    flagged = _dealt(at.join(sizes, "id"), ["k"], 0.25).mapInArrow(_flag, f"h long, id {kind}")
    flagged = materialize(flagged.distinct(), "jaccard-flagged")
    whole = _whole_sets(docs, flagged.select("id"), id_col, text_col, words)
    rest = _dealt(at.join(flagged, ["h", "id"], "left_semi").join(whole, "id"), ["s"], 8.0).mapInArrow(_link, f"a {kind}, b {kind}")
    return first.unionByName(rest)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group stays (the smallest id), with all its columns.

    A group is joined by steps of 5-word similarity 0.8 or more, and by those of simhash.near_groups. Rows without an id
    and rows that share one are taken as in simhash.drop_near_copies.
    """
    rows = docs.withColumn("__key", row_key(docs, id_col, text_col))
    groups = simhash.near_groups(rows, "__key", text_col).select(F.col("__key").alias("a"), F.col("component_id").alias("b")).where("a != b")
    found = connected_components(groups.unionByName(links(rows, "__key", text_col)))
    copies = materialize(found.where("node != component").select(F.col("node").alias("__key")).distinct(), "near-copies")
    return rows.join(few(copies), "__key", "left_anti").select(docs.columns)
