"""SimHash near-duplicate detection with covering locality-sensitive hashing: no pair within the radius is missed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.components import connected_components
from fathom.llm.runtime import bounded_batches, materialize, row_key, text_or_empty

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Fingerprints that one group of a bucket holds at most, about; larger buckets are compared block by block.
BLOCK = 2048
_AT_ONCE = 1 << 16


def fingerprint(data: bytes, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles of the lower-cased bytes: a bit is set if more than half of the hashes set it."""
    parts = data.lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09 to 0x0D
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), "i8", len(parts))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    ends = starts + sizes
    k = min(words, len(parts))
    n = len(parts) - k + 1
    ones, digest = np.zeros(64, "i8"), xxhash.xxh64_intdigest
    for i in range(0, n, _AT_ONCE):
        j = min(n, i + _AT_ONCE)
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[i:j].tolist(), ends[i + k - 1 : j + k - 1].tolist(), strict=True)], "<u8")
        ones += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """Rows (id, fp): the fingerprint of the whole text as a signed 64-bit integer. Null texts count as empty: fp 0."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_buffer().to_pybytes(), words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, "u8").view("i8"))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2^(radius + 1) - 1 masks such that for any `radius` bits some mask leaves out all of them.

    Bit i gets a code word c(i) of radius + 1 binary digits, not zero, by turns; the mask of a non-zero vector v holds
    the bits with an odd inner product of c(i) and v. Any `radius` code words have a common non-zero v that is
    orthogonal to all of them, so two fingerprints that differ only there agree under the mask of v.
    """
    codes = [1 + i % ((1 << (radius + 1)) - 1) for i in range(bits)]
    return [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> list[tuple[int, int]]:
    """Links between fingerprints a and b (indices; b counts on behind a unless it is the same block) that join different trees.

    Each fingerprint is held against all others at once, and trees are merged by whole arrays: the work in Python grows
    with the number of links that come out, not with the number of near pairs.
    """
    shift = 0 if same else len(a)
    label, out = np.arange(shift + len(b)), []
    for i in range(0, len(a), 512):
        near = np.bitwise_count(a[i : i + 512, None] ^ b[None, :]) <= radius
        for x in (np.flatnonzero(near.sum(1) > same) + i).tolist():
            y = np.flatnonzero(near[x - i]) + shift
            other = label[y] != label[x]
            if other.any():
                trees, first = np.unique(label[y[other]], return_index=True)
                out += [(x, z) for z in y[other][first].tolist()]
                every = np.append(trees, label[x])
                label[np.isin(label, every)] = every.min()
    return out


def _link_groups(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (table, key, i, j): each group is one block (i = j) or two; gives the links of a spanning forest of the group."""
    held: list[np.ndarray] = []

    def flush() -> list[tuple[int, int]]:
        own, fp, rep, i, j = (np.concatenate([h[k] for h in held]) for k in range(5))
        if i[0] == j[0]:
            return [(rep[x], rep[y]) for x, y in _forest(fp, fp, True, radius)]
        first, second = np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0])
        at = np.concatenate([first, second])
        return [(rep[at[x]], rep[at[y]]) for x, y in _forest(fp[first], fp[second], False, radius)]

    def send(out: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(out, "i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    last, out = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        c = {n: batch.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(batch.schema.names)}
        table, key, i, j = c["tab"], c["key"], c["i"], c["j"]
        new = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        cuts = [0, *new.tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            group = (table[s], key[s], i[s], j[s])
            if group != last and held:
                out += flush()
                held.clear()
                if len(out) >= 100_000:
                    yield send(out)
                    out = []
            last = group
            held.append((c["own"][s:e], c["fp"][s:e].view("u8"), c["rep"][s:e], i[s:e], j[s:e]))
    if held:
        out += flush()
    yield send(out)


def links(classes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """From rows (fp, rep), one per fingerprint: links (a, b) of reps that join all fingerprints reachable by steps within the radius.

    Every fingerprint goes into 2^(radius + 1) - 1 tables; pairs within the radius share a bucket of some table. Only
    buckets with more than one fingerprint are looked at. A bucket of over `block` fingerprints is dealt into blocks and
    each pair of blocks is compared by itself, so no bucket is too large for a task; within a pair only the links of a
    spanning forest come out, never all pairs.
    """
    masks = F.array(*[F.struct(F.lit(k).alias("tab"), F.lit(_signed(m)).alias("m")) for k, m in enumerate(covering_masks(radius))])
    rows = classes.select("fp", "rep", F.explode(masks).alias("t")).select("fp", "rep", "t.tab", F.col("fp").bitwiseAND(F.col("t.m")).alias("key"))
    full = rows.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = rows.join(full, ["tab", "key"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("tab", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "rep")
    cols = ["tab", "key", "i", "j"]
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, *cols).sortWithinPartitions(*cols).mapInArrow(lambda it: _link_groups(it, radius), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable, itself included).

    Documents with the same fingerprint are one class; links are sought between classes, also those whose documents have
    no id. Null, empty and blank texts have fingerprint zero and link like any other; rows whose id is null take the
    component of their class, null if no id is reachable; an empty table gives no rows; repeated rows share a class.
    Other columns are ignored.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, words), "simhash")
    classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("low")), "simhash-classes")
    found = links(classes.select("fp", F.col("fp").alias("rep")), radius, block)
    comp = materialize(connected_components(found).select(F.col("node").alias("fp"), "component"), "simhash-components")
    lows = comp.join(classes, "fp").groupBy("component").agg(F.min("low").alias("lowest"))
    classes = classes.join(comp, "fp", "left").join(lows, "component", "left").select("fp", F.coalesce("lowest", "low").alias("component_id"))
    classes = materialize(classes, "simhash-told")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(classes, "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group stays (the smallest id), with all its columns.

    Rows without an id are linked like any other and come after all that have one; of equal texts without an id all
    stay or none. So do rows that share an id: they count as one document.
    """
    rows = docs.withColumn("__key", row_key(docs, id_col, text_col))
    kept = near_groups(rows, "__key", text_col).where(F.col("__key") == F.col("component_id")).select("__key").distinct()
    return rows.join(kept, "__key", "left_semi").select(docs.columns)
