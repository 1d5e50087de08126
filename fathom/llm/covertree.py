"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.vectors import bound, dot, norm
from fathom.llm.components import connected_components
from fathom.llm.runtime import materialize

COSINE = 0.98
#: Vectors of a block, about; every pair of blocks of a label that the bounds allow is one task's work.
BLOCK = 2048
#: Pivots at most, over all labels: what is broadcast to deal vectors into cells. Larger cells have pivots of their own.
MOST_PIVOTS = 2048
#: Vectors of a cell that meet its own pivots in one task.
CHUNK = 1 << 15
#: Nodes of no more vectors, or no larger radius, are compared vector by vector.
LEAF_SIZE, LEAF_RADIUS = 16, 0.125
#: Added to bounds, far above the error of a distance in double precision.
_SLACK = 1e-7
_BATCH = 128


@dataclass
class Node:
    center: int
    members: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)


def _reach(x: np.ndarray, center: int, members: np.ndarray) -> float:
    return float(np.sqrt(np.maximum(0, 2 - 2 * (x[members] @ x[center])).max(initial=0)))


def _net(x: np.ndarray, members: np.ndarray, radius: float) -> list[np.ndarray]:
    """Parts of members, each within `radius` of its first one; first ones are more than `radius` apart."""
    least, out = 1 - radius * radius / 2, []
    while len(members):
        near = x[members[:_BATCH]] @ x[members].T >= least
        free = np.ones(len(members), bool)
        for i in range(len(near)):
            if free[i]:
                near[i, i] = True
                own = near[i] & free
                own[:i] = False
                free &= ~own
                at = np.flatnonzero(own)
                out.append(members[np.concatenate([[i], at[at != i]])])
        members = members[free]
    return out


def cover_tree(x: np.ndarray) -> Node:
    """A cover tree of unit vectors: radii halve from level to level, a node's center is also that of its first child,
    and every vector is within a node's radius of its center. `radius` is the largest distance there is, so bounds are tight."""

    def grow(members: np.ndarray, radius: float) -> Node:
        node = Node(int(members[0]), members, _reach(x, int(members[0]), members))
        while len(members) > LEAF_SIZE and node.radius > LEAF_RADIUS:
            radius /= 2
            parts = _net(x, members, radius)
            if len(parts) > 1:
                node.children = [grow(p, radius) for p in parts]
                break
        return node

    return grow(np.arange(len(x)), 2.0)


def pairs_within(x: np.ndarray, a: Node, y: np.ndarray, b: Node, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with x[i] . y[j] >= cosine, by traversing both trees at once.

    A pair of nodes is dropped if its centers are further apart than both radii and the threshold together.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + _SLACK
    open_pairs = [(a, b)]
    while open_pairs:
        p, q = open_pairs.pop()
        ps, qs = p.children or [p], q.children or [q]
        if ps[0] is p and qs[0] is q:
            yield _compare(x, p.members, y, q.members, cosine)
            continue
        pc, qc = np.array([n.center for n in ps]), np.array([n.center for n in qs])
        pr, qr = np.array([n.radius for n in ps]), np.array([n.radius for n in qs])
        pn, qn = np.array([len(n.members) for n in ps]), np.array([len(n.members) for n in qs])
        dots = x[pc] @ y[qc].T
        i, j = np.nonzero(np.sqrt(np.maximum(0, 2 - 2 * dots)) <= pr[:, None] + qr[None, :] + reach)
        single = (pn[i] == 1) & (qn[j] == 1)
        found = single & (dots[i, j] >= cosine)
        yield pc[i[found]], qc[j[found]]
        open_pairs += [(ps[s], qs[t]) for s, t in zip(i[~single].tolist(), j[~single].tolist(), strict=True)]


def _compare(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    s, t = np.nonzero(x[i] @ y[j].T >= cosine)
    return i[s], j[t]


def spanning_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index in the component of each of n nodes under links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new[label]
        left = label[i] != label[j]
        i, j = i[left], j[left]
    return label


def _unit(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length, as rows of length 1."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _array(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name).combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


def _link(table: pa.Table, cosine: float) -> pa.Table:
    """One pair of blocks (or one block): for each vector the copies that it links to, and links that join what hangs together."""
    side, rep, copies = (table.column(k).to_numpy() for k in ("side", "rep", "copies"))
    x, n = _unit(_array(table, "vec")), table.num_rows
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    count, ends = np.zeros(n, "i8"), ([], [])
    a = cover_tree(x[first])
    if len(second):
        found = ((first[i], second[j]) for i, j in pairs_within(x[first], a, x[second], cover_tree(x[second]), cosine))
    else:
        found = ((first[i], first[j]) for i, j in pairs_within(x[first], a, x[first], a, cosine))
    for i, j in found:
        if not len(second):
            i, j = i[i < j], j[i < j]
        np.add.at(count, i, copies[j])
        np.add.at(count, j, copies[i])
        ends[0].append(i)
        ends[1].append(j)
    label = spanning_labels(n, *(np.concatenate(e) if e else np.zeros(0, "i8") for e in ends))
    own, tied = np.flatnonzero(count), np.flatnonzero(label != np.arange(n))
    return pa.table({
        "a": np.concatenate([rep[own], rep[tied]]), "n": np.concatenate([count[own], np.zeros(len(tied), "i8")]),
        "b": pa.array([None] * len(own) + rep[label[tied]].tolist(), pa.int64()),
    })


_GROUP = ["label", "dim"]


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the first of the nearest pivots, and its distance."""
    dots = x @ pivots.T
    return dots.argmax(1), np.sqrt(np.maximum(0, 2 - 2 * dots.max(1)))


def _cells(classes: DataFrame, n: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows with cell (the nearest of the label's pivots) and far (the distance; -1 and 2 for labels without pivots), and the pivots (label, dim, cell, vec)."""
    spark = classes.sparkSession
    share = min(1 / block, MOST_PIVOTS / max(n, 1))
    picked = classes.where(F.pmod(F.xxhash64("rep", F.lit("pivot")), F.lit(1 << 40)) < int(share * (1 << 40)))
    place = F.row_number().over(Window.partitionBy(*_GROUP).orderBy("rep")) - 1
    picked = materialize(picked.select(*_GROUP, place.alias("cell"), "vec"), "vector-pivots")
    held: dict[tuple, list] = {}
    for r in picked.orderBy("cell").toLocalIterator():
        held.setdefault((r["label"], r["dim"]), []).append(r["vec"])
    known = spark.sparkContext.broadcast({k: _unit(pa.array(v, pa.list_(pa.float64()))) for k, v in held.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _GROUP)
            vecs = batch.column(batch.schema.get_field_index("vec"))
            cell, far = np.full(batch.num_rows, -1, "i4"), np.full(batch.num_rows, 2.0)
            by: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(labels, dims, strict=True)):
                by.setdefault(k, []).append(i)
            for k, at in by.items():
                if k in known.value:
                    cell[at], far[at] = _nearest(_unit(vecs.take(pa.array(at))), known.value[k])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    out = classes.mapInArrow(run, f"{_schema(classes)}, cell int, far double")
    return materialize(out, "vector-cells"), picked


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{c} {kind}" for c, kind in df.dtypes)


def _split(dealt: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows with sub (from 1; 0 where the cell is small) and far, now the distance from the sub's pivot, and those pivots.

    A cell of over `block` vectors gets pivots of its own, about two for each block, from its vectors; the others meet
    them in chunks of bounded size, so a task holds a chunk and one cell's pivots.
    """
    cell = [*_GROUP, "cell"]
    large = dealt.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    large = materialize(large.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")), "vector-large")
    rows = dealt.join(large.drop("n"), cell)
    drawn = rows.where(F.pmod(F.xxhash64("rep", F.lit("sub")), F.lit(1 << 40)) < int(min(1.0, 2 / block) * (1 << 40)))
    subs = drawn.select(*cell, (F.row_number().over(Window.partitionBy(*cell).orderBy("rep"))).alias("sub"), "vec", "chunks")
    subs = materialize(subs, "vector-subs")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).drop("chunks")
    asked = subs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*cell, "chunk", "sub", "vec")

    def run(members: pa.Table, pivots: pa.Table) -> pa.Table:
        sub, far = np.zeros(members.num_rows, "i4"), members.column("far").to_numpy()
        if members.num_rows and pivots.num_rows:
            order = pivots.sort_by("sub")
            at, far = _nearest(_unit(_array(members, "vec")), _unit(_array(order, "vec")))
            sub = order.column("sub").to_numpy()[at].astype("i4")
        return members.drop_columns(["far", "chunk"]).append_column("far", pa.array(far)).append_column("sub", pa.array(sub))

    small = dealt.join(large.select(cell), cell, "left_anti").withColumn("sub", F.lit(0))
    names = [c for c in dealt.columns if c != "far"]
    kinds = dict(dealt.dtypes)
    split = rows.select(*names, "far", "chunk").groupBy(*cell, "chunk").cogroup(asked.groupBy(*cell, "chunk"))
    split = split.applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", far double, sub int")
    return materialize(small.unionByName(split), "vector-split"), subs.select(*cell, "sub", "vec")


def _unit_column(v: Column) -> Column:
    scaled = lambda x: bound(F.array_max(F.transform(x, lambda c: F.abs(c.cast("double")))), lambda m: F.transform(x, lambda c: c.cast("double") / m))
    return bound(scaled(v), lambda x: bound(norm(x), lambda n: F.transform(x, lambda c: c / n)))


def _within(p: str, q: str, r: str, s: str, cosine: float) -> Column:
    """Whether two balls with centers p and q and radii r and s may hold a link; a center that is null may be anywhere."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + _SLACK
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot(F.col(p), F.col(q))))
    return F.col(p).isNull() | F.col(q).isNull() | (apart <= F.col(r) + F.col(s) + reach)


def _pairs(members: DataFrame, pivots: DataFrame, subs: DataFrame, block: int, cosine: float) -> DataFrame:
    """Pairs of blocks (cell, sub, part) and (cell2, sub2, part2) of one label that may hold links, by the triangle inequality.

    Cells are held against each other first, then only the subs of cells that may link. Subs of over `block` vectors are
    dealt into parts.
    """
    cell = [*_GROUP, "cell"]
    subs_of = members.groupBy(*cell, "sub").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    subs_of = subs_of.join(subs, [*cell, "sub"], "left").join(pivots.withColumnRenamed("vec", "first"), cell, "left")
    u = F.when(F.col("sub") > 0, F.col("vec")).otherwise(F.col("first"))
    subs_of = subs_of.select(*cell, "sub", _unit_column(u).alias("u"), "radius", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    subs_of = materialize(subs_of, "vector-blocks")
    # A vector's distance from its cell's pivot is no more than what the cell had at first.
    cells = members.groupBy(*cell).agg(F.max("cell_far").alias("radius")).join(pivots, cell, "left").select(*cell, _unit_column(F.col("vec")).alias("u"), "radius")
    cells = materialize(cells, "vector-cell-balls")
    other = cells.select(*_GROUP, *[F.col(c).alias(f"{c}2") for c in ("cell", "u", "radius")])
    near = cells.join(other, _GROUP).where("cell <= cell2").where(_within("u", "u2", "radius", "radius2", cosine)).select(*_GROUP, "cell", "cell2")
    near = materialize(near, "vector-cell-pairs")
    second = subs_of.select(*_GROUP, *[F.col(c).alias(f"{c}2") for c in ("cell", "sub", "u", "radius", "parts")])
    pairs = near.join(subs_of, cell).join(second, [*_GROUP, "cell2"]).where("cell < cell2 or sub <= sub2").where(_within("u", "u2", "radius", "radius2", cosine))
    parts = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pairs = pairs.select(*_GROUP, "cell", "sub", "cell2", "sub2", "parts2", parts("parts").alias("part")).withColumn("part2", parts("parts2")).drop("parts2")
    return materialize(pairs.where("cell < cell2 or sub < sub2 or part <= part2"), "vector-pairs")


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, block: int = BLOCK
) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component_id, kept (id = component_id).

    Vectors link if their labels are equal and not null and their cosine in double precision is at least `cosine`. Equal
    vectors are first merged into one class with its number of copies and a number of its own. Classes go to the nearest
    of their label's pivots (a sample of at most about MOST_PIVOTS, broadcast); cells of over `block` get pivots of their
    own, which meet the cell's vectors only. Each pair of blocks that the triangle inequality allows, of cells and then
    of their parts, is traversed with two cover trees by one task. Tasks give counts and a spanning forest, never pairs.
    All links of the threshold are found; vectors of different lengths never link.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do rows with a
    null id; the same id in several rows counts as several vectors, each with the links of its own; an empty table gives
    no rows. Other columns are ignored.
    """
    v = F.col("vec")
    plain = F.size(v) > 0
    for bad in (v.isNull(), F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), ~F.exists(v, lambda c: c != 0)):
        plain &= ~F.coalesce(bad, F.lit(True))
    ids = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vec"))
    ids = ids.withColumn("ok", F.coalesce(plain & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False)))
    classes = ids.where("ok").groupBy("label", "vec").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))
    # Numbers are drawn as the classes are written, once.
    classes = materialize(classes.select("label", "vec", "low", "copies", F.size("vec").alias("dim"), F.monotonically_increasing_id().alias("rep")), "vector-classes")
    dealt, pivots = _cells(classes.drop("low"), classes.count(), block)
    members, subs = _split(dealt.withColumn("cell_far", F.col("far")), block)
    pairs = _pairs(members, pivots, subs, block, cosine)
    own = ["cell", "sub", "part"]
    key = [*_GROUP, *own, *[f"{c}2" for c in own]]
    sides = pairs.select(*key, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), *[F.col(c).alias(f"own_{c}") for c in own]),
        F.struct(F.lit(1).alias("side"), *[F.col(f"{c}2").alias(f"own_{c}") for c in own]),
    )).alias("s")).where("s.side = 0 or cell != cell2 or sub != sub2 or part != part2").select(*key, "s.*")
    sized = materialize(members.groupBy(*_GROUP, "cell", "sub").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts")), "vector-parts")
    members = members.join(sized, [*_GROUP, "cell", "sub"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    members = members.select(*_GROUP, *[F.col(c).alias(f"own_{c}") for c in own], "vec", "rep", "copies")
    work = sides.join(members, [*_GROUP, *[f"own_{c}" for c in own]]).select(*key, "side", "vec", "rep", "copies")
    found = work.groupBy(*key).applyInArrow(lambda t: _link(t, cosine), "a long, n long, b long")
    found = materialize(found, "vector-links")
    counts = materialize(found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links")), "vector-counts")
    comp = materialize(connected_components(found.where("b is not null"), "a", "b").select(F.col("node").alias("rep"), "component"), "vector-components")
    lows = materialize(comp.join(classes.select("rep", "low"), "rep").groupBy("component").agg(F.min("low").alias("component_id")), "vector-lows")
    told = classes.join(counts, "rep", "left").join(comp, "rep", "left").join(lows, "component", "left")
    told = told.select(
        "label", "vec", F.lit(True).alias("ok"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "low").alias("component_id")
    )
    out = ids.join(told, ["label", "vec", "ok"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
