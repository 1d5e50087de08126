"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.runtime import materialize, row_key, text_or_empty

#: Words in a block, about: a source is cut into blocks of one size near this.
BLOCK_WORDS = 4096
#: The weights that sources get by turns, in the order of their names.
WEIGHTS = (5, 2, 1)
#: How often a source may be read.
MAX_EPOCHS = 3
#: Rows of a leaf, about, and leaves of a branch, in the two-level running sums over a source.
LEAF_ROWS, BRANCH_LEAVES = 64, 1024
#: Equal rows (of one id, or without one and of one text) that stand together in a source's stream.
SAME_ROWS = 1024
#: Slots whose ranks are counted together.
CHUNK = 1 << 16
#: Fractional part of the golden ratio: multiples of it, without their whole parts, fill [0, 1) evenly.
GOLDEN = 0.6180339887498949


def word_count(text: Column) -> Column:
    """Number of runs of characters other than 0x20 and 0x09 to 0x0D: each run and the white space behind it becomes one letter."""
    return F.length(F.ltrim(F.regexp_replace(text, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x"), F.lit(" \t\n\x0b\f\r"))).cast("long")


def _key(col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("null"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """From rows (source, size): one row per source with source_size, n_rows, weight, target and what the schedule needs.

    Targets share the words of all sources by weight and stop at MAX_EPOCHS times a source's words, the excess going to
    the others by weight. With sources in order of cap / weight, a source is capped exactly if filling all to its level
    takes no more than there is; one pass of running sums decides that for all.

    One row per source goes through one sort: sources are the components of a mixture, not rows of the corpus.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    turn = (F.row_number().over(ordered) - 1) % len(WEIGHTS)
    w = by_source.select("*", F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn + 1).cast("int")).alias("weight"), F.sum("source_size").over(everything).alias("total"))
    level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    w = w.withColumn("cap", F.col("source_size") * MAX_EPOCHS)
    w = w.withColumns({
        "cap_before": F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "weight_from": F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)),
    })
    w = w.withColumn("capped", F.col("cap_before") + F.col("cap") / F.col("weight") * F.col("weight_from") <= F.col("total"))
    w = w.withColumns({
        "left": F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0)),
        "weight_left": F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything),
    })
    w = w.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("left").cast("double") / F.col("weight_left") * F.col("weight")))
    return w.select("source", "source_size", "n_rows", "weight", "target")


def _plan_sources(targets: DataFrame, block_words: int) -> DataFrame:
    """Adds key, words to take, block size, blocks of one reading, slots needed, and the source's share [lo, hi) of the unit interval."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    s = targets.withColumns({"key": _key("source"), "take": F.floor("target").cast("long")})
    s = s.withColumn("block", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(F.lit(1), F.round(F.col("source_size") / block_words)))).cast("long"))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    s = s.withColumns({"whole": F.when(F.col("source_size") > 0, F.expr("take div source_size")).otherwise(F.lit(0)).cast("long")})
    s = s.withColumn("rest", F.col("take") - F.col("whole") * F.col("source_size"))
    s = s.withColumn("slots", (F.col("whole") * F.col("blocks") + F.ceil(F.col("rest") / F.col("block"))).cast("long"))
    share = F.try_divide(F.sum("slots").over(ordered.rowsBetween(Window.unboundedPreceding, 0)), F.sum("slots").over(Window.partitionBy()))
    s = s.withColumn("hi", F.coalesce(share, F.lit(0.0)))
    return s.withColumn("lo", F.coalesce(F.lag("hi").over(ordered), F.lit(0.0)))


def schedule(sources: DataFrame) -> DataFrame:
    """Rows (position, key, rank): which source's turn each slot is, and how many turns that source had before.

    Slot n stands at the fractional part of n golden ratios and goes to the source whose share holds that point. Points
    and shares meet in an equi-join on cells of the unit interval, over which the points spread evenly. So each stretch of
    slots holds every source in its share, up to a few slots. A source that got more slots than its target takes loses its
    last ones; one that got fewer has them added at the end (the discrepancy of the points bounds that by a few per source).
    """
    spark = sources.sparkSession
    slots, n_sources = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count(F.lit(1))).first()
    cells = max(4096, 4 * n_sources)
    points = spark.range(slots).select(F.col("id").alias("position"), ((F.col("id") + 1) * F.lit(GOLDEN) % 1.0).alias("u"))
    points = points.withColumns({"cell": F.floor(F.col("u") * cells), "chunk": F.expr(f"position div {CHUNK}")})
    shares = sources.where("slots > 0").select("key", "lo", "hi", F.col("slots").alias("needed"))
    last = Window.partitionBy()
    shares = shares.withColumn("hi", F.when(F.col("hi") == F.max("hi").over(last), F.lit(2.0)).otherwise(F.col("hi")))
    shares = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.least(F.col("hi"), F.lit(1.0)) * cells))))
    got = points.join(shares, "cell").where("lo <= u and u < hi").select("position", "key", "needed", "chunk")
    before = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = got.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("n"))
    starts = chunks.select("key", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = got.withColumn("at", F.row_number().over(Window.partitionBy("key", "chunk").orderBy("position")) - 1)
    ranked = ranked.join(starts, ["key", "chunk"]).select("position", "key", (F.col("start") + F.col("at")).alias("rank"), "needed")
    totals = chunks.groupBy("key").agg(F.sum("n").alias("had"))
    short = sources.join(totals, "key", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("slots > had")
    short = short.select("key", F.explode(F.sequence(F.col("had"), F.col("slots") - 1)).alias("rank")).select((F.lit(slots) + F.col("rank")).alias("position"), "key", "rank")
    return ranked.where("rank < needed").select("position", "key", "rank").unionByName(short)


def _streams(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows (key, id, size, off, ...): each row's place in its source's shuffled stream of words.

    The order is that of the md5 of the id, for rows without one of their text's hash. Equal rows are counted first and
    stand together by SAME_ROWS, so that any number of them spreads over the stream. Running sums go over leaves of about
    LEAF_ROWS rows, then over the leaves of a branch, then over a source's branches, so no source is sorted in one task.
    """
    about = sources.select("key", "n_rows", "source_size", "target", "block", "blocks")
    same = rows.groupBy(_key("source").alias("key"), "id", "x", "size").agg(F.count(F.lit(1)).alias("n"))
    same = same.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {SAME_ROWS}"))))
    name = F.concat(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("~"), F.col("x").cast("string"))), F.when(F.col("part") > 0, F.concat(F.lit("#"), F.col("part").cast("string"))).otherwise(""))
    d = same.select("key", "id", "x", "size", F.least(F.lit(SAME_ROWS), F.col("n") - F.col("part") * SAME_ROWS).alias("n"), F.md5(name).alias("m"))
    d = d.withColumn("words", F.col("size") * F.col("n")).join(about, "key")
    leaves = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / LEAF_ROWS)).cast("long")
    d = d.withColumn("leaf", F.shiftright(F.conv(F.substring("m", 1, 8), 16, 10).cast("long") * leaves, 32))
    prior = lambda w: F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    leaf = d.groupBy("key", "leaf").agg(F.sum("words").alias("words")).withColumn("branch", F.expr(f"leaf div {BRANCH_LEAVES}"))
    branch = leaf.groupBy("key", "branch").agg(F.sum("words").alias("words"))
    branch = branch.select("key", "branch", prior(Window.partitionBy("key").orderBy("branch")).alias("b0"))
    leaf = leaf.withColumn("l0", prior(Window.partitionBy("key", "branch").orderBy("leaf"))).join(branch, ["key", "branch"])
    leaf = leaf.select("key", "leaf", (F.col("b0") + F.col("l0")).alias("start"))
    d = d.withColumn("d0", prior(Window.partitionBy("key", "leaf").orderBy("m", "id", "size", "x"))).join(leaf, ["key", "leaf"])
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return d.withColumn("off", F.col("start") + F.col("d0") + F.col("k") * F.col("size")).drop("leaf", "start", "d0", "m", "n_rows", "n", "words", "x")


def _taken(docs: DataFrame, id_col: str, text_col: str, source_col: str, block_words: int) -> DataFrame:
    """Rows (key, id, off, size, source_size, target, taken, reads): reads are the slots (position, words) in which the document's
    readings begin, one per epoch, and the words read from then on."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.when(F.col(id_col).isNull(), F.xxhash64(text)).alias("x"))
    rows = materialize(rows, "mix-sizes")
    sources = materialize(_plan_sources(source_targets(rows), block_words), "mix-sources")
    streams = materialize(_streams(rows, sources), "mix-streams")
    spans = schedule(sources).join(sources.select("key", "block", "blocks", "source_size", "whole", "rest"), "key")
    spans = spans.withColumns({"nr": F.expr("rank % blocks"), "epoch": F.expr("rank div blocks")})
    spans = spans.select(
        "key", "nr", "epoch", "position", (F.col("nr") * F.col("block")).alias("s_lo"),
        F.least((F.col("nr") + 1) * F.col("block"), F.when(F.col("epoch") < F.col("whole"), F.col("source_size")).otherwise(F.col("rest"))).alias("s_hi"),
    )
    pieces = streams.where("size > 0").withColumn("nr", F.explode(F.sequence(F.expr("off div block"), F.expr("(off + size - 1) div block"))))
    met = pieces.join(spans, ["key", "nr"], "left")  # a block is read at most MAX_EPOCHS times
    words = F.greatest(F.lit(0), F.least(F.col("off") + F.col("size"), F.col("s_hi")) - F.greatest("off", "s_lo"))
    met = met.withColumn("words", F.when(F.col("position").isNotNull(), words).otherwise(F.lit(0)))
    reads = []
    for e in range(MAX_EPOCHS):
        own = (F.col("epoch") == e) & (F.col("words") > 0)
        reads.append(F.struct(F.min(F.when(own, F.col("position"))).alias("position"), F.coalesce(F.sum(F.when(own, F.col("words"))), F.lit(0)).alias("words")))
    taken = met.groupBy("key", "id", "off", "size", "source_size", "target").agg(F.sum("words").alias("taken"), F.array(*reads).alias("reads"))
    taken = taken.withColumn("reads", F.filter("reads", lambda r: r["words"] > 0))
    none = F.array().cast("array<struct<position: bigint, words: bigint>>")
    empty = streams.where("size = 0").select("key", "id", "off", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), none.alias("reads"))
    return taken.unionByName(empty)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words that the mix takes, repeats counted) and first_slot
    (the slot of the schedule in which it is first read, null if it is not).

    Each source's shuffled stream is cut into blocks of equal words; the source's r-th slot of the schedule reads block
    r modulo the number of blocks, and the last slot stops where the target (rounded down) is reached. So a source's
    taken words are its target without the fraction, no document is taken more than MAX_EPOCHS times, and documents in
    order of their slots give every stretch of the mix the sources' shares.

    Null and empty texts have size 0 and give nothing; a null source is a source of its own and comes last; rows with
    the same id are separate documents; an empty table gives no rows. Other columns are ignored. The result depends on
    ids, sizes and sources alone (on texts for rows without an id): reruns and other partitionings agree.
    """
    took = _taken(docs, id_col, text_col, source_col, block_words)
    first = F.array_min(F.transform("reads", lambda r: r["position"]))
    return took.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", first.alias("first_slot"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, slot_col: str | None = None) -> DataFrame:
    """The mixed corpus in the order of the schedule, with the columns of docs (and the slot, if slot_col names a column for it).

    Each document stands in the slot of each of its readings, as often as the mix takes it whole; of the one document of
    a source at which the target is reached, the last copy holds its first words (joined by single spaces). Rows come in
    ranges of slots, sorted within, so written files hold one stretch of the mix after the other.

    Ids should be unique here; rows that share an id, or have none and the same text, are all taken by the largest of
    their counts, at most MAX_EPOCHS times.
    """
    rows = docs.withColumn("__key", row_key(docs, id_col, text_col))
    took = _taken(rows, "__key", text_col, source_col, block_words).where("taken > 0")
    took = took.groupBy(F.col("id").alias("__key")).agg(F.max(F.struct("taken", "size", "reads")).alias("__most"))
    d = rows.join(took, "__key").withColumn("__read", F.explode("__most.reads"))
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    part = F.array_join(F.slice(words, 1, F.col("__read.words").cast("int")), " ")
    d = d.withColumn(text_col, F.when(F.col("__read.words") < F.col("__most.size"), part).otherwise(F.col(text_col))).withColumn("__slot", F.col("__read.position"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(n, "__slot", "__key").sortWithinPartitions("__slot", "__key")
    return d.select(*docs.columns, *([F.col("__slot").alias(slot_col)] if slot_col else []))
