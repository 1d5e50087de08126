"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.runtime import materialize


def _to_smallest(both: DataFrame, low: DataFrame) -> DataFrame:
    """Links from each node's larger neighbours to the smallest one; two tables meet, so a hub's rows can be split."""
    return both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node of a link that joins two different nodes; component is the smallest node reachable.

    Each round moves every node's links to its smallest neighbour (first for larger, then for smaller neighbours),
    until each component is a star around its smallest node; rounds grow with the logarithm of the longest chain.
    Links are never gathered: a round is two aggregations with partial results, which are written, and two joins of
    plain tables, so that Spark can split the links of a hub that many nodes share.
    Null nodes are ignored; no links give no rows.
    """
    links = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    links = materialize(links, "links")
    before = None
    while True:
        sign = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before or sign[0] == 0:
            break
        before = sign
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "large-low")
        large = materialize(_to_smallest(both, low).distinct(), "large-star")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "small-low")
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        links = materialize(small, "small-star")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
