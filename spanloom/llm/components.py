"""Connected components of a table of links, by alternating large-star and small-star steps on DataFrames.

Links are (u, v) with u != v. Each step joins the links with the least neighbour of each node, a pre-aggregated minimum; a node with a
third of all links makes a skewed partition of 16-byte rows, which adaptive execution splits. Every round is written to the shared folder, so lineage
stays short and a lost executor costs one round at most. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import materialise


def _starred(links: DataFrame, large: bool) -> DataFrame:
    """One star step: links (u, v) with u > v, each node's neighbours moved to the least of them (and the node)."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        moved = both.join(least, both["u"] == least["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        joined = links.join(least, links["u"] == least["n"])
        moved = joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
    return moved.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each node with a link the least node that it reaches. links: (u, v), in any direction and number."""
    now = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "links")
    was = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == was or not mark[0]:
            break
        was = mark
        now = materialise(_starred(materialise(_starred(now, True), "large-star"), False), "small-star")
    # All links now lead from a node to its component's least node.
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
