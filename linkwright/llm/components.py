"""Connected components by alternating large and small stars, on Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.shared import drop_written, written


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One step. Minima are pre-aggregated, so a node with many neighbours isn't gathered anywhere."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if small:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a != b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, root): every node that has a link, with the smallest node of its component."""
    edges = written(edges.where("a != b").distinct(), "links")
    state = None
    for _ in range(most_rounds):
        new = written(_stars(_stars(edges, small=False), small=True), "links")
        drop_written(edges)
        edges = new
        # a sum of digests that no longer changes is a table that no longer changes
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = found
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
