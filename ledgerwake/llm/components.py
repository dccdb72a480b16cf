"""Connected components by alternating large-star and small-star steps, all in DataFrames.

A step links the neighbours of a node to the least of them; the number of links never grows, and after
a number of steps that is logarithmic in the longest path every node is linked to the least node of its
component. Each step is written to the shared folder, which cuts the lineage; links never go to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: u, v with u > v. Small: all of a node's smaller neighbours, and itself, to the least of them. Large: a node's
    larger neighbours to the least of all its neighbours and itself."""
    if large:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first: a join of two fresh shuffles is one whose large partitions, those of hubs, Spark can split
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(least, "u")
        out = moved.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return out.where("u != v").distinct()


def _state(links: DataFrame) -> tuple:
    """What tells a set of links from another: their number, and the sum and the exclusive or of 64-bit hashes of them."""
    h = F.xxhash64("u", "v")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(20,0)")), F.bit_xor(h)).first())


def components(pairs: DataFrame, most_steps: int = 100) -> DataFrame:
    """node, component (the least node) of all nodes of ``pairs`` (a, b)."""
    a, b = pairs.columns
    links = pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = written(links, "links")
    state = _state(links)
    for _ in range(most_steps):
        if not state[0]:
            break
        links = written(_star(_star(links, True), False), "links")
        new = _state(links)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components: no end after {most_steps} steps")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
