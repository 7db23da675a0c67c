"""Connected components of an edge table by alternating large and small star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.llm.common import checkpointed


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
    return r["n"], r["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (u, v: long); component is the least node reachable.

    Minima are aggregated per node and joined back, so no node's neighbours ever meet in one
    row or task; the rounds needed grow with the logarithm of the longest path.
    """
    now = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = now.groupBy("u").agg(F.min("v").alias("m")).select("u", "m")
        least = least.unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("m")).distinct()).groupBy("u").agg(F.min("m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        linked = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v")))
        new = checkpointed(linked.where("u <> v").distinct())
        changed = _state(new)
        now = new
        if changed == state:
            break
        state = changed
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
