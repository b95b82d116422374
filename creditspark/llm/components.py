"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is joins and aggregations with map-side combine over edges; a node with a third of
all edges is only an aggregation key and the split side of a join. Rounds are written to the
scratch folder, so neither lineage nor any driver-side state grows with the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditspark.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = both.where("v > u").join(least, "u")
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) that isn't its component's smallest one.

    Null ends and loops are ignored; repeated edges count once; no edges give no rows. The result
    is a written table ``<name>-<round>`` of ``scratch``.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = scratch.table(pairs, f"{name}-0")
    state, step = None, 0
    while True:
        found = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if found == state or found["n"] == 0:
            break
        state, step = found, step + 1
        now = scratch.table(_small_star(_large_star(now)), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
