"""Connected components of a graph given as a table of edges, by alternating star steps.

Each step connects neighbours to the smallest one they know; it is an aggregation and a join on narrow rows. A hub's
neighbours are never gathered in one task. Every round is a written table, so a lost executor costs no earlier round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge; root is the smallest node of its component. `edges` has two columns of one
    ordered type; directions, repetitions and loops do not matter. Nulls are no nodes."""
    a, b = edges.columns
    pairs = edges.toDF("u", "v").where("u IS NOT NULL AND v IS NOT NULL")
    loops = pairs.where("u = v").select("u").distinct()
    now = staged(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = staged(_small_star(_large_star(now)), "edges")
    roots = now.select(F.col("v").alias("node")).union(loops.toDF("node")).distinct().join(
        now.select(F.col("u").alias("node")).distinct(), "node", "left_anti")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        roots.select("node", F.col("node").alias("root")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Connects every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connects a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
    return moved.union(low.select("u", F.col("low").alias("v"))).distinct()
