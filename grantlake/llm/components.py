"""Connected components of a table of links, without a driver-side graph and without a task that holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, root) for every node of links (u, v) other than the roots; root is the least node reachable.

    Each round, a node keeps its least smaller neighbour as its parent and links the parent to its other
    smaller neighbours; every link then moves on to its target's parent (pointer jumping). Parents are
    minima, added up before the shuffle; a node with very many neighbours on either side is otherwise only looked up, in a
    join whose large partitions can be split. Each round is a written table, so lost executors cost a round at most.
    """
    at = scratch.save(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    n = 0
    while True:
        parents = scratch.save(at.groupBy("u").agg(F.min("v").alias("p")), f"{name}-p{n}")
        rest = at.join(parents, "u").where(F.col("v") != F.col("p")).select(F.col("v").alias("u"), F.col("p").alias("v"), F.lit(True).alias("new"))
        moved = parents.select("u", F.col("p").alias("v"), F.lit(False).alias("new")).unionByName(rest)
        step = moved.join(parents.select(F.col("u").alias("v"), F.col("p").alias("pp")), "v", "left")
        step = step.groupBy("u", F.coalesce("pp", "v").alias("to")).agg(F.max(F.col("new") | F.col("pp").isNotNull()).alias("changed"))
        done = scratch.save(step.withColumnRenamed("to", "v"), f"{name}-{n + 1}")
        scratch.drop(f"{name}-{n}", f"{name}-p{n}")
        at, n = done.select("u", "v"), n + 1
        if not done.where("changed").limit(1).count():
            return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
