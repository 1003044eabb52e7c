"""Message passing over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def message_pass(vertices: DataFrame, edges: DataFrame, x: str = "x", steps: int = 1, keep: float = 0.5) -> DataFrame:
    """(id, x) after steps of x <- keep * x + (1 - keep) * mean over neighbours; psi = 0 without neighbours.

    Each step groups by the receiving vertex with partial sums.  Several steps are cut by checkpoint(), so
    lineage stays short and survives lost executors.
    """
    for i in range(steps):
        sent = edges.join(vertices.select(F.col("id").alias("src"), F.col(x).alias("__m")), "src")
        got = sent.groupBy(F.col("dst").alias("id")).agg(F.avg("__m").alias("__m"))
        vertices = vertices.select("id", x).join(got, "id", "left").select("id", (keep * F.col(x) + (1 - keep) * F.coalesce("__m", F.lit(0.0))).alias(x))
        if i + 1 < steps:
            vertices = cut(vertices)
    return vertices


def dag(vertices: DataFrame, edges: DataFrame, x: str = "x", share: float = 0.5) -> DataFrame:
    """(id, value): value = x + share * sum of the values of the vertices that point to it, each computed once.

    Levels of a graph without cycles: a vertex is due when all that point to it are done; what is done is kept
    as a table and joined, not computed again.  A job a level; a cycle raises.
    """
    edges = cut(edges.select("src", "dst").distinct())
    done, left = None, cut(vertices.select("id", F.col(x).cast("double").alias("x")))
    while not left.isEmpty():
        waits = edges.join(left.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        due = left.join(waits, "id", "left_anti")
        if done is None:
            level = due.select("id", F.col("x").alias("value"))
        else:
            got = edges.join(done.select(F.col("id").alias("src"), "value"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("value").alias("__sum"))
            level = due.join(got, "id", "left").select("id", (F.col("x") + share * F.coalesce("__sum", F.lit(0.0))).alias("value"))
        level = cut(level)
        if level.isEmpty():
            raise ValueError("the graph has a cycle")
        done = level if done is None else cut(done.unionByName(level))
        left = cut(left.join(level, "id", "left_anti"))
    return done if done is not None else left.select("id", F.col("x").alias("value"))
