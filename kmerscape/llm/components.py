"""Connected components of a graph that lies in tables: alternating large-star and small-star steps.

Every step is two joins and aggregates over edges; the edges are written after each round, so lineage stays short and a
lost executor costs at most a round. The least neighbours are written before they are joined: then both sides of the join are
dealt anew, and adaptive execution can split the edges of a hub. Nothing is collected; rounds grow with the logarithm of a
component's size. A step never adds edges, so the tables of all rounds are written by as many tasks as the first one's rows
need, and not by one for each shuffle partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, written

MAX_ROUNDS = 60
#: Edges that a task writes.
EDGES = 1 << 18


def _large_star(edges: DataFrame, held: list, files: int) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m")).coalesce(files), "edges")
    held.append(least)
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, held: list, files: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    least = written(down.groupBy("a").agg(F.min("b").alias("m")).coalesce(files), "edges")
    held.append(least)
    return down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each node has one smaller neighbour at most, and then no larger one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or (down = 1 and up = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of its component, for each node of the edges (a, b)."""
    held: list[DataFrame] = [written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")), "edges")]
    files = max(edges.sparkSession.sparkContext.defaultParallelism, -(-held[0].count() // EDGES))
    now = written(_small_star(held[0], held, files).coalesce(files), "edges")
    for _ in range(MAX_ROUNDS):
        drop(*held)
        held.clear()
        if _settled(now):
            break
        larger = written(_large_star(now, held, files).coalesce(files), "edges")
        then = written(_small_star(larger, held, files).coalesce(files), "edges")
        drop(now, larger)
        now = then
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
