"""Connected components of a table of links, by alternating large and small stars.

Each step is a grouped minimum and a join. The minima are written before they are
joined: a node of many links is reduced before it is shuffled, and its rows, which
no aggregate by the same key holds together, can be split between tasks. Written
steps keep plans short and survive lost executors; they are removed once read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_since, written, written_so_far


def large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the node's least neighbour (or itself)."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them. links: a > b."""
    least = written(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).where("a <> b").distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """node, label for every node with a link: label is the least node that it reaches.

    links: columns a and b of one type. Loops, repeated and null links don't matter.
    """
    before = written_so_far()
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    said = None
    for _ in range(most):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == said:
            break
        said = state
        now = written(small_star(large_star(now)), "links")
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    drop_since(links.sparkSession, before | {now.written_path})
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
