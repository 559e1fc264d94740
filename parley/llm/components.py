"""Connected components of a graph that only its edges' count bounds.

Alternating large-star and small-star steps: each round points every node to the smallest
neighbour it sees, and ends when nothing changes; the number of rounds grows with the
logarithm of a component's size. Each round is written to the shared folder, so the plan stays
short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm._shared import drop_path, new_path, write


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) -> each node's neighbours on one side linked to its smallest neighbour or itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    near = both.join(low, both["a"] == low["k"])
    if large:
        out = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("k"), F.col("m")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that an edge between two different nodes touches; root is its component's smallest node."""
    spark = edges.sparkSession
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b")).distinct()
    last, mark = "", None
    for _ in range(most_rounds):
        path = new_path(spark, "components")
        write(_star(_star(now, True), False), path)
        now = spark.read.schema("a long, b long").parquet(path)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if last:
            drop_path(spark, last)
        last = path
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b"))).distinct()
