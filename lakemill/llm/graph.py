"""Connected components over a distributed edge list (alternating large-star and small-star steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.store import shared_dir


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, component_id) for every node of an edge; component_id is the smallest id reachable.

    Edges hold integer ids; null ends and self-loops are ignored. Each round keeps at most one edge for each input edge and
    is written to the checkpoint folder; rounds grow with the logarithm of the longest path, and neither edges nor
    components reach the driver, only a count and a checksum.
    """
    shared_dir(edges.sparkSession)
    hi, lo = F.greatest(a, b), F.least(a, b)
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).where(F.col(a) != F.col(b)).select(hi.cast("long").alias("u"), lo.cast("long").alias("v")).distinct().checkpoint()
    state = _state(now)
    for _ in range(most):
        if not state[0]:
            break
        now = _small_star(_large_star(now)).checkpoint()
        state, before = _state(now), state
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component_id"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(roots)
