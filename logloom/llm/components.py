"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import common


def _mins(pairs: DataFrame) -> DataFrame:
    """u, v -> u, v, m: the least of u and its neighbours. Summed before the shuffle; a hub's rows may be split in the join."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("w")).drop("w")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b: long) -> (node, root): root is the least node of the component. Only nodes with edges come out.

    Each round's edges are written to the shared folder; the loop ends when a round changes nothing.
    """
    now = common.materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _mins(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _mins(large)
        new = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = common.materialise(new, "edges")
        at = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max(F.col("u") <= F.col("v"))).first()
        common.release(now)
        now = new
        if at == seen:
            break
        seen = at
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
