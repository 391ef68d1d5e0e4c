"""Connected components of an undirected edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.storage import discard, durable


def star_components(edges: DataFrame, a: str = "src", b: str = "dst", max_rounds: int = 200) -> DataFrame:
    """(id, label): the smallest id of each end's component; O(log n) rounds of joins and minima.

    Ids without an edge to another id are not listed.  Nothing but a count and a checksum
    reaches the driver.  Labels that aren't settled after ``max_rounds`` raise an error.
    """
    pairs = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct()
    current = durable(pairs)
    mark = None
    for _ in range(max_rounds):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = durable(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(current)
        current = following
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return current.select(F.col("u").alias("id"), F.col("v").alias("label")).union(current.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
