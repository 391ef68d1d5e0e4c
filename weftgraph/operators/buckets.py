"""Priority buckets: vertices with a numbered bucket each, taken in order.

A bucket table is ``(id, bkt)``; a null bucket holds nothing.  Taking the next bucket is a
minimum (or maximum) and a filter, so empty buckets cost nothing and a moved vertex never
leaves a stale copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def make_buckets(state: DataFrame, bucket: Column | str) -> DataFrame:
    """(id, bkt) from any state table."""
    return state.select("id", (F.expr(bucket) if isinstance(bucket, str) else bucket).cast("long").alias("bkt"))


def next_bucket(buckets: DataFrame, increasing: bool = True) -> tuple[int | None, DataFrame]:
    """The first bucket that isn't empty and its members; None when all are."""
    at = buckets.agg((F.min if increasing else F.max)("bkt")).first()[0]
    return at, buckets.where(F.col("bkt") == (at if at is not None else 0)).select("id") if at is not None else buckets.select("id").where(F.lit(False))


def next_bucket_rows(buckets: DataFrame, increasing: bool = True) -> DataFrame:
    """(id, bkt) of the first bucket that isn't empty, as one plan."""
    best = buckets.agg((F.min if increasing else F.max)("bkt").alias("bkt"))
    return buckets.join(F.broadcast(best), "bkt").select("id", "bkt")  # one row


def update_buckets(buckets: DataFrame, moves: DataFrame) -> DataFrame:
    """Move each id of ``moves`` (id, bkt) to its new bucket; null takes it out."""
    new = moves.select("id", F.col("bkt").alias("_to"), F.lit(True).alias("_moved"))
    return buckets.join(new, "id", "left").select("id", F.when(F.col("_moved"), F.col("_to")).otherwise(F.col("bkt")).alias("bkt"))


def changed_buckets(buckets: DataFrame, moves: DataFrame) -> DataFrame:
    """The moves (id, bkt) that put an id in another bucket than it is in; the others needn't be made."""
    old = buckets.select("id", F.col("bkt").alias("_was"))
    return moves.join(old, "id").where(~F.col("bkt").eqNullSafe(F.col("_was"))).select("id", "bkt")


def open_range(buckets: DataFrame, low: int, width: int = 128) -> DataFrame:
    """(id, slot): the buckets from ``low`` on as slots 0 to ``width`` - 1, and ``width`` for all that lie beyond."""
    return buckets.where(F.col("bkt") >= low).select("id", F.least(F.col("bkt") - low, F.lit(width)).alias("slot"))
