"""Sequence primitives over DataFrames: reductions, prefix sums, packing, histograms, sorting and keyed sums.

A sequence is a DataFrame with an order; nothing here needs one task for all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.storage import durable


def running(df: DataFrame, order: list, sums: list[str] = (), number: str = "n") -> DataFrame:
    """Row numbers from 1 in ``order`` and inclusive running sums ``<c>_sum`` (nulls count as 0).

    Two levels: rows are numbered and summed within sorted ranges as they are written, then
    shifted by the totals of the ranges before.  The rows move once.
    """
    spark = df.sparkSession
    sums = list(sums)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    types = ["double" if kinds[c] in ("double", "float") else "long" for c in sums]
    # the place in a range: the lower bits of the number that Spark gives to the rows of a partition
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    if sums:
        summed = [F.coalesce(F.col(c).cast(t), F.lit(0).cast(t)).alias(f"{c}_sum") for c, t in zip(sums, types)]
        placed = placed.select("*", *summed)
        names = placed.columns

        def add(batches):
            before = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                columns = list(batch.columns)
                totals = []
                for k, c in enumerate(sums):
                    at = names.index(f"{c}_sum")
                    run = np.cumsum(columns[at].to_numpy()) + (before[k] if before else 0)
                    columns[at] = pa.array(run, columns[at].type)
                    totals.append(run[-1])
                before = totals
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        placed = placed.mapInArrow(add, placed.schema)
    kept = durable(placed).withColumn("_p", F.shiftright("_at", 33))
    # running sums end with the row that comes last in a range
    per = sorted(kept.groupBy("_p").agg(F.count(F.lit(1)), *[F.max_by(f"{c}_sum", "_at") for c in sums]).collect(), key=lambda r: r[0])
    before, totals = [], [0] * (1 + len(sums))
    for row in per:
        before.append((row[0], *(float(v) if t == "double" else v for v, t in zip(totals, ["long", *types]))))
        totals = [a + (b or 0) for a, b in zip(totals, row[1:])]
    names = ["_n0", *[f"_b_{c}" for c in sums]]
    shifts = spark.createDataFrame(before, "_p long, " + ", ".join(f"{n} {t}" for n, t in zip(names, ["long", *types])))  # one row per partition
    out = kept.join(F.broadcast(shifts), "_p").withColumn(number, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + F.col("_n0"))
    for c in sums:
        out = out.withColumn(f"{c}_sum", F.col(f"{c}_sum") + F.col(f"_b_{c}"))
    return out.drop("_at", "_p", *names)


def reduce(df: DataFrame, column: str, how: str = "sum") -> DataFrame:
    """One row (value): the column reduced by a named aggregate."""
    return df.agg(getattr(F, how)(column).alias("value"))


def map_reduce(df: DataFrame, mapped: Column | str, how: str = "sum") -> DataFrame:
    return df.agg(getattr(F, how)(F.expr(mapped) if isinstance(mapped, str) else mapped).alias("value"))


def scan(df: DataFrame, index: str, column: str, inclusive: bool = False, backward: bool = False) -> DataFrame:
    """(index, value): prefix sums in the order of ``index``, exclusive by default, from the end if ``backward``."""
    order = [F.desc(index) if backward else F.col(index)]
    out = running(df.select(index, column), order, [column])
    return out.select(index, (F.col(f"{column}_sum") if inclusive else F.col(f"{column}_sum") - F.col(column)).alias("value"))


def pack(df: DataFrame, flag: Column | str) -> DataFrame:
    return df.where(flag)


def pack_index(df: DataFrame, index: str, flag: Column | str) -> DataFrame:
    """(position, index) of the flagged rows, positions from 0."""
    out = running(df.where(flag).select(index), [F.col(index)])
    return out.select((F.col("n") - 1).alias("position"), index)


def histogram(df: DataFrame, key: Column | str, how: str = "count", value: Column | str | None = None) -> DataFrame:
    """(key, value): rows per key, or a named aggregate of a value per key."""
    key = F.expr(key) if isinstance(key, str) else key
    value = F.lit(1) if value is None else F.expr(value) if isinstance(value, str) else value
    return df.groupBy(key.alias("key")).agg(getattr(F, how)(value).alias("value"))


def integer_sort(df: DataFrame, key: str, *ties: str) -> DataFrame:
    """(position, columns): rows placed by key, ties by the given columns."""
    out = running(df, [F.col(key), *map(F.col, ties)])
    return out.withColumn("position", F.col("n") - 1).drop("n")


def bucket_offsets(df: DataFrame, key: str) -> DataFrame:
    """(key, offset): where each key starts in the sorted order."""
    counts = df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("c"))
    return running(counts, [F.col("key")], ["c"]).select("key", (F.col("c_sum") - F.col("c")).alias("offset"))


def lower_bound(keys: DataFrame, key: str, probes: DataFrame, probe: str) -> DataFrame:
    """(probe, position): how many keys are below each probe; one sort of both sides."""
    both = keys.select(F.col(key).alias("x"), F.lit(1).alias("side"), F.lit(1).alias("c")).union(probes.select(F.col(probe), F.lit(0), F.lit(0)))
    out = running(both, [F.col("x"), F.col("side")], ["c"])
    return out.where("side = 0").select(F.col("x").alias("probe"), F.col("c_sum").alias("position")).distinct()


class AdditiveSet:
    """An immutable id-to-number map in which inserts of a known id add; a missing id reads as ``zero``."""

    def __init__(self, rows: DataFrame, zero=0):
        self.rows, self.zero = rows.groupBy("id").agg(F.sum("value").alias("value")), zero

    def insert(self, rows: DataFrame) -> AdditiveSet:
        return AdditiveSet(self.rows.select("id", "value").unionByName(rows.select("id", "value")), self.zero)

    def find(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.rows, "id", "left").select("id", F.coalesce("value", F.lit(self.zero)).alias("value"))

    def map(self, value: Column | str) -> AdditiveSet:
        return AdditiveSet(self.rows.select("id", (F.expr(value) if isinstance(value, str) else value).alias("value")), self.zero)

    def entries(self, keep: Column | str | None = None) -> DataFrame:
        return self.rows if keep is None else self.rows.where(keep)

    def count(self) -> int:
        return self.rows.count()


def append(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts (columns by name)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
