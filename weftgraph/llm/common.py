"""Helpers that the corpus operators share: durable tables and global row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.storage import discard, durable, shared_dir  # noqa: F401

#: Rows and bytes per Arrow batch, so that a batch of long texts stays small in a Python worker.
ARROW_ROWS, ARROW_BYTES = 512, 16 << 20
#: Largest document id; a null id is ordered after it.
LAST = (1 << 63) - 1


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def release() -> None:
    """Give a Python worker's freed memory back to the system, so that idle workers are small."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def trimmed(run):
    """An Arrow function that gives its worker's freed memory back when a task begins and ends: workers are kept for later stages."""

    def task(batches):
        release()
        yield from run(batches)
        release()

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def global_row_number(df: DataFrame, *keys, name: str = "g") -> DataFrame:
    """Number the rows 0, 1, ... in the order of ``keys`` without a one-task window.

    Rows are range-partitioned and sorted, written once so that a rerun task can't
    renumber them, and shifted by the row counts of earlier partitions.  Only one
    count per partition reaches the driver.
    """
    spark = df.sparkSession
    mask = (1 << 33) - 1
    ranged = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
    )
    kept = durable(ranged.withColumn("_at", F.col("_at").bitwiseAND(F.lit(mask))))
    counts = sorted(kept.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    rows, total = [], 0
    for part, n in counts:
        rows.append((part, total))
        total += n
    shifts = spark.createDataFrame(rows, "_part long, _shift long")
    # one row per partition, so the broadcast side is bounded by the partition count
    return (
        kept.join(F.broadcast(shifts), "_part")
        .withColumn(name, F.col("_at") + F.col("_shift"))
        .drop("_part", "_at", "_shift")
    )


def unit_hash(*cols) -> F.Column:
    """A reproducible number in [0, 1) from the md5 of the given columns."""
    digest = F.md5(F.concat_ws("\x1f", *cols))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
