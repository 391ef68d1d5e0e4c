"""Durable intermediate tables: lineage is cut in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="weftgraph-"))
        path = _own[0]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: its lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftgraph/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._weftgraph_path = path
    return kept


def path_of(df: DataFrame) -> str:
    """The folder of a table made by ``durable``."""
    return df._weftgraph_path


def discard(df: DataFrame | None) -> None:
    """Delete the files of a table made by ``durable`` that no later plan reads."""
    if df is None:
        return
    name = getattr(df, "_weftgraph_path", None)
    if name:
        spark = df.sparkSession
        if getattr(df, "_weftgraph_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {df._weftgraph_table}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` stored bucketed by ``key`` in the shared folder: joins and aggregations on the key don't shuffle it again."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"weftgraph_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/weftgraph/{name}"
    df.repartition(buckets, key).write.option("path", path).option("compression", "zstd").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    kept = spark.table(name)
    kept._weftgraph_path, kept._weftgraph_table = path, name
    return kept


def rows_of(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` made durable, and its row count (from the written files' footers)."""
    kept = durable(df)
    return kept, kept.count()
