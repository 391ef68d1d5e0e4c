"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A row's place on the ring is the hash of its text, so equal texts are neighbours.  Each
shard owns the arcs that end at its virtual nodes.  Rows that overflow a full shard go on
clockwise to the next virtual node whose shard has room.  Capacities are the row count
divided by the shards, rounded down or up, so counts differ by one at most.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_row_number, prepare

SHARDS = 8
VNODES = 64


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) of each virtual node, clockwise.  A shard's places don't depend on the other shards."""
    place = lambda s, v: int(hashlib.md5(f"{s}#{v}".encode()).hexdigest()[:15], 16)
    return sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))


def flow(arcs: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Runs (first row number, rows, shard, first slot) for arcs (rows, shard) given clockwise.

    Each shard first admits the rows of its own arcs, then the rest moves clockwise.
    Works on one number per virtual node, whatever the rows.
    """
    total = sum(n for n, _ in arcs)
    demand = [0] * shards
    for n, s in arcs:
        demand[s] += n
    room = [total // shards] * shards
    for s in sorted(range(shards), key=lambda s: (-demand[s], s))[: total % shards]:
        room[s] += 1
    slots = [0] * shards
    runs, rest, start = [], [], 0
    for k, (n, s) in enumerate(arcs):
        own = min(n, room[s])
        if own:
            runs.append((start, own, s, slots[s]))
            slots[s] += own
            room[s] -= own
        if n > own:
            rest.append((k, start + own, n - own))
        start += n
    for k, at, n in rest:
        step = k
        while n:
            step += 1
            s = arcs[step % len(arcs)][1]
            take = min(n, room[s])
            if take:
                runs.append((at, take, s, slots[s]))
                slots[s] += take
                room[s] -= take
                at, n = at + take, n - take
    return sorted(runs)


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row, by the law ``rows``.

    Null texts have the ring place and checksum of the empty text and size 1; null ids
    come first among equal texts; repeated rows are rows of their own; an empty table gives
    an empty result; other columns are ignored.  Slots follow the ring within each part
    that a shard takes.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("place"),
        F.lit(None).cast("int").alias("node"),
    )
    nodes = ring(shards, vnodes)
    marks = spark.createDataFrame([(p, k) for k, (p, _) in enumerate(nodes)], "place long, node int").selectExpr("cast(null as long) doc_id", "cast(null as long) size", "cast(null as long) text_crc32", "place", "node")
    # the virtual nodes are numbered with the rows: their numbers give each arc's row count
    numbered = global_row_number(rows.unionByName(marks), F.col("place"), F.col("node").isNotNull(), F.col("node"), F.col("doc_id"), F.col("size"), F.col("text_crc32"))
    at = [r.g for r in numbered.where("node is not null").select("node", "g").orderBy("node").collect()]
    ends = [g - k for k, g in enumerate(at)]  # rows before each node
    total = numbered.where("node is null").count()
    # rows after the last node belong to the first: its arc is made of two parts
    arcs = [(e - (ends[k - 1] if k else 0), nodes[k][1]) for k, e in enumerate(ends)] + [(total - ends[-1], nodes[0][1])]
    runs = flow(arcs, shards)
    firsts, who, base = (np.array([r[k] for r in runs] or [0], np.int64) for k in (0, 2, 3))
    marks_at = np.array(at, np.int64)

    @F.pandas_udf("shard int, slot long")
    def assign(g: pd.Series) -> pd.DataFrame:
        row = g.to_numpy() - np.searchsorted(marks_at, g.to_numpy())
        run = np.searchsorted(firsts, row, "right") - 1
        return pd.DataFrame({"shard": who[run].astype("int32"), "slot": row - firsts[run] + base[run]})

    out = numbered.where("node is null").withColumn("_to", assign("g"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_to.shard").alias("shard"), F.col("_to.slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
