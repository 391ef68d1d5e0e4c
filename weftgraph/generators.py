"""Deterministic graph and hypergraph generators: distributed ranges and hashed draws."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from weftgraph.functions.hashing import hash32, hash64_mod, mix32
from weftgraph.model import Graph, Hypergraph


def _unit(x: np.ndarray) -> np.ndarray:
    return mix32(x).astype(np.float64) / float((1 << 32) - 1)


def rmat(spark: SparkSession, n: int, m: int | None = None, seed: int = 1, a: float = 0.5, b: float = 0.1, c: float | None = None, symmetric: bool = False) -> Graph:
    """A recursive-matrix graph; n is rounded up to a power of two, m is 10 n by default.

    At every level, an edge's hashed draw chooses one of the quadrants with chances a, b, c
    (in single precision) and the rest.  An edge's draws start at the mix of twice its number
    times the mixed seed and go on by a stride of its own, in 32 bits.
    """
    levels = max(0, math.ceil(math.log2(max(n, 1))))
    m = 10 * n if m is None else m
    n, c = 1 << levels, b if c is None else c
    a, b, c = (float(np.float32(v)) for v in (a, b, c))
    h = mix32(seed)[0]

    @F.pandas_udf("src long, dst long")
    def place(i: pd.Series) -> pd.DataFrame:
        x = i.to_numpy().astype(np.uint32)
        at, stride = mix32(x * np.uint32(2) * h), mix32((x * np.uint32(2) + np.uint32(1)) * h)
        src, dst = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for _ in range(levels):
            draw = _unit(at)
            src = src * 2 + (draw >= a + b)
            dst = dst * 2 + (((draw >= a) & (draw < a + b)) | (draw >= a + b + c))
            at = at + stride
        return pd.DataFrame({"src": src, "dst": dst})

    edges = spark.range(m).select(place("id").alias("e")).select("e.*")
    graph = Graph(spark.range(n), edges)
    return graph.symmetrize() if symmetric else graph


def random_local(spark: SparkSession, n: int, m: int | None = None, dimension: int = 0, symmetric: bool = False) -> Graph:
    """About m random edges, the same number a vertex: uniform for dimension 0, else to neighbours whose distance falls off with the dimension.

    An edge's chain of 32-bit mixes starts at its number: a mix below one half widens the
    reach by ``dimension`` bits, the next one gives the distance; self-loops are drawn again.
    """
    degree = (10 * n if m is None else m) // max(n, 1)
    if degree == 0 or n < 2:
        return Graph(spark.range(n), spark.createDataFrame([], "src long, dst long"), symmetric)

    @F.pandas_udf(LongType())
    def target(k: pd.Series) -> pd.Series:
        x = k.to_numpy()
        own, to = x // degree, np.full(len(x), -1)
        h, reach, rest = x.astype(np.uint32), np.full(len(x), dimension + 2), np.arange(len(x))
        while len(rest):
            h[rest] = mix32(h[rest])
            if dimension == 0:
                to[rest] = h[rest] % np.uint32(n)
                rest = rest[to[rest] == own[rest]]
                continue
            wider = rest
            while len(wider := wider[h[wider] % np.uint32(1000003) < 500001]):
                reach[wider] += dimension
                h[wider] = mix32(h[wider])
            h[rest] = mix32(h[rest])
            to[rest] = (own[rest] + h[rest].astype(np.int64) % (1 << np.minimum(reach[rest], 62))) % n
            rest = rest[to[rest] == own[rest]]
        return pd.Series(to)

    edges = spark.range(n * degree).select(F.expr(f"id div {degree}").alias("src"), target("id").alias("dst"))
    graph = Graph(spark.range(n), edges)
    return graph.symmetrize() if symmetric else graph


def grid(spark: SparkSession, n: int, dimension: int = 2) -> Graph:
    """A torus of side round(n ** (1 / dimension)): each cell is joined to the next in every direction, both ways."""
    side = max(1, round(n ** (1.0 / dimension)))
    total = side**dimension
    step, jumps = 1, []
    for _ in range(dimension):
        along = F.expr(f"(id div {step}) % {side}")
        jumps.append(F.col("id") + (F.pmod(along + 1, F.lit(side)) - along) * step)
        step *= side
    edges = spark.range(total).select(F.col("id").alias("src"), F.explode(F.array(*jumps)).alias("dst"))
    return Graph(spark.range(total), edges).symmetrize()


def random_hypergraph(spark: SparkSession, nv: int = 100, nh: int | None = None, cardinality: int = 3, seed: int = 0) -> Hypergraph:
    """nh hyperedges of ``cardinality`` members each, the 64-bit mixes of their slots (plus ``seed``) modulo nv; repeats within a hyperedge dropped."""
    nh = 10 * nv if nh is None else nh
    slots = spark.range(nh * cardinality)
    member = hash64_mod(F.col("id") + F.lit(seed), max(nv, 1))
    pairs = slots.select(member.alias("v"), F.expr(f"id div {cardinality}").alias("h")).distinct()
    return Hypergraph.from_incidence(pairs, spark.range(nv), spark.range(nh))


def _weight(position, n: int):
    """floor((hash mod 2 L) / 2) + 1, with L the whole logarithm of n to base two."""
    level = max(1, int(math.log2(max(n, 2))))
    return (F.floor(F.pmod(hash32(position), F.lit(2 * level)) / 2) + 1).cast("int")


def add_weights(graph: Graph) -> Graph:
    """Hashed weights by edge position; a symmetric graph takes both directions' weight from the higher end."""
    from weftgraph.operators.sequences import running

    placed = running(graph.edges.select("src", "dst"), [F.col("src"), F.col("dst")]).select("src", "dst", _weight(F.col("n") - 1, graph.n).alias("w"))
    if graph.symmetric:
        upper = placed.where("src > dst")
        placed = upper.union(upper.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return Graph(graph.vertices, placed, graph.symmetric)


def add_hyper_weights(hg: Hypergraph) -> Hypergraph:
    """One hashed weight for the in-members and one for the out-members of each hyperedge."""
    n = max(hg.nv, hg.nh)
    into = hg.v2h.select("v", "h").withColumn("w", _weight(F.col("h"), n))
    out = hg.h2v.select("h", "v").withColumn("w", _weight(F.col("h") + F.lit(hg.nh), n))
    return Hypergraph(hg.vertices, hg.hyperedges, into, out, False)


def check_table(df: DataFrame) -> DataFrame:
    """One row: how many rows and a checksum, to compare two runs."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("checksum"))
