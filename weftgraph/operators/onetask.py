"""Graphs of a stated size as arrays inside one task: a search then takes one job, not some for each round.

A graph beyond that size stays a table, and the loops of joins run over it.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.kernels.net import Net
from weftgraph.model import Graph
from weftgraph.storage import durable

#: Stored edge rows (one for both directions of a symmetric graph) up to which a task holds the graph: some 40 bytes a row at most.
ROWS = 32_000_000


def stored(graph: Graph, weights: bool = False) -> DataFrame | None:
    """The edge rows (src, dst[, w]) of a graph that one task may hold, once for both directions of a symmetric one; else None."""
    weights = weights and graph.weighted
    key = ("stored", weights)
    if key not in graph._memo:
        rows = graph.edges.select("src", "dst", *(["w"] if weights else []))
        kept = durable(rows.where("src < dst") if graph.symmetric else rows)
        graph._memo[key] = kept if kept.count() <= ROWS else None
    return graph._memo[key]


def _lean(x: np.ndarray) -> np.ndarray:
    if x.dtype == np.int64 and len(x) and -(1 << 31) <= x.min() and x.max() < 1 << 31:
        return x.astype(np.int32)
    return x


def _arrays(batches, width: int) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in range(width)]
    for batch in batches:
        for k, c in enumerate(batch.columns):
            parts[k].append(_lean(c.to_numpy(zero_copy_only=False)))
    return [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]


def _told(found: list[np.ndarray], schema: pa.Schema):
    columns = [pa.array(np.asarray(c, t.type.to_pandas_dtype())) for c, t in zip(found, schema)]
    for a in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([c.slice(a, 1 << 16) for c in columns], schema=schema)


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in text.split(", "))])


def run(rows: DataFrame, both: bool, schema: str, kernel: Callable[[Net], list[np.ndarray]]) -> DataFrame:
    """The columns that ``kernel`` makes of the graph of the edge rows, in one task."""
    weighted, shape = "w" in rows.columns, _schema(schema)

    def work(batches):
        arrays = _arrays(batches, 3 if weighted else 2)
        yield from _told(kernel(Net(*arrays, both=both)), shape)

    return durable(rows.repartition(1).mapInArrow(work, schema))


def run_with(rows: DataFrame, told: DataFrame, schema: str, kernel: Callable[[Net, list[np.ndarray]], list[np.ndarray]]) -> DataFrame:
    """As ``run`` over a symmetric graph; ``told`` (id, ints) gives the kernel numbers of its vertices, -1 where there are none."""
    shape, names = _schema(schema), told.columns[1:]
    none = [F.lit(None).cast("int").alias(c) for c in names]
    both = rows.select("src", "dst", *none).union(told.select(F.col("id"), F.lit(None).cast("long"), *names))

    def work(batches):
        values: list[pa.RecordBatch] = []

        def edges():
            for b in batches:
                of = b.column(1).is_null()
                values.append(b.filter(of))
                yield b.filter(pc.invert(of)).select([0, 1])

        net = Net(*_arrays(edges(), 2))
        table = pa.Table.from_batches(values)
        at = net.place(table.column(0).to_numpy())
        filled = [np.full(net.n, -1, np.int64) for _ in names]
        for k, column in enumerate(filled):
            column[at] = table.column(k + 2).to_numpy()
        yield from _told(kernel(net, filled), shape)

    return durable(both.repartition(1).mapInArrow(work, schema))


def shared(rows: DataFrame, schema: str, kernel: Callable[[Net, int, int], list[np.ndarray]], tasks: int) -> DataFrame:
    """The columns of ``kernel`` (graph, task, tasks) from each of ``tasks`` tasks, all of which hold the symmetric graph."""
    shape = _schema(schema)
    dealt = rows.select("src", "dst", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("_task")).repartitionById(tasks, F.col("_task"))

    def work(batches):
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        task = first.column(2)[0].as_py()

        def rest():
            for b in itertools.chain([first], batches):
                yield pa.RecordBatch.from_arrays(b.columns[:2], names=["src", "dst"])

        yield from _told(kernel(Net(*_arrays(rest(), 2)), task, tasks), shape)

    return durable(dealt.mapInArrow(work, schema))
