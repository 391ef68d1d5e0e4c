"""Frontier operators: a frontier is a DataFrame ``(id[, payload])``.

``edge_map`` joins a frontier to its out-edges, reduces the messages of each destination
and keeps the destinations that pass a condition on their state.  Conditions on the
destination are tested once per destination, after the partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.model import Graph

#: Rows up to which a frontier may be sent to every executor.
SMALL_FRONTIER = 100_000
STRATEGIES = ("auto", "dense", "dense_forward", "sparse", "sparse_no_filter")


def _expr(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def vertex_subset(graph: Graph, ids: list[int] | None = None, where: Column | str | None = None) -> DataFrame:
    """A frontier of listed ids, or of the vertices that pass a condition, or of all."""
    if ids is not None:
        return graph.spark.createDataFrame([(int(i),) for i in ids], "id long")
    return graph.vertices if where is None else graph.vertices.where(_expr(where))


def size(subset: DataFrame) -> int:
    return subset.count()


def is_empty(subset: DataFrame) -> bool:
    return subset.isEmpty()


def is_in(subset: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, member) for each of ``ids``."""
    mark = subset.select("id").distinct().withColumn("_in", F.lit(True))
    return ids.join(mark, "id", "left").select("id", F.coalesce("_in", F.lit(False)).alias("member"))


def to_dense(graph: Graph, subset: DataFrame) -> DataFrame:
    """(id, member) for every vertex."""
    return is_in(subset, graph.vertices)


def to_sparse(dense: DataFrame) -> DataFrame:
    return dense.where("member").select("id")


def _spread(graph: Graph, frontier: DataFrame, strategy: str) -> DataFrame:
    """Frontier rows joined to their out-edges: src, dst[, w] and the payload as ``s_*``."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    left = frontier.withColumnsRenamed({c: f"s_{c}" for c in frontier.columns if c != "id"}).withColumnRenamed("id", "src")
    if strategy.startswith("sparse") and left.limit(SMALL_FRONTIER + 1).count() <= SMALL_FRONTIER:
        left = F.broadcast(left)  # counted: small
    elif strategy.startswith("dense"):
        left = left.hint("shuffle_hash")
    return graph.edges.join(left, "src")


def edge_map(
    graph: Graph,
    frontier: DataFrame,
    agg: dict[str, Column | str] | None = None,
    state: DataFrame | None = None,
    cond: Column | str | None = None,
    where: Column | str | None = None,
    changed: Column | str | None = None,
    strategy: str = "auto",
    no_output: bool = False,
) -> DataFrame:
    """Destinations of the frontier's out-edges, one row each, with the reduced messages.

    ``agg`` names aggregates over src, dst, w and the frontier's payload (``s_*``).  ``where``
    filters edges.  ``state`` (id, ...) is joined as ``d_*``; ``cond`` and ``changed`` test it and
    the aggregates, absent state being null.  ``no_output`` gives an empty frontier of the same columns.
    """
    rows = _spread(graph, frontier, strategy)
    if where is not None:
        rows = rows.where(_expr(where))
    keyed = rows.groupBy(F.col("dst").alias("id"))
    out = keyed.agg(*[_expr(v).alias(k) for k, v in agg.items()]) if agg else rows.select(F.col("dst").alias("id")).distinct()
    names = out.columns
    if state is not None:
        out = out.join(state.withColumnsRenamed({c: f"d_{c}" for c in state.columns if c != "id"}), "id", "left")
    for test in (cond, changed):
        if test is not None:
            out = out.where(_expr(test))
    out = out.select(*names, *[c for c in out.columns if c.startswith("d_")]) if changed is not None else out.select(*names)
    return out.where(F.lit(False)) if no_output else out


def edge_map_reduce(graph: Graph, frontier: DataFrame, message: Column | str, reduce: str = "sum", apply: Column | str | None = None) -> DataFrame:
    """(id, value): the messages of each destination reduced by a named aggregate; ``apply`` maps ``value`` and drops nulls."""
    out = edge_map(graph, frontier, {"value": getattr(F, reduce)(_expr(message))})
    return out if apply is None else out.select("id", _expr(apply).alias("value")).where("value is not null")


def edge_map_count(graph: Graph, frontier: DataFrame, apply: Column | str | None = None) -> DataFrame:
    """(id, value): how many frontier in-neighbours each destination has."""
    return edge_map_reduce(graph, frontier, F.lit(1), "count", apply)


def edge_map_induced(graph: Graph, frontier: DataFrame, value: Column | str | None = None) -> DataFrame:
    """(id, value) for every edge that leaves the frontier, repeated destinations included."""
    rows = _spread(graph, frontier, "auto")
    return rows.select(F.col("dst").alias("id"), (_expr(value) if value is not None else F.col("src")).alias("value"))


def edge_map_filter(graph: Graph, frontier: DataFrame, keep: Column | str) -> DataFrame:
    """(id, degree): how many out-edges of each frontier vertex pass ``keep`` (zeros included)."""
    good = graph.edges.where(_expr(keep)).groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    return frontier.select("id").join(good, F.col("id") == F.col("src"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def pack_edges(graph: Graph, frontier: DataFrame, keep: Column | str) -> tuple[Graph, DataFrame]:
    """The graph without the frontier's out-edges that fail ``keep``, and the new degrees (id, degree) of the frontier."""
    mark = frontier.select(F.col("id").alias("src")).distinct().withColumn("_in", F.lit(True))
    rows = graph.edges.join(mark, "src", "left").where(F.col("_in").isNull() | F.coalesce(_expr(keep), F.lit(False))).drop("_in")
    return Graph(graph.vertices, rows.select(*graph.edges.columns), False), edge_map_filter(graph, frontier, keep)


def vertex_map(state: DataFrame, subset: DataFrame | None = None, **columns: Column | str) -> DataFrame:
    """The state with columns set for the members of ``subset`` (all, if none is given)."""
    if subset is None:
        return state.withColumns({k: _expr(v) for k, v in columns.items()})
    marked = state.join(subset.select("id").distinct().withColumn("_in", F.lit(True)), "id", "left")
    known = set(state.columns)
    new = {k: F.when(F.col("_in"), _expr(v)).otherwise(F.col(k) if k in known else F.lit(None)) for k, v in columns.items()}
    return marked.withColumns(new).drop("_in")


def vertex_filter(subset: DataFrame, keep: Column | str, state: DataFrame | None = None) -> DataFrame:
    """The members that pass a condition on their payload and, if given, on their state."""
    rows = subset if state is None else subset.join(state, "id", "left")
    return rows.where(_expr(keep)).select(*subset.columns)


def remove_duplicates(frontier: DataFrame) -> DataFrame:
    """One row for each id, the least payload."""
    rest = [c for c in frontier.columns if c != "id"]
    if not rest:
        return frontier.distinct()
    return frontier.groupBy("id").agg(F.min(F.struct(*rest)).alias("_p")).select("id", *[F.col(f"_p.{c}") for c in rest])


def neighbours(graph: Graph, frontier: DataFrame | None = None, incoming: bool = False) -> DataFrame:
    """(id, neighbours): ascending neighbour lists with repeats, empty for isolated vertices."""
    g = graph.transpose() if incoming else graph
    lists = g.edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))
    chosen = graph.vertices if frontier is None else frontier.select("id")
    return chosen.join(lists, F.col("id") == F.col("src"), "left").select("id", F.coalesce("neighbours", F.array().cast("array<long>")).alias("neighbours"))
