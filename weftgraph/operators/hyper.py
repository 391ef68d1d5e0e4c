"""Frontier operators between the two sides of a hypergraph.

``vertex_prop`` moves a vertex frontier to hyperedges along ``v2h``; ``hyperedge_prop`` moves a
hyperedge frontier to vertices along ``h2v``.  Frontiers are ``(id[, payload])`` on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.model import Hypergraph

from .edgemap import edge_map, edge_map_count, edge_map_filter, edge_map_induced, edge_map_reduce, vertex_filter, vertex_map

hyperedge_map, hyperedge_filter = vertex_map, vertex_filter


def _side(hg: Hypergraph, source: str):
    if source not in ("v", "h"):
        raise ValueError("source is 'v' or 'h'")
    return hg.v_side() if source == "v" else hg.h_side()


def vertex_prop(hg: Hypergraph, frontier: DataFrame, agg=None, **options) -> DataFrame:
    return edge_map(hg.v_side(), frontier, agg, **options)


def hyperedge_prop(hg: Hypergraph, frontier: DataFrame, agg=None, **options) -> DataFrame:
    return edge_map(hg.h_side(), frontier, agg, **options)


def prop_reduce(hg: Hypergraph, source: str, frontier: DataFrame, message: Column | str, reduce: str = "sum", apply=None) -> DataFrame:
    """(id, value) of the other side's members, messages reduced."""
    return edge_map_reduce(_side(hg, source), frontier, message, reduce, apply)


def hyperedge_prop_count(hg: Hypergraph, frontier: DataFrame, apply=None) -> DataFrame:
    """How many frontier hyperedges reach each vertex."""
    return edge_map_count(hg.h_side(), frontier, apply)


def vertex_prop_count(hg: Hypergraph, frontier: DataFrame, apply=None) -> DataFrame:
    """How many frontier vertices reach each hyperedge."""
    return edge_map_count(hg.v_side(), frontier, apply)


def induced(hg: Hypergraph, source: str, frontier: DataFrame, value=None) -> DataFrame:
    return edge_map_induced(_side(hg, source), frontier, value)


def _pack(hg: Hypergraph, source: str, frontier: DataFrame, keep: Column | str) -> tuple[DataFrame, DataFrame]:
    side = _side(hg, source)
    mark = frontier.select(F.col("id").alias("src")).distinct().withColumn("_in", F.lit(True))
    test = F.expr(keep) if isinstance(keep, str) else keep
    rows = side.edges.join(mark, "src", "left").where(F.col("_in").isNull() | F.coalesce(test, F.lit(False)))
    return rows.select(*side.edges.columns), edge_map_filter(side, frontier, keep)


def hyperedge_filter_ngh(hg: Hypergraph, frontier: DataFrame, keep: Column | str) -> tuple[Hypergraph, DataFrame]:
    """Drop out-members (``dst``) of frontier hyperedges (``src``) that fail ``keep``; the vertex side stays.  And the new degrees."""
    rows, degrees = _pack(hg, "h", frontier, keep)
    return Hypergraph(hg.vertices, hg.hyperedges, hg.v2h, rows.withColumnsRenamed({"src": "h", "dst": "v"})), degrees


def vertex_filter_ngh(hg: Hypergraph, frontier: DataFrame, keep: Column | str) -> tuple[Hypergraph, DataFrame]:
    """Drop the hyperedges (``dst``) of frontier vertices (``src``) that fail ``keep``; the hyperedge side stays.  And the new degrees."""
    rows, degrees = _pack(hg, "v", frontier, keep)
    return Hypergraph(hg.vertices, hg.hyperedges, rows.withColumnsRenamed({"src": "v", "dst": "h"}), hg.h2v), degrees
