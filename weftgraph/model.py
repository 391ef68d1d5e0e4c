"""Graphs and hypergraphs as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.storage import bucketed, durable


@dataclass(frozen=True)
class Graph:
    """Vertices ``(id)`` and directed edges ``(src, dst[, w])``; an undirected graph holds both directions.

    Vertices are listed, never derived: an isolated vertex is a vertex.  Duplicate edges and
    self-loops stay unless the graph is symmetrised.
    """

    vertices: DataFrame
    edges: DataFrame
    symmetric: bool = False
    _memo: dict = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def from_edges(cls, edges: DataFrame, vertices: DataFrame | None = None, n: int | None = None, symmetric: bool = False) -> Graph:
        """From an edge table; without a vertex table the ids are 0 to ``n`` - 1, n being the largest id plus one by default."""
        cast = [F.col(c).cast("long").alias(c) for c in ("src", "dst")] + ([F.col("w")] if "w" in edges.columns else [])
        edges = edges.select(*cast)
        if vertices is None:
            if n is None:
                n = (edges.agg(F.max(F.greatest("src", "dst"))).first()[0] + 1) if edges.take(1) else 0
            vertices = edges.sparkSession.range(n)
        return cls(vertices.select(F.col("id").cast("long").alias("id")), edges, symmetric)

    @property
    def spark(self):
        return self.edges.sparkSession

    @property
    def weighted(self) -> bool:
        return "w" in self.edges.columns

    @cached_property
    def n(self) -> int:
        return self.vertices.count()

    @cached_property
    def m(self) -> int:
        return self.edges.count()

    def transpose(self) -> Graph:
        """The same graph with every edge turned around; a symmetric graph is its own transpose."""
        if self.symmetric:
            return self
        rest = ["w"] if self.weighted else []
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))

    def symmetrize(self) -> Graph:
        """Both directions of every edge, without self-loops and duplicates (the least weight stays)."""
        rest = ["w"] if self.weighted else []
        there = self.edges.where("src <> dst")
        both = there.unionByName(there.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))
        edges = both.groupBy("src", "dst").agg(F.min("w").alias("w")) if rest else both.distinct()
        return Graph(self.vertices, edges, True)

    def dedup(self) -> Graph:
        """One edge for each (src, dst), with the least weight; self-loops stay."""
        edges = self.edges.groupBy("src", "dst").agg(F.min("w").alias("w")) if self.weighted else self.edges.distinct()
        return Graph(self.vertices, edges, self.symmetric)

    def out_degrees(self) -> DataFrame:
        """(id, degree), zeros included."""
        found = self.edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.join(found, F.col("id") == F.col("src"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def in_degrees(self) -> DataFrame:
        return self.transpose().out_degrees()

    def pinned(self) -> Graph:
        """The graph stored for iteration: edges are bucketed by ``src``, so no later join on it moves them."""
        if "pinned" not in self._memo:
            self._memo["pinned"] = Graph(durable(self.vertices), bucketed(self.edges, "src"), self.symmetric, {})
            self._memo["pinned"]._memo["pinned"] = self._memo["pinned"]
        return self._memo["pinned"]


@dataclass(frozen=True)
class Hypergraph:
    """Vertices ``(v)``, hyperedges ``(h)`` and incidences: ``v2h (v, h[, w])`` of the in-members, ``h2v (h, v[, w])`` of the out-members.

    In a symmetric hypergraph both incidence tables hold the same pairs.
    """

    vertices: DataFrame
    hyperedges: DataFrame
    v2h: DataFrame
    h2v: DataFrame
    symmetric: bool = False
    _memo: dict = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def from_incidence(cls, incidence: DataFrame, vertices: DataFrame | None = None, hyperedges: DataFrame | None = None) -> Hypergraph:
        """A symmetric hypergraph from (v, h[, w])."""
        rest = ["w"] if "w" in incidence.columns else []
        pairs = incidence.select(F.col("v").cast("long").alias("v"), F.col("h").cast("long").alias("h"), *rest)
        vertices = pairs.select("v").distinct() if vertices is None else vertices.select(F.col(vertices.columns[0]).cast("long").alias("v"))
        hyperedges = pairs.select("h").distinct() if hyperedges is None else hyperedges.select(F.col(hyperedges.columns[0]).cast("long").alias("h"))
        return cls(vertices, hyperedges, pairs, pairs.select("h", "v", *rest), True)

    @property
    def spark(self):
        return self.v2h.sparkSession

    @property
    def weighted(self) -> bool:
        return "w" in self.v2h.columns

    @cached_property
    def nv(self) -> int:
        return self.vertices.count()

    @cached_property
    def nh(self) -> int:
        return self.hyperedges.count()

    @cached_property
    def mv(self) -> int:
        return self.v2h.count()

    @cached_property
    def mh(self) -> int:
        return self.h2v.count()

    def transpose(self) -> Hypergraph:
        """In-members become out-members and the reverse."""
        rest = ["w"] if self.weighted else []
        return Hypergraph(self.vertices, self.hyperedges, self.h2v.select("v", "h", *rest), self.v2h.select("h", "v", *rest), self.symmetric)

    def pinned(self) -> Hypergraph:
        if "pinned" not in self._memo:
            self._memo["pinned"] = Hypergraph(durable(self.vertices), durable(self.hyperedges), bucketed(self.v2h, "v"), bucketed(self.h2v, "h"), self.symmetric, {})
            self._memo["pinned"]._memo["pinned"] = self._memo["pinned"]
        return self._memo["pinned"]

    def v_side(self) -> Graph:
        """The V-to-H incidences as a bipartite graph from vertices to hyperedges (ids of different spaces)."""
        return Graph(self.vertices.select(F.col("v").alias("id")), self.v2h.withColumnsRenamed({"v": "src", "h": "dst"}))

    def h_side(self) -> Graph:
        return Graph(self.hyperedges.select(F.col("h").alias("id")), self.h2v.withColumnsRenamed({"h": "src", "v": "dst"}))
