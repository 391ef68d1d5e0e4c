"""Graphs inside one task: the same rows as by the loops of joins, in few jobs."""

import pytest
from pyspark.sql import functions as F

from weftgraph import generators as gen
from weftgraph.algorithms import components, eccentricity, hypergraphs, traversal
from weftgraph.model import Graph, Hypergraph
from weftgraph.operators import onetask


@pytest.fixture(scope="module")
def graph(spark):
    """Components of several sizes, a hub beyond ``WIDE``, a path and isolated vertices."""
    some = gen.random_local(spark, 150, 170).edges.select("src", "dst").where("src < 120 and dst < 120")
    hub = spark.range(201, 300).select(F.lit(200).cast("long").alias("src"), F.col("id").alias("dst"))
    path = spark.range(300, 306).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    pair = spark.createDataFrame([(340, 341), (60, 300)], "src long, dst long")
    rows = some.union(hub).union(path).union(pair).withColumn("w", F.pmod(F.col("src") * 7 + F.col("dst") * 3, F.lit(9)))
    return Graph.from_edges(rows, n=345).symmetrize()


def _jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().nextJobId()


RUNS = {
    "bfs": lambda g: traversal.bfs(g, 300),
    "bfs from an isolated vertex": lambda g: traversal.bfs(g, 344),
    "paths": lambda g: traversal.shortest_paths(g, 300),
    "labels": lambda g: components.propagate(g, shortcut=True),
    "delta": lambda g: traversal.delta_stepping(g, 300, 4),
    "dependency": lambda g: traversal.dependency(g, 300).withColumn("score", F.round("score", 6)),
    "radii": lambda g: traversal.radii(g),
    "exact": lambda g: eccentricity.exact(g),
    "bounded": lambda g: eccentricity.bounded(g),
    "kbfs": lambda g: eccentricity.kbfs(g, large=16),
    "masks": lambda g: eccentricity.sketch(g, 2),
    "registers": lambda g: eccentricity.registers(g),
    "two_approximation": lambda g: eccentricity.two_approximation(g),
    "near_set": lambda g: eccentricity.near_set_estimate(g),
    "lower_bounds": lambda g: eccentricity.lower_bounds(g),
}


def _fresh(g):
    return Graph(g.vertices, g.edges, g.symmetric)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_one_task_gives_the_rows_of_the_loop(spark, graph, monkeypatch, name):
    before = _jobs(spark)
    found = sorted(map(tuple, RUNS[name](_fresh(graph)).collect()))
    assert _jobs(spark) - before < 60  # it was some jobs for each round
    monkeypatch.setattr(onetask, "ROWS", -1)
    assert found == sorted(map(tuple, RUNS[name](_fresh(graph)).collect()))


def test_hypergraph_dependency_in_one_task(spark, monkeypatch):
    pairs = spark.range(160).select((F.col("id") % 41).alias("v"), F.floor(F.col("id") / 3).alias("h")).union(spark.createDataFrame([(50, 900), (51, 900)], "v long, h long")).distinct()
    make = lambda: Hypergraph.from_incidence(pairs)
    run = lambda: sorted((r.kind, r.id, r.sigma, r.score and round(r.score, 6)) for r in hypergraphs.hyper_dependency(make(), 0).collect())
    found = run()
    monkeypatch.setattr(onetask, "ROWS", -1)
    assert found == run()


def test_negative_weights_keep_to_the_loop(spark):
    rows = spark.createDataFrame([(0, 1, 1), (1, 2, -3), (2, 0, 1)], "src long, dst long, w int")
    assert all(r.negative_cycle and r.dist is None for r in traversal.shortest_paths(Graph.from_edges(rows), 0).collect())
