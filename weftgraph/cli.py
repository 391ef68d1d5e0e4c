"""Command line: ``python -m weftgraph.cli ALGORITHM INPUT [options]``.

Loads a graph or hypergraph, runs the algorithm once without and ``--rounds`` times with
timing, and writes the result if ``--out`` is given.  The algorithm ``convert`` writes the
input to ``--out`` in the form ``--to``.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.algorithms import clustering, components, cores, eccentricity, hypergraphs, ranking, traversal
from weftgraph.sources import codecs, text
from weftgraph.timing import timed

GRAPH: dict[str, Callable] = {
    "bfs": lambda g, o: traversal.bfs(g, o.root),
    "shortest-paths": lambda g, o: traversal.shortest_paths(g, o.root),
    "delta-stepping": lambda g, o: traversal.delta_stepping(g, o.root, o.delta),
    "dependency": lambda g, o: traversal.dependency(g, o.root),
    "radii": lambda g, o: traversal.radii(g),
    "components": lambda g, o: components.components(g),
    "components-shortcut": lambda g, o: components.propagate(g, shortcut=True),
    "pagerank": lambda g, o: ranking.pagerank(g, o.max_iters),
    "pagerank-delta": lambda g, o: ranking.pagerank_delta(g, o.max_iters),
    "factorize": lambda g, o: ranking.factorize(g, num_iter=o.max_iters),
    "kcore": lambda g, o: cores.kcore(g),
    "kcore-peel": lambda g, o: cores.kcore_peel(g),
    "independent-set": lambda g, o: cores.maximal_independent_set(g),
    "triangles": lambda g, o: cores.triangles(g),
    "set-cover": lambda g, o: cores.set_cover(g),
    "eccentricity": lambda g, o: eccentricity.exact(g),
    "eccentricity-bounded": lambda g, o: eccentricity.bounded(g),
    "eccentricity-kbfs": lambda g, o: eccentricity.kbfs(g),
    "eccentricity-one-phase": lambda g, o: eccentricity.kbfs(g, two_phase=False),
    "eccentricity-masks": lambda g, o: eccentricity.sketch(g),
    "eccentricity-registers": lambda g, o: eccentricity.registers(g),
    "eccentricity-lower-bounds": lambda g, o: eccentricity.lower_bounds(g),
    "eccentricity-two-approximation": lambda g, o: eccentricity.two_approximation(g),
    "eccentricity-near-set": lambda g, o: eccentricity.near_set_estimate(g),
    "nibble": lambda g, o: clustering.sweep_cut(g, clustering.nibble(g, o.root)),
    "push-pagerank": lambda g, o: clustering.sweep_cut(g, clustering.push_pagerank(g, o.root, epsilon=1e-6)),
    "heat-kernel": lambda g, o: clustering.sweep_cut(g, clustering.heat_kernel(g, o.root)),
    "heat-walks": lambda g, o: clustering.sweep_cut(g, clustering.heat_walks(g, o.root)),
}
HYPER: dict[str, Callable] = {
    "hyper-bfs": lambda h, o: hypergraphs.hyper_bfs(h, o.root),
    "hyper-bpath": lambda h, o: hypergraphs.hyper_bpath(h, o.root),
    "hyper-dependency": lambda h, o: hypergraphs.hyper_dependency(h, o.root),
    "hyper-components": lambda h, o: hypergraphs.hyper_components(h),
    "hyper-shortest-paths": lambda h, o: hypergraphs.hyper_shortest_paths(h, o.root),
    "hyper-pagerank": lambda h, o: hypergraphs.hyper_pagerank(h, o.max_iters, entropy=o.entropy),
    "hyper-independent-set": lambda h, o: hypergraphs.hyper_independent_set(h),
    "hyper-kcore": lambda h, o: hypergraphs.hyper_kcore(h),
    "hyper-lists": lambda h, o: hypergraphs.incidence_lists(h),
}


#: name -> function of (spark, path, weighted, symmetric)
GRAPH_READERS: dict[str, Callable] = {
    "adjacency": lambda spark, path, w, sym: text.read_adjacency(spark, path, sym),
    "binary": lambda spark, path, w, sym: codecs.read_binary(spark, path, w, sym),
    "compressed": lambda spark, path, w, sym: codecs.read_compressed(spark, path),
    "compressed-file": lambda spark, path, w, sym: codecs.read_compressed_file(spark, path, "run", sym, weighted=w),
    "edges": lambda spark, path, w, sym: text.read_edges(spark, path, w, sym),
}
HYPER_READERS: dict[str, Callable] = {
    "hyper-adjacency": lambda spark, path, w, sym: text.read_hyper_adjacency(spark, path, sym),
    "hyper-binary": lambda spark, path, w, sym: codecs.read_hyper_binary(spark, path, w, sym),
    "hyper-compressed": lambda spark, path, w, sym: codecs.read_compressed_hyper(spark, path),
    "members": lambda spark, path, w, sym: text.read_members(spark, path, w),
    "bipartite": lambda spark, path, w, sym: text.read_bipartite(spark, path, w),
}
#: name -> function of (graph or hypergraph, path)
GRAPH_WRITERS: dict[str, Callable] = {
    "adjacency": text.write_adjacency,
    "binary": codecs.write_binary,
    "compressed": lambda g, path: codecs.write_compressed(g, path, "run"),
    "compressed-file": lambda g, path: codecs.write_compressed_file(g, path, "run"),
}
HYPER_WRITERS: dict[str, Callable] = {
    "hyper-adjacency": text.write_hyper_adjacency,
    "hyper-binary": codecs.write_hyper_binary,
    "hyper-compressed": lambda h, path: codecs.write_compressed_hyper(h, path, "run"),
    "clique": lambda h, path: text.write_adjacency(text.clique_expansion(h), path),
    "mesh": text.write_mesh,
}


def options(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="weftgraph", description=__doc__.split("\n")[0])
    parser.add_argument("algorithm", choices=sorted({**GRAPH, **HYPER, "convert": None}))
    parser.add_argument("input")
    parser.add_argument("-s", "--symmetric", action="store_true", help="the input is undirected")
    parser.add_argument("--format", default="adjacency", choices=sorted(GRAPH_READERS | HYPER_READERS))
    parser.add_argument("--to", default="adjacency", choices=sorted(GRAPH_WRITERS | HYPER_WRITERS), help="the form that convert writes")
    parser.add_argument("--weighted", action="store_true", help="for formats that don't say so themselves")
    parser.add_argument("--root", "-r", type=int, default=0)
    parser.add_argument("--delta", type=int, default=1)
    parser.add_argument("--max-iters", type=int, default=20)
    parser.add_argument("--entropy", action="store_true")
    parser.add_argument("--rounds", type=int, default=3)
    parser.add_argument("--out", help="write the result there as Parquet")
    return parser.parse_args(args)


def load(spark: SparkSession, o: argparse.Namespace):
    hyper = o.algorithm in HYPER
    # the plain name stands for the text form of either kind
    form = "hyper-adjacency" if hyper and o.format == "adjacency" else o.format
    readers = HYPER_READERS if hyper else GRAPH_READERS
    if form not in readers:
        raise ValueError(f"{o.algorithm} doesn't read the format {o.format}")
    return readers[form](spark, o.input, o.weighted, o.symmetric).pinned()


def convert(spark: SparkSession, source: str, target: str, path: str, out: str, weighted: bool = False, symmetric: bool = False) -> None:
    """Read ``path`` in one form and write it to ``out`` in another of the same kind, or a hypergraph as its clique expansion or mesh."""
    readers, writers = (HYPER_READERS, HYPER_WRITERS) if source in HYPER_READERS else (GRAPH_READERS, GRAPH_WRITERS)
    if source not in readers or target not in writers:
        raise ValueError(f"no conversion from {source} to {target}")
    writers[target](readers[source](spark, path, weighted, symmetric), out)


def run(spark: SparkSession, args: list[str] | None = None) -> DataFrame:
    """The result of the run whose output is kept; the timings are printed."""
    o = options(args)
    if o.algorithm == "convert":
        convert(spark, o.format, o.to, o.input, o.out, o.weighted, o.symmetric)
        return spark.createDataFrame([(o.out,)], "out string")
    data = load(spark, o)
    algorithm = {**GRAPH, **HYPER}[o.algorithm]
    result = algorithm(data, o)
    for seconds in timed(lambda: algorithm(data, o).write.format("noop").mode("overwrite").save(), o.rounds, warm_up=False):
        print(f"Running time: {seconds:.3f}")
    if o.out:
        result.write.parquet(o.out)
    return result


if __name__ == "__main__":
    run(SparkSession.builder.appName("weftgraph").getOrCreate())
