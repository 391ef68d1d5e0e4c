"""Text formats: adjacency graphs and hypergraphs, edge lists, member lists and mesh files.

Files are read as lines; positions come from a distributed numbering of lines, so a file of
any size is read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.model import Graph, Hypergraph
from weftgraph.operators.sequences import running
from weftgraph.storage import durable

_BLANK = "[ \\t\\r\\n\\x00]+"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the file's lines numbered from 1 in file order."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    return running(raw, [F.col("_f"), F.col("_b"), F.col("_m")]).select("n", "value")


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """(k, token): the white-space separated words of a file numbered from 0."""
    rows = lines(spark, path).select("n", F.filter(F.split("value", _BLANK), lambda t: t != "").alias("t"))
    rows = running(rows.withColumn("c", F.size("t")), [F.col("n")], ["c"], "_r")
    return rows.select((F.col("c_sum") - F.col("c")).alias("_s"), F.posexplode("t").alias("_k", "token")).select((F.col("_s") + F.col("_k")).alias("k"), "token")


def _header(found: DataFrame, names: tuple[str, ...], numbers: int) -> tuple[str, list[int]]:
    head = sorted(found.where(F.col("k") <= numbers).collect())
    if len(head) <= numbers or head[0][1] not in names:
        raise ValueError(f"not one of {names}: {head[0][1] if head else 'an empty file'}")
    return head[0][1], [int(t) for _, t in head[1:]]


def _rows(found: DataFrame, at: int, offsets: int, targets: int, weighted: bool, names: tuple[str, str]) -> DataFrame:
    """(owner, member[, w]) of one offsets-targets[-weights] block that begins at token ``at``."""
    value = F.col("token").cast("long")
    block = lambda first, size, name: found.where((F.col("k") >= first) & (F.col("k") < first + size)).select((F.col("k") - first).alias("i"), value.alias(name))
    starts = block(at, offsets, "a")
    ends = starts.select((F.col("i") - 1).alias("i"), F.col("a").alias("z"))
    spans = starts.join(ends, "i", "left").select("i", "a", F.coalesce("z", F.lit(targets)).alias("z")).where("z > a")
    owners = spans.select(F.col("i").alias(names[0]), F.explode(F.sequence("a", F.col("z") - 1)).alias("i"))
    out = owners.join(block(at + offsets, targets, names[1]), "i")
    if weighted:
        out = out.join(block(at + offsets + targets, targets, "w"), "i").withColumn("w", F.col("w").cast("int"))
    return out.drop("i")


def read_adjacency(spark: SparkSession, path: str, symmetric: bool = False) -> Graph:
    """A graph file: header, n, m, n offsets, m targets and, if weighted, m weights."""
    found = durable(tokens(spark, path))
    kind, (n, m) = _header(found, ("AdjacencyGraph", "WeightedAdjacencyGraph"), 2)
    weighted = kind.startswith("Weighted")
    size = found.count()
    if size != 3 + n + m * (1 + weighted):
        raise ValueError(f"bad length: {size} words for n={n}, m={m}")
    return Graph(spark.range(n), _rows(found, 3, n, m, weighted, ("src", "dst")), symmetric)


def read_hyper_adjacency(spark: SparkSession, path: str, symmetric: bool = False) -> Hypergraph:
    """A hypergraph file: header, nv, mv, nh, mh, then the vertex block and the hyperedge block."""
    found = durable(tokens(spark, path))
    kind, (nv, mv, nh, mh) = _header(found, ("AdjacencyHypergraph", "WeightedAdjacencyHypergraph"), 4)
    weighted = kind.startswith("Weighted")
    size = found.count()
    if size != 5 + nv + nh + (mv + mh) * (1 + weighted):
        raise ValueError(f"bad length: {size} words")
    v2h = _rows(found, 5, nv, mv, weighted, ("v", "h"))
    h2v = _rows(found, 5 + nv + mv * (1 + weighted), nh, mh, weighted, ("h", "v"))
    if not v2h.where(F.col("h") >= nh).isEmpty() or not h2v.where(F.col("v") >= nv).isEmpty():
        raise ValueError("an id is out of range")
    return Hypergraph(spark.range(nv).select(F.col("id").alias("v")), spark.range(nh).select(F.col("id").alias("h")), v2h, h2v, symmetric)


def _block(ids: DataFrame, rows: DataFrame, owner: str, member: str, base: int, weighted: bool, n: int, m: int) -> DataFrame:
    """(k, value) of an offsets-targets[-weights] block, k from ``base``."""
    degrees = ids.join(rows.groupBy(owner).agg(F.count(F.lit(1)).alias("d")), owner, "left").select(owner, F.coalesce("d", F.lit(0)).alias("d"))
    offsets = running(degrees, [F.col(owner)], ["d"]).select((F.col("n") - 1 + base).alias("k"), (F.col("d_sum") - F.col("d")).alias("value"))
    ordered = running(rows, [F.col(owner), F.col(member)])
    out = offsets.union(ordered.select(F.col("n") - 1 + base + n, F.col(member)))
    return out.union(ordered.select(F.col("n") - 1 + base + n + m, F.col("w").cast("long"))) if weighted else out


def _write(spark: SparkSession, head: list, body: DataFrame, path: str) -> None:
    first = spark.createDataFrame([(k, str(v)) for k, v in enumerate(head)], "k long, value string")
    first.union(body.select("k", F.col("value").cast("string"))).orderBy("k").select("value").write.text(path)


def write_adjacency(graph: Graph, path: str) -> None:
    """The graph in adjacency form; the part files in name order are the file.  Ids are 0 to n - 1."""
    n, m = graph.n, graph.m
    ids = graph.vertices.select(F.col("id").alias("src"))
    _write(graph.spark, [("Weighted" if graph.weighted else "") + "AdjacencyGraph", n, m], _block(ids, graph.edges, "src", "dst", 3, graph.weighted, n, m), path)


def write_hyper_adjacency(hg: Hypergraph, path: str) -> None:
    nv, mv, nh, mh, w = hg.nv, hg.mv, hg.nh, hg.mh, hg.weighted
    body = _block(hg.vertices, hg.v2h, "v", "h", 5, w, nv, mv).union(_block(hg.hyperedges, hg.h2v, "h", "v", 5 + nv + mv * (1 + w), w, nh, mh))
    _write(hg.spark, [("Weighted" if w else "") + "AdjacencyHypergraph", nv, mv, nh, mh], body, path)


def write_array(values: DataFrame, path: str, order: str = "id", column: str = "value") -> None:
    """One value a line in the given order."""
    values.orderBy(order).select(F.col(column).cast("string").alias("value")).write.text(path)


def _columns(spark: SparkSession, path: str, comment: str) -> DataFrame:
    text = spark.read.text(path).where(~F.ltrim("value").startswith(comment) & (F.trim("value") != ""))
    return text.select(F.split(F.trim("value"), "\\s+").alias("t"))


def read_edges(spark: SparkSession, path: str, weighted: bool = False, symmetric: bool = False) -> Graph:
    """``src dst [w]`` lines, ``#`` comments anywhere; n is the largest id plus one."""
    t = _columns(spark, path, "#")
    cols = [F.col("t")[0].cast("long").alias("src"), F.col("t")[1].cast("long").alias("dst")] + ([F.col("t")[2].cast("int").alias("w")] if weighted else [])
    graph = Graph.from_edges(t.select(*cols))
    return graph.symmetrize() if symmetric else graph


def _compact(pairs: DataFrame, column: str) -> DataFrame:
    """Sparse ids replaced by their rank in ascending order."""
    ranks = running(pairs.select(F.col(column).alias("_o")).distinct(), [F.col("_o")]).select("_o", (F.col("n") - 1).alias("_r"))
    return pairs.join(ranks, F.col(column) == F.col("_o")).withColumn(column, F.col("_r")).drop("_o", "_r")


def read_members(spark: SparkSession, path: str, weighted: bool = False) -> Hypergraph:
    """One hyperedge a line (its member ids); if weighted, a line with its weight follows.  Vertex ids are compacted."""
    rows = lines(spark, path).where(F.trim("value") != "")
    rows = running(rows.select("value", F.col("n").alias("_l")), [F.col("_l")]).select((F.col("n") - 1).alias("i"), "value")
    if weighted:
        weights = rows.where("i % 2 = 1").select(F.expr("i div 2").alias("h"), F.trim("value").cast("int").alias("w"))
        rows = rows.where("i % 2 = 0").select(F.expr("i div 2").alias("h"), "value").join(weights, "h")
    else:
        rows = rows.select(F.col("i").alias("h"), "value")
    rest = ["w"] if weighted else []
    pairs = rows.select("h", *rest, F.explode(F.split(F.trim("value"), "\\s+")).alias("v")).withColumn("v", F.col("v").cast("long"))
    return Hypergraph.from_incidence(durable(_compact(pairs, "v")))


def read_bipartite(spark: SparkSession, path: str, weighted: bool = False) -> Hypergraph:
    """``v h`` lines with ``%`` comments; weighted files have four columns, the third being the weight.  Ids are compacted."""
    t = _columns(spark, path, "%")
    cols = [F.col("t")[0].cast("long").alias("v"), F.col("t")[1].cast("long").alias("h")] + ([F.col("t")[2].cast("int").alias("w")] if weighted else [])
    return Hypergraph.from_incidence(durable(_compact(_compact(t.select(*cols), "v"), "h")))


def clique_expansion(hg: Hypergraph) -> Graph:
    """Every ordered pair of different members of a hyperedge, as often as they share one; weights are those of the hyperedge."""
    rest = [F.col("w")] if hg.weighted else []
    a = hg.h2v.select("h", F.col("v").alias("src"), *rest)
    pairs = a.join(hg.h2v.select("h", F.col("v").alias("dst")), "h").where("src <> dst")
    return Graph(hg.vertices.select(F.col("v").alias("id")), pairs.drop("h").select("src", "dst", *rest), True)


def write_mesh(hg: Hypergraph, path: str) -> None:
    """CSV lines ``hyperedge,vertex``."""
    hg.h2v.select("h", "v").orderBy("h", "v").write.csv(path)
