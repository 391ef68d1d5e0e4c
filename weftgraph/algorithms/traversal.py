"""Breadth-first search, shortest paths, dependency scores and radii."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.hashing import mix64
from weftgraph.kernels import searches
from weftgraph.model import Graph
from weftgraph.operators import onetask
from weftgraph.storage import discard, durable, path_of, rows_of


def _union(tables: list[DataFrame]) -> DataFrame:
    """The rows of stored tables of one schema, as one scan."""
    spark = tables[0].sparkSession
    return spark.read.schema(tables[0].schema).parquet(*[path_of(t) for t in tables])


def bfs(graph: Graph, root: int = 0) -> DataFrame:
    """(id, parent, level): the least parent in the level before; the root is its own parent; null where unreached."""
    rows = onetask.stored(graph)
    if rows is not None:
        found = onetask.run(rows, graph.symmetric, "id long, parent long, level int", lambda net: searches.bfs(net, root))
        return graph.vertices.join(found.hint("merge"), "id", "left").select("id", "parent", "level")
    g = graph.pinned()
    frontier = durable(g.spark.createDataFrame([(root, root, 0)], "id long, parent long, level int"))
    levels, level = [frontier], 0
    while True:
        level += 1
        seen = _union(levels).select("id").hint("merge")  # it grows with the graph: never to the driver
        reached = g.edges.join(frontier.select(F.col("id").alias("src")).hint("merge"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        frontier, n = rows_of(reached.join(seen, "id", "left_anti").withColumn("level", F.lit(level)))
        if not n:
            break
        levels.append(frontier)
    return g.vertices.join(_union(levels), "id", "left").select("id", "parent", "level")


def multi_bfs(graph: Graph, sources: DataFrame) -> DataFrame:
    """(src, id, dist) from many sources at once, reached pairs only."""
    g = graph.pinned()
    frontier = durable(sources.select(F.col("src").cast("long").alias("src"), F.col("src").cast("long").alias("id"), F.lit(0).alias("dist")).distinct())
    levels, level = [frontier], 0
    while True:
        level += 1
        seen = _union(levels).select("src", "id").hint("merge")
        hop = g.edges.select(F.col("src").alias("_at"), F.col("dst")).join(frontier.select("src", F.col("id").alias("_at")).hint("merge"), "_at").select("src", F.col("dst").alias("id")).distinct()
        frontier, n = rows_of(hop.join(seen, ["src", "id"], "left_anti").withColumn("dist", F.lit(level)))
        if not n:
            return _union(levels)
        levels.append(frontier)


def _negative(rows: DataFrame) -> bool:
    """Whether a weight is below zero, or none at all or no whole number."""
    kind = rows.schema["w"].dataType.typeName()
    return kind not in ("long", "integer", "short", "byte") or not rows.where("w is null or w < 0").isEmpty()


def shortest_paths(graph: Graph, root: int = 0) -> DataFrame:
    """(id, dist, negative_cycle) by rounds of relaxation; null where unreached.

    If a round beyond the vertex count still improves, a negative cycle is reachable:
    then every distance is null and the flag is set.
    """
    rows = onetask.stored(graph, True)
    if rows is not None and not (graph.weighted and _negative(rows)):
        found = onetask.run(rows, graph.symmetric, "id long, dist long", lambda net: searches.least_costs(net, root))
        return graph.vertices.join(found.hint("merge"), "id", "left").select("id", "dist", F.lit(False).alias("negative_cycle"))
    g = graph.pinned()
    weight = "w" if g.weighted else "1"
    state = durable(g.spark.createDataFrame([(root, 0, True)], "id long, dist long, fresh boolean"))
    n, rounds, bad = g.n, 0, False
    while True:
        relaxed = g.edges.join(state.where("fresh").select(F.col("id").alias("src"), F.col("dist").alias("_d")), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.expr(f"_d + {weight}")).alias("new"))
        merged = state.join(relaxed, "id", "full").select("id", F.least("dist", "new").cast("long").alias("dist"), F.coalesce(F.col("new") < F.coalesce("dist", F.lit((1 << 62))), F.lit(False)).alias("fresh"))
        following = durable(merged)
        discard(state)
        state, rounds = following, rounds + 1
        if state.where("fresh").isEmpty():
            break
        if rounds >= n:
            bad = True
            break
    dist = F.lit(None).cast("long") if bad else F.col("dist")
    return g.vertices.join(state, "id", "left").select("id", dist.alias("dist"), F.lit(bad).alias("negative_cycle"))


def delta_stepping(graph: Graph, root: int = 0, delta: int = 1) -> DataFrame:
    """(id, dist) for weights of zero or more: the pending vertices of the lowest distance bucket are relaxed together."""
    rows = onetask.stored(graph, True)
    if rows is not None and not (graph.weighted and _negative(rows)):
        found = onetask.run(rows, graph.symmetric, "id long, dist long", lambda net: searches.least_costs(net, root))
        return graph.vertices.join(found.hint("merge"), "id", "left").select("id", "dist")
    g = graph.pinned()
    weight = "w" if g.weighted else "1"
    state = durable(g.spark.createDataFrame([(root, 0, True)], "id long, dist long, pending boolean"))
    while True:
        low = state.where("pending").agg(F.min(F.floor(F.col("dist") / delta))).first()[0]
        if low is None:
            break
        now = F.col("pending") & (F.floor(F.col("dist") / delta) == low)
        relaxed = g.edges.join(state.where(now).select(F.col("id").alias("src"), F.col("dist").alias("_d")), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.expr(f"_d + {weight}")).alias("new"))
        better = F.col("new").isNotNull() & (F.col("new") < F.coalesce("dist", F.lit(1 << 62)))
        following = durable(state.join(relaxed, "id", "full").select("id", F.least("dist", "new").cast("long").alias("dist"), (better | F.coalesce(F.col("pending") & ~now, F.lit(False))).alias("pending")))
        discard(state)
        state = following
    return g.vertices.join(state, "id", "left").select("id", "dist")


def dependency(graph: Graph, root: int = 0) -> DataFrame:
    """(id, sigma, score): shortest-path counts from the root and the dependency of the root on each vertex; null where unreached."""
    rows = onetask.stored(graph)
    if rows is not None:
        found = onetask.run(rows, graph.symmetric, "id long, sigma double, score double", lambda net: searches.dependency(net, root))
        return graph.vertices.join(found.hint("merge"), "id", "left").select("id", "sigma", "score")
    g = graph.pinned()
    frontier = durable(g.spark.createDataFrame([(root, 1.0, 0)], "id long, sigma double, level int"))
    levels, level = [frontier], 0
    while True:
        level += 1
        seen = _union(levels).select("id").hint("merge")  # it grows with the graph: never to the driver
        reached = g.edges.join(frontier.select(F.col("id").alias("src"), "sigma").hint("merge"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        frontier, n = rows_of(reached.join(seen, "id", "left_anti").withColumn("level", F.lit(level)))
        if not n:
            break
        levels.append(frontier)
    scores = [durable(levels[-1].select("id", "sigma", F.lit(0.0).alias("score")))]
    for here in reversed(levels[:-1]):
        below = scores[-1].select(F.col("id").alias("dst"), F.col("sigma").alias("_s"), F.col("score").alias("_d"))
        pulled = g.edges.join(below, "dst").groupBy(F.col("src").alias("id")).agg(F.sum((1 + F.col("_d")) / F.col("_s")).alias("_pull"))
        scores.append(durable(here.join(pulled, "id", "left").select("id", "sigma", (F.col("sigma") * F.coalesce("_pull", F.lit(0.0))).alias("score"))))
    return g.vertices.join(_union(scores), "id", "left").select("id", "sigma", "score")


def radius_sources(n: int, count: int = 64) -> list[int]:
    """The hashed start vertices of the bit-parallel searches, without repeats."""
    return list(dict.fromkeys((mix64(range(count)) % n).astype("int64").tolist()))


def bit_radii(graph: Graph, sources: list[int], words: int = 1) -> DataFrame:
    """(id, value): the last round in which a vertex was reached by a new source, 64 sources to a word; null where never."""
    rows = onetask.stored(graph)
    if rows is not None:
        found = onetask.run(rows, graph.symmetric, "id long, value int", lambda net: searches.last_heard(net, sources))
        return graph.vertices.join(found.hint("merge"), "id", "left")
    g = graph.pinned()
    columns = [f"b{k}" for k in range(words)]
    seeds: dict[int, list[int]] = {}
    for k, s in enumerate(sources):
        seeds.setdefault(s, [0] * words)[k // 64] |= 1 << (k % 64)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    state = durable(g.spark.createDataFrame([(s, 0, True, *map(signed, bits)) for s, bits in seeds.items()], "id long, value int, fresh boolean, " + ", ".join(f"{c} long" for c in columns)))
    level = 0
    while True:
        level += 1
        heard = g.edges.join(state.where("fresh").select(F.col("id").alias("src"), *columns), "src").groupBy(F.col("dst").alias("id")).agg(*[F.bit_or(c).alias(f"n{c}") for c in columns])
        both = [F.coalesce(c, F.lit(0)).bitwiseOR(F.coalesce(f"n{c}", F.lit(0))) for c in columns]
        new = F.lit(False)
        for c, b in zip(columns, both):
            new = new | (b != F.coalesce(c, F.lit(0)))
        following = durable(state.join(heard, "id", "full").select("id", F.when(new, F.lit(level)).otherwise(F.col("value")).alias("value"), new.alias("fresh"), *[b.alias(c) for c, b in zip(columns, both)]))
        discard(state)
        state = following
        if state.where("fresh").isEmpty():
            break
    return g.vertices.join(state.select("id", "value"), "id", "left")


def radii(graph: Graph) -> DataFrame:
    """(id, value): the largest distance from 64 hashed sources; null where none reaches."""
    n = graph.n
    return bit_radii(graph, radius_sources(n) if n else [])
