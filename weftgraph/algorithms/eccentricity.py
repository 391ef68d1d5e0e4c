"""Eccentricities of symmetric graphs: exact, bounded and estimated.

Every function returns (id, value).  Where sources are drawn, they are the vertices with
the smallest MD5 of "seed#id", so results are the same in every run and in other engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.kernels import radii
from weftgraph.model import Graph
from weftgraph.operators import onetask
from weftgraph.operators.sequences import running
from weftgraph.storage import discard, durable

from .components import components
from .traversal import multi_bfs


def labelled(graph: Graph) -> DataFrame:
    """(id, label, size): the component of each vertex and its size."""
    labels = components(graph)
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return durable(labels.join(sizes, "label").select("id", "label", "size"))


def _in_one_task(graph: Graph, kernel) -> DataFrame | None:
    """(id, value) by a kernel over the graph without its isolated vertices, whose value is 0; None if the graph is beyond one task."""
    rows = onetask.stored(graph) if graph.symmetric else None
    if rows is None:
        return None
    return _whole(graph, onetask.run(rows, True, "id long, value int", kernel))


def _whole(graph: Graph, found: DataFrame) -> DataFrame:
    return graph.vertices.join(found.hint("merge"), "id", "left").select("id", F.coalesce("value", F.lit(0)).cast("int").alias("value"))


def _draw(seed: int, column: str = "id") -> F.Column:
    """The MD5 that orders and marks vertices at random."""
    return F.md5(F.concat(F.lit(f"{seed}#"), F.col(column).cast("string")))


def _bits(seed: int) -> F.Column:
    """60 random bits of a vertex."""
    return F.conv(F.substring(_draw(seed), 1, 15), 16, 10).cast("long")


def _sample(parts: DataFrame, most, seed: int) -> DataFrame:
    """Per component, the ``most`` members of smallest hash."""
    by = Window.partitionBy("label").orderBy(_draw(seed), "id")
    return parts.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= most)


def _small(size: F.Column, value: F.Column) -> F.Column:
    return F.when(size == 1, 0).when(size == 2, 1).otherwise(value).cast("int")


def kbfs(graph: Graph, words: int = 1, two_phase: bool = True, seed: int = 1, large: int = 1024) -> DataFrame:
    """Lower bounds from bit-parallel searches of 64 * ``words`` sources per component.

    The second phase searches again from the vertices with the largest first estimates, in
    components above ``large`` vertices.
    """
    found = _in_one_task(graph, lambda net: radii.kbfs(net, words, two_phase, seed, large))
    if found is not None:
        return found
    g = graph.pinned()
    parts = labelled(g)
    per = 64 * words

    def estimate(starts: DataFrame) -> DataFrame:
        # a vertex's slot is its place in its component; components don't meet, so they share the bits
        slots = starts.select("id", (F.col("_k") - 1).alias("slot")).where(F.col("slot") < per)
        return _slot_radii(g, slots, words)

    first = durable(estimate(_sample(parts, per, seed)))
    if not two_phase:
        return parts.join(first, "id").select("id", _small(F.col("size"), F.coalesce("value", F.lit(0))).alias("value"))
    ranked = parts.where(F.col("size") > large).join(first, "id").withColumn("_k", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("value"), "id")))
    again = ranked.where(F.col("_k") <= per)
    second = durable(estimate(again).withColumnRenamed("value", "_v"))
    both = parts.join(first, "id").join(second, "id", "left")
    return both.select("id", _small(F.col("size"), F.greatest(F.coalesce("value", F.lit(0)), F.coalesce("_v", F.lit(0)))).alias("value"))


def _slot_radii(g: Graph, slots: DataFrame, words: int) -> DataFrame:
    """Last round in which each vertex heard of a new slot, all sources at once."""
    columns = [f"b{k}" for k in range(words)]
    bit = F.expr("shiftleft(1L, cast(pmod(slot, 64) as int))")
    seeds = slots.groupBy("id").agg(*[F.bit_or(F.when(F.floor(F.col("slot") / 64) == k, bit).otherwise(F.lit(0).cast("long"))).alias(c) for k, c in enumerate(columns)])
    state = durable(seeds.select("id", F.lit(0).alias("value"), F.lit(True).alias("fresh"), *columns))
    level = 0
    while True:
        level += 1
        heard = g.edges.join(state.where("fresh").select(F.col("id").alias("src"), *columns).hint("merge"), "src").groupBy(F.col("dst").alias("id")).agg(*[F.bit_or(c).alias(f"n{c}") for c in columns])
        merged = [F.coalesce(c, F.lit(0)).bitwiseOR(F.coalesce(f"n{c}", F.lit(0))) for c in columns]
        new = F.lit(False)
        for c, b in zip(columns, merged):
            new = new | (b != F.coalesce(c, F.lit(0)))
        following = durable(state.join(heard, "id", "full").select("id", F.when(new, F.lit(level)).otherwise(F.col("value")).alias("value"), new.alias("fresh"), *[b.alias(c) for c, b in zip(columns, merged)]))
        discard(state)
        state = following
        if state.where("fresh").isEmpty():
            return g.vertices.join(state.select("id", "value"), "id", "left")


def exact(graph: Graph, words: int = 8) -> DataFrame:
    """Exact values from bit-parallel searches, in one task of the vertices that bounds leave open, else of all, 64 * ``words`` at a time."""
    found = _in_one_task(graph, lambda net: radii.exact(net))
    if found is not None:
        return found
    g = graph.pinned()
    numbered = durable(_numbered(g))
    n = numbered.count()
    best = None
    for at in range(0, n, 64 * words):
        slots = numbered.where((F.col("k") >= at) & (F.col("k") < at + 64 * words)).select("id", (F.col("k") - at).alias("slot"))
        found = _slot_radii(g, slots, words).select("id", F.coalesce("value", F.lit(0)).alias("_v"))
        following = durable(found.select("id", F.col("_v").alias("value")) if best is None else best.join(found, "id").select("id", F.greatest("value", "_v").alias("value")))
        discard(best)
        best = following
    return best.select("id", F.col("value").cast("int").alias("value")) if best is not None else g.vertices.select("id", F.lit(0).alias("value"))


def _numbered(g: Graph) -> DataFrame:
    """(id, k): vertices numbered in id order."""
    return running(g.vertices, [F.col("id")]).select("id", (F.col("n") - 1).alias("k"))


def sketch(graph: Graph, counters: int = 1, seed: int = 1) -> DataFrame:
    """Estimates from Flajolet-Martin masks spread by OR: the last round in which a mask changed."""
    found = _in_one_task(graph, lambda net: radii.sketch(net, counters, seed))
    if found is not None:
        return found
    g = graph.pinned()
    columns = [f"b{k}" for k in range(counters)]

    def mask(k: int) -> F.Column:
        h = _bits(seed + k)
        low = h.bitwiseAND(-h)  # the lowest set bit
        return F.when(h == 0, F.lit(1).cast("long")).otherwise(low)

    state = durable(g.vertices.select("id", F.lit(0).alias("value"), F.lit(True).alias("fresh"), *[mask(k).alias(c) for k, c in enumerate(columns)]))
    level = 0
    while True:
        level += 1
        heard = g.edges.join(state.where("fresh").select(F.col("id").alias("src"), *columns).hint("merge"), "src").groupBy(F.col("dst").alias("id")).agg(*[F.bit_or(c).alias(f"n{c}") for c in columns])
        merged = [F.col(c).bitwiseOR(F.coalesce(f"n{c}", F.lit(0))) for c in columns]
        new = F.lit(False)
        for c, b in zip(columns, merged):
            new = new | (b != F.col(c))
        following = durable(state.join(heard, "id", "left").select("id", F.when(new, F.lit(level)).otherwise(F.col("value")).alias("value"), new.alias("fresh"), *[b.alias(c) for c, b in zip(columns, merged)]))
        discard(state)
        state = following
        if state.where("fresh").isEmpty():
            return state.select("id", F.col("value").cast("int").alias("value"))


def registers(graph: Graph, count: int = 10, seed: int = 1) -> DataFrame:
    """Estimates from LogLog registers spread by maximum: the last round in which a register grew."""
    found = _in_one_task(graph, lambda net: radii.registers(net, count, seed))
    if found is not None:
        return found
    g = graph.pinned()
    names = [f"r{k}" for k in range(count)]
    slot = F.pmod(_bits(seed), F.lit(count))
    bits = _bits(seed + 1)
    # trailing zeros plus one, at most 63
    zeros = F.when(bits == 0, 63).otherwise(F.least(F.lit(63), F.round(F.log2(F.abs(bits.bitwiseAND(-bits)).cast("double"))).cast("int") + 1))
    state = durable(g.vertices.select("id", F.lit(0).alias("value"), F.lit(True).alias("fresh"), *[F.when(slot == k, zeros).otherwise(0).alias(n) for k, n in enumerate(names)]))
    level = 0
    while True:
        level += 1
        heard = g.edges.join(state.where("fresh").select(F.col("id").alias("src"), *names).hint("merge"), "src").groupBy(F.col("dst").alias("id")).agg(*[F.max(n).alias(f"n{n}") for n in names])
        merged = [F.greatest(F.col(n), F.coalesce(f"n{n}", F.lit(0))) for n in names]
        new = F.lit(False)
        for n, b in zip(names, merged):
            new = new | (b > F.col(n))
        following = durable(state.join(heard, "id", "left").select("id", F.when(new, F.lit(level)).otherwise(F.col("value")).alias("value"), new.alias("fresh"), *[b.alias(n) for n, b in zip(names, merged)]))
        discard(state)
        state = following
        if state.where("fresh").isEmpty():
            return state.select("id", F.col("value").cast("int").alias("value"))


def bounded(graph: Graph, per_round: int = 32) -> DataFrame:
    """Exact values by pruning with lower and upper bounds.

    A round searches from up to ``per_round`` open vertices of every component at once, taken
    in turn by the largest upper and the smallest lower bound.
    """
    found = _in_one_task(graph, lambda net: radii.exact(net))
    if found is not None:
        return found
    g = graph.pinned()
    parts = labelled(g)
    state = durable(parts.select("id", "label", F.lit(0).alias("low"), F.lit((1 << 31) - 1).alias("high"), F.lit(False).alias("closed")))
    by_high = Window.partitionBy("label").orderBy(F.desc("high"), "id")
    by_low = Window.partitionBy("label").orderBy("low", "id")
    while True:
        open_ = state.where("not closed")
        ranked = open_.withColumn("_a", F.row_number().over(by_high)).withColumn("_b", F.row_number().over(by_low))
        sources = durable(ranked.where((F.col("_a") <= per_round // 2) | (F.col("_b") <= per_round // 2)).select(F.col("id").alias("src")))
        if sources.isEmpty():
            return state.select("id", F.col("low").cast("int").alias("value"))
        reached = multi_bfs(g, sources)
        ecc = reached.groupBy("src").agg(F.max("dist").alias("e"))
        own = F.col("src") == F.col("id")
        near = reached.join(ecc, "src").groupBy("id").agg(
            F.max(F.when(own, F.col("e")).otherwise(F.greatest("dist", F.col("e") - F.col("dist")))).alias("_l"),
            F.min(F.when(own, F.col("e")).otherwise(F.col("e") + F.col("dist"))).alias("_h"),
        )
        low, high = F.greatest("low", F.coalesce("_l", F.lit(0))), F.least("high", F.coalesce("_h", F.lit((1 << 31) - 1)))
        following = durable(state.join(near, "id", "left").select("id", "label", low.alias("low"), high.alias("high"), (F.col("closed") | (low == high)).alias("closed")))
        discard(state)
        state = following


def two_approximation(graph: Graph, seed: int = 1) -> DataFrame:
    """The eccentricity of one drawn vertex per component for all its members: at most a factor of two off."""
    found = _in_one_task(graph, lambda net: radii.two_approximation(net, seed))
    if found is not None:
        return found
    g = graph.pinned()
    parts = labelled(g)
    reached = multi_bfs(g, durable(_sample(parts, 1, seed).select(F.col("id").alias("src"))))
    ecc = reached.groupBy("src").agg(F.max("dist").alias("value"))
    return reached.join(ecc, "src").select("id", F.col("value").cast("int").alias("value"))


def _neighbourhood(graph: Graph, seed: int):
    """Sample, farthest vertex and its near set, shared by the two estimators."""
    g = graph.pinned()
    parts = labelled(g)
    size = F.col("size").cast("double")
    log = F.log2(size)
    s = F.least(F.col("size"), F.floor(F.sqrt(size * log)))
    count = F.least(F.col("size"), F.greatest(F.lit(10), F.floor(size / F.greatest(s, F.lit(1)) * log)))
    sample = _sample(parts.where("size > 2"), count, seed).select(F.col("id").alias("src"), "label")
    sample = durable(sample)
    seen = durable(multi_bfs(g, sample.select("src")))
    nearest = seen.groupBy("id").agg(F.min("dist").alias("d_near"), F.max("dist").alias("d_far"))
    far = parts.where("size > 2").join(nearest, "id").groupBy("label").agg(F.max(F.struct("d_near", (-F.col("id")).alias("i"))).alias("_w")).select("label", (-F.col("_w.i")).alias("src"))
    far = durable(far)
    from_w = durable(multi_bfs(g, far.select("src")).withColumnRenamed("dist", "d_w"))
    by = Window.partitionBy("label").orderBy("d_w", "id")
    near = from_w.join(parts, "id").withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= s).select(F.col("id").alias("src"), "label")
    near = durable(near)
    seen2 = durable(multi_bfs(g, near.select("src")))
    return parts, sample, seen, nearest, from_w, near, seen2


def _by_neighbourhood(graph: Graph, kernel, seed: int) -> DataFrame | None:
    """(id, value) by a kernel that also takes the radii of the sample's and the near set's searches, which tasks share; None if the graph is beyond one task."""
    rows = onetask.stored(graph) if graph.symmetric else None
    if rows is None:
        return None
    names = ["far_s", "own_s", "far_n", "own_n"]
    tasks = max(2, min(16, graph.spark.sparkContext.defaultParallelism))
    found = onetask.shared(rows, "id long, " + ", ".join(f"{c} int" for c in names), lambda net, task, of: radii.neighbourhood_radii(net, task, of, seed), tasks)
    told = found.groupBy("id").agg(*[F.max(c).alias(c) for c in names])
    return _whole(graph, onetask.run_with(rows, told, "id long, value int", lambda net, values: kernel(net, values, seed)))


def near_set_estimate(graph: Graph, seed: int = 1) -> DataFrame:
    """Estimates from a sample and the near set of its farthest vertex w (about sqrt(n log n) searches per component).

    Searched vertices are exact.  Others take the larger of their sampled distances and,
    by the near vertex t on the way to w, the value of t or the sample's least value.
    """
    found = _by_neighbourhood(graph, radii.near_set_estimate, seed)
    if found is not None:
        return found
    parts, sample, seen, nearest, from_w, near, seen2 = _neighbourhood(graph, seed)
    ecc_s = seen.groupBy("src").agg(F.max("dist").alias("e"))
    ecc_w = from_w.groupBy("src").agg(F.max("d_w").alias("e"))
    ecc_n = seen2.groupBy("src").agg(F.max("dist").alias("e"))
    known = ecc_s.union(ecc_w).union(ecc_n).groupBy(F.col("src").alias("id")).agg(F.max("e").alias("known"))
    least = sample.join(ecc_s, "src").groupBy("label").agg(F.min("e").alias("min_s"))
    # the near vertex closest to v on a shortest path from w: least distance, then id
    onpath = seen2.join(from_w.select(F.col("id").alias("src"), F.col("d_w").alias("d_tw")), "src").groupBy("id").agg(F.min(F.struct("dist", "src", "d_tw")).alias("t"))
    rows = parts.where("size > 2").join(nearest, "id").join(from_w.select("id", "d_w"), "id").join(onpath, "id").join(known, "id", "left").join(least, "label")
    rows = rows.join(ecc_n.select(F.col("src").alias("_t"), F.col("e").alias("e_t")), F.col("t.src") == F.col("_t"))
    floor = F.greatest("d_far", "d_w")
    value = F.coalesce("known", F.when(F.col("t.dist") <= F.col("t.d_tw"), F.greatest(floor, F.col("e_t"))).otherwise(F.greatest(floor, F.col("min_s"))))
    big = rows.select("id", value.cast("int").alias("value"))
    return big.union(parts.where("size <= 2").select("id", (F.col("size") - 1).cast("int")))


def lower_bounds(graph: Graph, seed: int = 1) -> DataFrame:
    """Lower bounds max(d, ecc(s) - d) over a sample, its farthest vertex and that vertex's near set; searched vertices are exact."""
    found = _by_neighbourhood(graph, radii.lower_bounds, seed)
    if found is not None:
        return found
    parts, sample, seen, nearest, from_w, near, seen2 = _neighbourhood(graph, seed)
    every = seen.unionByName(from_w.withColumnRenamed("d_w", "dist")).unionByName(seen2)
    ecc = every.groupBy("src").agg(F.max("dist").alias("e"))
    found = every.join(ecc, "src").groupBy("id").agg(F.max(F.greatest("dist", F.col("e") - F.col("dist"))).alias("value"))
    return parts.join(found, "id", "left").select("id", _small(F.col("size"), F.coalesce("value", F.lit(0))).alias("value"))


def write_values(values: DataFrame, path: str) -> None:
    """One integer a line, line i being vertex i, in range-sorted part files; null is written as -1."""
    values.orderBy("id").select(F.coalesce("value", F.lit(-1)).cast("string").alias("value")).write.text(path)
