"""Coreness, independent sets, triangles and set cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.model import Graph
from weftgraph.operators.buckets import next_bucket
from weftgraph.storage import discard, durable


def kcore(graph: Graph) -> DataFrame:
    """(id, value): coreness, as the fixed point of neighbours' h-indices; few rounds, no loop over k.

    The graph is symmetric; parallel edges count by their number.
    """
    g = graph.pinned()
    state = durable(g.out_degrees().select("id", F.col("degree").cast("int").alias("value"), F.lit(True).alias("fresh")))
    # a hub's neighbours are counted by their value first: a window holds one row for each value, not for each neighbour
    by = Window.partitionBy("id").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while True:
        heard = g.edges.select("src", F.col("dst").alias("id")).join(state.select(F.col("id").alias("src"), F.col("value").alias("c")), "src")
        # only vertices next to a change can change
        touched = g.edges.join(state.where("fresh").select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        counts = heard.join(touched, "id", "left_semi").groupBy("id", "c").agg(F.count(F.lit(1)).alias("_m"))
        heights = counts.withColumn("_k", F.sum("_m").over(by).cast("int")).groupBy("id").agg(F.max(F.least("_k", "c")).alias("_h"))
        following = durable(state.join(heights, "id", "left").select("id", F.least("value", F.coalesce("_h", "value")).alias("value"), F.coalesce(F.col("_h") < F.col("value"), F.lit(False)).alias("fresh")))
        discard(state)
        state = following
        if state.where("fresh").isEmpty():
            return state.select("id", "value")


def kcore_peel(graph: Graph) -> DataFrame:
    """(id, value): coreness by peeling the lowest bucket of remaining degrees, empty ones skipped."""
    g = graph.pinned()
    state = durable(g.out_degrees().select("id", "degree", F.lit(None).cast("long").alias("core")))
    k = 0
    while True:
        low, _ = next_bucket(state.where("core is null").select("id", F.col("degree").alias("bkt")))
        if low is None:
            return state.select("id", F.col("core").cast("int").alias("value"))
        k = max(k, low)
        gone = state.where(F.col("core").isNull() & (F.col("degree") <= k)).select(F.col("id").alias("src"))
        cut = g.edges.join(gone, "src").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("_cut"))
        leaves = F.col("core").isNull() & (F.col("degree") <= k)
        following = durable(state.join(cut, "id", "left").select("id", (F.col("degree") - F.coalesce("_cut", F.lit(0))).alias("degree"), F.when(leaves, F.lit(k)).otherwise(F.col("core")).cast("long").alias("core")))
        discard(state)
        state = following


def maximal_independent_set(graph: Graph) -> DataFrame:
    """(id, in_set): the independent set that takes vertices in id order."""
    g = graph.pinned()
    down = g.edges.where("dst < src")  # a vertex waits for its smaller neighbours
    state = durable(g.vertices.select("id", F.lit(0).alias("status")))
    while True:
        open_ = state.where("status = 0").select("id")
        waits = down.join(open_.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).distinct()
        enter = open_.join(waits, "id", "left_anti").withColumn("_in", F.lit(True))
        enter = durable(enter)
        out = g.edges.join(enter.select(F.col("id").alias("src")), "src").where("src <> dst").select(F.col("dst").alias("id"), F.lit(True).alias("_out")).distinct()
        status = F.when(F.col("status") != 0, F.col("status")).when(F.col("_in"), 1).when(F.col("_out"), 2).otherwise(0)
        following = durable(state.join(enter, "id", "left").join(out, "id", "left").select("id", status.alias("status")))
        discard(state)
        discard(enter)
        state = following
        if state.where("status = 0").isEmpty():
            return state.select("id", (F.col("status") == 1).alias("in_set"))


def check_independent_set(graph: Graph, chosen: DataFrame) -> DataFrame:
    """One row: edges inside the set, and vertices outside it without a neighbour in it; both are 0 for a maximal set."""
    members = chosen.where("in_set").select("id")
    inside = graph.edges.where("src <> dst").join(members.select(F.col("id").alias("src")), "src").join(members.select(F.col("id").alias("dst")), "dst").agg(F.count(F.lit(1)).alias("edges_inside"))
    near = graph.edges.join(members.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
    free = chosen.where("not in_set").join(near, "id", "left_anti").agg(F.count(F.lit(1)).alias("addable"))
    return inside.join(F.broadcast(free))  # one row each


def _ranked(graph: Graph) -> DataFrame:
    """Distinct edges turned from the higher to the lower degree end, ties by id: few out-edges even at hubs."""
    pairs = graph.edges.select("src", "dst").where("src <> dst").distinct()
    degrees = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    both = pairs.where("src < dst").join(degrees.select("src", F.col("d").alias("ds")), "src").join(degrees.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    swap = (F.col("ds") > F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") > F.col("dst")))
    return both.select(F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("b"))


def triangle_list(graph: Graph) -> DataFrame:
    """(x, y, z), x < y < z, once per triangle of a symmetric graph."""
    e = durable(_ranked(graph))
    wedges = e.join(e.select("a", F.col("b").alias("c")), "a").where("b < c")
    closing = e.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("c"))
    found = wedges.join(closing, ["b", "c"])
    xyz = F.array_sort(F.array("a", "b", "c"))
    return found.select(xyz[0].alias("x"), xyz[1].alias("y"), xyz[2].alias("z"))


def triangles(graph: Graph) -> DataFrame:
    """One row: the number of triangles."""
    return triangle_list(graph).agg(F.count(F.lit(1)).alias("triangles"))


def triangles_per_vertex(graph: Graph) -> DataFrame:
    """(id, triangles): how many triangles have this vertex as their largest, zeros included."""
    found = triangle_list(graph).groupBy(F.col("z").alias("id")).agg(F.count(F.lit(1)).alias("triangles"))
    return graph.vertices.join(found, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def set_cover(graph: Graph, epsilon: float = 0.01) -> DataFrame:
    """(id, in_cover): a greedy set cover; each vertex is the set of its out-neighbours.

    Sets lie in buckets by the logarithm of their uncovered size.  In a round the highest
    bucket's sets that still have the size bid for their elements, the smaller id wins,
    and sets that win enough join the cover.
    """
    g = graph.pinned()
    import math

    scale, base = 1.0 / math.log(1.0 + epsilon), 1.0 + epsilon
    level = F.when(F.col("d") > 0, F.floor(F.lit(scale) * F.log(F.col("d").cast("double"))))
    sets = durable(g.out_degrees().select("id", F.col("degree").alias("d")).select("id", level.cast("long").alias("bkt"), F.lit(False).alias("in_cover")))
    covered = durable(g.vertices.where(F.lit(False)))
    while True:
        top = sets.agg(F.max("bkt")).first()[0]
        if top is None:
            return sets.select("id", "in_cover")
        now = sets.where(F.col("bkt") == top).select("id")
        left = durable(g.edges.join(now.select(F.col("id").alias("src")), "src").select("src", "dst").join(covered.select(F.col("id").alias("dst")), "dst", "left_anti"))
        sizes = now.join(left.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))
        bidders = sizes.where(F.col("d") >= math.ceil(base**top)).select(F.col("id").alias("src"))
        won = durable(left.join(bidders, "src").groupBy("dst").agg(F.min("src").alias("id")))
        joined = durable(won.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(math.ceil(base ** (top - 1)), 1)).select("id", F.lit(True).alias("_in")))
        fresh = won.join(joined.select("id"), "id", "left_semi").select(F.col("dst").alias("id"))
        # the sizes are those before this round's covering; a lower bucket is found when next met
        moved = sizes.select("id", level.cast("long").alias("_b"), F.lit(True).alias("_now"))
        state = sets.join(moved, "id", "left").join(joined, "id", "left")
        bucket = F.when(F.col("_in"), F.lit(None)).when(F.col("_now"), F.col("_b")).otherwise(F.col("bkt"))
        following = durable(state.select("id", bucket.cast("long").alias("bkt"), (F.col("in_cover") | F.coalesce("_in", F.lit(False))).alias("in_cover")))
        more = durable(covered.union(fresh))
        for old in (sets, covered, left, won, joined):
            discard(old)
        sets, covered = following, more
