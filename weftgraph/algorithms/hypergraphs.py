"""Algorithms on hypergraphs.

Where both sides take part alike, the hypergraph is read as one bipartite graph: hyperedge
h has the id ``base`` + h, ``base`` being the largest vertex id plus one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.hashing import hash64_mod
from weftgraph.kernels import searches
from weftgraph.model import Graph, Hypergraph
from weftgraph.operators import onetask
from weftgraph.storage import discard, durable, rows_of

from .components import components, propagate
from .ranking import DAMPING
from .traversal import _union, bfs, shortest_paths


def bipartite(hg: Hypergraph) -> tuple[Graph, int]:
    """The bipartite graph of the incidences, and the id of hyperedge 0."""
    base = (hg.vertices.agg(F.max("v")).first()[0] or 0) + 1
    rest = ["w"] if hg.weighted else []
    up = hg.v2h.select(F.col("v").alias("src"), (F.col("h") + base).alias("dst"), *rest)
    down = hg.h2v.select((F.col("h") + base).alias("src"), F.col("v").alias("dst"), *rest)
    ids = hg.vertices.select(F.col("v").alias("id")).union(hg.hyperedges.select((F.col("h") + base).alias("id")))
    return Graph(ids, up.unionByName(down), hg.symmetric), base


def _sides(result: DataFrame, base: int) -> DataFrame:
    """kind 'v' or 'h' and the id of that side, with the other columns."""
    rest = [c for c in result.columns if c != "id"]
    return result.select(F.when(F.col("id") < base, "v").otherwise("h").alias("kind"), F.when(F.col("id") < base, F.col("id")).otherwise(F.col("id") - base).alias("id"), *rest)


def hyper_bfs(hg: Hypergraph, root: int = 0) -> DataFrame:
    """(kind, id, parent, level): parents are of the other side, the least of the level before; the root is its own."""
    graph, base = bipartite(hg)
    found = bfs(graph, root)
    return _sides(found.withColumn("parent", F.when(F.col("parent") >= base, F.col("parent") - base).otherwise(F.col("parent"))), base)


def hyper_components(hg: Hypergraph) -> DataFrame:
    """(kind, id, label): the least vertex that reaches each member; null for a hyperedge that no vertex reaches."""
    graph, base = bipartite(hg)
    found = components(graph) if hg.symmetric else propagate(graph)
    return _sides(found.withColumn("label", F.when(F.col("label") < base, F.col("label"))), base)


def hyper_shortest_paths(hg: Hypergraph, root: int = 0) -> DataFrame:
    """(kind, id, dist, negative_cycle) over alternating incidences, each with its weight (1 without weights)."""
    graph, base = bipartite(hg)
    return _sides(shortest_paths(graph, root), base)


def hyper_bpath(hg: Hypergraph, root: int = 0) -> DataFrame:
    """(kind, id, reached, level): a hyperedge fires once all its in-members are reached; one without in-members never fires."""
    h = hg.pinned()
    remaining = durable(h.v2h.groupBy("h").agg(F.count(F.lit(1)).alias("left")))
    frontier = durable(h.spark.createDataFrame([(root, 0)], "v long, level int"))
    reached, fired, level = [frontier], [], 0
    while True:
        level += 1
        hits = h.v2h.join(frontier.select("v"), "v").groupBy("h").agg(F.count(F.lit(1)).alias("_n"))
        counted = durable(remaining.join(hits, "h", "left").select("h", (F.col("left") - F.coalesce("_n", F.lit(0))).alias("left"), F.col("_n").isNotNull().alias("_hit")))
        discard(remaining)
        remaining = counted.select("h", "left")
        firing, n = rows_of(counted.where("_hit and left = 0").select("h", F.lit(level).alias("level")))
        if not n:
            break
        fired.append(firing)
        level += 1
        out = h.h2v.join(firing.select("h"), "h").select("v").distinct()
        frontier, n = rows_of(out.join(_union(reached).select("v"), "v", "left_anti").withColumn("level", F.lit(level)))
        if not n:
            break
        reached.append(frontier)
    v = h.vertices.join(_union(reached), "v", "left").select(F.lit("v").alias("kind"), F.col("v").alias("id"), F.col("level").isNotNull().alias("reached"), "level")
    found = _union(fired) if fired else h.spark.createDataFrame([], "h long, level int")
    return v.union(h.hyperedges.join(found, "h", "left").select(F.lit("h"), F.col("h"), F.col("level").isNotNull(), "level"))


def hyper_dependency(hg: Hypergraph, root: int = 0) -> DataFrame:
    """(kind, id, sigma, score): path counts, and on vertices 1 + the dependency of the root (without the 1 at the root itself); null where unreached."""
    graph, base = bipartite(hg)
    rows = onetask.stored(graph)
    if rows is not None:
        found = onetask.run(rows, graph.symmetric, "id long, sigma double, score double", lambda net: searches.hyper_dependency(net, root))
        return _sides(graph.vertices.join(found.hint("merge"), "id", "left").select("id", "sigma", "score"), base)
    h = hg.pinned()
    frontier = durable(h.spark.createDataFrame([(root, 1.0, 0)], "id long, sigma double, level int"))
    sides: dict[str, list[DataFrame]] = {"v": [frontier], "h": []}
    order, level = [frontier], 0
    while True:
        level += 1
        kind, edges, at, to = ("h", h.v2h, "v", "h") if level % 2 else ("v", h.h2v, "h", "v")
        hop = edges.join(frontier.select(F.col("id").alias(at), "sigma").hint("merge"), at).groupBy(F.col(to).alias("id")).agg(F.sum("sigma").alias("sigma"))
        if sides[kind]:
            hop = hop.join(_union(sides[kind]).select("id").hint("merge"), "id", "left_anti")  # it grows with the graph: never to the driver
        frontier, n = rows_of(hop.withColumn("level", F.lit(level)))
        if not n:
            break
        sides[kind].append(frontier)
        order.append(frontier)
    # from the last level back: hyperedges gather Dep / sigma of the vertices below, vertices sigma times that of their hyperedges
    scores: list[DataFrame] = []
    below = None
    for at in range(len(order) - 1, -1, -1):
        here = order[at]
        if at % 2:
            if below is None:
                scored = here.select("id", "sigma", F.lit(0.0).alias("score"))
            else:
                part = below.select(F.col("id").alias("v"), (F.col("score") / F.col("sigma")).alias("_x"))
                got = h.h2v.join(part, "v").groupBy(F.col("h").alias("id")).agg(F.sum("_x").alias("_g"))
                scored = here.join(got, "id", "left").select("id", "sigma", F.coalesce("_g", F.lit(0.0)).alias("score"))
        else:
            one = F.lit(0.0 if at == 0 else 1.0)
            if below is None:
                scored = here.select("id", "sigma", one.alias("score"))
            else:
                part = below.select(F.col("id").alias("h"), F.col("score").alias("_x"))
                got = h.v2h.join(part, "h").groupBy(F.col("v").alias("id")).agg(F.sum("_x").alias("_g"))
                scored = here.join(got, "id", "left").select("id", "sigma", (one + F.col("sigma") * F.coalesce("_g", F.lit(0.0))).alias("score"))
        below = durable(scored)
        scores.append(below)
    scores.reverse()
    v = h.vertices.select(F.col("v").alias("id")).join(_union(scores[0::2]), "id", "left").select(F.lit("v").alias("kind"), "id", "sigma", "score")
    found = _union(scores[1::2]) if scores[1::2] else h.spark.createDataFrame([], "id long, sigma double, score double")
    return v.union(h.hyperedges.select(F.col("h").alias("id")).join(found, "id", "left").select(F.lit("h"), "id", "sigma", "score"))


def hyper_pagerank(hg: Hypergraph, max_iters: int = 1, damping: float = DAMPING, entropy: bool = False) -> DataFrame:
    """(kind, id, score[, entropy]) after a fixed number of rounds vertices to hyperedges to vertices; without a round, hyperedges score 0.

    With ``entropy``, hyperedges get the sum over their out-members of p_v / p_h * log2(p_v / p_h).
    """
    h = hg.pinned()
    nv = max(h.nv, 1)
    dv = durable(h.vertices.join(h.v2h.groupBy("v").agg(F.count(F.lit(1)).alias("d")), "v", "left").select("v", F.coalesce("d", F.lit(0)).alias("d")))
    dh = durable(h.hyperedges.join(h.h2v.groupBy("h").agg(F.count(F.lit(1)).alias("d")), "h", "left").select("h", F.coalesce("d", F.lit(0)).alias("d")))
    pv = durable(dv.select("v", "d", F.lit(1.0 / nv).alias("p")))
    ph = durable(dh.select("h", "d", F.lit(0.0).alias("p")))
    for _ in range(max_iters):
        up = h.v2h.join(pv.where("d > 0").select("v", (F.col("p") / F.col("d")).alias("_p")), "v").groupBy("h").agg(F.sum("_p").alias("_in"))
        discard(ph)
        ph = durable(dh.join(up, "h", "left").select("h", "d", F.coalesce("_in", F.lit(0.0)).alias("p")))
        down = h.h2v.join(ph.where("d > 0").select("h", (F.col("p") / F.col("d")).alias("_p")), "h").groupBy("v").agg(F.sum("_p").alias("_in"))
        following = durable(dv.join(down, "v", "left").select("v", "d", (F.lit(damping) * F.coalesce("_in", F.lit(0.0)) + F.lit((1 - damping) / nv)).alias("p")))
        discard(pv)
        pv = following
    out_v = pv.select(F.lit("v").alias("kind"), F.col("v").alias("id"), F.col("p").alias("score"))
    out_h = ph.select(F.lit("h").alias("kind"), F.col("h").alias("id"), F.col("p").alias("score"))
    if not entropy:
        return out_v.union(out_h)
    ratio = F.col("_pv") / F.col("_ph")
    both = h.h2v.join(pv.select("v", F.col("p").alias("_pv")), "v").join(ph.where("p > 0").select("h", F.col("p").alias("_ph")), "h")
    spread = both.groupBy(F.col("h").alias("id")).agg(F.sum(ratio * F.log2(ratio)).alias("entropy"))
    return out_v.withColumn("entropy", F.lit(None).cast("double")).union(out_h.join(spread, "id", "left").select("kind", "id", "score", "entropy"))


def hyper_independent_set(hg: Hypergraph, inverse_probability: int = 3) -> DataFrame:
    """(id, flag, in_set): a maximal set that holds no hyperedge whole, by hashed sampling.

    In a round, undecided vertices are sampled by the hash of their id plus the vertices
    processed so far; hyperedges sampled whole give their members back; then the chosen
    leave their hyperedges, and the last vertex of a hyperedge is ruled out.  The flag is 1
    for ruled out, else the round of entry (from 2).
    """
    h = hg.pinned()
    state = durable(h.vertices.select("v", F.lit(0).alias("flag")))
    left = durable(h.h2v.select("h", "v"))
    done, round_ = 0, 1
    while True:
        n = state.where("flag = 0").count()
        if not n:
            return state.select(F.col("v").alias("id"), "flag", (F.col("flag") >= 2).alias("in_set"))
        round_ += 1
        drawn = hash64_mod(F.col("v") + F.lit(done), inverse_probability) == 0
        chosen = durable(state.where("flag = 0").withColumn("_hit", drawn).where("_hit").select("v", F.lit(True).alias("_in")))
        done += n
        marked = left.join(chosen, "v", "left")
        full = marked.groupBy("h").agg(F.min(F.coalesce("_in", F.lit(False))).alias("_all")).where("_all").select("h")
        undone = left.join(full, "h", "left_semi").select("v").distinct()
        kept = durable(chosen.join(undone, "v", "left_anti"))
        rest = durable(left.join(kept.select("v"), "v", "left_anti"))
        sizes = rest.groupBy("h").agg(F.count(F.lit(1)).alias("_n"), F.min("v").alias("v"))
        out = sizes.where("_n = 1").select("v", F.lit(True).alias("_out")).distinct()
        following = durable(state.join(kept, "v", "left").join(out, "v", "left").select("v", F.when(F.col("flag") != 0, F.col("flag")).when(F.col("_in"), round_).when(F.col("_out"), 1).otherwise(0).alias("flag")))
        remaining = durable(rest.join(sizes.where("_n > 1").select("h"), "h", "left_semi"))
        for old in (state, left, chosen, kept, rest):
            discard(old)
        state, left = following, remaining


def hyper_kcore(hg: Hypergraph) -> DataFrame:
    """(id, value): coreness when removing a vertex deletes its hyperedges, and each deletion lowers the other members' degrees by one."""
    h = hg.pinned()
    state = durable(h.vertices.join(h.v2h.groupBy("v").agg(F.count(F.lit(1)).alias("d")), "v", "left").select("v", F.coalesce("d", F.lit(0)).alias("d"), F.lit(None).cast("int").alias("core")))
    dead = durable(h.hyperedges.where(F.lit(False)))
    k = 0
    while True:
        low = state.where("core is null").agg(F.min("d")).first()[0]
        if low is None:
            return state.select(F.col("v").alias("id"), F.col("core").alias("value"))
        k = max(k, low)
        gone = F.col("core").isNull() & (F.col("d") <= k)
        killed = durable(h.v2h.join(state.where(gone).select("v"), "v").select("h").distinct().join(dead, "h", "left_anti"))
        cut = h.h2v.join(killed, "h").groupBy("v").agg(F.count(F.lit(1)).alias("_cut"))
        following = durable(state.join(cut, "v", "left").select("v", (F.col("d") - F.coalesce("_cut", F.lit(0))).alias("d"), F.when(gone, F.lit(k)).otherwise(F.col("core")).alias("core")))
        more = durable(dead.union(killed))
        for old in (state, dead, killed):
            discard(old)
        state, dead = following, more


def incidence_lists(hg: Hypergraph) -> DataFrame:
    """(kind, id, outgoing, incoming): the ascending member lists of every vertex and hyperedge."""

    def lists(table: DataFrame, key: str, member: str, name: str) -> DataFrame:
        return table.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(member)).alias(name))

    none = F.array().cast("array<long>")
    parts = []
    for kind, ids, out, into, key, member in (("v", hg.vertices, hg.v2h, hg.h2v, "v", "h"), ("h", hg.hyperedges, hg.h2v, hg.v2h, "h", "v")):
        rows = ids.select(F.col(key).alias("id")).join(lists(out, key, member, "outgoing"), "id", "left").join(lists(into, key, member, "incoming"), "id", "left")
        parts.append(rows.select(F.lit(kind).alias("kind"), "id", F.coalesce("outgoing", none).alias("outgoing"), F.coalesce("incoming", none).alias("incoming")))
    return parts[0].union(parts[1])
