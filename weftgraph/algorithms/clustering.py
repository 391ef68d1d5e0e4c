"""Local clustering around a seed vertex, and sweep cuts.  Score tables are (id, score)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.hashing import next64
from weftgraph.model import Graph
from weftgraph.operators.sequences import running
from weftgraph.storage import discard, durable


def _seed(g: Graph, root: int) -> DataFrame:
    """(id, score) with one unit at the root, which must have a neighbour."""
    if g.edges.where(F.col("src") == root).isEmpty():
        raise ValueError(f"seed vertex {root} has no neighbours")
    return durable(g.spark.createDataFrame([(root, 1.0)], "id long, score double"))


def _degrees(g: Graph) -> DataFrame:
    return durable(g.out_degrees().select("id", F.col("degree").cast("double").alias("deg")))


def _push(g: Graph, active: DataFrame, share: F.Column) -> DataFrame:
    """(id, got): ``share`` of each active row (id, score, deg), given to every neighbour."""
    return g.edges.join(active.select(F.col("id").alias("src"), share.alias("_s")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("_s").alias("got"))


def nibble(graph: Graph, root: int = 0, steps: int = 10, epsilon: float = 1e-9) -> DataFrame:
    """Truncated lazy walk: a vertex keeps half and spreads half while its score exceeds its degree times epsilon; other mass is dropped."""
    g = graph.pinned()
    deg = _degrees(g)
    q = _seed(g, root)
    for _ in range(steps):
        active = durable(q.join(deg, "id").where(F.col("score") > F.col("deg") * epsilon))
        if active.isEmpty():
            break
        kept = active.select("id", (F.col("score") / 2).alias("got"))
        moved = kept.union(_push(g, active, F.col("score") / (2 * F.col("deg"))))
        following = durable(moved.groupBy("id").agg(F.sum("got").alias("score")))
        discard(q)
        q = following
    return q


def push_pagerank(graph: Graph, root: int = 0, alpha: float = 0.15, epsilon: float = 1e-9, optimised: bool = False, max_iters: int = 10000) -> DataFrame:
    """Approximate personalised PageRank by synchronous pushes of residuals above degree times epsilon.

    The plain rule moves alpha of a residual to the score and keeps (1 - alpha) / 2; the
    optimised rule moves 2 alpha / (1 + alpha) and keeps nothing.
    """
    g = graph.pinned()
    deg = _degrees(g)
    take = 2 * alpha / (1 + alpha) if optimised else alpha
    keep = 0.0 if optimised else (1 - alpha) / 2
    give = (1 - alpha) / (1 + alpha) if optimised else (1 - alpha) / 2
    state = durable(_seed(g, root).select("id", F.lit(0.0).alias("p"), F.col("score").alias("r")))
    for _ in range(max_iters):
        active = durable(state.join(deg, "id").where(F.col("r") > F.col("deg") * epsilon).select("id", F.col("r").alias("score"), "deg"))
        if active.isEmpty():
            break
        got = _push(g, active, F.lit(give) * F.col("score") / F.col("deg"))
        own = active.select("id", F.col("score").alias("_a"))
        merged = state.join(own, "id", "left").join(got, "id", "full")
        r = F.when(F.col("_a").isNotNull(), keep * F.col("_a")).otherwise(F.coalesce("r", F.lit(0.0))) + F.coalesce("got", F.lit(0.0))
        following = durable(merged.select("id", (F.coalesce("p", F.lit(0.0)) + F.lit(take) * F.coalesce("_a", F.lit(0.0))).alias("p"), r.alias("r")))
        discard(state)
        state = following
    return state.where("p > 0").select("id", F.col("p").alias("score"))


def heat_coefficients(t: float, levels: int) -> list[float]:
    """psi_k for k below ``levels``: the sums over m < levels - k of k! t^m / (m + k)!."""
    psi = [1.0] * levels
    for k in range(levels - 2, -1, -1):
        psi[k] = psi[k + 1] * t / (k + 1) + 1
    return psi


def heat_kernel(graph: Graph, root: int = 0, t: float = 3.0, epsilon: float = 1e-9, levels: int = 1) -> DataFrame:
    """Heat-kernel PageRank truncated at ``levels`` terms, by pushes of residuals that exceed their level's threshold."""
    g = graph.pinned()
    deg = _degrees(g)
    psi = heat_coefficients(t, levels)
    residual = _seed(g, root)
    scores = None
    for j in range(levels):
        bound = math.exp(t) * epsilon / (2.0 * levels * psi[j])
        active = residual.join(deg, "id")
        if j:
            active = active.where(F.col("score") >= F.col("deg") * bound)
        active = durable(active)
        if active.isEmpty():
            break
        now = active.select("id", "score")
        scores = durable(now if scores is None else scores.unionByName(now).groupBy("id").agg(F.sum("score").alias("score")))
        if j + 1 == levels:
            last = _push(g, active, F.col("score") / F.col("deg")).withColumnRenamed("got", "score")
            scores = durable(scores.unionByName(last).groupBy("id").agg(F.sum("score").alias("score")))
            break
        residual = durable(_push(g, active, F.lit(t / (j + 1)) * F.col("score") / F.col("deg")).withColumnRenamed("got", "score"))
    return scores


def heat_walks(graph: Graph, root: int = 0, walks: int = 10, longest: int = 10, t: float = 3.0, seed: int = 1) -> DataFrame:
    """Shares of end points of seeded random walks whose lengths follow a Poisson law of mean t, cut below ``longest``."""
    g = graph.pinned()
    _seed(g, root)
    chance, cumulative, total = math.exp(-t), [], 0.0
    for k in range(longest):
        total += chance
        cumulative.append(total)
        chance *= t / (k + 1)
    lists = durable(g.edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("to")))
    unit = (F.pmod(next64(F.col("walk") + F.lit(seed * 1_000_003)), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("u")
    start = g.spark.range(walks).select(F.col("id").alias("walk")).select("walk", F.lit(root).cast("long").alias("at"), unit)
    length = F.lit(0)
    for c in cumulative[: longest - 1]:
        length = length + F.when(F.col("u") > c, 1).otherwise(0)
    state = durable(start.select("walk", "at", length.alias("length")))
    for step in range(longest):
        pick = F.pmod(next64(F.col("walk") * F.lit(1_000_033) + F.lit(step * 7919 + seed)), F.size("to").cast("long"))
        moved = state.join(lists.hint("merge"), F.col("at") == F.col("src"), "left").select("walk", F.when((F.col("length") > step) & F.col("to").isNotNull(), F.col("to")[pick.cast("int")]).otherwise(F.col("at")).alias("at"), "length")
        following = durable(moved)
        discard(state)
        state = following
    return state.groupBy(F.col("at").alias("id")).agg((F.count(F.lit(1)) / F.lit(float(walks))).alias("score"))


def sweep_table(graph: Graph, scores: DataFrame) -> DataFrame:
    """(rank, id, vol_s, edges_crossing, conductance) for each prefix of the scores by score over degree, ties by id.

    Crossing edges come from +1 and -1 events at ranks, so the work is a sort and running
    sums over the scored vertices.  The sums run in two levels: within ranges, then over the
    range totals.
    """
    g = graph
    deg = g.out_degrees().where("degree > 0")
    rated = scores.where("score > 0").join(deg, "id").select("id", "degree", (F.col("score") / F.col("degree")).alias("_x"))
    ranked = durable(running(rated, [F.desc("_x"), F.col("id")], [], "rank"))
    m = g.edges.count()
    ends = g.edges.where("src <> dst").join(ranked.select(F.col("id").alias("src"), F.col("rank").alias("i")), "src").join(ranked.select(F.col("id").alias("dst"), F.col("rank").alias("k")), "dst", "left")
    later = ends.where(F.col("k").isNull() | (F.col("k") > F.col("i")))
    events = later.select(F.col("i").alias("rank"), F.lit(1).alias("e")).union(later.where("k is not null").select(F.col("k"), F.lit(-1)))
    change = events.groupBy("rank").agg(F.sum("e").alias("_e"))
    rows = ranked.join(change, "rank", "left").select("rank", "id", "degree", F.coalesce("_e", F.lit(0)).alias("_e"))
    summed = running(rows, [F.col("rank")], ["degree", "_e"], "_n")
    least = F.least(F.col("degree_sum"), F.lit(m) - F.col("degree_sum"))
    conductance = F.when((F.col("_e_sum") == 0) | (least <= 0), F.lit(1.0)).otherwise(F.try_divide(F.col("_e_sum"), least).cast("double"))
    return summed.select("rank", "id", F.col("degree_sum").alias("vol_s"), F.col("_e_sum").alias("edges_crossing"), conductance.alias("conductance"), F.lit(m).alias("vol"))


def sweep_cut(graph: Graph, scores: DataFrame, zero_cut_is_best: bool = False) -> DataFrame:
    """One row: conductance, size_s, vol_s, vol, edges_crossing of the best prefix, the earliest at ties."""
    table = sweep_table(graph, scores)
    if zero_cut_is_best:
        table = table.withColumn("conductance", F.when((F.col("edges_crossing") == 0) & (F.col("vol_s") < F.col("vol")), 0.0).otherwise(F.col("conductance")))
    best = table.agg(F.min_by(F.struct("conductance", F.col("rank").alias("size_s"), "vol_s", "vol", "edges_crossing"), F.struct("conductance", "rank")).alias("b"))
    return best.select("b.*")
