"""Component labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.kernels import searches
from weftgraph.model import Graph
from weftgraph.operators import onetask
from weftgraph.operators.stars import star_components
from weftgraph.storage import discard, durable


def propagate(graph: Graph, shortcut: bool = False) -> DataFrame:
    """(id, label): the least id that reaches each vertex along directed edges.

    With ``shortcut``, labels also jump to their label's label after each round.
    """
    rows = onetask.stored(graph)
    if rows is not None:
        found = onetask.run(rows, graph.symmetric, "id long, label long", searches.least_labels)
        return graph.vertices.join(found.hint("merge"), "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    g = graph.pinned()
    state = durable(g.vertices.select("id", F.col("id").alias("label"), F.lit(True).alias("fresh")))
    while True:
        heard = g.edges.join(state.where("fresh").select(F.col("id").alias("src"), "label").hint("merge"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("_new"))
        step = state.join(heard.hint("merge"), "id", "left").select("id", F.least("label", "_new").alias("label"), F.col("label").alias("_old"))
        plain = None
        if shortcut:
            plain = step = durable(step)
            jump = step.select(F.col("id").alias("_at"), F.col("label").alias("_root"))
            step = step.join(jump.hint("merge"), F.col("label") == F.col("_at")).select("id", F.least("label", "_root").alias("label"), "_old")
        following = durable(step.select("id", "label", (F.col("label") < F.col("_old")).alias("fresh")))
        discard(state)
        discard(plain)
        state = following
        if state.where("fresh").isEmpty():
            return state.select("id", "label")


def components(graph: Graph) -> DataFrame:
    """(id, label): the least id of each component; a symmetric graph takes the star contraction, O(log n) rounds."""
    if not graph.symmetric:
        return propagate(graph)
    g = graph.pinned()
    found = star_components(g.edges)
    return g.vertices.join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
