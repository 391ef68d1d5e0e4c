"""Mixing sources to target weights by systematic sampling.

Each source gets a target size; its documents then have equal expected copies (target
over source size).  Within a source the expected copies are prefix-summed, one random
offset is added, and a document is emitted once per integer boundary crossed.  Documents
are ordered by size first, so neighbours are alike and the taken size stays within about
one document of the target, whatever the offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, global_row_number, unit_hash

#: Words as maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
#: Sources up to which their figures are broadcast (and their targets found on the driver): a few MB at most.
SOURCES = 50_000


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill(total: int, rows: list[tuple[float, int]]) -> float | None:
    """The level at which shares of ``level * weight``, stopped at their caps, add up to ``total``; None if all stop.

    ``rows`` holds (weight, cap).  Sources stop in the order of cap over weight, so one sorted pass finds it.
    """
    free, stopped = sum(w for w, _ in rows), 0
    for w, cap in sorted(rows, key=lambda r: r[1] / r[0]):
        level = (total - stopped) / free
        if level * w < cap:
            return level
        free, stopped = free - w, stopped + cap
        if not free:
            break
    return None


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST, bound: int = SOURCES) -> DataFrame:
    """Add ``target`` to one row per source (source, source_size).

    Sources in code-point order, null last, take the weights in turn.  A target stops at
    ``most`` times the source's size; the excess is shared again by weight until no target
    is above.  Up to ``bound`` sources that is one sorted pass; beyond, aggregates until
    nothing changes.
    """
    ranked = global_row_number(sources, F.col("source").isNull(), F.col("source"), name="_rank")
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = durable(ranked.withColumn("_w", F.element_at(table, (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))).withColumn("_cap", F.col("source_size") * most))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    if ranked.count() <= bound:
        level = fill(total, [(r["_w"], r["_cap"]) for r in ranked.select("_w", "_cap").collect()])
    else:
        while True:
            over = F.lit(False) if level is None else F.lit(level) * F.col("_w") >= F.col("_cap")
            n, cap, free = ranked.agg(F.sum(over.cast("long")), F.sum(F.when(over, F.col("_cap")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("_w")))).first()
            if n == capped or not free:
                level = level if free else None
                break
            capped, level = n, (total - (cap or 0)) / free
    cap = F.col("_cap").cast("double")
    return ranked.withColumn("target", cap if level is None else F.least(F.lit(level) * F.col("_w"), cap)).drop("_rank", "_w", "_cap")


def _planned(numbered: DataFrame, weights, most: int, seed: int, bound: int) -> DataFrame:
    """Add source_size, target and copies to numbered rows (g, source, size), which are in the order of the prefix sums."""
    per_source = numbered.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("g").alias("_first"))
    per_source = durable(targets(durable(per_source), weights, most, bound))
    figures = per_source.withColumnRenamed("source", "_s")
    if per_source.count() <= bound:
        rows = numbered.join(F.broadcast(figures), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    else:
        # too many sources to broadcast: the join is salted, since one source may hold a third of all rows
        salts = 16
        spread = figures.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on = F.col("source").eqNullSafe(F.col("_s")) & (F.pmod(F.col("g"), F.lit(salts)).cast("int") == F.col("_salt"))
        rows = numbered.join(spread, on, "left").drop("_s", "_salt")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = unit_hash(F.lit(seed), F.col("source"))
    at = (F.col("g") - F.col("_first")).cast("double")
    crossed = F.floor((at + 1) * rate + offset) - F.floor(at * rate + offset)
    copies = F.when(F.col("size") > 0, F.least(F.greatest(crossed, F.lit(0)), F.lit(most))).otherwise(0).cast("long")
    return rows.withColumn("copies", copies).drop("g", "_first")


def _order(text_hash, *more) -> list:
    """The order of the prefix sums: one global numbering, so that a hot source spreads over many tasks."""
    return [F.col("source").isNull(), F.col("source"), F.col("size").desc(), F.col("doc_id").isNull(), F.col("doc_id"), text_hash, *more]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST, seed: int = 17, bound: int = SOURCES) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken, text_hash.

    Null texts have size 0; the null source is a source of its own; null ids come last in
    their source; repeated rows are documents of their own; documents of size 0 take no
    part in the mix (no copies) since they add no words; a text of any length is one
    document.  An empty table gives an empty result; other columns are ignored.
    """
    text = F.col(text_col)
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_hash"))
    # stored first: the ranges of the numbering are found by a pass of its own, which needn't read the texts
    numbered = global_row_number(durable(sized), *_order(F.col("text_hash")))
    return _planned(numbered, weights, most, seed, bound).withColumn("taken", F.col("copies") * F.col("size"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST, seed: int = 17, bound: int = SOURCES) -> DataFrame:
    """The documents of the mix, each row as often as it is taken, with the columns of ``docs`` whatever their names.

    Edge rows as for ``mix``; rows alike in id, source and text keep their other columns.
    The whole rows are sorted once; none is joined back by its id.
    """
    names = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in names])
    text = F.col(f"`{text_col}`")
    sized = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(text).alias("size"), whole.alias("row"))
    numbered = global_row_number(sized, *_order(F.xxhash64(F.col("row")[text_col]), F.xxhash64("row")))
    taken = _planned(numbered, weights, most, seed, bound).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col("row")[c].alias(c) for c in names])
