"""Exact top-k search by inner product with M-trees.

Vectors are lifted by one coordinate so that all have one length; then the order by inner
product is the reverse order by Euclidean distance, a metric.  The root level of the
search is global: every vector belongs to the nearest of a fixed number of pivots, whose
least and greatest distances to their vectors are known, and a query goes only to the
pivots that its bound doesn't rule out.  A pivot's vectors fill blocks, and each block is a
paged M-tree: a node's entries hold a routing vector, a covering radius and the distance to
the parent's routing vector.  Best-first search takes nodes by their least possible
distance; stored parent distances and radii rule out entries by the triangle inequality
before any distance to them is computed.  Scores are whole numbers and ties are kept, so
the search is exact.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, prepare, trimmed
from .textkernel import reduceat

SCALE = 256
#: Vectors of a block (one tree), queries of a block, entries of a leaf page and of an inner page.
BLOCK, QUERIES, LEAF, FAN = 16384, 256, 256, 32
#: Vectors of the sample that gives pivots and each query's first bound; pivots.
PROBES, PIVOTS = 2048, 32
#: Components and squares beyond it are left out of the metric: nothing is ruled out by them then.
_METRIC = 1e100
#: Bounds of a long, at which scores stop, and the product of squared lengths from which they may.
_LEAST, _MOST, _WIDE = -(1 << 63), (1 << 63) - 1, 2.0**124


class MTree:
    """An M-tree over whole-number vectors, bulk-loaded."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None):
        """``rows`` numbers the vectors (their ids, if not given): a query leaves out the row of its own number."""
        self.ids, self.rows, self.x = ids, ids if rows is None else rows, vectors.astype(np.float64)
        shown = np.clip(self.x, -_METRIC, _METRIC)
        squares = (shown * shown).sum(1)
        self.top = float(squares.max()) if len(ids) else 0.0
        self.exact = self.top * 4 < 2**52  # products of floats are then whole and exact
        self.points = np.concatenate([shown, np.sqrt(np.maximum(self.top - squares, 0))[:, None]], axis=1)
        self.slack = 1e-6 * (1 + math.sqrt(self.top))
        self.nodes: list[tuple] = []  # (leaf, members, parent distances, radii, children)
        self.computed = 0
        self.root = self._build(np.arange(len(ids)), 0) if len(ids) else None

    def _far(self, rows: np.ndarray, to: int) -> np.ndarray:
        gap = self.points[rows] - self.points[to]
        return np.sqrt((gap * gap).sum(1))

    def _build(self, rows: np.ndarray, route: int) -> int:
        if len(rows) <= LEAF:
            self.nodes.append((True, rows, self._far(rows, route), None, None))
            return len(self.nodes) - 1
        rng = np.random.default_rng(len(rows))
        routes = rng.choice(rows, min(FAN, 2 * -(-len(rows) // LEAF)), replace=False)
        p = self.points[rows]
        square = (p * p).sum(1)[:, None] - 2 * p @ self.points[routes].T + (self.points[routes] ** 2).sum(1)
        near = square.argmin(1)
        groups = [(int(routes[k]), rows[near == k]) for k in range(len(routes)) if (near == k).any()]
        if len(groups) == 1:  # alike vectors: cut into pages
            route_of, step = groups[0][0], -(-len(rows) // FAN)
            groups = [(route_of, rows[at : at + step]) for at in range(0, len(rows), step)]
        children = [self._build(group, r) for r, group in groups]
        members = np.array([r for r, _ in groups])
        radii = np.array([self._far(group, r).max() for r, group in groups])
        self.nodes.append((False, members, self._far(members, route), radii, np.array(children)))
        return len(self.nodes) - 1

    def search(self, query: np.ndarray, own: int, k: int, bound: int | None) -> list[tuple[int, int]]:
        """Up to k pairs (score, id) of the highest scores, at least ``bound``, ties to smaller ids; the row ``own`` is left out."""
        if self.root is None:
            return []
        q = query.astype(np.float64)
        shown = np.clip(q, -_METRIC, _METRIC)
        size = float(shown @ shown)
        exact = self.exact and size * 4 < 2**52
        lifted = np.append(shown, 0.0)
        slack = self.slack + 1e-6 * math.sqrt(size)
        best: list[tuple[int, int]] = []  # heap of (score, -id)

        def reach() -> float:
            low = best[0][0] if len(best) == k else bound
            if low is None or size * self.top > _WIDE:  # scores may stop at a long's bounds: ties there need all
                return math.inf
            if bound is not None:
                low = max(low, bound)
            return math.sqrt(max(size + self.top - 2.0 * low, 0.0)) + slack

        gap = self.points[0] - lifted
        limit = reach()
        heap = [(0.0, self.root, math.sqrt(float(gap @ gap)))]  # least distance, node, distance to its routing vector
        while heap:
            least, node, parent = heapq.heappop(heap)
            if least > limit:
                break
            leaf, members, away, radii, children = self.nodes[node]
            if leaf:
                rows = members[np.abs(parent - away) <= limit]
                if not len(rows):
                    continue
                self.computed += len(rows)
                if exact:
                    scores = np.rint(self.x[rows] @ q).astype(np.int64)
                else:
                    scores = products(self.x[rows], q)
                floor = best[0][0] if len(best) == k else bound
                hits = np.arange(len(rows)) if floor is None else np.flatnonzero(scores >= floor)
                ranked = hits[np.lexsort((self.ids[rows[hits]], -scores[hits]))] if exact else sorted(hits, key=lambda h: (-scores[h], self.ids[rows[h]]))
                for at in ranked:
                    if self.rows[rows[at]] == own:
                        continue
                    item = int(scores[at]), -int(self.ids[rows[at]])
                    if bound is not None and item[0] < bound:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                    else:
                        break
                limit = reach()
            else:
                maybe = np.flatnonzero(np.abs(parent - away) - radii <= limit)
                if not len(maybe):
                    continue
                self.computed += len(maybe)
                gap = self.points[members[maybe]] - lifted
                far = np.sqrt((gap * gap).sum(1))
                low = np.maximum(far - radii[maybe], least)
                for at in np.flatnonzero(low <= limit):
                    heapq.heappush(heap, (float(low[at]), int(children[maybe[at]]), float(far[at])))
        return sorted(((s, -i) for s, i in best), key=lambda p: (-p[0], p[1]))


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers with one, by Python's integers; they stop at the bounds of a long."""
    other = [int(v) for v in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, other)), _LEAST), _MOST) for row in x.tolist()], object)


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, square) with v the whole numbers floor(SCALE * x) as doubles, which hold them exactly; rows that take no part are dropped."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            width = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            with np.errstate(over="ignore"):
                whole = np.floor(SCALE * flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False))
            ends = np.concatenate([[0], np.cumsum(width)])
            good = reduceat(np.logical_and, np.isfinite(whole), ends, True) & ids.is_valid().to_numpy(zero_copy_only=False) & lists.is_valid().to_numpy(zero_copy_only=False)
            squares = reduceat(np.add, np.clip(whole, -_METRIC, _METRIC) ** 2, ends, 0.0)
            out = [whole[a:b].tobytes() for a, b in zip(ends[:-1][good], ends[1:][good])]
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), pa.array(out, pa.binary()), pa.array(squares[good])], ["vec_id", "v", "square"])

    return table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(trimmed(run), "vec_id long, v binary, square double")


def _stack(values: list[bytes], width: int | None = None) -> np.ndarray:
    """Rows of equal width; shorter vectors are filled with zeros, which add nothing to a product."""
    width = max([width or 0, *(len(v) // 8 for v in values)])
    if all(len(v) == 8 * width for v in values):
        return np.frombuffer(b"".join(values), np.float64).reshape(len(values), width)
    out = np.zeros((len(values), width))
    for k, v in enumerate(values):
        out[k, : len(v) // 8] = np.frombuffer(v, np.float64)
    return out


class Pivots:
    """The root of the search: pivots in lifted space, and how near and far their vectors are."""

    def __init__(self, probes: np.ndarray, top: float, most: int = PIVOTS):
        self.top, self.width = top, probes.shape[1]
        probes = np.clip(probes, -_METRIC, _METRIC)
        points = self.lift(probes, (probes * probes).sum(1))
        rng = np.random.default_rng(4)
        picked = [0] if len(points) else []
        gap = self._gaps(points, points[picked])[:, 0] if picked else np.zeros(0)
        while len(picked) < min(most, len(points)) and gap.max() > 0:
            # far from those picked, but where many are
            picked.append(int(rng.choice(len(points), p=gap**2 / (gap**2).sum())))
            gap = np.minimum(gap, self._gaps(points, points[picked[-1:]])[:, 0])
        self.points = points[picked]
        self.near, self.far = np.zeros(len(picked)), np.full(len(picked), math.inf)

    def lift(self, x: np.ndarray, squares: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.top - squares, 0))[:, None]], axis=1)

    @staticmethod
    def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0))

    def fit_width(self, x: np.ndarray) -> np.ndarray:
        """Rows cut or filled to the pivots' width; what is cut is counted in the lifted coordinate's place by ``gaps``."""
        return x[:, : self.width] if x.shape[1] >= self.width else np.pad(x, ((0, 0), (0, self.width - x.shape[1])))

    def gaps(self, x: np.ndarray, lifted: np.ndarray) -> np.ndarray:
        """Distances of rows (with their last coordinates) to the pivots."""
        x = np.clip(x, -_METRIC, _METRIC)
        shown = self.fit_width(x)
        rest = (x[:, self.width :] ** 2).sum(1) if x.shape[1] > self.width else np.zeros(len(x))
        return np.sqrt(self._gaps(np.concatenate([shown, lifted[:, None]], axis=1), self.points) ** 2 + rest[:, None])

    def wanted(self, queries: np.ndarray, bounds: list[int | None]) -> np.ndarray:
        """(queries, pivots): whether a vector of the pivot may reach the query's bound."""
        gaps = self.gaps(queries, np.zeros(len(queries)))
        size = (np.clip(queries, -_METRIC, _METRIC) ** 2).sum(1)
        low = np.array([-math.inf if b is None else float(b) for b in bounds])
        reach = np.sqrt(np.maximum(size + self.top - 2 * low, 0)) + 1e-6 * (1 + math.sqrt(self.top) + np.sqrt(size))
        open_ = size[:, None] * self.top > _WIDE
        return open_ | ((gaps - self.far <= reach[:, None]) & (self.near - gaps <= reach[:, None]))


def top_k(table: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) with the k highest scores for each row that ``is_query`` admits (a condition on vec_id).

    Vectors that are null or hold null or non-finite components (before or after scaling),
    and rows with a null id, take no part.  Products are exact for components of any size; a
    score beyond a long counts as the nearest long.  Vectors of unequal length are
    compared as if filled with zeros.  Each row is a query and a candidate of its own, whatever
    its id: only the query's own row is left out, repeated rows are found.  Ties fall to the
    smaller id.  An empty table gives an empty result; other columns are ignored.

    The queries are a stated set against all rows: each batch of queries meets, block by
    block, the vectors of the pivots that its bounds (from a fixed sample) leave open, and
    each block returns at most k rows a query.
    """
    spark = table.sparkSession
    prepare(spark)
    vectors = durable(whole_vectors(table, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()))
    top = float(vectors.agg(F.max("square")).first()[0] or 0.0)
    # a bounded sample by hash of the row
    probes = vectors.orderBy(F.xxhash64("row", F.lit(9)), "row").limit(PROBES).collect()
    probe_rows, sample = np.array([r.row for r in probes], np.int64), _stack([bytes(r.v) for r in probes])
    root = Pivots(sample, top)
    shipped = spark.sparkContext.broadcast(root)  # PIVOTS vectors

    def assign(batches):
        """Each vector's pivot and its distance to it."""
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _stack(part.column(1).to_pylist(), shipped.value.width)
                gaps = shipped.value.gaps(x, np.sqrt(np.maximum(top - part.column(2).to_numpy(), 0)))
                near = gaps.argmin(1) if gaps.shape[1] else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(near.astype(np.int32)), pa.array(gaps[np.arange(len(x)), near])], ["vec_id", "v", "row", "pivot", "gap"])

    held = durable(vectors.select("vec_id", "v", "square", "row").mapInArrow(trimmed(assign), "vec_id long, v binary, row long, pivot int, gap double"))
    spans = {r.pivot: r for r in held.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high")).collect()}
    blocks = [-(-spans[p].n // block) if p in spans else 0 for p in range(len(root.points))]
    first = np.concatenate([[0], np.cumsum(blocks)]).astype(int).tolist()
    root.near = np.array([spans[p].low if p in spans else math.inf for p in range(len(root.points))])
    root.far = np.array([spans[p].high if p in spans else -math.inf for p in range(len(root.points))])

    def pack(batches):
        """Batches of queries with their first bounds, once for each pivot that some of them need."""
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                ids, rows = part.column(0).to_pylist(), part.column(2).to_numpy()
                q = _stack(part.column(1).to_pylist(), sample.shape[1])
                full = sample if sample.shape[1] == q.shape[1] else np.pad(sample, ((0, 0), (0, q.shape[1] - sample.shape[1])))
                bounds: list[int | None] = [None] * len(rows)
                if len(full) > k:
                    # floats may be off in the last digits: a bound is lowered by what they may be off
                    with np.errstate(over="ignore", invalid="ignore"):
                        scores = q @ full.T
                        off = 1e-9 * (np.abs(q) @ np.abs(full).max(0)) + 1
                    scores[rows[:, None] == probe_rows[None, :]] = -np.inf
                    kth = np.partition(scores, -k, axis=1)[:, -k]
                    bounds = [min(math.floor(b), _MOST) if math.isfinite(b) else None for b in kth - off]
                wanted = root.wanted(q, bounds)
                for p in range(wanted.shape[1]):
                    chosen = np.flatnonzero(wanted[:, p])
                    if len(chosen) and blocks[p]:
                        out = [{"row": int(rows[c]), "id": ids[c], "low": None if bounds[c] is None else float(bounds[c]), "v": q[c].tobytes()} for c in chosen]
                        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([out], pa.list_(asked_type))], ["pivot", "queries"])

    asked_type = pa.struct([("row", pa.int64()), ("id", pa.int64()), ("low", pa.float64()), ("v", pa.binary())])
    asked_schema = "array<struct<row: long, id: long, low: double, v: binary>>"
    firsts, lasts = (F.array(*[F.lit(int(v)) for v in values]) if len(root.points) else F.array(F.lit(0)) for values in (first[:-1], [b - 1 for b in first[1:]]))
    packed = vectors.where(is_query).select("vec_id", "v", "row").mapInArrow(trimmed(pack), f"pivot int, queries {asked_schema}")
    asked = packed.select(F.explode(F.sequence(F.element_at(firsts, F.col("pivot") + 1), F.element_at(lasts, F.col("pivot") + 1))).alias("block"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("binary").alias("v"), "queries")
    # row numbers, not ids, spread a pivot's vectors over its blocks: no value can make a block large
    sizes = F.array(*[F.lit(max(1, int(b))) for b in blocks]) if blocks else F.array(F.lit(1))
    place = F.element_at(firsts, F.col("pivot") + 1) + F.pmod(F.xxhash64("row"), F.element_at(sizes, F.col("pivot") + 1)).cast("int")
    stored = held.select(place.alias("block"), F.lit(0).alias("kind"), "vec_id", "row", "v", F.lit(None).cast(asked_schema).alias("queries"))

    def search(batches):
        current, ids, numbers, rows, tree = None, [], [], [], None
        for batch in batches:
            found: list[tuple[int, int, int, int]] = []
            for b, kind, vec_id, number, v, queries in zip(*(c.to_pylist() for c in batch.columns)):
                if b != current:
                    current, ids, numbers, rows, tree = b, [], [], [], None
                if kind == 0:
                    ids.append(vec_id)
                    numbers.append(number)
                    rows.append(v)
                    continue
                width = max(len(q["v"]) // 8 for q in queries)
                if tree is None or tree.x.shape[1] < width:
                    tree = MTree(np.array(ids, np.int64), _stack(rows, width), np.array(numbers, np.int64))
                for q in queries:
                    row = _stack([q["v"]], tree.x.shape[1])[0]
                    low = None if q["low"] is None else min(int(q["low"]), _MOST)
                    found += [(q["row"], q["id"], i, s) for s, i in tree.search(row, q["row"], k, low)]
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(4)], ["query", "query_id", "vec_id", "score"])

    met = stored.unionByName(asked).repartition(F.col("block")).sortWithinPartitions("block", "kind")
    pairs = met.mapInArrow(trimmed(search), "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
