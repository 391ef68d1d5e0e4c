"""The registered queries, one per operator, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import generators as gen
from weftgraph.algorithms import clustering, components, cores, eccentricity, hypergraphs, ranking, traversal
from weftgraph.model import Graph
from weftgraph.operators import buckets, edgemap, hyper, sequences
from weftgraph.sources import codecs, text
from weftgraph.storage import durable, shared_dir

from . import recursive_sql as rsql
from .tables import CO45, NN, OP, OP45, PS, big_orders, co45, load, nations, orders_parts, parts_suppliers, supplies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name, with its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def small_parts(spark: SparkSession, d: str) -> DataFrame:
    """The frontier of the single-step queries: parts of size up to 10."""
    return load(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size"))


FRONTIER = "f AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size <= 10)"

# ---- frontier operators -------------------------------------------------------------------

_STEP = f"""WITH {CO45}, {FRONTIER} SELECT v AS id, min(u) AS parent, CAST(sum(w + size) AS BIGINT) AS total
 FROM e JOIN f ON f.id = e.u WHERE v NOT IN (SELECT id FROM f) GROUP BY v"""


def _step(strategy: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        front = small_parts(spark, d)
        return edgemap.edge_map(co45(spark, d), front, {"parent": "min(src)", "total": "sum(w + s_size)"}, state=front, cond="d_size is null", strategy=strategy)

    return run


for _name, _strategy in (("c01_edge_map_data", "auto"), ("c03_edge_map_dense", "dense"), ("c04_edge_map_dense_forward", "dense_forward"), ("c05_edge_map_sparse", "sparse"), ("c06_edge_map_sparse_no_filter", "sparse_no_filter")):
    query(_name, _STEP)(_step(_strategy))


@query("c02_edge_map", f"WITH {CO45}, {FRONTIER} SELECT DISTINCT v AS id FROM e JOIN f ON f.id = e.u")
def c02(spark, d):
    return edgemap.edge_map(co45(spark, d), small_parts(spark, d))


@query("c07_pack_edges", f"WITH {CO45}, {FRONTIER} SELECT u AS src, v AS dst, w FROM e WHERE u NOT IN (SELECT id FROM f) OR w >= 95")
def c07(spark, d):
    return edgemap.pack_edges(co45(spark, d), small_parts(spark, d), "w >= 95")[0].edges


@query("c08_edge_map_filter", f"WITH {CO45}, {FRONTIER} SELECT f.id, count(e.u) AS degree FROM f LEFT JOIN e ON e.u = f.id AND w >= 95 GROUP BY f.id")
def c08(spark, d):
    return edgemap.edge_map_filter(co45(spark, d), small_parts(spark, d), "w >= 95")


@query("c09_vertex_map", f"WITH {FRONTIER} SELECT p_partkey AS id, CAST(CASE WHEN f.id IS NOT NULL THEN p_size * 2 ELSE p_size END AS BIGINT) AS x FROM part LEFT JOIN f ON f.id = p_partkey")
def c09(spark, d):
    state = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("x"))
    return edgemap.vertex_map(state, small_parts(spark, d), x="x * 2")


@query("c10_vertex_filter", f"WITH {FRONTIER} SELECT f.id FROM f JOIN part ON p_partkey = f.id WHERE p_retailprice > 950")
def c10(spark, d):
    state = load(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_retailprice")
    return edgemap.vertex_filter(small_parts(spark, d).select("id"), "p_retailprice > 950", state)


@query("c11_vertex_filter_payload", f"WITH {FRONTIER} SELECT id, size FROM f WHERE size + id > 500")
def c11(spark, d):
    return edgemap.vertex_filter(small_parts(spark, d), "size + id > 500")


@query("c12_edge_map_reduce", f"WITH {CO45}, {FRONTIER} SELECT id, value FROM (SELECT v AS id, CAST(sum(w) AS BIGINT) AS value FROM e JOIN f ON f.id = e.u GROUP BY v) WHERE value >= 150")
def c12(spark, d):
    return edgemap.edge_map_reduce(co45(spark, d), small_parts(spark, d), "w", "sum", "case when value >= 150 then value end")


@query("c13_edge_map_count_ps", "SELECT l_partkey AS id, count(DISTINCT l_suppkey) AS value FROM lineitem GROUP BY 1")
def c13(spark, d):
    g = parts_suppliers(spark, d)
    return edgemap.edge_map_count(g, load(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


@query("c14_edge_map_induced", f"WITH {CO45}, {FRONTIER} SELECT v AS id, u * 100 + w AS value FROM e JOIN f ON f.id = e.u")
def c14(spark, d):
    return edgemap.edge_map_induced(co45(spark, d), small_parts(spark, d), "src * 100 + w")


@query("c15_transpose", f"WITH {NN} SELECT v AS src, u AS dst, count(*) AS edges FROM e GROUP BY 1, 2")
def c15(spark, d):
    return nations(spark, d).transpose().edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("edges"))


@query(
    "c16_user_functions",
    f"""WITH {CO45}, {FRONTIER} SELECT v AS id, min(size + w) AS best FROM e JOIN f ON f.id = e.u JOIN part ON p_partkey = v
 WHERE w <= 95 AND p_size > 10 GROUP BY v, p_size HAVING min(size + w) < p_size + 80""",
)
def c16(spark, d):
    state = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size"))
    out = edgemap.edge_map(co45(spark, d), small_parts(spark, d), {"best": "min(s_size + w)"}, state=state, where="w <= 95", cond="d_size > 10", changed="best < d_size + 80")
    return out.select("id", "best")


@query("c17_flags", f"WITH {CO45}, {FRONTIER} SELECT CAST(0 AS BIGINT) AS none, count(DISTINCT v) AS rows FROM e JOIN f ON f.id = e.u")
def c17(spark, d):
    g, front = co45(spark, d), small_parts(spark, d)
    none = edgemap.edge_map(g, front, no_output=True).agg(F.count(F.lit(1)).alias("none"))
    return none.join(F.broadcast(edgemap.remove_duplicates(edgemap.edge_map_induced(g, front).select("id")).agg(F.count(F.lit(1)).alias("rows"))))  # one row each


@query("c18_remove_duplicates", f"WITH {CO45}, {FRONTIER} SELECT v AS id, min(u) AS value FROM e JOIN f ON f.id = e.u GROUP BY v")
def c18(spark, d):
    return edgemap.remove_duplicates(edgemap.edge_map_induced(co45(spark, d), small_parts(spark, d)))


@query("c19_vertex_subset", "SELECT p_partkey AS id, p_size <= 10 AS member FROM part")
def c19(spark, d):
    return edgemap.to_dense(co45(spark, d), small_parts(spark, d))


@query("c20_neighbour_lists", f"WITH {CO45} SELECT n.id, count(v) AS degree, coalesce(string_agg(CAST(v AS VARCHAR), ',' ORDER BY v), '') AS neighbours FROM n LEFT JOIN e ON e.u = n.id GROUP BY n.id")
def c20(spark, d):
    lists = edgemap.neighbours(co45(spark, d))
    return lists.select("id", F.size("neighbours").cast("long").alias("degree"), F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query("c21_edge_map_outputs", f"WITH {CO45}, {FRONTIER} SELECT v AS id, count(*) AS n, max(w) AS w FROM e JOIN f ON f.id = e.u GROUP BY v")
def c21(spark, d):
    return edgemap.edge_map(co45(spark, d), small_parts(spark, d), {"n": "count(1)", "w": "max(w)"})


# ---- buckets --------------------------------------------------------------------------------

_BUCKETS = f"WITH {CO45}, b AS (SELECT n.id, CASE WHEN count(v) > 0 THEN CAST(count(v) // 2 AS BIGINT) END AS bkt FROM n LEFT JOIN e ON e.u = n.id GROUP BY n.id)"


def _degree_buckets(spark, d):
    return buckets.make_buckets(co45(spark, d).out_degrees(), "case when degree > 0 then degree div 2 end")


@query("b01_make_buckets", _BUCKETS + " SELECT id, bkt FROM b")
def b01(spark, d):
    return _degree_buckets(spark, d)


@query("b02_next_bucket", _BUCKETS + " SELECT id, bkt FROM b WHERE bkt = (SELECT max(bkt) FROM b)")
def b02(spark, d):
    return buckets.next_bucket_rows(_degree_buckets(spark, d), increasing=False)


@query("b04_update_buckets", _BUCKETS + f", {FRONTIER} SELECT b.id, CASE WHEN f.id IS NOT NULL THEN CASE WHEN size > 3 THEN size END ELSE bkt END AS bkt FROM b LEFT JOIN f ON f.id = b.id")
def b04(spark, d):
    return buckets.update_buckets(_degree_buckets(spark, d), small_parts(spark, d).select("id", F.when(F.col("size") > 3, F.col("size")).alias("bkt")))


# ---- hypergraph operators -------------------------------------------------------------------


def urgent_orders(spark, d):
    return load(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))


_URGENT = "g AS (SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT')"


@query("h01_vertex_prop", f"WITH {OP}, {FRONTIER} SELECT h AS id, min(v) AS low, CAST(sum(size) AS BIGINT) AS total FROM i JOIN f ON f.id = v GROUP BY h")
def h01(spark, d):
    return hyper.vertex_prop(orders_parts(spark, d), small_parts(spark, d), {"low": "min(src)", "total": "sum(s_size)"})


@query("h02_hyperedge_prop", f"WITH {OP}, {_URGENT} SELECT v AS id, min(h) AS low FROM i JOIN g ON g.id = h GROUP BY v")
def h02(spark, d):
    return hyper.hyperedge_prop(orders_parts(spark, d), urgent_orders(spark, d), {"low": "min(src)"})


@query("h03_bipartite_strategies", f"WITH {OP}, {_URGENT} SELECT v AS id, min(h) AS low FROM i JOIN g ON g.id = h GROUP BY v")
def h03(spark, d):
    return hyper.hyperedge_prop(orders_parts(spark, d), urgent_orders(spark, d), {"low": "min(src)"}, strategy="sparse")


@query("h04_hyperedge_filter", "SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000")
def h04(spark, d):
    state = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return hyper.hyperedge_filter(urgent_orders(spark, d), "o_totalprice > 100000", state)


@query("h05_hyperedge_filter_ngh", f"WITH {OP}, {_URGENT} SELECT h, v FROM i WHERE h NOT IN (SELECT id FROM g) OR v >= 100")
def h05(spark, d):
    return hyper.hyperedge_filter_ngh(orders_parts(spark, d), urgent_orders(spark, d), "dst >= 100")[0].h2v


@query("h06_induced", f"WITH {OP}, {_URGENT} SELECT v AS id, h AS value FROM i JOIN g ON g.id = h")
def h06(spark, d):
    return hyper.induced(orders_parts(spark, d), "h", urgent_orders(spark, d))


@query("h07_prop_reduce", f"WITH {OP}, {FRONTIER} SELECT h AS id, max(v) AS value FROM i JOIN f ON f.id = v GROUP BY h")
def h07(spark, d):
    return hyper.prop_reduce(orders_parts(spark, d), "v", small_parts(spark, d), "src", "max")


@query("h08_prop_count", f"WITH {OP}, {_URGENT} SELECT v AS id, count(*) AS value FROM i JOIN g ON g.id = h GROUP BY v")
def h08(spark, d):
    return hyper.hyperedge_prop_count(orders_parts(spark, d), urgent_orders(spark, d))


@query("h09_transpose", f"WITH {OP} SELECT v, h FROM i")
def h09(spark, d):
    return orders_parts(spark, d).transpose().v2h


# ---- sequence primitives --------------------------------------------------------------------


@query("p01_reduce", "SELECT CAST(sum(o_custkey) AS BIGINT) AS value FROM orders")
def p01(spark, d):
    return sequences.reduce(load(spark, d, "orders"), "o_custkey")


@query("p02_scan", "SELECT o_orderkey, CAST(sum(o_custkey) OVER (ORDER BY o_orderkey) - o_custkey AS BIGINT) AS value FROM orders")
def p02(spark, d):
    return sequences.scan(load(spark, d, "orders"), "o_orderkey", "o_custkey")


@query("p02_scan_backward", "SELECT o_orderkey, CAST(sum(o_custkey) OVER (ORDER BY o_orderkey DESC) AS BIGINT) AS value FROM orders")
def p02b(spark, d):
    return sequences.scan(load(spark, d, "orders"), "o_orderkey", "o_custkey", inclusive=True, backward=True)


@query("p03_pack_index", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def p03(spark, d):
    return sequences.pack_index(load(spark, d, "orders"), "o_orderkey", "o_orderstatus = 'F'")


@query("p04_map_reduce", "SELECT max(l_partkey * 1000 + l_suppkey) AS value FROM lineitem WHERE l_returnflag = 'R'")
def p04(spark, d):
    return sequences.map_reduce(sequences.pack(load(spark, d, "lineitem"), "l_returnflag = 'R'"), "l_partkey * 1000 + l_suppkey", "max")


@query("p05_histogram", "SELECT l_suppkey AS key, CAST(sum(l_partkey) AS BIGINT) AS value FROM lineitem GROUP BY 1")
def p05(spark, d):
    return sequences.histogram(load(spark, d, "lineitem"), "l_suppkey", "sum", "l_partkey")


@query("p06_count_sort", "SELECT key, CAST(sum(c) OVER (ORDER BY key) - c AS BIGINT) AS \"offset\" FROM (SELECT o_custkey AS key, count(*) AS c FROM orders GROUP BY 1)")
def p06(spark, d):
    return sequences.bucket_offsets(load(spark, d, "orders"), "o_custkey")


@query("p07_integer_sort", "SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS position, o_custkey, o_orderkey FROM orders")
def p07(spark, d):
    return sequences.integer_sort(load(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("p08_sample_sort", "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS n, o_totalprice, o_orderkey FROM orders")
def p08(spark, d):
    return sequences.running(load(spark, d, "orders").select("o_totalprice", "o_orderkey"), [F.col("o_totalprice"), F.col("o_orderkey")])


@query("p09_binary_search", "SELECT c_custkey AS probe, (SELECT count(*) FROM orders WHERE o_custkey < c_custkey) AS position FROM customer")
def p09(spark, d):
    return sequences.lower_bound(load(spark, d, "orders"), "o_custkey", load(spark, d, "customer"), "c_custkey")


@query("p10_write_min", "SELECT l_partkey AS key, min(l_orderkey) AS value FROM lineitem GROUP BY 1")
def p10(spark, d):
    return sequences.histogram(load(spark, d, "lineitem"), "l_partkey", "min", "l_orderkey")


@query("p11_write_or", "SELECT l_partkey AS key, bit_or(l_suppkey) AS value FROM lineitem GROUP BY 1")
def p11(spark, d):
    return sequences.histogram(load(spark, d, "lineitem"), "l_partkey", "bit_or", "l_suppkey")


_MIX = [("0x7ED55D16", 12), ("0xC761C23C", -19), ("0x165667B1", 5), ("0xD3A2646C", 9), ("0xFD7046C5", 3), ("0xB55A4F09", -16)]


def _mix_sql(x: str) -> str:
    """Nested SQL of the 32-bit mix."""
    wide = 4294967296
    for k, (c, s) in enumerate(_MIX):
        c = int(c, 16)
        moved = f"((a * {1 << s}) % {wide})" if s > 0 else f"(a >> {-s})"
        body = f"((a + {c}) % {wide} + {moved}) % {wide}" if k in (0, 2, 4) else f"xor((a + {c}) % {wide}, {moved})" if k == 3 else f"xor(xor(a, {c}), {moved})"
        x = f"(SELECT {body} AS a, id FROM {x})" if k else f"(SELECT {body} AS a, id FROM (SELECT o_orderkey AS a, o_orderkey AS id FROM orders))"
    return x


@query("p12_hash", f"SELECT id, CAST(a AS BIGINT) AS value FROM {_mix_sql('orders')}")
def p12(spark, d):
    from weftgraph.functions.hashing import hash32

    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), hash32(F.col("o_orderkey")).alias("value"))


@query("p14_additive_set", "SELECT c_custkey AS id, CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def p14(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("value"))
    return sequences.AdditiveSet(rows).find(load(spark, d, "customer").select(F.col("c_custkey").alias("id")))


@query("p15_keyed_add", "SELECT l_suppkey AS id, count(*) + CAST(sum(l_partkey) AS BIGINT) AS value FROM lineitem GROUP BY 1")
def p15(spark, d):
    items = load(spark, d, "lineitem")
    first = sequences.AdditiveSet(items.select(F.col("l_suppkey").alias("id"), F.lit(1).cast("long").alias("value")))
    return first.insert(items.select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("value"))).entries()


@query("p16_append", "SELECT c_nationkey AS x FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def p16(spark, d):
    return sequences.append([load(spark, d, "customer").select(F.col("c_nationkey").alias("x")), load(spark, d, "supplier").select(F.col("s_nationkey").alias("x"))])


# ---- algorithms -----------------------------------------------------------------------------

_BFS = f"""WITH RECURSIVE {CO45}, b(id, lvl) USING KEY (id) AS (SELECT CAST(0 AS BIGINT), 0 UNION
 SELECT e.v, min(b.lvl) + 1 FROM b JOIN e ON e.u = b.id LEFT JOIN recurring.b r ON r.id = e.v WHERE r.id IS NULL GROUP BY e.v)"""
_BFS_OUT = _BFS + """ SELECT n.id, CASE WHEN n.id = 0 THEN 0 ELSE p.parent END AS parent, b.lvl AS level FROM n LEFT JOIN b ON b.id = n.id
 LEFT JOIN (SELECT y.id, min(x.id) AS parent FROM b y JOIN e ON e.v = y.id JOIN b x ON x.id = e.u AND x.lvl = y.lvl - 1 GROUP BY y.id) p ON p.id = n.id"""


@query("a01_bfs_co45", _BFS_OUT)
def a01(spark, d):
    return traversal.bfs(co45(spark, d), 0)


@query("a02_bfs_bitvector_co45", _BFS + " SELECT n.id, b.id IS NOT NULL AS reached FROM n LEFT JOIN b ON b.id = n.id")
def a02(spark, d):
    return traversal.bfs(co45(spark, d), 0).select("id", F.col("level").isNotNull().alias("reached"))


_CC = f"""WITH RECURSIVE {CO45}, cc(id, label) USING KEY (id) AS (SELECT id, id FROM n UNION
 SELECT e.v, min(cc.label) FROM cc JOIN e ON e.u = cc.id JOIN recurring.cc r ON r.id = e.v WHERE cc.label < r.label GROUP BY e.v) SELECT id, label FROM cc"""


@query("a03_bfs_components_co45", _CC)
def a03(spark, d):
    return components.propagate(co45(spark, d))


@query("a04_dependency_co45", rsql.dependency(CO45))
def a04(spark, d):
    return traversal.dependency(co45(spark, d), 0).select("id", "sigma", F.round(F.col("score") + rsql.OFF_6, 6).alias("score"))


_SSSP = f"""WITH RECURSIVE {CO45}, s(id, d) USING KEY (id) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION
 SELECT e.v, min(s.d + e.w) FROM s JOIN e ON e.u = s.id LEFT JOIN recurring.s r ON r.id = e.v WHERE r.id IS NULL OR s.d + e.w < r.d GROUP BY e.v)"""


@query("a05_shortest_paths_co45", _SSSP + " SELECT n.id, s.d AS dist, false AS negative_cycle FROM n LEFT JOIN s ON s.id = n.id")
def a05(spark, d):
    return traversal.shortest_paths(co45(spark, d), 0)


@query(
    "a06_factorize_co45",
    f"""WITH {CO45}, g AS (SELECT v, sum((w - 1.0) * 0.5) AS g FROM e GROUP BY v)
 SELECT n.id, round(0.5 + 3.5e-7 * (-0.001 * 0.5 + coalesce(g, 0)), 9) AS x FROM n LEFT JOIN g ON g.v = n.id""",
)
def a06(spark, d):
    # one step of four equal coordinates of 0.5: each product of two vectors is 1
    return ranking.factorize(co45(spark, d), k=4, num_iter=1).select("id", F.round(F.col("latent")[0], 9).alias("x"))


@query("a07_components_co45", _CC)
def a07(spark, d):
    return components.components(co45(spark, d))


@query("a08_components_shortcut_co45", _CC)
def a08(spark, d):
    return components.propagate(co45(spark, d), shortcut=True)


_CORE = f"""WITH RECURSIVE {CO45}, k(id, c) USING KEY (id) AS (SELECT id, (SELECT count(*) FROM e WHERE u = id) FROM n UNION
 SELECT h.u, h.h FROM (SELECT u, max(least(rn, c)) AS h FROM (SELECT e.u, r.c, row_number() OVER (PARTITION BY e.u ORDER BY r.c DESC) AS rn
 FROM e JOIN recurring.k r ON r.id = e.v) GROUP BY u) h JOIN recurring.k o ON o.id = h.u WHERE h.h < o.c) SELECT id, CAST(c AS INTEGER) AS value FROM k"""


@query("a09_kcore_co45", _CORE)
def a09(spark, d):
    return cores.kcore(co45(spark, d))


@query(
    "a10_independent_set_co45",
    f"""WITH RECURSIVE {CO45}, m(id, st) USING KEY (id) AS (SELECT id, 0 FROM n UNION SELECT id, st2 FROM (
 SELECT k.id, CASE WHEN EXISTS (SELECT 1 FROM e JOIN recurring.m x ON x.id = e.v WHERE e.u = k.id AND x.st = 1) THEN 2
  WHEN NOT EXISTS (SELECT 1 FROM e JOIN recurring.m x ON x.id = e.v WHERE e.u = k.id AND x.st = 0 AND e.v < k.id) THEN 1 ELSE 0 END AS st2
 FROM recurring.m k WHERE k.st = 0) WHERE st2 <> 0) SELECT id, st = 1 AS in_set FROM m""",
)
def a10(spark, d):
    return cores.maximal_independent_set(co45(spark, d))


def _pagerank_sql(rounds: int) -> str:
    ctes = [CO45, "c AS (SELECT count(*) AS n FROM n)", "g AS (SELECT u, count(*) AS d FROM e GROUP BY u)", "p0 AS (SELECT id, 1.0 / n AS p FROM n, c)".replace("FROM n, c", "FROM n CROSS JOIN c")]
    for k in range(rounds):
        ctes.append(f"p{k + 1} AS (SELECT n.id, 0.85 * coalesce(s.x, 0) + 0.15 / c.n AS p FROM n CROSS JOIN c LEFT JOIN (SELECT e.v, sum(p / d) AS x FROM e JOIN p{k} ON p{k}.id = e.u JOIN g ON g.u = e.u GROUP BY e.v) s ON s.v = n.id)")
    return "WITH " + ", ".join(ctes) + f" SELECT p{rounds}.id, round(p * n, 6) AS score FROM p{rounds} CROSS JOIN c".replace("round(p * n, 6)", "round(p * c.n, 6)")


@query("a11_pagerank_co45_10it", _pagerank_sql(10))
def a11(spark, d, graph=co45):
    g = graph(spark, d)
    return ranking.pagerank(g, max_iters=10).select("id", F.round(F.col("score") * F.lit(float(g.n)), 6).alias("score"))


@query("a12_pagerank_delta_co45", rsql.pagerank_delta(CO45))
def a12(spark, d):
    g = co45(spark, d)
    return ranking.pagerank_delta(g).select("id", F.round(F.col("score") * F.lit(float(g.n)), 6).alias("score"))


_MULTI = f"""WITH RECURSIVE {CO45}, q AS (SELECT id FROM n ORDER BY id LIMIT 64),
 b(s, id, lvl) USING KEY (s, id) AS (SELECT id, id, 0 FROM q UNION
 SELECT b.s, e.v, min(b.lvl) + 1 FROM b JOIN e ON e.u = b.id LEFT JOIN recurring.b r ON r.id = e.v AND r.s = b.s WHERE r.id IS NULL GROUP BY b.s, e.v)"""


@query("a13_radii_co45", _MULTI + " SELECT n.id, CAST(max(lvl) AS INTEGER) AS value FROM n LEFT JOIN b ON b.id = n.id GROUP BY n.id")
def a13(spark, d):
    # the 64 sources are the smallest ids, so that SQL can name them
    return traversal.bit_radii(co45(spark, d), [r.id for r in co45(spark, d).vertices.orderBy("id").limit(64).collect()])


@query("a13_radii_hashed_co45", rsql.radii(CO45))
def a13h(spark, d):
    return traversal.radii(co45(spark, d))


_TRI = f"{CO45}, t AS (SELECT z.u AS z FROM e z JOIN e y ON y.u = z.v JOIN e x ON x.u = z.u AND x.v = y.v WHERE z.u > z.v AND y.u > y.v)"


@query("a14_triangles_co45", f"WITH {_TRI} SELECT count(*) AS triangles FROM t")
def a14(spark, d):
    return cores.triangles(co45(spark, d))


@query("a14_triangles_per_vertex_co45", f"WITH {_TRI} SELECT n.id, count(z) AS triangles FROM n LEFT JOIN t ON t.z = n.id GROUP BY n.id")
def a14v(spark, d):
    return cores.triangles_per_vertex(co45(spark, d))


@query("k01_delta_stepping_co45", _SSSP + " SELECT n.id, s.d AS dist FROM n LEFT JOIN s ON s.id = n.id")
def k01(spark, d):
    return traversal.delta_stepping(co45(spark, d), 0, 400)


@query("k02_kcore_buckets_co45", _CORE)
def k02(spark, d):
    return cores.kcore_peel(co45(spark, d))


@query("k04_set_cover_co45", rsql.set_cover(CO45))
def k04(spark, d):
    return cores.set_cover(co45(spark, d))


_HBFS = f"""WITH RECURSIVE {OP45}, m AS (SELECT max(p_partkey) + 1 AS base FROM part), e AS (SELECT v AS u, h + base AS v FROM i CROSS JOIN m UNION ALL SELECT h + base, v FROM i CROSS JOIN m),
 n AS (SELECT p_partkey AS id FROM part UNION ALL SELECT DISTINCT h + base FROM i CROSS JOIN m)"""


@query(
    "g01_hyper_bfs_op45",
    _HBFS + """, b(id, lvl) USING KEY (id) AS (SELECT CAST(0 AS BIGINT), 0 UNION
 SELECT e.v, min(b.lvl) + 1 FROM b JOIN e ON e.u = b.id LEFT JOIN recurring.b r ON r.id = e.v WHERE r.id IS NULL GROUP BY e.v)
 SELECT CASE WHEN n.id < base THEN 'v' ELSE 'h' END AS kind, CASE WHEN n.id < base THEN n.id ELSE n.id - base END AS id, lvl AS level FROM n CROSS JOIN m LEFT JOIN b ON b.id = n.id""",
)
def g01(spark, d, orders=big_orders):
    return hypergraphs.hyper_bfs(orders(spark, d), 0).select("kind", "id", "level")


@query("g02_hyper_bpath_op45", rsql.hyper_bpath(OP45))
def g02(spark, d, orders=big_orders):
    return hypergraphs.hyper_bpath(orders(spark, d), 0)


@query("g03_hyper_dependency_op45", rsql.hyper_dependency(_HBFS))
def g03(spark, d, orders=big_orders):
    return hypergraphs.hyper_dependency(orders(spark, d), 0).select("kind", "id", "sigma", F.round(F.col("score") + rsql.OFF_6, 6).alias("score"))


@query(
    "g04_hyper_components_op45",
    _HBFS + """, cc(id, label) USING KEY (id) AS (SELECT id, id FROM n UNION
 SELECT e.v, min(cc.label) FROM cc JOIN e ON e.u = cc.id JOIN recurring.cc r ON r.id = e.v WHERE cc.label < r.label GROUP BY e.v)
 SELECT CASE WHEN id < base THEN 'v' ELSE 'h' END AS kind, CASE WHEN id < base THEN id ELSE id - base END AS id, CASE WHEN label < base THEN label END AS label FROM cc CROSS JOIN m""",
)
def g04(spark, d, orders=big_orders):
    return hypergraphs.hyper_components(orders(spark, d))


@query(
    "g05_hyper_shortest_paths_op45",
    _HBFS + """, b(id, lvl) USING KEY (id) AS (SELECT CAST(0 AS BIGINT), 0 UNION
 SELECT e.v, min(b.lvl) + 1 FROM b JOIN e ON e.u = b.id LEFT JOIN recurring.b r ON r.id = e.v WHERE r.id IS NULL GROUP BY e.v)
 SELECT CASE WHEN n.id < base THEN 'v' ELSE 'h' END AS kind, CASE WHEN n.id < base THEN n.id ELSE n.id - base END AS id, CAST(lvl AS BIGINT) AS dist, false AS negative_cycle FROM n CROSS JOIN m LEFT JOIN b ON b.id = n.id""",
)
def g05(spark, d, orders=big_orders):
    return hypergraphs.hyper_shortest_paths(orders(spark, d), 0)


@query(
    "g06_hyper_pagerank_op",
    f"""WITH {OP}, c AS (SELECT count(*) AS nv FROM part), dv AS (SELECT v, count(*) AS d FROM i GROUP BY v), dh AS (SELECT h, count(*) AS d FROM i GROUP BY h),
 ph AS (SELECT i.h, sum(1.0 / nv / dv.d) AS p FROM i JOIN dv ON dv.v = i.v CROSS JOIN c GROUP BY i.h),
 pv AS (SELECT i.v, sum(ph.p / dh.d) AS x FROM i JOIN ph ON ph.h = i.h JOIN dh ON dh.h = i.h GROUP BY i.v)
 SELECT 'v' AS kind, p_partkey AS id, round((0.85 * coalesce(x, 0) + 0.15 / nv) * nv, 6) AS score FROM part CROSS JOIN c LEFT JOIN pv ON pv.v = p_partkey
 UNION ALL SELECT 'h', h, round(p * nv, 6) FROM ph CROSS JOIN c""",
)
def g06(spark, d):
    hg = orders_parts(spark, d)
    return hypergraphs.hyper_pagerank(hg).select("kind", "id", F.round(F.col("score") * F.lit(float(hg.nv)), 6).alias("score"))


@query("g07_hyper_independent_set_op45", rsql.hyper_independent_set(OP45))
def g07(spark, d, orders=big_orders):
    return hypergraphs.hyper_independent_set(orders(spark, d))


@query("g08_hyper_kcore_op45", rsql.hyper_kcore(OP45))
def g08(spark, d, orders=big_orders):
    return hypergraphs.hyper_kcore(orders(spark, d))


@query("g10_incidence_lists_op", f"WITH {OP} SELECT 'v' AS kind, p_partkey AS id, coalesce(string_agg(CAST(h AS VARCHAR), ',' ORDER BY h), '') AS outgoing FROM part LEFT JOIN i ON v = p_partkey GROUP BY 2 UNION ALL SELECT 'h', h, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) FROM i GROUP BY h")
def g10(spark, d):
    return hypergraphs.incidence_lists(orders_parts(spark, d)).select("kind", "id", F.array_join(F.transform("outgoing", lambda x: x.cast("string")), ",").alias("outgoing"))


# ---- eccentricity ---------------------------------------------------------------------------

_ECC = f"""WITH RECURSIVE {CO45}, b(s, id, lvl) USING KEY (s, id) AS (SELECT id, id, 0 FROM n UNION
 SELECT b.s, e.v, min(b.lvl) + 1 FROM b JOIN e ON e.u = b.id LEFT JOIN recurring.b r ON r.id = e.v AND r.s = b.s WHERE r.id IS NULL GROUP BY b.s, e.v)
 SELECT id, CAST(max(lvl) AS INTEGER) AS value FROM b GROUP BY id"""


@query("x03_eccentricity_exact_co45", _ECC)
def x03(spark, d):
    return eccentricity.exact(co45(spark, d), words=16)


@query("x08_eccentricity_bounded_co45", _ECC)
def x08(spark, d):
    return eccentricity.bounded(co45(spark, d), per_round=256)


for _name, _run, _sql in (
    ("x01_eccentricity_kbfs_co45", lambda g: eccentricity.kbfs(g), rsql.kbfs(CO45, True)),
    ("x02_eccentricity_one_phase_co45", lambda g: eccentricity.kbfs(g, two_phase=False), rsql.kbfs(CO45, False)),
    ("x04_eccentricity_masks_co45", lambda g: eccentricity.sketch(g), rsql.sketch(CO45)),
    ("x05_eccentricity_registers_co45", lambda g: eccentricity.registers(g), rsql.registers(CO45)),
    ("x06_eccentricity_near_set_co45", lambda g: eccentricity.near_set_estimate(g), rsql.near_set_estimate(CO45)),
    ("x07_eccentricity_lower_bounds_co45", lambda g: eccentricity.lower_bounds(g), rsql.lower_bounds(CO45)),
    ("x09_eccentricity_two_approximation_co45", lambda g: eccentricity.two_approximation(g), rsql.two_approximation(CO45)),
):
    query(_name, _sql)(lambda spark, d, run=_run: run(co45(spark, d)))

# ---- local clustering -----------------------------------------------------------------------

for _name, _run, _sql in (
    ("l01_nibble_co45", lambda g: clustering.nibble(g, 0), rsql.nibble(CO45)),
    ("l02_push_pagerank_optimised_co45", lambda g: clustering.push_pagerank(g, 0, optimised=True), rsql.push_pagerank(CO45, True)),
    ("l03_push_pagerank_co45", lambda g: clustering.push_pagerank(g, 0), rsql.push_pagerank(CO45, False)),
    ("l04_heat_kernel_co45", lambda g: clustering.heat_kernel(g, 0, levels=6), rsql.heat_kernel(CO45, clustering.heat_coefficients(3.0, 6))),
    ("l05_heat_walks_co45", lambda g: clustering.heat_walks(g, 0, walks=100), rsql.heat_walks(CO45, 100)),
):
    query(_name, _sql)(lambda spark, d, run=_run: run(co45(spark, d)).select("id", F.round(F.col("score") + rsql.OFF_9, 9).alias("score")))


@query(
    "l06_sweep_co45",
    f"""WITH {CO45}, g AS (SELECT u, count(*) AS d FROM e GROUP BY u), m AS (SELECT count(*) AS vol FROM e),
 r AS (SELECT u AS id, d, row_number() OVER (ORDER BY CAST(p_size AS DOUBLE) / d DESC, u) AS rank FROM g JOIN part ON p_partkey = u),
 x AS (SELECT a.rank AS rank, 1 AS c FROM e JOIN r a ON a.id = e.u LEFT JOIN r b ON b.id = e.v WHERE b.rank IS NULL OR b.rank > a.rank
  UNION ALL SELECT b.rank, -1 FROM e JOIN r a ON a.id = e.u JOIN r b ON b.id = e.v WHERE b.rank > a.rank),
 y AS (SELECT rank, sum(c) AS c FROM x GROUP BY rank),
 s AS (SELECT r.rank, r.id, CAST(sum(d) OVER (ORDER BY r.rank) AS BIGINT) AS vol_s, CAST(sum(coalesce(c, 0)) OVER (ORDER BY r.rank) AS BIGINT) AS edges_crossing FROM r LEFT JOIN y ON y.rank = r.rank)
 SELECT rank, id, vol_s, edges_crossing, round(CASE WHEN edges_crossing = 0 OR least(vol_s, vol - vol_s) <= 0 THEN 1.0 ELSE edges_crossing / CAST(least(vol_s, vol - vol_s) AS DOUBLE) END, 9) AS conductance
 FROM s CROSS JOIN m""",
)
def l06(spark, d):
    scores = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score"))
    return clustering.sweep_table(co45(spark, d), scores).select("rank", "id", "vol_s", "edges_crossing", F.round("conductance", 9).alias("conductance"))


# ---- sources and sinks: written to the shared folder and read again -------------------------

_EDGES = f"WITH {CO45} SELECT u AS src, v AS dst, w FROM e"


def _place(spark) -> str:
    return f"{shared_dir(spark)}/weftgraph/{uuid.uuid4().hex}"


@query("i01_adjacency_text", _EDGES)
def i01(spark, d):
    path = _place(spark)
    text.write_adjacency(co45(spark, d), path)
    return text.read_adjacency(spark, path, True).edges.select("src", "dst", F.col("w").cast("long").alias("w"))


@query("i03_compressed_table", _EDGES)
def i03(spark, d):
    path = _place(spark)
    codecs.write_compressed(co45(spark, d), path, "nibble")
    return codecs.read_compressed(spark, path).edges.select("src", "dst", F.col("w").cast("long").alias("w"))


@query("i05_hyper_adjacency_text", f"WITH {OP45} SELECT v, dense_rank() OVER (ORDER BY h) - 1 AS h FROM i")
def i05(spark, d, orders=big_orders):
    path = _place(spark)
    hg = orders(spark, d)
    # hyperedge ids are compacted: files have dense ids
    pairs = text._compact(hg.v2h.select("v", "h"), "h")
    from weftgraph.model import Hypergraph

    dense = Hypergraph.from_incidence(durable(pairs), hg.vertices)
    text.write_hyper_adjacency(dense, path)
    return text.read_hyper_adjacency(spark, path, True).v2h.select("v", "h")


@query("i08_edge_list", _EDGES)
def i08(spark, d):
    path = _place(spark)
    co45(spark, d).edges.select(F.concat_ws(" ", "src", "dst", "w").alias("value")).write.text(path)
    return text.read_edges(spark, path, weighted=True).edges.select("src", "dst", F.col("w").cast("long").alias("w"))


@query("i09_member_lists", f"WITH {OP45}, o AS (SELECT DISTINCT v FROM i), k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r FROM o) SELECT r AS v, count(*) AS hyperedges FROM i JOIN k ON k.v = i.v GROUP BY r")
def i09(spark, d, orders=big_orders):
    path = _place(spark)
    lists = orders(spark, d).h2v.groupBy("h").agg(F.array_sort(F.collect_list("v")).alias("m"))
    lists.select(F.array_join(F.transform("m", lambda x: x.cast("string")), " ").alias("value")).write.text(path)
    return text.read_members(spark, path).v2h.groupBy("v").agg(F.count(F.lit(1)).alias("hyperedges"))


@query("i10_bipartite_list", f"WITH {OP45}, o AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS a, dense_rank() OVER (ORDER BY h) - 1 AS b FROM i) SELECT a AS v, b AS h FROM o")
def i10(spark, d, orders=big_orders):
    path = _place(spark)
    orders(spark, d).v2h.select(F.concat_ws(" ", "v", "h").alias("value")).write.text(path)
    return text.read_bipartite(spark, path).v2h.select("v", "h")


@query("i13_compressed_hypergraph", f"WITH {OP45} SELECT v, h FROM i")
def i13(spark, d, orders=big_orders):
    path = _place(spark)
    codecs.write_compressed_hyper(orders(spark, d), path, "byte")
    return codecs.read_compressed_hyper(spark, path).v2h


for _kind, _id in (("byte", "i14_codec_byte"), ("run", "i15_codec_run"), ("nibble", "i16_codec_nibble")):
    query(_id, f"WITH {CO45} SELECT u AS src, v AS dst FROM e")(
        lambda spark, d, kind=_kind: codecs.decompress(codecs.compress(Graph(co45(spark, d).vertices, co45(spark, d).edges.select("src", "dst"), True), kind), kind)
    )


# ---- construction ---------------------------------------------------------------------------


@query("u01_symmetrize_nn", f"WITH {NN} SELECT DISTINCT u AS src, v AS dst FROM (SELECT u, v FROM e UNION ALL SELECT v, u FROM e) WHERE u <> v")
def u01(spark, d):
    return nations(spark, d).symmetrize().edges


@query("u02_dedup_nn", f"WITH {NN} SELECT DISTINCT u AS src, v AS dst FROM e")
def u02(spark, d):
    return nations(spark, d).dedup().edges


@query("u03_degrees_co45", f"WITH {CO45} SELECT n.id, count(v) AS degree FROM n LEFT JOIN e ON e.u = n.id GROUP BY n.id")
def u03(spark, d):
    return co45(spark, d).out_degrees()


@query("u04_rmat", rsql.rmat_degrees())
def u04(spark, d):
    return gen.rmat(spark, load(spark, d, "part").count(), symmetric=True).out_degrees()


@query("u05_random_local", rsql.local_degrees())
def u05(spark, d):
    return gen.random_local(spark, load(spark, d, "part").count(), dimension=2, symmetric=True).out_degrees()


@query(
    "u06_grid",
    """WITH s AS (SELECT CAST(round(sqrt(count(*))) AS BIGINT) AS k FROM part), c AS (SELECT k, unnest(generate_series(0, k * k - 1)) AS id FROM s),
 j AS (SELECT id AS u, (id // k) * k + (id % k + 1) % k AS v FROM c UNION ALL SELECT id, ((id // k + 1) % k) * k + id % k FROM c)
 SELECT DISTINCT u AS src, v AS dst FROM (SELECT u, v FROM j UNION ALL SELECT v, u FROM j) WHERE u <> v""",
)
def u06(spark, d):
    return gen.grid(spark, load(spark, d, "part").count(), 2).edges


@query("u07_random_hypergraph", rsql.random_hypergraph())
def u07(spark, d):
    return gen.random_hypergraph(spark, load(spark, d, "part").count()).v2h


@query("u09_add_weights_co45", rsql.add_weights(CO45))
def u09(spark, d):
    return gen.add_weights(co45(spark, d)).edges


@query("u10_add_hyper_weights_op45", rsql.add_hyper_weights(OP45))
def u10(spark, d, orders=big_orders):
    return gen.add_hyper_weights(orders(spark, d)).v2h


@query("u13_clique_expansion_op45", f"WITH {OP45} SELECT a.v AS src, b.v AS dst, count(*) AS edges FROM i a JOIN i b ON a.h = b.h AND a.v <> b.v GROUP BY 1, 2")
def u13(spark, d, orders=big_orders):
    return text.clique_expansion(orders(spark, d)).edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("edges"))


@query("u14_mesh_op45", f"WITH {OP45} SELECT h, v FROM i")
def u14(spark, d, orders=big_orders):
    path = _place(spark)
    text.write_mesh(orders(spark, d), path)
    return spark.read.schema("h long, v long").csv(path)


# ---- more forms of the operators above --------------------------------------------------------


@query("b03_changed_buckets", "SELECT p_partkey AS id, CAST((p_size + 3) // 5 AS BIGINT) AS bkt FROM part WHERE (p_size + 3) // 5 <> p_size // 5")
def b03(spark, d):
    part = load(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return buckets.changed_buckets(buckets.make_buckets(part, "p_size div 5"), buckets.make_buckets(part, "(p_size + 3) div 5"))


@query("b05_open_range", "SELECT p_partkey AS id, CAST(least(p_size - 10, 16) AS BIGINT) AS slot FROM part WHERE p_size >= 10")
def b05(spark, d):
    part = load(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return buckets.open_range(buckets.make_buckets(part, "p_size"), 10, 16)


@query("p13_functions", "SELECT CAST(sum(l_suppkey) AS BIGINT) AS added, min(l_suppkey) AS least, max(l_suppkey) AS greatest, count(*) FILTER (WHERE l_suppkey <> 7) AS others FROM lineitem")
def p13(spark, d):
    items = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("x"))
    named = {"added": sequences.reduce(items, "x", "sum"), "least": sequences.reduce(items, "x", "min"), "greatest": sequences.reduce(items, "x", "max"), "others": sequences.map_reduce(sequences.pack(items, "x <> 7"), "1", "sum")}
    out = None
    for name, one in named.items():
        one = one.withColumnRenamed("value", name)
        out = one if out is None else out.join(F.broadcast(one))  # one row each
    return out


@query("p12_hash64", f"SELECT p_partkey AS id, CASE WHEN x >= 9223372036854775808 THEN CAST(CAST(x AS HUGEINT) - 18446744073709551616::HUGEINT AS BIGINT) ELSE CAST(x AS BIGINT) END AS h FROM (SELECT p_partkey, {rsql.mix64('p_partkey')} AS x FROM part)")
def p12b(spark, d):
    from weftgraph.functions.hashing import hash64

    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), hash64("p_partkey").alias("h"))


@query("x00_component_sizes_co45", _CC.replace("SELECT id, label FROM cc", "SELECT id, label, count(*) OVER (PARTITION BY label) AS size FROM cc"))
def x00(spark, d):
    return eccentricity.labelled(co45(spark, d))


query("k03_kcore_serial_co45", _CORE)(lambda spark, d: cores.kcore_peel(co45(spark, d)))
query("g09_hyper_kcore_efficient_op45", rsql.hyper_kcore(OP45))(lambda spark, d: hypergraphs.hyper_kcore(big_orders(spark, d)))


@query("g11_bipartite_lists_op", f"WITH {OP} SELECT 'v' AS kind, p_partkey AS id, coalesce(string_agg(CAST(h AS VARCHAR), ',' ORDER BY h), '') AS lists FROM part LEFT JOIN i ON v = p_partkey GROUP BY 2 UNION ALL SELECT 'h', h, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) FROM i GROUP BY h")
def g11(spark, d):
    # the out-lists of the vertices and the in-lists of the hyperedges
    shown = F.when(F.col("kind") == "v", F.col("outgoing")).otherwise(F.col("incoming"))
    return hypergraphs.incidence_lists(orders_parts(spark, d)).select("kind", "id", F.array_join(F.transform(shown, lambda x: x.cast("string")), ",").alias("lists"))


@query(
    "g01_hyper_bfs_parents_op45",
    _HBFS + """, b(id, lvl) USING KEY (id) AS (SELECT CAST(0 AS BIGINT), 0 UNION
 SELECT e.v, min(b.lvl) + 1 FROM b JOIN e ON e.u = b.id LEFT JOIN recurring.b r ON r.id = e.v WHERE r.id IS NULL GROUP BY e.v),
 p AS (SELECT y.id, min(x.id) AS parent FROM b y JOIN e ON e.v = y.id JOIN b x ON x.id = e.u AND x.lvl = y.lvl - 1 GROUP BY y.id)
 SELECT CASE WHEN n.id < base THEN 'v' ELSE 'h' END AS kind, CASE WHEN n.id < base THEN n.id ELSE n.id - base END AS id,
  CASE WHEN n.id = 0 THEN 0 WHEN parent >= base THEN parent - base ELSE parent END AS parent FROM n CROSS JOIN m LEFT JOIN p ON p.id = n.id""",
)
def g01p(spark, d):
    return hypergraphs.hyper_bfs(big_orders(spark, d), 0).select("kind", "id", "parent")


@query("i02_binary_graph", _EDGES)
def i02(spark, d):
    path = _place(spark)
    codecs.write_binary(co45(spark, d), path)
    return codecs.read_binary(spark, path, True).edges.select("src", "dst", F.col("w").cast("long").alias("w"))


for _kind in codecs.KINDS:

    @query(f"i12_compressed_file_{_kind}", _EDGES)
    def i12(spark, d, kind=_kind):
        path = _place(spark)
        codecs.write_compressed_file(co45(spark, d), path, kind)
        return codecs.read_compressed_file(spark, path, kind, weighted=True).edges.select("src", "dst", F.col("w").cast("long").alias("w"))


@query("i05_hyper_binary", ORACLES["i05_hyper_adjacency_text"])
def i05b(spark, d):
    from weftgraph.model import Hypergraph

    path = _place(spark)
    hg = big_orders(spark, d)
    codecs.write_hyper_binary(Hypergraph.from_incidence(durable(text._compact(hg.v2h.select("v", "h"), "h")), hg.vertices), path)
    return codecs.read_hyper_binary(spark, path).v2h.select("v", "h")


@query("i18_value_lines", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS line, CASE WHEN p_size > 40 THEN -1 ELSE p_size END AS value FROM part")
def i18(spark, d):
    path = _place(spark)
    eccentricity.write_values(load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") <= 40, F.col("p_size")).alias("value")), path)
    found = sequences.running(text.lines(spark, path).select("n", "value"), [F.col("n")], [], "line")
    return found.select((F.col("line") - 1).alias("line"), F.col("value").cast("int").alias("value"))


@query("u08_edges_to_adjacency", f"WITH {CO45} SELECT u AS src, v AS dst FROM e")
def u08(spark, d):
    from weftgraph.cli import convert

    lines, path = _place(spark), _place(spark)
    co45(spark, d).edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(lines)
    convert(spark, "edges", "adjacency", lines, path, symmetric=True)
    return text.read_adjacency(spark, path, True).edges.select("src", "dst")


@query("u11_adjacency_to_binary", f"WITH {CO45} SELECT u AS src, v AS dst FROM e")
def u11(spark, d):
    from weftgraph.cli import convert

    adjacency, path = _place(spark), _place(spark)
    g = co45(spark, d)
    text.write_adjacency(Graph(g.vertices, g.edges.select("src", "dst"), True), adjacency)
    convert(spark, "adjacency", "binary", adjacency, path, symmetric=True)
    return codecs.read_binary(spark, path).edges.select("src", "dst")


@query("u12_bipartite_to_adjacency", ORACLES["i10_bipartite_list"])
def u12(spark, d):
    from weftgraph.cli import convert

    lines, path = _place(spark), _place(spark)
    big_orders(spark, d).v2h.select(F.concat_ws(" ", "v", "h").alias("value")).write.text(lines)
    convert(spark, "bipartite", "hyper-adjacency", lines, path)
    return text.read_hyper_adjacency(spark, path, True).v2h.select("v", "h")


# ---- the same operators over whole tables ---------------------------------------------------

for _name, _from, _run in (
    ("g01_hyper_bfs_op", "g01_hyper_bfs_op45", g01),
    ("g02_hyper_bpath_op", "g02_hyper_bpath_op45", g02),
    ("g03_hyper_dependency_op", "g03_hyper_dependency_op45", g03),
    ("g04_hyper_cc_op", "g04_hyper_components_op45", g04),
    ("g05_hyper_shortest_paths_op", "g05_hyper_shortest_paths_op45", g05),
    ("g07_hyper_independent_set_op", "g07_hyper_independent_set_op45", g07),
    ("g08_hyper_kcore_op", "g08_hyper_kcore_op45", g08),
    ("i05_hyper_adjacency_text_op", "i05_hyper_adjacency_text", i05),
    ("i09_member_lists_op", "i09_member_lists", i09),
    ("i10_bipartite_list_op", "i10_bipartite_list", i10),
    ("i13_compressed_hypergraph_op", "i13_compressed_hypergraph", i13),
    ("u10_add_hyper_weights_op", "u10_add_hyper_weights_op45", u10),
    ("u13_clique_expand_op", "u13_clique_expansion_op45", u13),
    ("u14_mesh_op", "u14_mesh_op45", u14),
):
    query(_name, ORACLES[_from].replace(OP45, OP) if _from in ORACLES else None)(lambda spark, d, run=_run: run(spark, d, orders_parts))


@query("a11_pagerank_ps_10it", _pagerank_sql(10).replace(CO45, PS))
def a11_ps(spark, d):
    return a11(spark, d, supplies)


@query("a06_factorize_ps", rsql.factorize(PS))
def a06_ps(spark, d):
    return ranking.factorize(supplies(spark, d)).select("id", F.posexplode("latent").alias("coordinate", "x")).withColumn("x", F.round("x", 9))
