"""Graphs and hypergraphs of the star-schema tables.

``CO45`` and the like are the common table expressions of the same data for SQL engines:
e(u, v, w) edges, n(id) vertices, i(h, v) incidences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.model import Graph, Hypergraph

_memo: dict = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def co45(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts joined if they share an order with at least 45 pieces of each; the weight is the least sum of quantities."""
    key = (spark.sparkContext.applicationId, sf_dir, "co45")
    if key not in _memo:
        big = load(spark, sf_dir, "lineitem").where("l_quantity >= 45").select("l_orderkey", "l_partkey", "l_quantity")
        other = big.withColumnsRenamed({"l_partkey": "dst", "l_quantity": "q"})
        pairs = big.join(other, "l_orderkey").where("l_partkey <> dst")
        edges = pairs.groupBy(F.col("l_partkey").alias("src"), "dst").agg(F.min((F.col("l_quantity") + F.col("q")).cast("int")).cast("long").alias("w"))
        _memo[key] = Graph(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), edges, True)
    return _memo[key]


CO45 = """big AS (SELECT l_orderkey AS o, l_partkey AS k, l_quantity AS q FROM lineitem WHERE l_quantity >= 45),
 e AS (SELECT a.k AS u, b.k AS v, min(CAST(a.q + b.q AS BIGINT)) AS w FROM big a JOIN big b ON a.o = b.o AND a.k <> b.k GROUP BY 1, 2),
 n AS (SELECT p_partkey AS id FROM part)"""


def parts_suppliers(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers to the parts they supply."""
    items = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return Graph(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), items)


def supplies(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts and suppliers joined both ways where a line item has both; suppliers are numbered after the parts, the weight is the least quantity."""
    key = (spark.sparkContext.applicationId, sf_dir, "ps")
    if key not in _memo:
        parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
        base = parts.agg(F.max("id") + 1).first()[0]
        suppliers = load(spark, sf_dir, "supplier").select((F.col("s_suppkey") + base).alias("id"))
        pairs = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + base).alias("dst")).agg(F.min(F.col("l_quantity").cast("int")).cast("long").alias("w"))
        edges = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
        _memo[key] = Graph(parts.union(suppliers), edges, True)
    return _memo[key]


PS = """b AS (SELECT max(p_partkey) + 1 AS base FROM part),
 ps AS (SELECT l_partkey AS u, l_suppkey + base AS v, min(CAST(CAST(l_quantity AS INTEGER) AS BIGINT)) AS w FROM lineitem CROSS JOIN b GROUP BY 1, 2),
 e AS (SELECT u, v, w FROM ps UNION ALL SELECT v, u, w FROM ps),
 n AS (SELECT p_partkey AS id FROM part UNION ALL SELECT s_suppkey + base FROM supplier CROSS JOIN b)"""


def nations(spark: SparkSession, sf_dir: str) -> Graph:
    """Customer nation to supplier nation, one edge a line item, self-loops included."""
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("src"))
    suppliers = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("dst"))
    edges = items.join(orders, "l_orderkey").join(customers, "o_custkey").join(suppliers, "l_suppkey").select("src", "dst")
    return Graph(load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id")), edges)


NN = """e AS (SELECT CAST(c_nationkey AS BIGINT) AS u, CAST(s_nationkey AS BIGINT) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey
   JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def orders_parts(spark: SparkSession, sf_dir: str) -> Hypergraph:
    """Orders as hyperedges over their parts; orders are numbered by their own keys."""
    key = (spark.sparkContext.applicationId, sf_dir, "op")
    if key not in _memo:
        pairs = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("v"), F.col("l_orderkey").alias("h")).distinct()
        _memo[key] = Hypergraph.from_incidence(pairs, load(spark, sf_dir, "part").select("p_partkey"))
    return _memo[key]


OP = """i AS (SELECT DISTINCT l_orderkey AS h, l_partkey AS v FROM lineitem)"""


def big_orders(spark: SparkSession, sf_dir: str) -> Hypergraph:
    """Orders over the parts bought in at least 45 pieces: sparse enough for deep searches."""
    key = (spark.sparkContext.applicationId, sf_dir, "op45")
    if key not in _memo:
        pairs = load(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("v"), F.col("l_orderkey").alias("h")).distinct()
        _memo[key] = Hypergraph.from_incidence(pairs, load(spark, sf_dir, "part").select("p_partkey"))
    return _memo[key]


OP45 = """i AS (SELECT DISTINCT l_orderkey AS h, l_partkey AS v FROM lineitem WHERE l_quantity >= 45)"""
