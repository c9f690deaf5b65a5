"""Graphs over the supplied business tables. One SQL text for each table of nodes or edges, for Spark and others alike."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .model import DIRECTED, UNDIRECTED, Graph, graph_from_tables

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations")

#: Part-supplier pairs with the quantity delivered (undirected, two-sided).
SUPPLY = """SELECT concat('p', l_partkey, '-s', l_suppkey) AS id, concat('p', l_partkey) AS source_id, concat('s', l_suppkey) AS target_id, sum(l_quantity) AS weight
FROM lineitem GROUP BY l_partkey, l_suppkey"""
SUPPLY_NODES = """SELECT concat('p', l_partkey) AS id, CAST(min(l_partkey) AS BIGINT) AS ord FROM lineitem GROUP BY l_partkey
UNION ALL SELECT concat('s', l_suppkey) AS id, CAST(10000000 + min(l_suppkey) AS BIGINT) AS ord FROM lineitem GROUP BY l_suppkey"""
#: Trade from supplier nations to customer nations, weighted by order lines.
TRADE = """SELECT concat(s.n_name, '>', c.n_name) AS id, CAST(min(s.n_nationkey) * 100 + min(c.n_nationkey) AS BIGINT) AS ord, s.n_name AS source_id, c.n_name AS target_id, CAST(count(*) AS DOUBLE) AS weight
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation s ON s_nationkey = s.n_nationkey JOIN nation c ON c_nationkey = c.n_nationkey GROUP BY s.n_name, c.n_name"""
TRADE_NODES = "SELECT n_name AS id, CAST(n_nationkey AS BIGINT) AS ord FROM nation"
#: Regions over nations over customers and suppliers.
GEO_NODES = """SELECT concat('r', r_regionkey) AS id, CAST(NULL AS STRING) AS parent_id, CAST(r_regionkey AS BIGINT) AS ord FROM region
UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), CAST(100 + n_nationkey AS BIGINT) FROM nation
UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), CAST(1000 + c_custkey AS BIGINT) FROM customer
UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), CAST(100000000 + s_suppkey AS BIGINT) FROM supplier"""
#: Each customer's orders, one after the other.
CHAIN = """SELECT concat('e', b) AS id, concat('o', a) AS source_id, concat('o', b) AS target_id, CAST(b AS BIGINT) AS ord
FROM (SELECT lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, o_orderkey AS b FROM orders) t WHERE a IS NOT NULL"""
CHAIN_NODES = "SELECT concat('o', o_orderkey) AS id, CAST(o_orderkey AS BIGINT) AS ord FROM orders"
#: Each user's events, one after the other, by kind of event (with loops).
FLOW = """SELECT concat(a, '>', b) AS id, a AS source_id, b AS target_id, CAST(count(*) AS DOUBLE) AS weight
FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) t WHERE b IS NOT NULL GROUP BY a, b"""
#: The turns of conversations, one after the other.
DIALOG = """SELECT concat(conv_id, '.', a, '-', b) AS id, concat(conv_id, '.', a) AS source_id, concat(conv_id, '.', b) AS target_id, CAST(conv_id * 1000 + a AS BIGINT) AS ord
FROM (SELECT conv_id, turn AS a, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) t WHERE b IS NOT NULL"""
DIALOG_NODES = "SELECT concat(conv_id, '.', turn) AS id, CAST(conv_id * 1000 + turn AS BIGINT) AS ord FROM conversations"

#: A world over regions over nations over customers as a tree of edges; without the customers, the lands.
_LANDS = """SELECT concat('r', r_regionkey) AS id, 'w' AS parent, CAST(r_regionkey AS BIGINT) AS ord FROM region
UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), CAST(100 + n_nationkey AS BIGINT) FROM nation"""
_WORLD = f"{_LANDS} UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), CAST(1000 + c_custkey AS BIGINT) FROM customer"
_AS_EDGES = "SELECT concat('e-', id) AS id, parent AS source_id, id AS target_id, ord, CAST(1 + ord % 7 AS DOUBLE) AS weight FROM"
_AS_NODES = "SELECT 'w' AS id, CAST(-1 AS BIGINT) AS ord UNION ALL SELECT id, ord FROM"
LANDS, LAND_NODES = f"{_AS_EDGES} ({_LANDS}) t", f"{_AS_NODES} ({_LANDS}) t"
WORLD, WORLD_NODES = f"{_AS_EDGES} ({_WORLD}) t", f"{_AS_NODES} ({_WORLD}) t"


def _frame(spark: SparkSession, sf_dir: str, sql: str):
    for name in TABLES:
        if name in sql:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)


def _graph(spark: SparkSession, sf_dir: str, nodes: str | None, edges: str | None, mode: str) -> Graph:
    own = _frame(spark, sf_dir, nodes) if nodes else None
    links = _frame(spark, sf_dir, edges) if edges else spark.createDataFrame([], "id string, source_id string, target_id string")
    return graph_from_tables(own, links, mode)


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    return _graph(spark, sf_dir, SUPPLY_NODES, SUPPLY, UNDIRECTED)


def trade(spark: SparkSession, sf_dir: str, edges: str = TRADE) -> Graph:
    return _graph(spark, sf_dir, TRADE_NODES, edges, DIRECTED)


def geo(spark: SparkSession, sf_dir: str) -> Graph:
    return _graph(spark, sf_dir, GEO_NODES, None, DIRECTED)


def chain(spark: SparkSession, sf_dir: str) -> Graph:
    return _graph(spark, sf_dir, CHAIN_NODES, CHAIN, DIRECTED)


def flow(spark: SparkSession, sf_dir: str) -> Graph:
    return _graph(spark, sf_dir, None, FLOW, DIRECTED)


def dialog(spark: SparkSession, sf_dir: str) -> Graph:
    return _graph(spark, sf_dir, DIALOG_NODES, DIALOG, DIRECTED)


def world(spark: SparkSession, sf_dir: str, mode: str = DIRECTED) -> Graph:
    return _graph(spark, sf_dir, WORLD_NODES, WORLD, mode)


def lands(spark: SparkSession, sf_dir: str, mode: str = DIRECTED) -> Graph:
    return _graph(spark, sf_dir, LAND_NODES, LANDS, mode)
