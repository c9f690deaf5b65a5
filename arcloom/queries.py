"""The registered queries of the graph operators, over whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views as V
from .model import UNDIRECTED
from .operators import centrality, changes, community, coverage, generators, layout, paths, queries, structure, transforms, traversal
from .plans.storage import stored
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if there is any."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


DEGREES = """ends AS (SELECT source_id AS id FROM e UNION ALL SELECT target_id FROM e), d AS (SELECT id, count(*) AS degree FROM ends GROUP BY id)"""


@query(f"WITH e AS ({V.SUPPLY}), {DEGREES} SELECT id, degree, degree AS in_degree, degree AS out_degree FROM d")
def degree_supply(spark, sf):
    return queries.degrees(V.supply(spark, sf))


@query(f"WITH e AS ({V.CHAIN}), n AS ({V.CHAIN_NODES}) SELECT n.id, (SELECT count(*) FROM e WHERE source_id = n.id) + (SELECT count(*) FROM e WHERE target_id = n.id) AS degree, (SELECT count(*) FROM e WHERE target_id = n.id) AS in_degree, (SELECT count(*) FROM e WHERE source_id = n.id) AS out_degree FROM n")
def degree_chain(spark, sf):
    return queries.degrees(V.chain(spark, sf))


@query(f"WITH e AS ({V.SUPPLY}), {DEGREES}, n AS (SELECT count(*) AS n FROM d) SELECT id, round(degree / (n - 1.0), 9) AS score FROM d, n")
def degree_centrality(spark, sf):
    return centrality.get_degree_centrality(V.supply(spark, sf)).select("id", F.round("score", 9).alias("score"))


@query(f"WITH e AS ({V.TRADE}) SELECT n_name AS id, round((SELECT count(*) FROM e WHERE target_id = n_name) / 24.0, 9) AS in_score, round((SELECT count(*) FROM e WHERE source_id = n_name) / 24.0, 9) AS out_score FROM nation")
def in_out_centrality(spark, sf):
    g = V.trade(spark, sf)
    a = centrality.get_in_degree_centrality(g).select("id", F.round("score", 9).alias("in_score"))
    return a.join(centrality.get_out_degree_centrality(g).select("id", F.round("score", 9).alias("out_score")), "id")


@query(f"WITH e AS ({V.CHAIN}) SELECT source_id AS id, target_id AS other FROM e")
def successors_chain(spark, sf):
    return queries.successors(V.chain(spark, sf))


@query(f"WITH e AS ({V.CHAIN}) SELECT target_id AS id, source_id AS other FROM e")
def predecessors_chain(spark, sf):
    return queries.predecessors(V.chain(spark, sf))


@query(f"WITH e AS ({V.SUPPLY}) SELECT source_id AS id, target_id AS other FROM e UNION SELECT target_id, source_id FROM e")
def neighbors_supply(spark, sf):
    return queries.neighbors(V.supply(spark, sf))


@query(f"WITH e AS ({V.TRADE}) SELECT id, source_id, target_id, weight FROM e WHERE source_id = (SELECT min(n_name) FROM nation) OR target_id = (SELECT min(n_name) FROM nation)")
def edges_of(spark, sf):
    g = V.trade(spark, sf)
    return queries.get_edges_of(g, g.nodes.agg(F.min("id")).first()[0]).select("id", "source_id", "target_id", "weight")


@query(f"WITH e AS ({V.CHAIN}), n AS ({V.CHAIN_NODES}) SELECT id, id NOT IN (SELECT target_id FROM e) AS is_source, id NOT IN (SELECT source_id FROM e) AS is_sink FROM n WHERE id NOT IN (SELECT target_id FROM e) OR id NOT IN (SELECT source_id FROM e)")
def sources_and_sinks(spark, sf):
    g = V.chain(spark, sf)
    a, b = (f(g).select("id", F.lit(True).alias(name)) for f, name in ((queries.get_sources, "is_source"), (queries.get_sinks, "is_sink")))
    return a.join(b, "id", "full_outer").na.fill(False)


# hierarchy


@query(f"WITH RECURSIVE n AS ({V.GEO_NODES.replace('STRING', 'VARCHAR')}), up AS (SELECT id, parent_id AS ancestor, 1 AS distance FROM n WHERE parent_id IS NOT NULL UNION ALL SELECT up.id, n.parent_id, distance + 1 FROM up JOIN n ON n.id = up.ancestor WHERE n.parent_id IS NOT NULL) SELECT id, ancestor, distance FROM up")
def ancestors_geo(spark, sf):
    return queries.ancestry(V.geo(spark, sf)).select("id", "ancestor", F.col("distance").cast("int").alias("distance"))


@query("SELECT concat('r', r_regionkey) AS id, 0::BIGINT AS depth FROM region UNION ALL SELECT concat('n', n_nationkey), 1 FROM nation UNION ALL SELECT concat('c', c_custkey), 2 FROM customer UNION ALL SELECT concat('s', s_suppkey), 2 FROM supplier")
def depths_geo(spark, sf):
    return queries.depths(V.geo(spark, sf))


@query(f"WITH n AS ({V.GEO_NODES.replace('STRING', 'VARCHAR')}) SELECT id, parent_id FROM n WHERE id IN (SELECT parent_id FROM n)")
def compound_geo(spark, sf):
    return queries.compound_nodes(V.geo(spark, sf)).select("id", "parent_id")


@query(f"WITH n AS ({V.GEO_NODES.replace('STRING', 'VARCHAR')}) SELECT id FROM n WHERE parent_id = 'r1' OR parent_id IN (SELECT id FROM n WHERE parent_id = 'r1')")
def descendants_geo(spark, sf):
    return queries.get_descendants(V.geo(spark, sf), "r1").select("id")


@query("SELECT concat('n', a.n_nationkey) AS id FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE b.n_nationkey = 3 AND a.n_nationkey <> 3")
def siblings_geo(spark, sf):
    return queries.get_siblings(V.geo(spark, sf), "n3").select("id")


# traversal and components


@query("SELECT concat('o', o_orderkey) AS id, concat('o', min(o_orderkey) OVER (PARTITION BY o_custkey)) AS component FROM orders")
def components_chain(spark, sf):
    return traversal.get_connected_components(V.chain(spark, sf))


@query("SELECT concat('o', o_orderkey) AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS level FROM orders")
def topological_levels(spark, sf):
    return traversal.topological_levels(V.chain(spark, sf))


TURNS = "t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"


@query(f"WITH {TURNS} SELECT concat(a.conv_id, '.', a.turn) AS source, concat(b.conv_id, '.', b.turn) AS id, b.k - a.k AS distance FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.k <= b.k")
def distances_dialog(spark, sf):
    return traversal.distances_between_all(V.dialog(spark, sf))


@query(f"WITH {TURNS} SELECT concat(a.conv_id, '.', a.turn) AS source, concat(b.conv_id, '.', b.turn) AS id, CAST(b.k - a.k AS DOUBLE) AS dist FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.k <= b.k")
def weighted_distances_dialog(spark, sf):
    return paths.distances(V.dialog(spark, sf))


@query(f"WITH e AS ({V.TRADE}), d0 AS (SELECT source_id AS s, target_id AS t, weight AS w FROM e WHERE source_id <> target_id UNION ALL SELECT n_name, n_name, 0.0 FROM nation), "
       + ", ".join(f"d{i} AS (SELECT a.s, b.t, min(a.w + b.w) AS w FROM d{i - 1} a JOIN d{i - 1} b ON a.t = b.s GROUP BY a.s, b.t)" for i in range(1, 6)) + " SELECT s AS source, t AS id, w AS dist FROM d5")
def weighted_distances_trade(spark, sf):
    return paths.distances(V.trade(spark, sf))


@query("SELECT concat('o', o_orderkey) AS id, concat('o', o_orderkey) AS component FROM orders")
def strong_components_chain(spark, sf):
    return paths.strong_component_labels(V.chain(spark, sf))


@query("SELECT TRUE AS chain_acyclic, FALSE AS flow_acyclic, (SELECT count(DISTINCT o_custkey) <= 1 FROM orders) AS chain_connected, TRUE AS supply_bipartite, TRUE AS flow_strong")
def shapes(spark, sf):
    chain, flow = V.chain(spark, sf), V.flow(spark, sf)
    flow = V.graph_from_tables(None, stored(flow.edges.select("id", "source_id", "target_id", "weight"), "flow"), flow.mode)  # small, and read in each round
    row = (traversal.is_acyclic(chain), traversal.is_acyclic(flow), traversal.is_connected(chain), structure.is_bipartite(V.supply(spark, sf)), traversal.is_strongly_connected(flow))
    return spark.createDataFrame([row], "chain_acyclic boolean, flow_acyclic boolean, chain_connected boolean, supply_bipartite boolean, flow_strong boolean")


# centrality and communities


@query(f"WITH {TURNS}, m AS (SELECT count(*) AS m FROM t) SELECT concat(conv_id, '.', turn) AS id, round(CASE WHEN n = k THEN 0.0 ELSE (n - k) / ((n - k) * (n - k + 1) / 2.0) * ((n - k) / (m - 1.0)) END, 9) AS score FROM t, m")
def closeness_dialog(spark, sf):
    return centrality.get_closeness_centrality(V.dialog(spark, sf)).select("id", F.round("score", 9).alias("score"))


@query(f"WITH {TURNS}, m AS (SELECT count(*)::DOUBLE AS m FROM t) SELECT concat(conv_id, '.', turn) AS id, round((k - 1) * (n - k) / ((m - 1) * (m - 2)), 12) AS score FROM t, m")
def betweenness_dialog(spark, sf):
    return centrality.get_betweenness_centrality(V.dialog(spark, sf)).select("id", F.round("score", 12).alias("score"))


ROUNDS = 6
_RANKS = ", ".join(f"r{i} AS (SELECT a.t AS id, 0.15 / (SELECT count(*) FROM o) + 0.85 * sum(r.score / o.n) AS score FROM a JOIN r{i - 1} r ON r.id = a.s JOIN o ON o.id = a.s GROUP BY a.t)" for i in range(1, ROUNDS + 1))


@query(f"WITH e AS ({V.SUPPLY}), a AS (SELECT source_id AS s, target_id AS t FROM e UNION ALL SELECT target_id, source_id FROM e), o AS (SELECT s AS id, count(*) AS n FROM a GROUP BY s), r0 AS (SELECT id, 1.0 / (SELECT count(*) FROM o) AS score FROM o), {_RANKS} SELECT id, round(score / (SELECT sum(score) FROM r{ROUNDS}), 9) AS score FROM r{ROUNDS}")
def page_rank_supply(spark, sf):
    return centrality.get_page_rank(V.supply(spark, sf), max_iterations=ROUNDS, tolerance=0.0).select("id", F.round("score", 9).alias("score"))


_LABELS = ", ".join(f"l{i} AS (SELECT id, label FROM (SELECT a.t AS id, l.label, row_number() OVER (PARTITION BY a.t ORDER BY count(*) DESC, l.label) AS k FROM a JOIN l{i - 1} l ON l.id = a.s GROUP BY a.t, l.label) x WHERE k = 1)" for i in range(1, 4))


@query(f"WITH e AS ({V.SUPPLY}), a AS (SELECT source_id AS s, target_id AS t FROM e UNION ALL SELECT target_id, source_id FROM e), l0 AS (SELECT DISTINCT s AS id, s AS label FROM a), {_LABELS} SELECT id, label AS community FROM l3")
def label_propagation_supply(spark, sf):
    return community.get_label_propagation_communities(V.supply(spark, sf), max_iterations=3)


# the SQL of the two above unrolls few rounds; these run to the operators' own ends and have no SQL


@query()
def page_rank_full_supply(spark, sf):
    return centrality.get_page_rank(V.supply(spark, sf)).select("id", F.round("score", 9).alias("score"))


@query()
def label_propagation_full_supply(spark, sf):
    return community.get_label_propagation_communities(V.supply(spark, sf))


@query(f"WITH e AS ({V.TRADE}), c AS (SELECT n_name AS id, n_regionkey AS c FROM nation), d AS (SELECT c, sum(k) AS d FROM (SELECT source_id AS id, count(*) AS k FROM e GROUP BY 1 UNION ALL SELECT target_id, count(*) FROM e GROUP BY 1) x JOIN c USING (id) GROUP BY c), l AS (SELECT a.c, count(*) AS l FROM e JOIN c a ON a.id = source_id JOIN c b ON b.id = target_id WHERE a.c = b.c GROUP BY a.c), m AS (SELECT 2.0 * count(*) AS m FROM e) SELECT round(sum((2 * coalesce(l, 0) - d * d / m) / m), 9) AS q FROM d LEFT JOIN l USING (c), m")
def modularity_trade(spark, sf):
    regions = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("id"), F.col("n_regionkey").alias("community"))
    return spark.createDataFrame([(round(community.get_modularity(V.trade(spark, sf), regions), 9),)], "q double")


@query(f"WITH e AS ({V.CHAIN}), n AS ({V.CHAIN_NODES}) SELECT id, CASE WHEN id IN (SELECT source_id FROM e UNION SELECT target_id FROM e) THEN 1 ELSE 0 END::BIGINT AS core FROM n")
def core_numbers_chain(spark, sf):
    return structure.get_core_numbers(V.chain(spark, sf))


# transforms and set operations: trade of returned and of other order lines


def _part(flag: str, same: bool = True) -> str:
    return V.TRADE.replace("GROUP BY", f"WHERE l_returnflag {'=' if same else '<>'} '{flag}' GROUP BY")


def _two(spark, sf):
    return V.trade(spark, sf, _part("R")), V.trade(spark, sf, _part("N", False))


LEFT, RIGHT = f"l AS ({_part('R')})", f"r AS ({_part('N', False)})"
EDGE = ("id", "source_id", "target_id", "weight")


@query(f"WITH {LEFT}, {RIGHT} SELECT id, source_id, target_id, weight FROM r UNION ALL SELECT id, source_id, target_id, weight FROM l WHERE id NOT IN (SELECT id FROM r)")
def union_trade(spark, sf):
    return transforms.get_graph_union(*_two(spark, sf)).edges.select(*EDGE)


@query(f"WITH {LEFT}, {RIGHT} SELECT id, source_id, target_id, weight FROM r WHERE id IN (SELECT id FROM l)")
def intersection_trade(spark, sf):
    return transforms.get_graph_intersection(*_two(spark, sf)).edges.select(*EDGE)


@query(f"WITH {LEFT}, {RIGHT} SELECT id, source_id, target_id, weight FROM l WHERE id NOT IN (SELECT id FROM r)")
def difference_trade(spark, sf):
    return transforms.get_graph_difference(*_two(spark, sf)).edges.select(*EDGE)


@query(f"WITH {LEFT}, {RIGHT} SELECT id, source_id, target_id, weight FROM l WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT id, source_id, target_id, weight FROM r WHERE id NOT IN (SELECT id FROM l)")
def symmetric_difference_trade(spark, sf):
    return transforms.get_graph_symmetric_difference(*_two(spark, sf)).edges.select(*EDGE)


@query(f"WITH {LEFT}, {RIGHT} SELECT id, source_id, target_id, weight FROM l UNION ALL SELECT CASE WHEN id IN (SELECT id FROM l) THEN id || '#2' ELSE id END, source_id || '#2', target_id || '#2', weight FROM r")
def disjoint_union_trade(spark, sf):
    return transforms.get_disjoint_union(*_two(spark, sf)).edges.select(*EDGE)


@query(f"WITH {LEFT} SELECT a.n_name AS source_id, b.n_name AS target_id FROM nation a JOIN nation b ON a.n_name <> b.n_name WHERE NOT EXISTS (SELECT 1 FROM l WHERE source_id = a.n_name AND target_id = b.n_name)")
def complement_trade(spark, sf):
    return transforms.get_graph_complement(_two(spark, sf)[0]).edges.select("source_id", "target_id")


@query(f"WITH {LEFT}, {RIGHT} SELECT coalesce(l.id, r.id) AS id, CASE WHEN l.id IS NULL THEN 'added' WHEN r.id IS NULL THEN 'removed' ELSE 'updated' END AS kind FROM l FULL OUTER JOIN r ON l.id = r.id WHERE l.id IS NULL OR r.id IS NULL OR l.weight <> r.weight")
def diff_trade(spark, sf):
    return changes.get_diff(*_two(spark, sf)).filter("entity = 'edge'").select("id", "kind")


@query(f"WITH {RIGHT} SELECT id, source_id, target_id, weight FROM r")
def patched_trade(spark, sf):
    a, b = _two(spark, sf)
    return changes.get_patched_graph(a, changes.get_patches(a, b)).edges.select(*EDGE)


@query(f"WITH e AS ({V.TRADE}) SELECT id, target_id AS source_id, source_id AS target_id, weight FROM e")
def reversed_trade(spark, sf):
    return transforms.get_reversed_graph(V.trade(spark, sf)).edges.select(*EDGE)


@query(f"WITH e AS ({V.TRADE}), n AS (SELECT n_name FROM nation WHERE n_regionkey = 2) SELECT id, source_id, target_id, weight FROM e WHERE source_id IN (SELECT n_name FROM n) AND target_id IN (SELECT n_name FROM n)")
def subgraph_trade(spark, sf):
    asia = spark.read.parquet(f"{sf}/nation.parquet").filter("n_regionkey = 2").select(F.col("n_name").alias("id"))
    return transforms.get_subgraph_of(V.trade(spark, sf), asia).edges.select(*EDGE)


@query(f"WITH e AS ({V.CHAIN}) SELECT a.id AS source_id, b.id AS target_id, a.target_id AS via FROM e a JOIN e b ON a.target_id = b.source_id")
def line_graph_chain(spark, sf):
    line = transforms.get_line_graph(V.chain(spark, sf))
    return line.edges.select("source_id", "target_id", F.get_json_object("data", "$.viaNodeId").alias("via"))


@query(f"WITH e AS ({V.CHAIN}) SELECT id, source_id, target_id FROM e")
def transitive_reduction_chain(spark, sf):
    return transforms.get_transitive_reduction(V.chain(spark, sf)).edges.select("id", "source_id", "target_id")


FLAT = """SELECT DISTINCT concat('c', c_custkey) AS source_id, first AS target_id FROM customer a JOIN (SELECT n_nationkey, concat('c', min(c_custkey)) AS first FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey) b ON b.n_nationkey = (a.c_nationkey + 1) % 25 WHERE concat('c', c_custkey) <> first"""


@query(FLAT)
def flattened_geo(spark, sf):
    """Each nation's customers lie in it, and an edge leads from each nation to the next one's first customer."""
    nodes = V._frame(spark, sf, "SELECT concat('n', n_nationkey) AS id, CAST(NULL AS STRING) AS parent_id, CAST(n_nationkey AS BIGINT) AS ord, first AS initial_node_id FROM nation LEFT JOIN (SELECT c_nationkey, concat('c', min(c_custkey)) AS first FROM customer GROUP BY c_nationkey) t ON c_nationkey = n_nationkey UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), CAST(100 + c_custkey AS BIGINT), CAST(NULL AS STRING) FROM customer")
    edges = V._frame(spark, sf, "SELECT concat('e', n_nationkey) AS id, concat('n', n_nationkey) AS source_id, concat('n', (n_nationkey + 1) % 25) AS target_id, CAST(n_nationkey AS BIGINT) AS ord FROM nation")
    flat = transforms.get_flattened_graph(V.graph_from_tables(nodes, edges))
    return flat.edges.filter("source_id LIKE 'c%'").select("source_id", "target_id")


@query(f"WITH e AS ({V.CHAIN}), bad AS (SELECT count(*) AS n FROM e WHERE source_id NOT IN (SELECT concat('o', o_orderkey) FROM orders WHERE o_orderstatus = 'O')) SELECT 'dangling-edge-endpoint' AS code, (SELECT count(*) FROM e WHERE source_id NOT IN (SELECT concat('o', o_orderkey) FROM orders WHERE o_orderstatus = 'O')) + (SELECT count(*) FROM e WHERE target_id NOT IN (SELECT concat('o', o_orderkey) FROM orders WHERE o_orderstatus = 'O')) AS n")
def issues_chain(spark, sf):
    g = V.chain(spark, sf)
    shut = V._frame(spark, sf, "SELECT concat('o', o_orderkey) AS id FROM orders WHERE o_orderstatus = 'O'")
    return changes.get_graph_issues(g.with_(nodes=g.nodes.join(shut, "id", "left_semi").select(*g.nodes.columns))).groupBy("code").agg(F.count("*").alias("n"))


# paths, coverage, formats, generators, layout


@query("SELECT concat('edge:', conv_id, '.', a, '-', b) AS target FROM (SELECT conv_id, turn AS a, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) t WHERE b IS NOT NULL AND conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 2)")
def path_coverage_dialog(spark, sf):
    """Each conversation of more than two turns is a path; what they cover of all edges."""
    g = V.dialog(spark, sf)
    steps = V._frame(spark, sf, V.DIALOG).withColumn("conv", F.substring_index("source_id", ".", 1))
    one = steps.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("ord", F.col("id").alias("edge"), F.col("target_id").alias("node"), "source_id"))).alias("s")).filter("size(s) > 1")
    own = one.select(F.col("conv").cast("long").alias("path"), F.element_at("s", 1)["source_id"].alias("source"), F.transform("s", lambda x: F.struct(x["edge"].alias("edge"), x["node"].alias("node"))).alias("steps"))
    return coverage.get_path_coverage(own, coverage.get_coverage_targets(g, "edges"))["covered"].select("target")


@query(f"WITH e AS ({V.CHAIN}) SELECT concat('path:', '{{\"src\":\"', a.source_id, '\",\"edges\":[\"', a.id, '\",\"', b.id, '\"]}}') AS target FROM e a JOIN e b ON a.target_id = b.source_id")
def edge_pairs_chain(spark, sf):
    return coverage.get_coverage_targets(V.chain(spark, sf), "edge-pairs").select("target")


@query(f"WITH e AS ({V.SUPPLY}), a AS (SELECT source_id AS id, target_id AS t FROM e UNION ALL SELECT target_id, source_id FROM e) SELECT id, string_agg(t, ',' ORDER BY t) AS targets FROM a GROUP BY id")
def adjacency_list_supply(spark, sf):
    return tables.to_adjacency_list(V.supply(spark, sf)).select("id", F.array_join(F.array_sort("targets"), ",").alias("targets"))


@query(f"WITH e AS ({V.SUPPLY}) SELECT source_id, target_id FROM e")
def edge_list_supply(spark, sf):
    return tables.from_edge_list(tables.to_edge_list(V.supply(spark, sf))).edges.select("source_id", "target_id")


@query(f"WITH e AS ({V.TRADE}) SELECT a.n_name AS id, string_agg(coalesce(e.weight, 0)::BIGINT::VARCHAR, ',' ORDER BY b.n_nationkey) AS cells FROM nation a JOIN nation b ON TRUE LEFT JOIN e ON e.source_id = a.n_name AND e.target_id = b.n_name GROUP BY a.n_name")
def adjacency_matrix_trade(spark, sf):
    return tables.to_adjacency_matrix(V.trade(spark, sf)).select("id", F.array_join(F.transform("row", lambda x: x.cast("long").cast("string")), ",").alias("cells"))


@query(f"WITH e AS ({V.TRADE}) SELECT source_id, target_id, weight FROM (SELECT (s.n_nationkey + 1)::VARCHAR AS source_id, (t.n_nationkey + 1)::VARCHAR AS target_id, weight FROM e JOIN nation s ON s.n_name = e.source_id JOIN nation t ON t.n_name = e.target_id) x")
def matrix_market_trade(spark, sf):
    return tables.from_matrix_market(tables.to_matrix_market(V.trade(spark, sf))).edges.select("source_id", "target_id", "weight")


@query("SELECT concat('n', a) AS source_id, concat('n', b) AS target_id, concat('e', row_number() OVER (ORDER BY a, b) - 1) AS id FROM range(200) x(a) JOIN range(200) y(b) ON a < b")
def complete_graph(spark, sf):
    return generators.create_complete_graph(spark, 200).edges.select("id", "source_id", "target_id")


@query("WITH c AS (SELECT a AS c FROM range(600) x(a)), e AS (SELECT c, 0 AS w, c + 1 AS t FROM c WHERE c % 30 < 29 UNION ALL SELECT c, 1, c + 30 FROM c WHERE c < 570) SELECT concat('e', row_number() OVER (ORDER BY c, w) - 1) AS id, concat('n', c) AS source_id, concat('n', t) AS target_id FROM e")
def grid_graph(spark, sf):
    return generators.create_grid_graph(spark, 20, 30).edges.select("id", "source_id", "target_id")


@query("SELECT min(c_acctbal) AS x, min(c_custkey)::DOUBLE AS y, max(c_acctbal) - min(c_acctbal) AS width, (max(c_custkey) - min(c_custkey))::DOUBLE AS height FROM customer")
def layout_bounds(spark, sf):
    nodes = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"))
    box = layout.get_layout_bounds(V.graph_from_tables(nodes, spark.createDataFrame([], "id string, source_id string, target_id string")))
    return spark.createDataFrame([tuple(box[k] for k in ("x", "y", "width", "height"))], "x double, y double, width double, height double")


# without a SQL form: tests hold them against brute force


@query()
def minimum_spanning_tree_trade(spark, sf):
    return structure.get_minimum_spanning_tree(V.trade(spark, sf).with_(mode=UNDIRECTED), "kruskal").edges.select(*EDGE)


@query()
def max_flow_trade(spark, sf):
    names = [r[0] for r in V.trade(spark, sf).nodes.orderBy("ord").select("id").collect()]
    return structure.get_max_flow(V.trade(spark, sf), names[0], names[-1])[1]


@query()
def louvain_supply(spark, sf):
    return community.get_louvain_communities(V.supply(spark, sf))


@query()
def hits_trade(spark, sf):
    return centrality.get_hits(V.trade(spark, sf))


@query()
def random_walk_flow(spark, sf):
    g = V.flow(spark, sf)
    return coverage.gen_weighted_random_walk(g, 1000, seed=7, start=g.nodes.agg(F.min("id")).first()[0])


@query()
def preorder_chain(spark, sf):
    g = V.chain(spark, sf)
    return traversal.dfs(g, queries.get_sources(g).select("id"))
