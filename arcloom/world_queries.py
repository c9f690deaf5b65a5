"""Registered queries of further operators, mostly over a tree of the world, its regions, nations and customers, where SQL
can say what each operator gives. They register themselves beside those of queries.py."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import views as V
from .model import UNDIRECTED, create_graph, create_port
from .operators import centrality, changes, community, coverage, generators, layout, paths, queries, structure, transforms, traversal
from .queries import LEFT, RIGHT, _two, query
from .sources import tables

W, N = f"e AS ({V.WORLD})", f"n AS ({V.WORLD_NODES})"
E, L = f"e AS ({V.LANDS})", f"n AS ({V.LAND_NODES})"


def told(spark, **values) -> DataFrame:
    """what and value, as text: answers that are one value each."""
    text = {True: "true", False: "false", None: None}
    return spark.createDataFrame([(k, text[v] if v is None or isinstance(v, bool) else str(v)) for k, v in values.items()], "what string, value string")


def lists(**frames: DataFrame) -> DataFrame:
    """what and value of the first column of each frame."""
    return reduce(DataFrame.unionByName, [f.select(F.lit(k).alias("what"), F.col(f.columns[0]).cast("string").alias("value")) for k, f in frames.items()])


def said(**values: str) -> str:
    """SQL for told(): an expression for each value."""
    return " UNION ALL ".join(f"SELECT '{k}' AS what, CAST({v} AS VARCHAR) AS value" for k, v in values.items())


def listed(**queries_: str) -> str:
    """SQL for lists(): a query of one column, named x, for each."""
    return " UNION ALL ".join(f"SELECT '{k}' AS what, CAST(x AS VARCHAR) AS value FROM ({v}) q_{k}" for k, v in queries_.items())


# lookups


@query(
    f"WITH {W}, {N} " + said(has_node="true", has_no_node="false", has_edge="true", has_no_edge="false", degree="(SELECT count(*) FROM e WHERE 'n3' IN (source_id, target_id))", in_degree="1", out_degree="(SELECT count(*) FROM e WHERE source_id = 'n3')")
    + " UNION ALL " + listed(
        node="SELECT id AS x FROM n WHERE id = 'n3'", edge="SELECT target_id AS x FROM e WHERE id = 'e-n3'", in_edges="SELECT id AS x FROM e WHERE target_id = 'n3'", out_edges="SELECT id AS x FROM e WHERE source_id = 'n3'",
        between="SELECT id AS x FROM e WHERE source_id = 'w' AND target_id = 'r1'", directed="SELECT id AS x FROM e", successors="SELECT target_id AS x FROM e WHERE source_id = 'r1'", predecessors="SELECT source_id AS x FROM e WHERE target_id = 'r1'",
        neighbors="SELECT CASE WHEN source_id = 'r1' THEN target_id ELSE source_id END AS x FROM e WHERE 'r1' IN (source_id, target_id)", sources="SELECT 'w' AS x", sinks="SELECT id AS x FROM n WHERE id NOT IN (SELECT source_id FROM e)",
    )
)
def lookups_world(spark, sf):
    g = V.world(spark, sf)
    one = told(spark, has_node=queries.has_node(g, "n3"), has_no_node=queries.has_node(g, "zz"), has_edge=queries.has_edge(g, "e-n3"), has_no_edge=queries.has_edge(g, "zz"), degree=queries.get_degree(g, "n3"), in_degree=queries.get_in_degree(g, "n3"), out_degree=queries.get_out_degree(g, "n3"))
    more = lists(
        node=queries.get_node(g, "n3").select("id"), edge=queries.get_edge(g, "e-n3").select("target_id"), in_edges=queries.get_in_edges(g, "n3").select("id"), out_edges=queries.get_out_edges(g, "n3").select("id"),
        between=queries.get_edges_between(g, "w", "r1").select("id"), directed=queries.edge_modes(g).filter("directed").select("id"), successors=queries.get_successors(g, "r1").select("id"), predecessors=queries.get_predecessors(g, "r1").select("id"),
        neighbors=queries.get_neighbors(g, "r1").select("id"), sources=queries.get_sources(g).select("id"), sinks=queries.get_sinks(g).select("id"),
    )
    return one.unionByName(more)


@query(
    "WITH " + f"n AS ({V.GEO_NODES.replace('STRING', 'VARCHAR')}) "
    + said(
        leaf="true", no_leaf="false", compound="true", depth="2", lca="(SELECT CASE WHEN a.n_nationkey = b.n_nationkey THEN concat('n', a.n_nationkey) WHEN a.n_regionkey = b.n_regionkey THEN concat('r', a.n_regionkey) END FROM customer x JOIN nation a ON a.n_nationkey = x.c_nationkey, customer y JOIN nation b ON b.n_nationkey = y.c_nationkey WHERE x.c_custkey = 1 AND y.c_custkey = 2)",
        lca_of_two="(SELECT concat('r', n_regionkey) FROM nation WHERE n_nationkey = 3)",
    )
    + " UNION ALL " + listed(children="SELECT id AS x FROM n WHERE parent_id = 'r1'", roots="SELECT id AS x FROM n WHERE parent_id IS NULL", parent="SELECT parent_id AS x FROM n WHERE id = 'n3'", ancestors="SELECT parent_id AS x FROM n WHERE id = 'n3'", siblings="SELECT id AS x FROM n WHERE parent_id IS NULL AND id <> 'r0'")
)
def hierarchy_geo(spark, sf):
    g = V.geo(spark, sf)
    other = g.nodes.filter("id LIKE 'n%'").join(g.nodes.filter("id = 'n3'").select("parent_id"), "parent_id", "left_semi").filter("id <> 'n3'").agg(F.min("id")).first()[0] or "n3"
    one = told(spark, leaf=queries.is_leaf(g, "c1"), no_leaf=queries.is_leaf(g, "r1"), compound=queries.is_compound(g, "r1"), depth=queries.get_depth(g, "c1"), lca=queries.get_lca(g, "c1", "c2"), lca_of_two=queries.get_lca(g, "n3", other))
    return one.unionByName(lists(children=queries.get_children(g, "r1").select("id"), roots=queries.get_roots(g).select("id"), parent=queries.get_parent(g, "n3").select("id"), ancestors=queries.get_ancestors(g, "n3").select("id"), siblings=queries.get_siblings(g, "r0").select("id")))


@query(
    "SELECT 'ports' AS what, x AS value FROM (VALUES ('in'), ('out')) t(x) UNION ALL SELECT 'port', 'out' UNION ALL SELECT 'by_port', 'ab' UNION ALL SELECT 'by_port', 'loop' UNION ALL SELECT 'by_port', 'loop' UNION ALL SELECT 'distances', 'c:2' UNION ALL SELECT 'distances', 'a:0' UNION ALL SELECT 'distances', 'b:1' UNION ALL SELECT 'distance', '2' UNION ALL SELECT 'visual', 'ab' UNION ALL SELECT 'visual', 'loop' UNION ALL SELECT 'visual', 'bc'"
)
def ports_small(spark, sf):
    nodes = [{"id": "p", "initial_node_id": "a"}, {"id": "a", "parent_id": "p", "ports": [create_port("in", "in"), create_port("out", "inout")]}, {"id": "b", "parent_id": "p"}, {"id": "c", "parent_id": "p"}]
    edges = [{"id": "ab", "source_id": "a", "target_id": "b", "source_port": "out"}, {"id": "loop", "source_id": "a", "target_id": "a", "source_port": "out", "target_port": "out"}, {"id": "bc", "source_id": "b", "target_id": "c"}]
    g = create_graph(spark, nodes, edges)
    away = queries.get_relative_distance_map(g, "p").select(F.concat("id", F.lit(":"), "distance").alias("x"))
    from .model import create_visual_graph

    many = lists(ports=queries.get_ports(g, "a").select("name"), port=queries.get_port(g, "a", "out").select("name"), by_port=queries.get_edges_by_port(g, "a", "out").select("id"), distances=away, visual=create_visual_graph(g).edges.select("id"))
    return many.unionByName(told(spark, distance=queries.get_relative_distance(g, "c")))


# changes


def _changed(spark, sf):
    g = V.world(spark, sf)
    g = changes.add_edge(changes.add_node(g, id="x1"), id="ex1", source_id="w", target_id="x1", weight=3.0)
    g = changes.add_entities(g, [{"id": "x2"}], [{"id": "ex2", "source_id": "x1", "target_id": "x2", "weight": 4.0}])
    g = changes.update_edge(changes.update_node(g, "n3", label="Three"), "e-n3", weight=99.0)
    g = changes.update_entities(g, {"n4": {"label": "Four"}}, {"e-n4": {"weight": 98.0}})
    return changes.delete_entities(changes.delete_node(changes.delete_edge(g, "e-n5"), "n6"), ["n7", "e-n8"])


@query(
    f"WITH {W} SELECT id, source_id, target_id, CASE id WHEN 'e-n3' THEN 99.0 WHEN 'e-n4' THEN 98.0 ELSE weight END AS weight FROM e WHERE id NOT IN ('e-n5', 'e-n8') AND source_id NOT IN ('n6', 'n7') AND target_id NOT IN ('n6', 'n7') UNION ALL VALUES ('ex1', 'w', 'x1', 3.0), ('ex2', 'x1', 'x2', 4.0)"
)
def changed_edges_world(spark, sf):
    return _changed(spark, sf).edges.select("id", "source_id", "target_id", "weight")


@query(f"WITH {N} SELECT id, CASE id WHEN 'n3' THEN 'Three' WHEN 'n4' THEN 'Four' END AS label FROM n WHERE id NOT IN ('n6', 'n7') UNION ALL VALUES ('x1', NULL), ('x2', NULL)")
def changed_nodes_world(spark, sf):
    return changes.to_node_config(_changed(spark, sf)).select("id", "label")


@query(f"WITH {LEFT}, {RIGHT} " + said(same="true", other="false", equal="true", layout="true", not_layout="false", graph="true", no_graph="false", as_diff="true") + " UNION ALL SELECT 'back', id || ':' || CAST(weight AS BIGINT) FROM l UNION ALL SELECT 'forth', id || ':' || CAST(weight AS BIGINT) FROM r")
def diffs_and_patches_trade(spark, sf):
    left, right = _two(spark, sf)
    diff = changes.get_diff(left, right)
    forth = changes.update_graph_with_patches(left, changes.get_patches(left, right))
    back = changes.apply_patches(right, changes.to_patches(changes.invert_diff(diff)))
    name = left.nodes.agg(F.min("id")).first()[0]
    a, b = (g.nodes.filter(F.col("id") == name).first() for g in (left, changes.update_node(left, name, x=5.0)))
    one = told(
        spark, same=changes.is_empty_diff(changes.get_diff(left, left)), other=changes.is_empty_diff(diff), equal=changes.are_entities_equal(a, a), layout=changes.is_non_layout_equal(a, b), not_layout=changes.is_layout_equal(a, b),
        graph=changes.is_graph(left), no_graph=changes.is_graph("left"), as_diff=changes.to_diff(changes.to_patches(diff)).count() == diff.count(),
    )
    weight = F.concat("id", F.lit(":"), F.col("weight").cast("long"))
    return one.unionByName(lists(back=back.edges.select(weight), forth=forth.edges.select(weight)))


# traversal


_DOWN = "p AS (SELECT 'w' AS id, '' AS path, 0 AS depth, 0.0::DOUBLE AS cost UNION ALL SELECT e.target_id, p.path || '/' || lpad(CAST(e.ord AS VARCHAR), 12, '0'), p.depth + 1, p.cost + e.weight FROM p JOIN e ON e.source_id = p.id)"


@query(f"WITH RECURSIVE {W}, {_DOWN} SELECT id, depth::BIGINT AS depth FROM p")
def bfs_world(spark, sf):
    return traversal.bfs(V.world(spark, sf), "w").select("id", "depth")


@query(f"WITH RECURSIVE {W}, {_DOWN} SELECT row_number() OVER (ORDER BY path) - 1 AS at, id FROM p")
def preorder_world(spark, sf):
    return traversal.get_preorder(V.world(spark, sf), "w")


@query(f"WITH RECURSIVE {W}, {_DOWN} SELECT row_number() OVER (ORDER BY path) - 1 AS at, id FROM p")
def dfs_world(spark, sf):
    return traversal.dfs(V.world(spark, sf), "w")


@query(f"WITH RECURSIVE {W}, {_DOWN} SELECT row_number() OVER (ORDER BY path || '~') - 1 AS at, id FROM p")
def postorder_world(spark, sf):
    return traversal.get_postorder(V.world(spark, sf), "w")


@query(
    f"WITH {W} " + said(path="true", no_path="false", components="1", connected="true", weakly="true", strongly="false", acyclic="true", tree="true", arborescence="true", not_rooted="false", sorted="(SELECT count(*) FROM e)", preorders="2", postorders="2")
    + " UNION ALL " + listed(near="SELECT 'n3' AS x UNION ALL SELECT target_id FROM e WHERE source_id = 'n3'")
)
def shape_world(spark, sf):
    g = V.world(spark, sf)
    at = traversal.get_topological_sort(g)
    ends = g.edges.join(at.select(F.col("id").alias("source_id"), F.col("at").alias("a")), "source_id").join(at.select(F.col("id").alias("target_id"), F.col("at").alias("b")), "target_id")
    fork = create_graph(spark, [{"id": i} for i in "abc"], [{"id": "x", "source_id": "a", "target_id": "b"}, {"id": "y", "source_id": "a", "target_id": "c"}])
    one = told(
        spark, path=traversal.has_path(g, "w", "c1"), no_path=traversal.has_path(g, "c1", "w"), components=traversal.component_count(g), connected=traversal.is_connected(g), weakly=traversal.is_weakly_connected(g),
        strongly=traversal.is_strongly_connected(g), acyclic=traversal.is_acyclic(g), tree=traversal.is_tree(g), arborescence=traversal.is_arborescence(g), not_rooted=traversal.is_arborescence(g, "n3"), sorted=ends.filter("a < b").count(),
        preorders=traversal.get_preorders(fork, "a").count(), postorders=traversal.get_postorders(fork, "a").count(),
    )
    return one.unionByName(lists(near=traversal.get_neighborhood(g, ["n3"], 1).nodes.select("id")))


# paths


def _ends(paths_: DataFrame) -> DataFrame:
    return paths_.select("source", F.element_at("steps", -1)["node"].alias("id"), F.size("steps").cast("long").alias("steps"), "cost")


@query(f"WITH RECURSIVE {W}, {_DOWN} SELECT 'w' AS source, id, depth::BIGINT AS steps, cost FROM p WHERE depth > 0")
def shortest_paths_world(spark, sf):
    return _ends(paths.get_shortest_paths(V.world(spark, sf), "w"))


_PAIRS = "p AS (SELECT source_id AS source, target_id AS id, 1 AS steps, weight AS cost FROM e UNION ALL SELECT p.source, e.target_id, p.steps + 1, p.cost + e.weight FROM p JOIN e ON e.source_id = p.id)"


@query(f"WITH RECURSIVE {E}, {_PAIRS} SELECT source, id, steps::BIGINT AS steps, cost FROM p")
def all_pairs_lands(spark, sf):
    return _ends(paths.get_all_pairs_shortest_paths(V.lands(spark, sf)))


@query(f"WITH RECURSIVE {E}, {_PAIRS} SELECT source, id, steps::BIGINT AS steps, cost FROM p")
def simple_paths_lands(spark, sf):
    return _ends(paths.get_simple_paths(V.lands(spark, sf), everywhere=True))


_ROUTE = "(SELECT 'w>r' || n_regionkey || '>n3' FROM nation WHERE n_nationkey = 3)"


@query(f"WITH {E} " + said(shortest=_ROUTE, a_star=_ROUTE, simple=_ROUTE, ranked=_ROUTE, joined=_ROUTE, no_cycles="0", no_cycle="0", ring_cycles="1", ring_cycle="6", circuit="6", euler="2", no_circuit="0"))
def single_paths_lands(spark, sf):
    g = V.lands(spark, sf)
    route = lambda p: p.select(F.array_join(coverage.get_path_nodes(), ">").alias("x")).first()[0]
    region = queries.get_predecessors(g, "n3").first()["id"]
    ring = create_graph(spark, [{"id": f"a{i}"} for i in range(6)], [{"id": f"e{i}", "source_id": f"a{i}", "target_id": f"a{(i + 1) % 6}"} for i in range(6)])
    line = create_graph(spark, [{"id": i} for i in "abc"], [{"id": "x", "source_id": "a", "target_id": "b"}, {"id": "y", "source_id": "b", "target_id": "c"}])
    steps = lambda p: p.select(F.size("steps")).first()[0]
    return told(
        spark, shortest=route(paths.get_shortest_path(g, "w", "n3")), a_star=route(paths.get_a_star_path(g, "w", "n3", lambda _: 0.0)), simple=route(paths.get_simple_path(g, "w", "n3")), ranked=route(paths.get_shortest_simple_paths(g, "w", "n3", 3)),
        joined=route(paths.join_paths(paths.get_shortest_path(g, "w", region), paths.get_shortest_path(g, region, "n3"))), no_cycles=paths.get_cycles(g).count(), no_cycle=paths.get_cycle(g).count(), ring_cycles=paths.get_cycles(ring).count(),
        ring_cycle=steps(paths.get_cycle(ring)), circuit=steps(paths.get_eulerian_circuit(ring)), euler=steps(paths.get_eulerian_path(line)), no_circuit=paths.get_eulerian_circuit(line).count(),
    )


# structure


@query(
    f"WITH {W}, {N} " + listed(tree="SELECT id AS x FROM e", bridges="SELECT id AS x FROM e", cut_points="SELECT id AS x FROM n WHERE (SELECT count(*) FROM e WHERE n.id IN (source_id, target_id)) > 1", dominators="SELECT target_id || '<' || source_id AS x FROM e", blocks="SELECT target_id || '+' || source_id AS x FROM e", core="SELECT id AS x FROM n")
    + " UNION ALL " + said(colors="true", bipartite="true", planar="true", no_core="0", components="(SELECT count(*) FROM n)")
)
def structure_world(spark, sf):
    g, u = V.world(spark, sf), V.world(spark, sf, UNDIRECTED)
    rank = F.when(F.col("id") == "w", 0).when(F.col("id").startswith("r"), 1).when(F.col("id").startswith("n"), 2).otherwise(3)
    blocks = structure.get_biconnected_components(u).withColumn("rank", rank).groupBy("block").agg(F.array_join(F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("rank", "id")))), lambda x: x["id"]), "+").alias("x"))
    many = lists(
        tree=structure.get_minimum_spanning_tree(u).edges.select("id"), bridges=structure.get_bridges(u).select("id"), cut_points=structure.get_articulation_points(u).select("id"),
        dominators=structure.get_dominator_tree(g, "w").filter("dominator IS NOT NULL").select(F.concat("id", F.lit("<"), "dominator")), blocks=blocks.select("x"), core=structure.get_k_core(u, 1).select("id"),
    )
    colors = structure.get_graph_coloring(u)
    return many.unionByName(told(spark, colors=structure.is_valid_coloring(u, colors), bipartite=structure.is_bipartite(u), planar=structure.is_planar(V.lands(spark, sf, UNDIRECTED)), no_core=structure.get_k_core(u, 2).count(), components=paths.get_strongly_connected_components(g).select(F.countDistinct("at")).first()[0]))


_LEAST = "(SELECT min(weight) FROM e WHERE target_id = 'n3' OR target_id = (SELECT source_id FROM e WHERE target_id = 'n3'))"


@query(f"WITH {E}, {L} " + said(flow=_LEAST, cut=_LEAST, matching="(SELECT count(*) FROM region)", tour="6.0", stops="6", isomorphic="true", not_isomorphic="false") + " UNION ALL " + listed(steiner="SELECT id AS x FROM e WHERE target_id IN ('n3', 'r0', 'r1', 'r2', 'r3', 'r4') AND (target_id = 'n3' OR target_id = (SELECT source_id FROM e WHERE target_id = 'n3'))"))
def flows_lands(spark, sf):
    g, u = V.lands(spark, sf), V.lands(spark, sf, UNDIRECTED)
    tour, length = structure.get_tsp_tour(generators.create_complete_graph(spark, 6))
    return told(
        spark, flow=structure.get_max_flow(g, "w", "n3")[0], cut=structure.get_min_cut(g, "w", "n3")[0], matching=structure.get_maximum_bipartite_matching(u).count(), tour=length, stops=len(tour),
        isomorphic=structure.is_isomorphic(g, g), not_isomorphic=structure.is_isomorphic(g, transforms.get_reversed_graph(g)),
    ).unionByName(lists(steiner=structure.get_steiner_tree(u, ["w", "n3"]).edges.select("id")))


@query("SELECT concat('n', a) AS id, round(1 / sqrt(30), 5) AS eigenvector, round(1 / sqrt(30), 5) AS katz, round(1 / sqrt(30), 5) AS hub, round(1 / sqrt(30), 5) AS authority FROM range(30) x(a)")
def scores_complete(spark, sf):
    g = generators.create_complete_graph(spark, 30)
    own = centrality.get_eigenvector_centrality(g).select("id", F.round("score", 5).alias("eigenvector")).join(centrality.get_katz_centrality(g, 0.01).select("id", F.round("score", 5).alias("katz")), "id")
    return own.join(centrality.get_hits(g).select("id", F.round("hub", 5).alias("hub"), F.round("authority", 5).alias("authority")), "id")


@query("SELECT algorithm, concat('n', n_nationkey) AS id, concat('n', min(n_nationkey) OVER (PARTITION BY n_regionkey, algorithm)) AS community FROM nation, (VALUES ('louvain'), ('greedy'), ('propagated')) t(algorithm)")
def communities_neighbors(spark, sf):
    nations = V._frame(spark, sf, "SELECT concat('n', n_nationkey) AS id, CAST(n_nationkey AS BIGINT) AS ord, n_regionkey FROM nation")
    other = nations.select(F.col("id").alias("target_id"), F.col("ord").alias("o"), "n_regionkey")
    edges = nations.join(other, "n_regionkey").filter("ord < o").select(F.concat("id", F.lit("-"), "target_id").alias("id"), F.col("id").alias("source_id"), "target_id", (F.col("ord") * 100 + F.col("o")).alias("ord"))
    from .model import graph_from_tables

    g = graph_from_tables(nations.select("id", "ord"), edges, UNDIRECTED)
    named = lambda df, name: df.join(g.nodes.select("id", "ord"), "id").select(F.lit(name).alias("algorithm"), "id", F.concat(F.lit("n"), F.min("ord").over(_by_community)).alias("community"))
    from pyspark.sql import Window

    _by_community = Window.partitionBy("community")
    found = (("louvain", community.get_louvain_communities(g)), ("greedy", community.get_greedy_modularity_communities(g)), ("propagated", community.get_label_propagation_communities(g)))
    return reduce(DataFrame.unionByName, [named(df, name) for name, df in found])


# transforms


@query(f"WITH {W} SELECT id, target_id AS source_id, source_id AS target_id, 'w' || CAST(weight AS BIGINT) AS data FROM e WHERE weight > 2 AND source_id <> 'n3' AND target_id <> 'n3'")
def transformed_world(spark, sf):
    g = transforms.get_filtered_graph(V.world(spark, sf), F.col("id") != "n3", F.col("weight") > 2)
    g = transforms.get_mapped_graph(transforms.reverse_graph(g), edge=F.concat(F.lit("w"), F.col("weight").cast("long")))
    return g.edges.select("id", "source_id", "target_id", "data")


# coverage and walks


@query(f"WITH {E} SELECT 'w>' || a.target_id || '>' || b.target_id AS nodes, a.id || ',' || b.id AS edges, a.weight + b.weight AS weight, true AS valid, 1.0 AS coverage FROM e a JOIN e b ON b.source_id = a.target_id WHERE a.source_id = 'w'")
def edge_coverage_lands(spark, sf):
    g = V.lands(spark, sf)
    made = coverage.get_reduced_paths(coverage.get_coverage_preserving_paths(coverage.get_edge_coverage_paths(g, "w"), coverage.get_coverage_targets(g)))
    share = coverage.get_path_coverage(made, coverage.get_coverage_targets(g))
    whole = made.select("path", F.array_join(coverage.get_path_nodes(), ">").alias("nodes"), F.array_join(coverage.get_path_edges(), ",").alias("edges"))
    return whole.join(coverage.get_path_weights(g, made), "path").join(coverage.valid_paths(g, made), "path").select("nodes", "edges", "weight", "valid", F.lit(float(share["ratio"])).alias("coverage"))


@query(f"WITH RECURSIVE {E}, {L} SELECT concat('node:', id) AS target FROM n UNION ALL SELECT concat('path:', '{{\"source\":\"w\",\"edges\":[\"', a.id, '\",\"', b.id, '\"]}}') FROM e a JOIN e b ON b.source_id = a.target_id")
def targets_lands(spark, sf):
    g = V.lands(spark, sf)
    return coverage.get_coverage_targets(g, "nodes").unionByName(coverage.get_coverage_targets(g, "maximal-simple-paths")).select("target")


@query(f"WITH {E}, r AS (SELECT source_id AS region FROM e WHERE target_id = 'n3') SELECT what, step::BIGINT AS step, CASE step WHEN 0 THEN region ELSE 'n3' END AS node FROM r, (VALUES ('all', 0), ('all', 1), ('one', 0), ('until node', 0), ('until edge', 0), ('until edge', 1)) t(what, step)")
def walks_lands(spark, sf):
    g = V.lands(spark, sf)
    region = queries.get_predecessors(g, "n3").first()["id"]
    walk = coverage.gen_predefined_walk(g, [f"e-{region}", "e-n3"], "w")
    found = {"all": walk, "one": coverage.take_steps(walk, 1), "until node": coverage.take_until_node(walk, region), "until edge": coverage.take_until_edge(walk, "e-n3")}
    return reduce(DataFrame.unionByName, [w.select(F.lit(k).alias("what"), "step", "node") for k, w in found.items()])


# generators


@query("SELECT least(a, (a + k) % 40)::BIGINT AS low, greatest(a, (a + k) % 40)::BIGINT AS high FROM range(40) x(a), (VALUES (1), (2)) t(k)")
def ring_lattice(spark, sf):
    number = lambda c: F.expr(f"cast(substring({c}, 2) as bigint)")
    g = generators.create_watts_strogatz_graph(spark, 40, 4, 0.0, 7)
    return g.edges.select(F.least(number("source_id"), number("target_id")).alias("low"), F.greatest(number("source_id"), number("target_id")).alias("high"))


@query(said(random_none="0", random_all="1225", grown_nodes="50", grown_connected="true", states="3", transitions="3"))
def generated(spark, sf):
    grown = generators.create_barabasi_albert_graph(spark, 50, 2, 3)
    machine = generators.create_graph_from_machine(spark, {"red": {"on": {"t": "green"}}, "green": {"on": {"t": "yellow"}}, "yellow": {"on": {"t": "red"}}}, "red")
    return told(
        spark, random_none=generators.create_random_graph(spark, 50, 0.0, 3).edges.count(), random_all=generators.create_random_graph(spark, 50, 1.0, 3).edges.count(), grown_nodes=grown.nodes.count(), grown_connected=traversal.is_connected(grown),
        states=machine.nodes.count(), transitions=machine.edges.count(),
    )


@query(f"WITH {W} SELECT source_id AS src, target_id AS dst, id AS edge_id, weight AS w FROM e")
def sparse_rows_world(spark, sf):
    return generators.get_csr(generators.get_graph_snapshot(V.world(spark, sf))).select("src", "dst", "edge_id", "w")


# layout


@query(f"WITH RECURSIVE {E}, {_DOWN} SELECT id, depth * 90.0 AS y, 100.0 AS width, 50.0 AS height FROM p")
def tidy_tree_lands(spark, sf):
    g = V.lands(spark, sf)
    return layout.get_tidy_tree_layout(g, "w").select("id", "y").join(layout.get_node_sizes(g), "id")


@query("SELECT concat('c', c_custkey) AS id, c_acctbal + 10 AS moved_x, c_custkey - 5.0 AS moved_y, round(c_acctbal - (min(c_acctbal) OVER () + max(c_acctbal) OVER ()) / 2, 6) AS centered_x, round(c_acctbal / 2, 6) AS half_x FROM customer")
def placed_customers(spark, sf):
    frame = V._frame(spark, sf, "SELECT concat('c', c_custkey) AS id, c_acctbal AS x, CAST(c_custkey AS DOUBLE) AS y FROM customer")
    from .model import graph_from_tables

    g = layout.apply_layout_frame(graph_from_tables(frame.select("id"), spark.createDataFrame([], "id string, source_id string, target_id string")), frame)
    moved = layout.translate_graph(g, 10.0, -5.0).nodes.select("id", F.col("x").alias("moved_x"), F.col("y").alias("moved_y"))
    middle = layout.center_graph(g, 0.0, 0.0, 0.0, 0.0).nodes.select("id", F.round("x", 6).alias("centered_x"))
    half = layout.gen_layout_transition(frame.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), frame, 2).filter("frame = 1").select("id", F.round("x", 6).alias("half_x"))
    return moved.join(middle, "id").join(half, "id")


# formats


#: Formats that keep ids of nodes and order of edges, whatever they are.
_KEPT = ("tgf", "gml", "dot", "d2", "plantuml", "networkx", "graphology", "graphlib", "cytoscape", "d3", "jgf", "xyflow", "elk", "cx2", "graphson", "graphviz-json", "graphml", "gexf", "dgml", "drawio", "mermaid/flowchart", "mermaid/state", "mermaid/sequence", "mermaid/class", "mermaid/er", "mermaid/requirement", "mermaid/architecture", "mermaid/block", "mermaid/c4", "mermaid/usecase", "mermaid/sankey", "mermaid/mindmap", "mermaid/ishikawa")


@query(f"WITH {E}, f AS (SELECT unnest([{', '.join(repr(x) for x in _KEPT)}]) AS format) SELECT format, source_id, target_id FROM e, f")
def documents_lands(spark, sf):
    """Written in each document format and read back where the documents lie."""
    from .sources.registry import read_documents, to_document

    g = V.lands(spark, sf)
    out = []
    for name in _KEPT:
        docs = spark.createDataFrame([(name, to_document(g, name))], "graph_id string, text string")
        out.append(read_documents(docs, name)[1].select(F.col("graph_id").alias("format"), "source_id", "target_id"))
    return reduce(DataFrame.unionByName, out)


@query(f"WITH {E}, {L}, k AS (SELECT id, row_number() OVER (ORDER BY ord)::VARCHAR AS k FROM n) SELECT a.k AS source_id, b.k AS target_id, e.weight FROM e JOIN k a ON a.id = source_id JOIN k b ON b.id = target_id")
def pajek_lands(spark, sf):
    """A format whose ids are places in the document."""
    from .sources.registry import from_document, to_document

    return from_document(spark, to_document(V.lands(spark, sf), "pajek"), "pajek").edges.select("source_id", "target_id", "weight")


@query(f"WITH {E}, f AS (SELECT unnest(['csv', 'tsv', 'adjacency list', 'edge list']) AS format) SELECT format, source_id, target_id FROM e, f UNION ALL SELECT 'matrix', source_id, target_id FROM e")
def tables_lands(spark, sf):
    g = V.lands(spark, sf)
    csv, tsv = tables.to_csv(g), tables.to_tsv(g)
    back = {
        "csv": tables.from_csv(spark, csv["nodes"], csv["edges"]), "tsv": tables.from_tsv(spark, tsv["nodes"], tsv["edges"]), "adjacency list": tables.from_adjacency_list(tables.to_adjacency_list(g)),
        "edge list": tables.from_edge_list(tables.to_edge_list(g)), "matrix": tables.from_adjacency_matrix(tables.to_adjacency_matrix(g)),
    }
    return reduce(DataFrame.unionByName, [b.edges.select(F.lit(k).alias("format"), "source_id", "target_id") for k, b in back.items()])


@query("SELECT concat('<http://x/', 'n', n_nationkey, '> <http://x/in> <http://x/r', n_regionkey, '> .') AS line FROM nation")
def statements_nations(spark, sf):
    lines = V._frame(spark, sf, "SELECT concat('<http://x/', 'n', n_nationkey, '> <http://x/in> <http://x/r', n_regionkey, '> .') AS value FROM nation")
    g = tables.from_rdf_dataset(tables.to_rdf_dataset(tables.from_rdf(lines)))
    return tables.to_rdf(g).toDF("line")


def _ring(spark, n: int):
    return create_graph(spark, [{"id": f"a{i}"} for i in range(n)], [{"id": f"e{i}", "source_id": f"a{i}", "target_id": f"a{(i + 1) % n}", "weight": 1.0} for i in range(n)])


@query(
    "SELECT kind, a::BIGINT AS step, concat('e', a % 8) AS edge, concat('a', (a + 1) % 8) AS node FROM range(20) x(a), (VALUES ('random', 20), ('weighted', 20), ('all nodes', 7), ('all edges', 8), ('half the nodes', 3)) t(kind, n) WHERE a < n"
)
def walks_ring(spark, sf):
    """On a directed ring every walk, whatever its draws, has one way to go."""
    g = _ring(spark, 8)
    walk = coverage.gen_random_walk(g, 20, 5, "a0")
    found = {
        "random": walk, "weighted": coverage.gen_weighted_random_walk(g, 20, 5, "a0"), "all nodes": coverage.take_until_node_coverage(walk, g, 1.0, "a0"), "all edges": coverage.take_until_edge_coverage(walk, g, 1.0),
        "half the nodes": coverage.take_until_node_coverage(walk, g, 0.5, "a0"),
    }
    return reduce(DataFrame.unionByName, [w.select(F.lit(k).alias("kind"), "step", "edge", "node") for k, w in found.items()])


@query("SELECT level, concat('n', a) AS id, CASE WHEN a < 5 OR level = 0 THEN 'n0' ELSE 'n5' END AS community FROM range(10) x(a), (VALUES (0), (1)) t(level)")
def girvan_newman_two_cliques(spark, sf):
    edges = [(a, b) for a in range(10) for b in range(a + 1, 10) if (a < 5) == (b < 5) or (a, b) == (4, 5)]
    g = create_graph(spark, [{"id": f"n{i}"} for i in range(10)], [{"id": f"{a}-{b}", "source_id": f"n{a}", "target_id": f"n{b}"} for a, b in edges], UNDIRECTED)
    return reduce(DataFrame.unionByName, [community.get_girvan_newman_communities(g, k).select(F.lit(k).alias("level"), "id", "community") for k in (0, 1)])


@query(
    f"WITH {E}, {L} " + said(valid="0", node_coverage="0.5", edge_coverage="0.375", snapshot="'{{\"a\":2,\"b\":[1]}}'".replace("{{", "{").replace("}}", "}"), calls="1", counted="12", counted_edges="12", indexed="(SELECT count(*) FROM e)", placed="(SELECT count(*) FROM n)", visits="'main>side'")
    + " UNION ALL " + listed(configured="SELECT id || ':' || CAST(weight AS BIGINT) AS x FROM e")
)
def odds_and_ends_lands(spark, sf):
    g = V.lands(spark, sf)
    ring = _ring(spark, 8)
    share = coverage.get_coverage(ring, coverage.gen_predefined_walk(ring, ["e0", "e1", "e2"], "a0"), "a0")
    calls = []
    counted = generators.memoize_by_graph(lambda graph: calls.append(1) or graph.edges.count())
    counted(g), counted(g)
    clock = generators.create_graph_from_transition(spark, lambda s, _: (s + 1) % 12, 0, ["tick"])
    index = generators.get_index(g)
    indexed = index.edges.count()
    generators.invalidate_index(index)
    frame = layout.get_force_layout(g, 5)
    git = create_graph(spark, [{"id": "main"}, {"id": "side"}], [{"id": "e0", "source_id": "main", "target_id": "side"}])
    from .sources.registry import from_document, to_document

    back = from_document(spark, to_document(git, "mermaid/gitgraph"), "mermaid/gitgraph")
    one = told(
        spark, valid=changes.validate_graph(g).count(), node_coverage=share["nodes"], edge_coverage=share["edges"], snapshot=generators.get_serialized_snapshot({"b": [1], "a": 2}), calls=len(calls), counted=clock.nodes.count(),
        counted_edges=clock.edges.count(), indexed=indexed, placed=frame.filter("isnotnull(x) AND NOT isnan(x) AND isnotnull(y) AND NOT isnan(y)").count(), visits=back.edges.select(F.concat("source_id", F.lit(">"), "target_id")).first()[0],
    )
    return one.unionByName(lists(configured=changes.to_edge_config(g).select(F.concat("id", F.lit(":"), F.col("weight").cast("long")))))
