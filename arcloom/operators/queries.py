"""Lookups, neighborhoods, degrees, hierarchy and ports, as bulk queries; the single-id forms filter them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..plans.iterate import reach
from ..plans.storage import stored


def get_node(graph: Graph, node_id: str) -> DataFrame:
    """The node row of an id, of repeated ids the last; no row if there is none."""
    return graph.nodes.filter(F.col("id") == node_id).orderBy(F.desc("ord")).limit(1)


def get_edge(graph: Graph, edge_id: str) -> DataFrame:
    return graph.edges.filter(F.col("id") == edge_id).orderBy(F.desc("ord")).limit(1)


def has_node(graph: Graph, node_id: str) -> bool:
    return not graph.nodes.filter(F.col("id") == node_id).isEmpty()


def has_edge(graph: Graph, edge_id: str) -> bool:
    return not graph.edges.filter(F.col("id") == edge_id).isEmpty()


def edge_modes(graph: Graph) -> DataFrame:
    """id, mode and directed: each edge's effective mode."""
    return graph.edges.select("id", graph.edge_mode().alias("mode"), graph.is_directed().alias("directed"))


def get_edges_of(graph: Graph, node_id: str) -> DataFrame:
    """Edges that touch a node, outgoing ones first, a self-loop once."""
    touching = graph.edges.filter((F.col("source_id") == node_id) | (F.col("target_id") == node_id))
    return touching.orderBy(F.col("source_id") != node_id, "ord")


def get_in_edges(graph: Graph, node_id: str) -> DataFrame:
    """Edges whose target is the node, whatever their mode."""
    return graph.edges.filter(F.col("target_id") == node_id).orderBy("ord")


def get_out_edges(graph: Graph, node_id: str) -> DataFrame:
    return graph.edges.filter(F.col("source_id") == node_id).orderBy("ord")


def get_edges_between(graph: Graph, source: str, target: str) -> DataFrame:
    """Edges source to target, then non-directed edges target to source."""
    ahead = (F.col("source_id") == source) & (F.col("target_id") == target)
    back = (F.col("source_id") == target) & (F.col("target_id") == source) & ~graph.is_directed()
    return graph.edges.filter(ahead | back).orderBy(~ahead, "ord")


def successors(graph: Graph) -> DataFrame:
    """id, other: every node that an arc leads to from each node, once; both exist."""
    return graph.arcs().select(F.col("src").alias("id"), F.col("dst").alias("other")).distinct()


def predecessors(graph: Graph) -> DataFrame:
    return graph.arcs().select(F.col("dst").alias("id"), F.col("src").alias("other")).distinct()


def neighbors(graph: Graph) -> DataFrame:
    """id, other: nodes joined by an edge of any mode and direction; a self-loop makes a node its own neighbor."""
    both = graph.valid_edges().select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("other")), F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("other")))).alias("e"))
    return both.select("e.id", "e.other").distinct()


def _nodes_of(graph: Graph, pairs: DataFrame, node_id: str) -> DataFrame:
    others = pairs.filter(F.col("id") == node_id).select(F.col("other").alias("id"))
    return graph.nodes.join(others, "id", "left_semi").orderBy("ord")


def get_successors(graph: Graph, node_id: str) -> DataFrame:
    return _nodes_of(graph, successors(graph), node_id)


def get_predecessors(graph: Graph, node_id: str) -> DataFrame:
    return _nodes_of(graph, predecessors(graph), node_id)


def get_neighbors(graph: Graph, node_id: str) -> DataFrame:
    return _nodes_of(graph, neighbors(graph), node_id)


def degrees(graph: Graph) -> DataFrame:
    """id, degree, in_degree, out_degree of every node.

    The degree counts edge ends, so a self-loop counts 2 and an edge with one missing end counts at the other. In- and
    out-degrees also count a non-directed edge at its other end, except for self-loops.
    """
    loop = F.col("source_id") == F.col("target_id")
    both = ~graph.is_directed() & ~loop
    one, none = F.lit(1), F.lit(0)
    ends = F.array(
        F.struct(F.col("source_id").alias("id"), one.alias("d"), F.when(both, one).otherwise(none).alias("i"), one.alias("o")),
        F.struct(F.col("target_id").alias("id"), one.alias("d"), one.alias("i"), F.when(both, one).otherwise(none).alias("o")),
    )
    counted = graph.edges.select(F.explode(ends).alias("e")).groupBy(F.col("e.id").alias("id")).agg(F.sum("e.d").alias("degree"), F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return graph.distinct_nodes.select("id").join(counted, "id", "left").na.fill(0, ["degree", "in_degree", "out_degree"])


def _one(frame: DataFrame, node_id: str, column: str) -> int:
    row = frame.filter(F.col("id") == node_id).select(column).first()
    return row[0] if row else 0


def get_degree(graph: Graph, node_id: str) -> int:
    return _one(degrees(graph), node_id, "degree")


def get_in_degree(graph: Graph, node_id: str) -> int:
    return _one(degrees(graph), node_id, "in_degree")


def get_out_degree(graph: Graph, node_id: str) -> int:
    return _one(degrees(graph), node_id, "out_degree")


def get_sources(graph: Graph) -> DataFrame:
    """Nodes with in-degree 0, in node order."""
    return graph.nodes.join(degrees(graph).filter("in_degree = 0"), "id", "left_semi").orderBy("ord")


def get_sinks(graph: Graph) -> DataFrame:
    return graph.nodes.join(degrees(graph).filter("out_degree = 0"), "id", "left_semi").orderBy("ord")


# hierarchy


def get_children(graph: Graph, parent_id: str | None) -> DataFrame:
    """Direct children in node order; the roots for None."""
    return graph.nodes.filter(F.col("parent_id").eqNullSafe(F.lit(parent_id))).orderBy("ord")


def get_roots(graph: Graph) -> DataFrame:
    return get_children(graph, None)


def get_parent(graph: Graph, node_id: str) -> DataFrame:
    parent = graph.nodes.filter(F.col("id") == node_id).select(F.col("parent_id").alias("id"))
    return graph.nodes.join(parent, "id", "left_semi")


def ancestry(graph: Graph) -> DataFrame:
    """id, ancestor, distance (1 for the parent) of every node, by doubling; a parent cycle ends at its first repeat."""
    ids = graph.nodes.select(F.col("id").alias("ancestor"))
    parent = graph.nodes.filter("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("ancestor")).distinct().join(ids, "ancestor", "left_semi")
    up = stored(parent.select("id", "ancestor", F.lit(1).alias("distance")), "up")
    span = 1
    while True:
        upper = up.filter(F.col("distance") <= span).select(F.col("id").alias("ancestor"), F.col("ancestor").alias("higher"), F.col("distance").alias("more"))
        top = up.filter(F.col("distance") == span)
        longer = top.join(upper, "ancestor").select("id", F.col("higher").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        longer = stored(longer.filter("id <> ancestor").join(up, ["id", "ancestor"], "left_anti").groupBy("id", "ancestor").agg(F.min("distance").alias("distance")), "up")
        if longer.isEmpty():
            return up
        up, span = stored(up.unionByName(longer), "up"), span * 2


def get_ancestors(graph: Graph, node_id: str) -> DataFrame:
    """The nodes above, the nearest first."""
    above = ancestry(graph).filter(F.col("id") == node_id).select(F.col("ancestor").alias("id"), "distance")
    return graph.nodes.join(above, "id").orderBy("distance").select(*graph.nodes.columns)


def get_descendants(graph: Graph, node_id: str) -> DataFrame:
    """The nodes below, in preorder: each before its children, children in node order."""
    up = ancestry(graph)
    below = up.filter(F.col("ancestor") == node_id).select("id", "distance")
    chain = up.join(below.select("id", F.col("distance").alias("depth")), "id").filter("distance < depth")
    place = graph.nodes.select(F.col("id").alias("ancestor"), F.col("ord").alias("o"))
    own = below.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance"))
    path = chain.select("id", "ancestor", "distance").unionByName(own).join(place, "ancestor").groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "o"))).alias("p"))
    path = path.select("id", F.transform("p", lambda x: x["o"]).alias("path"))
    return graph.nodes.join(path, "id").orderBy("path").select(*graph.nodes.columns)


def depths(graph: Graph) -> DataFrame:
    """id, depth: 0 for roots; a missing parent counts as one level and ends the way up."""
    up = ancestry(graph).groupBy("id").agg(F.max("distance").alias("known"), F.max_by("ancestor", "distance").alias("top"))
    dangling = graph.nodes.filter("parent_id IS NOT NULL").select(F.col("id").alias("top"), "parent_id").join(graph.nodes.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("top", F.lit(1).alias("extra"))
    own = graph.nodes.select("id").distinct().join(up, "id", "left").withColumn("top", F.coalesce("top", "id")).join(dangling, "top", "left")
    return own.select("id", (F.coalesce("known", F.lit(0)) + F.coalesce("extra", F.lit(0))).cast("long").alias("depth"))


def get_depth(graph: Graph, node_id: str) -> int | None:
    row = depths(graph).filter(F.col("id") == node_id).first()
    return row["depth"] if row else None


def compound_nodes(graph: Graph) -> DataFrame:
    """Nodes with a child at least."""
    return graph.nodes.join(graph.nodes.select(F.col("parent_id").alias("id")), "id", "left_semi")


def is_compound(graph: Graph, node_id: str) -> bool:
    return not graph.nodes.filter(F.col("parent_id") == node_id).isEmpty()


def is_leaf(graph: Graph, node_id: str) -> bool:
    return has_node(graph, node_id) and not is_compound(graph, node_id)


def get_siblings(graph: Graph, node_id: str) -> DataFrame:
    """Nodes with the same parent, without the node itself."""
    own = graph.nodes.filter(F.col("id") == node_id).select(F.col("parent_id").alias("p"))
    return graph.nodes.filter(F.col("id") != node_id).join(own, F.col("parent_id").eqNullSafe(F.col("p")), "left_semi").orderBy("ord")


def get_lca(graph: Graph, *ids: str) -> str | None:
    """The lowest node above all the given ones and none of them itself."""
    wanted = set(ids)
    if not wanted or graph.nodes.filter(F.col("id").isin(*wanted)).select("id").distinct().count() < len(wanted):
        return None
    shared = ancestry(graph).filter(F.col("id").isin(*wanted)).groupBy("ancestor").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
    row = shared.filter((F.col("n") == len(wanted)) & ~F.col("ancestor").isin(*wanted)).orderBy("far").first()
    return row["ancestor"] if row else None


def get_relative_distance_map(graph: Graph, parent_id: str | None) -> DataFrame:
    """id, distance: arcs from the parent's initial node to each of its children, over children only."""
    own = graph.nodes.filter(F.col("id") == parent_id).select("initial_node_id").first() if parent_id is not None else None
    start = (own[0] if own else None) if parent_id is not None else graph.initial_node_id
    group = get_children(graph, parent_id).select("id")
    inner = graph.arcs().join(group.withColumnRenamed("id", "src"), "src", "left_semi").join(group.withColumnRenamed("id", "dst"), "dst", "left_semi")
    begin = group.filter(F.col("id") == F.lit(start)).select(F.col("id").alias("node"))
    return reach(begin, inner, []).select(F.col("node").alias("id"), F.col("depth").cast("long").alias("distance"))


def get_relative_distance(graph: Graph, node_id: str) -> int | None:
    own = graph.nodes.filter(F.col("id") == node_id).select("parent_id").first()
    row = own and get_relative_distance_map(graph, own[0]).filter(F.col("id") == node_id).first()
    return row["distance"] if row else None


# ports


def get_ports(graph: Graph, node_id: str) -> DataFrame:
    """The ports of a node, in their order."""
    return get_node(graph, node_id).select(F.posexplode("ports").alias("at", "port")).orderBy("at").select("port.*")


def get_port(graph: Graph, node_id: str, name: str) -> DataFrame:
    return get_ports(graph, node_id).filter(F.col("name") == name).limit(1)


def get_edges_by_port(graph: Graph, node_id: str, name: str) -> DataFrame:
    """Edges that leave by the port, then edges that enter by it; a self-loop through it both ways comes twice."""
    leave = graph.edges.filter((F.col("source_id") == node_id) & (F.col("source_port") == name)).withColumn("way", F.lit(0))
    enter = graph.edges.filter((F.col("target_id") == node_id) & (F.col("target_port") == name)).withColumn("way", F.lit(1))
    return leave.unionByName(enter).orderBy("way", "ord").drop("way")


