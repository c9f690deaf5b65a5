"""Changing graphs, differences and patches, equality and validation. Every change gives a new graph."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..model import EDGE_KINDS, NODE_KINDS, Graph, GraphError, _ddl, _row, create_edge, create_node
from ..plans.storage import stored
from .queries import ancestry

# fixed values: the columns that only say how a graph is drawn
LAYOUT_KEYS = {
    "node": ("x", "y", "width", "height", "style", "color", "shape"),
    "edge": ("x", "y", "width", "height", "points", "routing", "style", "color"),
}
NODE_FIELDS = tuple(k for k in NODE_KINDS if k not in ("id", "ord"))
EDGE_FIELDS = tuple(k for k in EDGE_KINDS if k not in ("id", "ord"))


def to_node_config(graph: Graph) -> DataFrame:
    return graph.nodes.select("id", *NODE_FIELDS)


def to_edge_config(graph: Graph) -> DataFrame:
    return graph.edges.select("id", *EDGE_FIELDS)


def _missing(df: DataFrame, ids: Iterable[str | None]) -> set[str]:
    wanted = {i for i in ids if i is not None}
    return wanted - {r[0] for r in df.filter(F.col("id").isin(*wanted)).select("id").distinct().collect()} if wanted else set()


def _appended(df: DataFrame, rows: list[dict], kinds: dict[str, str]) -> DataFrame:
    at = df.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0] + 1
    return df.unionByName(df.sparkSession.createDataFrame([_row(r, kinds, at + i) for i, r in enumerate(rows)], _ddl(kinds)))


def _check_ports(graph: Graph, edges: list[dict]) -> None:
    wanted = {(e[end], e[port]) for e in edges for end, port in (("source_id", "source_port"), ("target_id", "target_port")) if e.get(port) is not None}
    if wanted:
        rows = graph.nodes.filter(F.col("id").isin(*{n for n, _ in wanted})).select("id", F.explode("ports.name").alias("port")).collect()
        for node, port in sorted(wanted - {tuple(r) for r in rows}):
            raise GraphError(f"node {node} has no port {port}")


def add_entities(graph: Graph, nodes: Iterable[dict] = (), edges: Iterable[dict] = ()) -> Graph:
    """New nodes and edges at the end. Ids must be new, parents and ends known (or added along)."""
    nodes, edges = [create_node(**n) for n in nodes], [create_edge(**e) for e in edges]
    for name, rows, df in (("node", nodes, graph.nodes), ("edge", edges, graph.edges)):
        ids = [r["id"] for r in rows]
        here = set(ids) - _missing(df, ids)
        if here or len(set(ids)) < len(ids):
            raise GraphError(f"{name} id {sorted(here or ids)[0]} is there already")
    fresh = {n["id"] for n in nodes}
    refs = {n.get(k) for n in nodes for k in ("parent_id", "initial_node_id")} | {e[k] for e in edges for k in ("source_id", "target_id")}
    lost = _missing(graph.nodes, refs - fresh)
    if lost:
        raise GraphError(f"node {sorted(lost)[0]} does not exist")
    out = graph.with_(nodes=_appended(graph.nodes, nodes, NODE_KINDS)) if nodes else graph
    _check_ports(out, edges)
    return out.with_(edges=_appended(graph.edges, edges, EDGE_KINDS)) if edges else out


def add_node(graph: Graph, **fields) -> Graph:
    return add_entities(graph, [fields])


def add_edge(graph: Graph, **fields) -> Graph:
    return add_entities(graph, (), [fields])


def delete_entities(graph: Graph, ids: Iterable[str], reparent: bool = False) -> Graph:
    """Without the nodes and edges of these ids; unknown ones are ignored.

    Nodes go with all below them and with their edges; with ``reparent``, children move up to the nearest node left.
    """
    wanted = list(ids)
    gone = graph.nodes.filter(F.col("id").isin(*wanted) if wanted else F.lit(False)).select("id").distinct()
    up = ancestry(graph)
    nodes = graph.nodes
    if reparent:
        high = up.join(gone.select(F.col("id").alias("ancestor")), "ancestor", "left_anti").groupBy("id").agg(F.min_by("ancestor", "distance").alias("higher"))
        own = nodes.join(gone.select(F.col("id").alias("parent_id"), F.lit(True).alias("lost")), "parent_id", "left").join(high, "id", "left")
        nodes = own.withColumn("parent_id", F.when(F.col("lost"), F.col("higher")).otherwise(F.col("parent_id"))).select(*graph.nodes.columns)
    else:
        gone = gone.unionByName(up.join(gone.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id")).distinct()
    gone = stored(gone, "gone")
    left = nodes.join(gone, "id", "left_anti").select(*graph.nodes.columns)
    edges = graph.edges.filter(~F.col("id").isin(*wanted) if wanted else F.lit(True))
    for end in ("source_id", "target_id"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return graph.with_(nodes=left, edges=edges.select(*graph.edges.columns))


def delete_node(graph: Graph, node_id: str, reparent: bool = False) -> Graph:
    if _missing(graph.nodes, [node_id]):
        raise GraphError(f"node {node_id} does not exist")
    return _without_node(graph, node_id, reparent)


def _without_node(graph: Graph, node_id: str, reparent: bool) -> Graph:
    """delete_entities() for a node id, whatever edges carry the same id."""
    out = delete_entities(graph, [node_id], reparent)
    same = graph.edges.filter((F.col("id") == node_id) & (F.col("source_id") != node_id) & (F.col("target_id") != node_id))
    return out if same.isEmpty() else out.with_(edges=out.edges.unionByName(same))


def delete_edge(graph: Graph, edge_id: str) -> Graph:
    if _missing(graph.edges, [edge_id]):
        raise GraphError(f"edge {edge_id} does not exist")
    return graph.with_(edges=graph.edges.filter(F.col("id") != edge_id))


def _patched(df: DataFrame, kinds: dict[str, str], patches: dict[str, dict]) -> DataFrame:
    """``df`` with fields of given ids set; None unsets, absent fields stay."""
    if not patches:
        return df
    for fields in patches.values():
        unknown = set(fields) - set(kinds) | set(fields) & {"id", "ord"}
        if unknown:
            raise GraphError(f"cannot set {', '.join(sorted(unknown))}")
    full = df.sparkSession.createDataFrame([_row({"id": k, **v}, kinds, 0) for k, v in patches.items()], _ddl(kinds))
    touched = df.sparkSession.createDataFrame([(k, list(v)) for k, v in patches.items()], "id string, _set array<string>")
    new = full.select("id", F.struct(*[c for c in kinds if c != "id"]).alias("_new")).join(touched, "id")
    joined = df.join(new, "id", "left")
    pick = lambda c: F.when(F.array_contains("_set", c), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*[c if c in ("id", "ord") else pick(c) for c in df.columns])


def update_entities(graph: Graph, nodes: dict[str, dict] | None = None, edges: dict[str, dict] | None = None) -> Graph:
    """Fields of nodes and edges set by id: absent fields stay, None unsets. References must hold afterwards."""
    nodes, edges = nodes or {}, edges or {}
    for name, df, patches in (("node", graph.nodes, nodes), ("edge", graph.edges, edges)):
        lost = _missing(df, patches)
        if lost:
            raise GraphError(f"{name} {sorted(lost)[0]} does not exist")
    refs = {p[k] for p in nodes.values() for k in ("parent_id", "initial_node_id") if p.get(k)} | {p[k] for p in edges.values() for k in ("source_id", "target_id") if k in p}
    lost = _missing(graph.nodes, refs)
    if lost or None in refs:
        raise GraphError(f"node {sorted(lost or ['None'])[0]} does not exist")
    out = graph.with_(nodes=_patched(graph.nodes, NODE_KINDS, nodes), edges=_patched(graph.edges, EDGE_KINDS, edges))
    if any("parent_id" in p for p in nodes.values()) and not parent_cycles(out).isEmpty():
        raise GraphError("a node cannot lie below itself")
    if edges or any("ports" in p for p in nodes.values()):
        bad = _port_issues(out).first()
        if bad and (bad["id"] in edges or bad["node"] in nodes):
            raise GraphError(bad["message"])
    return out


def update_node(graph: Graph, node_id: str, **fields) -> Graph:
    return update_entities(graph, {node_id: fields})


def update_edge(graph: Graph, edge_id: str, **fields) -> Graph:
    return update_entities(graph, None, {edge_id: fields})


# graphs never change in place, so the copying forms are the same functions
get_graph_with_node, get_graph_with_edge, get_graph_with_entities = add_node, add_edge, add_entities
get_graph_without_node, get_graph_without_edge, get_graph_without_entities = delete_node, delete_edge, delete_entities
get_graph_with_updated_node, get_graph_with_updated_edge, get_graph_with_updated_entities = update_node, update_edge, update_entities


# differences and patches


def _text(c: str, kind: str) -> Column:
    """A value as JSON text, null as null; a map with its keys in order."""
    if kind == "string":
        return F.to_json(F.array(c))
    if kind.startswith("map"):
        return F.to_json(F.sort_array(F.map_entries(c)))
    return F.to_json(F.array(c)) if kind in ("double", "bigint") else F.to_json(c)


def _differences(a: DataFrame, b: DataFrame, kinds: dict[str, str], fields: tuple[str, ...], entity: str) -> DataFrame:
    last = lambda df, n: df.groupBy("id").agg(F.max_by(F.struct("ord", *fields), "ord").alias(n))
    both = last(a, "a").join(last(b, "b"), "id", "full_outer")
    has_a, has_b = F.col("a").isNotNull(), F.col("b").isNotNull()
    changed = F.filter(F.array(*[F.when(~_text(f"a.{c}", kinds[c]).eqNullSafe(_text(f"b.{c}", kinds[c])), F.lit(c)) for c in fields]), lambda c: c.isNotNull())
    kind = F.when(has_a & has_b, "updated").when(has_b, "added").otherwise("removed")
    whole = lambda s: F.to_json(F.struct(*[F.col(f"{s}.{c}").alias(c) for c in fields]))
    part = lambda s: F.to_json(F.map_filter(F.create_map(*[x for c in fields for x in (F.lit(c), F.coalesce(_text(f"{s}.{c}", kinds[c]), F.lit("null")))]), lambda k, _: F.array_contains("fields", k)))
    rows = both.select("id", "a", "b", kind.alias("kind"), changed.alias("fields")).filter("kind <> 'updated' OR size(fields) > 0")
    return rows.select(
        F.lit(entity).alias("entity"), "kind", "id", F.coalesce("b.ord", "a.ord").alias("ord"),
        F.when(F.col("kind") == "updated", F.col("fields")).alias("fields"),
        F.when(F.col("kind") == "removed", whole("a")).when(F.col("kind") == "updated", part("a")).alias("old"),
        F.when(F.col("kind") == "added", whole("b")).when(F.col("kind") == "updated", part("b")).alias("new"),
    )


def get_diff(a: Graph, b: Graph) -> DataFrame:
    """entity, kind (added, removed, updated), id, ord, fields, old, new: what leads from one graph to the other.

    Nodes and edges meet by id; null and absent are one; nested values are compared by their JSON text. For updated
    entities old and new hold the changed fields, each as JSON text.
    """
    return _differences(a.nodes, b.nodes, NODE_KINDS, NODE_FIELDS, "node").unionByName(_differences(a.edges, b.edges, EDGE_KINDS, EDGE_FIELDS, "edge"))


def is_empty_diff(diff: DataFrame) -> bool:
    return diff.isEmpty()


def get_inverted_diff(diff: DataFrame) -> DataFrame:
    kind = F.when(F.col("kind") == "added", "removed").when(F.col("kind") == "removed", "added").otherwise(F.col("kind"))
    return diff.select("entity", kind.alias("kind"), "id", "ord", "fields", F.col("new").alias("old"), F.col("old").alias("new"))


invert_diff = get_inverted_diff

#: The order in which patches apply: ends exist before edges need them, and edges move before nodes go.
PATCH_ORDER = (("node", "added", "addNode"), ("edge", "updated", "updateEdge"), ("edge", "removed", "deleteEdge"), ("node", "removed", "deleteNode"), ("edge", "added", "addEdge"), ("node", "updated", "updateNode"))


def to_patches(diff: DataFrame) -> DataFrame:
    """rank, op, id, data: the steps of a diff in an order in which they can be applied."""
    rank, op = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (entity, kind, name) in enumerate(PATCH_ORDER):
        here = (F.col("entity") == entity) & (F.col("kind") == kind)
        rank, op = F.when(here, F.lit(i)).otherwise(rank), F.when(here, F.lit(name)).otherwise(op)
    return diff.select(rank.alias("rank"), "ord", op.alias("op"), "id", "fields", F.col("new").alias("data")).orderBy("rank", "ord", "id")


def to_diff(patches: DataFrame) -> DataFrame:
    """The diff that a list of patches stands for; what was there before is not known."""
    entity = F.when(F.col("op").endswith("Node"), "node").otherwise("edge")
    kind = F.when(F.col("op").startswith("add"), "added").when(F.col("op").startswith("delete"), "removed").otherwise("updated")
    return patches.select(entity.alias("entity"), kind.alias("kind"), "id", "ord", "fields", F.lit(None).cast("string").alias("old"), F.col("data").alias("new"))


def get_patches(a: Graph, b: Graph) -> DataFrame:
    return to_patches(get_diff(a, b))


def _merged(df: DataFrame, steps: DataFrame, kinds: dict[str, str], fields: tuple[str, ...]) -> DataFrame:
    """A table after its added, updated and removed rows: one join, no loop over patches."""
    shape = "struct<" + ",".join(f"{c}:{kinds[c]}" for c in fields) + ">"
    gone = steps.filter("kind = 'removed'").select("id")
    added = steps.filter("kind = 'added'").select("id", "ord", F.from_json("new", shape).alias("v")).select("id", "ord", "v.*").select(*df.columns)
    up = steps.filter("kind = 'updated'").select("id", "fields", F.from_json("new", "map<string,string>").alias("v"))
    joined = df.join(gone, "id", "left_anti").join(up, "id", "left")

    def value(c: str) -> Column:
        text, kind = F.col("v")[c], kinds[c]
        if kind.startswith("map"):
            fresh = F.map_from_entries(F.from_json(text, "array<struct<key:string,value:string>>"))
        elif kind in ("string", "double", "bigint"):
            fresh = F.from_json(text, f"array<{kind}>")[0]
        else:
            fresh = F.from_json(text, kind)
        return F.when(F.array_contains("fields", c), F.when(text != "null", fresh)).otherwise(F.col(c)).alias(c)

    return joined.select(*[c if c in ("id", "ord") else value(c) for c in df.columns]).unionByName(added)


def get_patched_graph(graph: Graph, patches: DataFrame) -> Graph:
    """The graph after a list of patches; edges whose ends go with a deleted node go too."""
    diff = stored(to_diff(patches), "diff")
    nodes = _merged(graph.nodes, diff.filter("entity = 'node'"), NODE_KINDS, NODE_FIELDS)
    edges = _merged(graph.edges, diff.filter("entity = 'edge'"), EDGE_KINDS, EDGE_FIELDS)
    gone = diff.filter("entity = 'node' AND kind = 'removed'").select("id")
    for end in ("source_id", "target_id"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return graph.with_(nodes=nodes, edges=edges.select(*graph.edges.columns))


update_graph_with_patches = apply_patches = get_patched_graph


# equality


def are_entities_equal(a: Row, b: Row, keys: Iterable[str] | None = None) -> bool:
    """Whether two rows agree on ``keys``, or on all fields that either has; null and absent are one."""
    x, y = a.asDict(True), b.asDict(True)
    same = lambda p, q: json.dumps(p, sort_keys=True, default=str) == json.dumps(q, sort_keys=True, default=str)
    return all(same(x.get(k), y.get(k)) for k in (list(keys or ()) or {*x, *y}))


def _entity(row: Row) -> str:
    return "edge" if "source_id" in row.asDict() else "node"


def is_layout_equal(a: Row, b: Row) -> bool:
    return are_entities_equal(a, b, LAYOUT_KEYS[_entity(a)])


def is_non_layout_equal(a: Row, b: Row) -> bool:
    return are_entities_equal(a, b, [k for k in {*a.asDict(), *b.asDict()} if k not in LAYOUT_KEYS[_entity(a)]])


# validation


def parent_cycles(graph: Graph) -> DataFrame:
    """id, first: nodes that lie below themselves, each with the first node of its cycle."""
    parent = graph.nodes.filter("parent_id IS NOT NULL").select("id", "parent_id")
    left = stored(parent, "left")
    while True:  # nodes whose parent has no parent left are on no cycle
        fresh = stored(left.join(left.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi").select("id", "parent_id"), "left")
        same = fresh.count() == left.count()
        left = fresh
        if same:
            break
    while True:  # nor are nodes that are nobody's parent
        fresh = stored(left.join(left.select(F.col("parent_id").alias("id")).distinct(), "id", "left_semi").select("id", "parent_id"), "left")
        same = fresh.count() == left.count()
        left = fresh
        if same:
            break
    from ..plans.components import min_labels

    place = graph.distinct_nodes.select(F.col("id").alias("v"), F.col("ord").alias("rank")).join(left.select(F.col("id").alias("v")), "v", "left_semi")
    return min_labels(place, left.select(F.col("id").alias("a"), F.col("parent_id").alias("b"))).select(F.col("v").alias("id"), F.col("root").alias("first"))


def _port_issues(graph: Graph) -> DataFrame:
    known = graph.nodes.select(F.col("id").alias("node"), F.coalesce(F.col("ports.name"), F.array().cast("array<string>")).alias("names"))
    parts = []
    for end in ("source", "target"):
        used = graph.edges.filter(F.col(f"{end}_port").isNotNull()).select("id", "ord", F.col(f"{end}_id").alias("node"), F.col(f"{end}_port").alias("port"))
        bad = used.join(known, "node").filter(~F.array_contains("names", F.col("port")))
        parts.append(bad.select(F.lit(f"missing-{end}-port").alias("code"), "id", "ord", "node", F.concat(F.lit("edge "), "id", F.lit(": node "), "node", F.lit(" has no port "), "port").alias("message"), F.lit(f"{end}_port").alias("field")))
    return parts[0].unionByName(parts[1])


def get_graph_issues(graph: Graph) -> DataFrame:
    """code, path, message: everything that breaks the graph's rules; one query for each rule, never an error."""
    nodes, edges = graph.nodes, graph.edges
    ids = nodes.select("id").distinct()
    issue = lambda df, code, where, field, message: df.select(F.lit(code).alias("code"), F.concat(F.lit(f"{where}["), F.col("ord").cast("string"), F.lit("]."), F.lit(field)).alias("path"), message.alias("message"))
    lost = lambda df, column: df.filter(F.col(column).isNotNull()).join(ids.withColumnRenamed("id", column), column, "left_anti")
    say = lambda *parts: F.concat(*[F.col(p[1:]) if p.startswith("$") else F.lit(p) for p in parts])
    twice = lambda df: df.withColumn("_n", F.count("*").over(Window.partitionBy("id"))).filter("_n > 1")
    ports = nodes.select("id", "ord", F.posexplode("ports.name").alias("at", "name")).withColumn("_n", F.count("*").over(Window.partitionBy("id", "ord", "name"))).filter("_n > 1")
    out = [
        issue(twice(nodes), "duplicate-node-id", "nodes", "id", say("node id ", "$id", " is used more than once")),
        issue(twice(edges), "duplicate-edge-id", "edges", "id", say("edge id ", "$id", " is used more than once")),
        issue(lost(nodes, "parent_id"), "missing-parent", "nodes", "parentId", say("node ", "$id", ": parent ", "$parent_id", " does not exist")),
        issue(lost(nodes.filter("initial_node_id <> ''"), "initial_node_id"), "missing-node-initial", "nodes", "initialNodeId", say("node ", "$id", ": initial node ", "$initial_node_id", " does not exist")),
        ports.select(F.lit("duplicate-port-name").alias("code"), F.concat(F.lit("nodes["), "ord", F.lit("].ports["), "at", F.lit("].name")).alias("path"), say("node ", "$id", ": port name ", "$name", " is used more than once").alias("message")),
        issue(parent_cycles(graph).filter("id = first").join(graph.distinct_nodes, "id"), "parent-cycle", "nodes", "parentId", say("node ", "$id", " lies below itself")),
        issue(lost(edges, "source_id"), "dangling-edge-endpoint", "edges", "sourceId", say("edge ", "$id", ": node ", "$source_id", " does not exist")),
        issue(lost(edges, "target_id"), "dangling-edge-endpoint", "edges", "targetId", say("edge ", "$id", ": node ", "$target_id", " does not exist")),
    ]
    wrong = _port_issues(graph)
    field = F.when(F.col("field") == "source_port", "sourcePort").otherwise("targetPort")
    out.append(wrong.select("code", F.concat(F.lit("edges["), "ord", F.lit("]."), field).alias("path"), "message"))
    if graph.initial_node_id and _missing(nodes, [graph.initial_node_id]):
        out.append(graph.spark.createDataFrame([("missing-initial-node", "initialNodeId", f"initial node {graph.initial_node_id} does not exist")], "code string, path string, message string"))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def validate_graph(graph: Graph) -> DataFrame:
    """get_graph_issues() with codes in snake case, and empty ids besides; columns are checked first."""
    if not is_graph(graph):
        return graph.spark.createDataFrame([("invalid_shape", "", "nodes or edges lack columns")], "code string, path string, message string")
    issues = get_graph_issues(graph).withColumn("code", F.replace("code", F.lit("-"), F.lit("_")))
    for where, df, fields in (("nodes", graph.nodes, ("id",)), ("edges", graph.edges, ("id", "source_id", "target_id"))):
        for f in fields:
            empty = df.filter(F.col(f).isNull() | (F.col(f) == "")).select(F.lit(f"empty_{f}").alias("code"), F.concat(F.lit(f"{where}["), F.col("ord").cast("string"), F.lit(f"].{f}")).alias("path"), F.lit("must not be empty").alias("message"))
            issues = issues.unionByName(empty)
    return issues


def is_graph(value) -> bool:
    return isinstance(value, Graph) and set(NODE_KINDS) <= set(value.nodes.columns) and set(EDGE_KINDS) <= set(value.edges.columns)
