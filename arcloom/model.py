"""The property graph: two DataFrames, ``nodes`` and ``edges``, and a few values of the graph as a whole."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIRECTED, UNDIRECTED, BIDIRECTIONAL = "directed", "undirected", "bidirectional"
_STYLE = "map<string,string>"
_PORT = f"struct<name:string,direction:string,label:string,data:string,x:double,y:double,width:double,height:double,style:{_STYLE}>"
NODE_KINDS = {
    "id": "string", "ord": "bigint", "parent_id": "string", "initial_node_id": "string", "label": "string", "data": "string", "ports": f"array<{_PORT}>",
    "x": "double", "y": "double", "width": "double", "height": "double", "shape": "string", "color": "string", "style": _STYLE,
}
EDGE_KINDS = {
    "id": "string", "ord": "bigint", "source_id": "string", "target_id": "string", "mode": "string", "weight": "double", "label": "string", "data": "string",
    "source_port": "string", "target_port": "string", "points": "array<struct<x:double,y:double>>", "routing": "string",
    "x": "double", "y": "double", "width": "double", "height": "double", "color": "string", "style": _STYLE,
}


def _ddl(kinds: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in kinds.items())


class GraphError(ValueError):
    """An operation that the graph's rules do not allow."""


def create_port(name: str, direction: str = "inout", **fields: Any) -> dict:
    """A port; its name must not be empty."""
    if not name:
        raise GraphError("a port needs a name")
    return {"name": name, "direction": direction, **fields}


def create_node(id: str, **fields: Any) -> dict:  # noqa: A002
    """A node's fields; ids and parent ids must not be empty, empty port lists are dropped."""
    if not id:
        raise GraphError("a node needs an id")
    if fields.get("parent_id") == "":
        raise GraphError("parent_id must not be empty")
    if "ports" in fields:
        ports = [create_port(**p) for p in fields.pop("ports") or ()]
        if len({p["name"] for p in ports}) < len(ports):
            raise GraphError(f"node {id}: port names must differ")
        if ports:
            fields["ports"] = ports
    return {"id": id, **fields}


def create_edge(id: str, source_id: str, target_id: str, **fields: Any) -> dict:  # noqa: A002
    """An edge's fields; id and both ends must not be empty, a weight of 0 is kept."""
    if not id or not source_id or not target_id:
        raise GraphError("an edge needs an id, a source_id and a target_id")
    return {"id": id, "source_id": source_id, "target_id": target_id, **fields}


def _row(fields: dict, kinds: dict[str, str], at: int) -> tuple:
    def plain(name: str) -> Any:
        value = at if name == "ord" and fields.get("ord") is None else fields.get(name)
        if name == "data" and value is not None and not isinstance(value, str):
            return json.dumps(value, separators=(",", ":"), sort_keys=True)
        if name == "style" and value is not None:
            return {k: json.dumps(v) for k, v in value.items()}
        if name == "ports" and value is not None:
            keys = ("name", "direction", "label", "data", "x", "y", "width", "height", "style")
            return [tuple(None if p.get(k) is None else float(p[k]) if k in ("x", "y", "width", "height") else json.dumps(p[k]) if k == "data" else p[k] for k in keys) for p in value]
        if name == "points" and value is not None:
            return [(float(p["x"]), float(p["y"])) for p in value]
        return float(value) if value is not None and kinds[name] == "double" else value

    unknown = set(fields) - set(kinds)
    if unknown:
        raise GraphError(f"unknown fields: {', '.join(sorted(unknown))}")
    return tuple(plain(k) for k in kinds)


def complete(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``df`` with all columns of a schema, absent ones null; ``ord`` follows the rows' order where it is absent."""
    here = set(df.columns)
    fill = lambda k: F.monotonically_increasing_id() if k == "ord" else F.lit(None)
    return df.select(*[(F.col(k) if k in here else fill(k)).cast(v).alias(k) for k, v in kinds.items()])


@dataclass(frozen=True)
class Graph:
    """Nodes, edges and the graph's own values. Operators return new graphs; DataFrames never change."""

    nodes: DataFrame
    edges: DataFrame
    mode: str = DIRECTED
    id: str = ""
    initial_node_id: str | None = None
    data: Any = None
    direction: str | None = None
    style: dict | None = field(default=None)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def with_(self, **changes: Any) -> Graph:
        return replace(self, **changes)

    def edge_mode(self) -> Column:
        """The effective mode of an edge row: its own, or else the graph's."""
        return F.coalesce(F.col("mode"), F.lit(self.mode))

    def is_directed(self) -> Column:
        return self.edge_mode() == DIRECTED

    @cached_property
    def distinct_nodes(self) -> DataFrame:
        """One row for each node id; of repeated ids the last counts."""
        return self.nodes.groupBy("id").agg(F.max("ord").alias("ord"))

    @cached_property
    def extent(self) -> tuple[int, int, int]:
        """How many nodes, edges between them and components there are."""
        from .plans.components import least_numbers, with_numbers
        from .plans.storage import stored

        ends = self.edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
        _, n, links = with_numbers(self.distinct_nodes.select(F.col("id").alias("v"), F.col("ord").alias("rank")), ends)
        links = stored(links.select(F.col("s").alias("a"), F.col("t").alias("b")), "links")
        return n, links.count(), least_numbers(n, links).filter("n = root").count()

    def valid_edges(self) -> DataFrame:
        """Edges both of whose ends are nodes, with the effective mode."""
        ids = self.nodes.select("id").distinct()
        known = self.edges.withColumn("mode", self.edge_mode())
        return known.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")

    def arcs(self, loops: str = "twice") -> DataFrame:
        """One row for each direction in which an edge can be passed: src, dst, edge_id, edge_ord, arc_ord, w, backward.

        A non-directed self-loop gives two arcs, or one with ``loops="once"``. Dangling edges give none.
        """
        back = F.col("mode") != DIRECTED
        if loops == "once":
            back = back & (F.col("source_id") != F.col("target_id"))
        ways = F.when(back, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
        each = self.valid_edges().withColumn("backward", F.explode(ways))
        return each.select(
            F.when(F.col("backward"), F.col("target_id")).otherwise(F.col("source_id")).alias("src"),
            F.when(F.col("backward"), F.col("source_id")).otherwise(F.col("target_id")).alias("dst"),
            F.col("id").alias("edge_id"), F.col("ord").alias("edge_ord"), (2 * F.col("ord") + F.col("backward").cast("long")).alias("arc_ord"),
            F.coalesce("weight", F.lit(1.0)).alias("w"), "backward",
        )


def create_graph(spark: SparkSession, nodes: Iterable[dict] = (), edges: Iterable[dict] = (), mode: str = DIRECTED, **values: Any) -> Graph:
    """A graph from plain records. Ends, parents and initial nodes are not looked up: dangling references are legal."""
    node_rows = [_row(create_node(**n), NODE_KINDS, i) for i, n in enumerate(nodes)]
    edge_rows = [_row(create_edge(**e), EDGE_KINDS, i) for i, e in enumerate(edges)]
    return Graph(spark.createDataFrame(node_rows, _ddl(NODE_KINDS)), spark.createDataFrame(edge_rows, _ddl(EDGE_KINDS)), mode, **values)


def graph_from_tables(nodes: DataFrame | None, edges: DataFrame, mode: str = DIRECTED, **values: Any) -> Graph:
    """A graph over existing tables: edges need source_id and target_id, nodes an id; without nodes, the edges' ends."""
    edges = edges if "id" in edges.columns else edges.withColumn("id", F.concat_ws("->", "source_id", "target_id"))
    if nodes is None:
        nodes = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return Graph(complete(nodes, NODE_KINDS), complete(edges, EDGE_KINDS), mode, **values)


def create_visual_graph(graph: Graph) -> Graph:
    """The graph with places and sizes filled with 0 on nodes, edges and ports, and a direction ('down' by default)."""
    zero = {k: F.coalesce(k, F.lit(0.0)) for k in ("x", "y", "width", "height")}
    fields = ("name", "direction", "label", "data", "x", "y", "width", "height", "style")
    port = lambda p: F.struct(*[(F.coalesce(p[k], F.lit(0.0)) if k in zero else p[k]).alias(k) for k in fields])
    return graph.with_(nodes=graph.nodes.withColumns(zero).withColumn("ports", F.transform("ports", port)), edges=graph.edges.withColumns(zero), direction=graph.direction or "down")
