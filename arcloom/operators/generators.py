"""Made graphs, state spaces, and what a graph keeps for repeated use."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Hashable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.random32 import nth_number, numbers
from ..model import EDGE_KINDS, NODE_KINDS, UNDIRECTED, Graph, GraphError, complete, create_graph
from ..plans.numbering import numbered
from ..plans.storage import drop_stored, stored


def _whole(what: str, n: int) -> None:
    if n != int(n) or n < 0:
        raise GraphError(f"{what} must be a whole number, 0 or more")


def _made(nodes: DataFrame, edges: DataFrame) -> Graph:
    return Graph(complete(nodes, NODE_KINDS), complete(edges, EDGE_KINDS), UNDIRECTED)


def _numbered(spark: SparkSession, n: int, prefix: str) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("id"), F.col("id").alias("ord"))


def _pairs(spark: SparkSession, n: int) -> DataFrame:
    """i < j with their place k in the order of (i, j); a range join of numbers, each pair made where it is used."""
    i = spark.range(n).select(F.col("id").alias("i"))
    each = i.filter(F.col("i") < n - 1).select("i", F.explode(F.sequence(F.col("i") + 1, F.lit(n - 1).cast("long"))).alias("j"))
    return each.withColumn("k", (F.col("i") * (2 * n - F.col("i") - 1) / 2).cast("long") + F.col("j") - F.col("i") - 1)


def create_complete_graph(spark: SparkSession, n: int, prefix: str = "n") -> Graph:
    """All pairs joined; edges e0 ... in the order of their ends."""
    _whole("the number of nodes", n)
    name = lambda c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    edges = _pairs(spark, n).select(F.concat(F.lit("e"), F.col("k").cast("string")).alias("id"), F.col("k").alias("ord"), name("i").alias("source_id"), name("j").alias("target_id"))
    return _made(_numbered(spark, n, prefix), edges)


def create_grid_graph(spark: SparkSession, rows: int, columns: int, prefix: str = "n") -> Graph:
    """Cells joined to the right and down; the edge to the right comes first."""
    _whole("rows", rows)
    _whole("columns", columns)
    cell = spark.range(rows * columns).select(F.col("id").alias("c"), F.floor(F.col("id") / columns if columns else F.lit(0)).alias("r"))
    ways = F.filter(F.array(F.struct(F.lit(0).alias("way"), (F.col("c") + 1).alias("to"), (F.col("c") % max(columns, 1) < columns - 1).alias("ok")), F.struct(F.lit(1).alias("way"), (F.col("c") + columns).alias("to"), (F.col("r") < rows - 1).alias("ok"))), lambda w: w["ok"])
    each = cell.select("c", "r", F.explode(ways).alias("w"))
    # edges before a cell: each earlier cell has one to the right unless in the last column, one down unless in the last row
    col = F.col("c") % max(columns, 1)
    before = F.col("r") * (columns - 1) + col + F.least(F.col("c"), F.lit((rows - 1) * columns))
    k = before + F.when((F.col("w.way") == 1) & (col < columns - 1), 1).otherwise(0)
    name = lambda c: F.concat(F.lit(prefix), c.cast("string"))
    return _made(_numbered(spark, rows * columns, prefix), each.select(F.concat(F.lit("e"), k.cast("string")).alias("id"), k.cast("long").alias("ord"), name(F.col("c")).alias("source_id"), name(F.col("w.to")).alias("target_id")))


def create_random_graph(spark: SparkSession, n: int, probability: float, seed: int, prefix: str = "n") -> Graph:
    """Each pair joined with a probability. Draws belong to pairs, so they are made in parallel."""
    _whole("the number of nodes", n)
    if not 0 <= probability <= 1:
        raise GraphError("the probability must lie between 0 and 1")
    drawn = _pairs(spark, n).filter(nth_number(seed, F.col("k") + 1) < probability)
    k = numbered(drawn, "k", name="e")
    name = lambda c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    return _made(_numbered(spark, n, prefix), k.select(F.concat(F.lit("e"), F.col("e").cast("string")).alias("id"), F.col("e").alias("ord"), name("i").alias("source_id"), name("j").alias("target_id")))


def _listed(spark: SparkSession, n: int, pairs: Iterable[tuple[int, int]], prefix: str) -> Graph:
    return create_graph(spark, ({"id": f"{prefix}{i}"} for i in range(n)), ({"id": f"e{k}", "source_id": f"{prefix}{a}", "target_id": f"{prefix}{b}"} for k, (a, b) in enumerate(pairs)), UNDIRECTED)


def create_watts_strogatz_graph(spark: SparkSession, n: int, k: int, beta: float, seed: int, prefix: str = "n") -> Graph:
    """A ring of nodes joined to their k nearest; each edge gets a new end with probability beta. Drawn in sequence."""
    _whole("the number of nodes", n)
    if k % 2 or k < 0 or n and k >= n:
        raise GraphError("k must be even and less than the number of nodes")
    if not 0 <= beta <= 1:
        raise GraphError("beta must lie between 0 and 1")
    draw = numbers(seed)
    ring = dict.fromkeys(frozenset((i, (i + d) % n)) for i in range(n) for d in range(1, k // 2 + 1))
    order, seen = [], set()
    for i in range(n):
        for d in range(1, k // 2 + 1):
            pair = frozenset((i, (i + d) % n))
            if pair not in seen:
                seen.add(pair)
                order.append((i, (i + d) % n))
    joined = set(ring)
    for at, (a, b) in enumerate(order):
        if draw() < beta:
            for _ in range(n):
                c = int(draw() * n)
                if c != a and frozenset((a, c)) not in joined:
                    joined.discard(frozenset((a, b)))
                    joined.add(frozenset((a, c)))
                    order[at] = (a, c)
                    break
    return _listed(spark, n, order, prefix)


def create_barabasi_albert_graph(spark: SparkSession, n: int, m: int, seed: int, prefix: str = "n") -> Graph:
    """Nodes join m earlier ones each, chosen in proportion to their degree, from a complete graph of m on."""
    _whole("the number of nodes", n)
    if n and not 1 <= m <= n:
        raise GraphError("m must be 1 at least and at most the number of nodes")
    draw = numbers(seed)
    pairs = [(i, j) for i in range(min(m, n)) for j in range(i + 1, min(m, n))]
    ends = [v for pair in pairs for v in pair] or [0]
    for v in range(m, n):
        chosen: dict[int, None] = {}
        while len(chosen) < m:
            pick = ends[int(draw() * len(ends))]
            chosen[pick] = None
        for u in chosen:
            pairs.append((v, u))
            ends += [v, u]
    return _listed(spark, n, pairs, prefix)


def create_graph_from_transition(
    spark: SparkSession, transition: Callable[[Any, Any], Any], initial: Any, events: Iterable[Any] | Callable[[Any], Iterable[Any]], limit: int = 100_000,
    serialize: Callable[[Any], Hashable] | None = None, serialize_event: Callable[[Any], str] | None = None, stop_when: Callable[[Any], bool] | None = None,
) -> Graph:
    """The states that a transition function reaches, breadth first. Nodes are named by their state as text, edges by
    state, event and next state. ``limit`` counts expanded states; states for which ``stop_when`` holds are not expanded."""
    text = serialize or (lambda s: json.dumps(s, sort_keys=True, separators=(",", ":")))
    event_text = serialize_event or (lambda e: e if isinstance(e, str) else json.dumps(e, sort_keys=True, separators=(",", ":")))
    states, edges, queue, taken = {text(initial): initial}, {}, deque([initial]), 0
    while queue:
        state = queue.popleft()
        taken += 1
        if taken > limit:
            raise GraphError("Traversal limit exceeded")
        if stop_when and stop_when(state):
            continue
        for event in events(state) if callable(events) else events:
            after = transition(state, event)
            if after is None:
                continue
            name, key = text(after), "|".join((text(state), event_text(event), text(after)))
            edges.setdefault(key, (text(state), name, event))
            if name not in states:
                states[name] = after
                queue.append(after)
    return create_graph(spark, ({"id": k, "data": json.dumps(v, sort_keys=True)} for k, v in states.items()), ({"id": k, "source_id": s, "target_id": t, "label": event_text(e)} for k, (s, t, e) in edges.items()), initial_node_id=text(initial))


def create_graph_from_machine(spark: SparkSession, states: dict[str, dict], initial: str) -> Graph:
    """A graph from an exported transition table: {state: {"on": {event: target}, "parent": ..., "initial": ...}}."""
    nodes = ({"id": k, "parent_id": v.get("parent"), "initial_node_id": v.get("initial")} for k, v in states.items())
    edges = ({"id": f"{k}|{e}|{t}", "source_id": k, "target_id": t, "label": e} for k, v in states.items() for e, t in v.get("on", {}).items())
    return create_graph(spark, nodes, edges, initial_node_id=initial)


def get_serialized_snapshot(snapshot: Any) -> str:
    """A state's identity: its JSON text with keys in order."""
    return json.dumps(snapshot, sort_keys=True, separators=(",", ":"), default=str)


# what is kept for repeated use


def get_index(graph: Graph) -> Graph:
    """The graph with nodes and edges stored in the shared folder, evaluated once and safe from lost executors."""
    return graph.with_(nodes=stored(graph.nodes, "nodes"), edges=stored(graph.edges, "edges"))


def invalidate_index(graph: Graph) -> None:
    """Deletes what get_index() has stored."""
    drop_stored(graph.nodes)
    drop_stored(graph.edges)


def get_graph_snapshot(graph: Graph) -> Graph:
    """The graph itself: frames do not change."""
    return graph


def get_csr(graph: Graph) -> DataFrame:
    """The arcs, dealt out by source so that joins on it need no further shuffle."""
    return graph.arcs().repartition("src").sortWithinPartitions("src", "arc_ord")


def memoize_by_graph(function: Callable, key: Callable | None = None) -> Callable:
    """``function`` with its results kept for each graph (by identity of its frames) and arguments."""
    kept: dict[tuple, tuple] = {}

    def called(graph: Graph, *args: Any) -> Any:
        own = (id(graph.nodes), id(graph.edges), graph.mode, key(*args) if key else args)
        if own not in kept:
            kept[own] = (graph, function(graph, *args))  # the graph is held, so that its identity stays its own
        return kept[own][1]

    return called
