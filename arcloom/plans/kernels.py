"""Order-exact sequential algorithms in one task for one graph.

Operators whose results follow from a sequential walk (depth-first orders, flows, matchings, planarity ...) have no
plan of joins. Such a kernel gets the whole graph as one group; graphs above a stated size are refused with a clear
error rather than left to run out of memory. Operators with a distributed form do not come here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph, GraphError
from .components import BROADCAST_ROWS, least_numbers, with_numbers
from .storage import stored

#: Nodes and edges that a kernel takes at most.
KERNEL_ROWS = 2_000_000
#: Nodes and edges of small components that a kernel of parts takes together, at most and but for the last component.
PART_ROWS = 200_000


@dataclass
class LocalGraph:
    """A graph within a task: node ids in order, and edges (id, source, target, mode, weight, source position, target position)."""

    ids: list[str]
    edges: list[tuple]
    mode: str
    initial_node_id: str | None = None
    parents: dict[str, str | None] = field(default_factory=dict)
    initial: dict[str, str | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.place = {v: i for i, v in enumerate(self.ids)}
        self.valid = [(k, e, self.place[e[1]], self.place[e[2]]) for k, e in enumerate(self.edges) if e[1] in self.place and e[2] in self.place]

    def directed(self, edge: tuple) -> bool:
        return edge[3] == "directed"

    def arcs(self, loops: str = "twice") -> list[list[tuple[int, int, float]]]:
        """For each node position, its arcs (target position, edge position, weight) in edge order."""
        out: list[list[tuple[int, int, float]]] = [[] for _ in self.ids]
        for k, e, s, t in self.valid:
            w = 1.0 if e[4] is None else e[4]
            out[s].append((t, k, w))
            if not self.directed(e) and (s != t or loops == "twice"):
                out[t].append((s, k, w))
        return out

    def incoming(self) -> list[list[tuple[int, int, float]]]:
        out: list[list[tuple[int, int, float]]] = [[] for _ in self.ids]
        for u, arcs in enumerate(self.arcs()):
            for v, k, w in arcs:
                out[v].append((u, k, w))
        return [sorted(x, key=lambda a: a[1]) for x in out]

    def around(self, loops: bool = False) -> list[list[tuple[int, int, float]]]:
        """Arcs of the graph taken as undirected."""
        out: list[list[tuple[int, int, float]]] = [[] for _ in self.ids]
        for k, e, s, t in self.valid:
            w = 1.0 if e[4] is None else e[4]
            if s != t:
                out[s].append((t, k, w))
                out[t].append((s, k, w))
            elif loops:
                out[s].append((s, k, w))
        return out

    def starts(self, start: str | None) -> list[int]:
        """The start node: as given, else the graph's initial node, else the one node no edge points to."""
        if start is not None:
            return [self.place[start]] if start in self.place else []
        if self.initial_node_id in self.place:
            return [self.place[self.initial_node_id]]
        entered = {t for _, _, _, t in self.valid}
        free = [i for i in range(len(self.ids)) if i not in entered]
        if len(free) != 1:
            raise GraphError("no start node: give one, or set the graph's initial_node_id")
        return free


@dataclass
class Part:
    """Whole components of a graph within a task, as arrays: the numbers of the nodes in order, their places among the
    starts (-1 for none), and of each edge in order the positions of both ends, the weight and whether it is directed.
    ``total`` is the sum of the weights of the whole graph."""

    nodes: object
    place: object
    source: object
    target: object
    weight: object
    directed: object
    total: float

    @staticmethod
    def of(g: LocalGraph) -> Part:
        import numpy as np

        n, weight = len(g.ids), np.array([1.0 if e[4] is None else e[4] for _, e, _, _ in g.valid], float)
        ends = np.array([(s, t) for _, _, s, t in g.valid], np.int32).reshape(-1, 2)
        return Part(np.arange(n), np.full(n, -1), ends[:, 0], ends[:, 1], weight, np.array([g.directed(e) for _, e, _, _ in g.valid], bool), float(weight.sum()))

    def rows(self, outgoing: bool) -> tuple[list[int], object, object]:
        """Bounds of each node's arcs, and the arcs' ends and weights, in edge order; a non-directed loop is two arcs."""
        import numpy as np

        back = ~self.directed if outgoing else np.ones(len(self.source), bool)
        at = np.flatnonzero(np.column_stack([np.ones(len(back), bool), back]).ravel())
        ends = np.column_stack([self.source, self.target])
        start, end = ends.ravel()[at], ends[:, ::-1].ravel()[at]
        order = np.argsort(start, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(start, minlength=len(self.nodes)))])
        return bounds.tolist(), end[order], np.repeat(self.weight, 2)[at[order]]


def fits_kernel(graph: Graph) -> bool:
    """Whether run() takes a graph."""
    return graph.nodes.count() + graph.edges.count() <= KERNEL_ROWS


def run_parts(graph: Graph, kernel: Callable[[Part], tuple], schema: str, starts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The columns that ``kernel`` makes for whole components, and the nodes (v, rank, n) whose numbers they hold.

    For kernels that never look from one component at another. ``starts`` (id, place) are the starts of walks. Large components are parts of their own, small ones
    share parts; numbers follow the order of nodes. No names come into a task: a part takes some 20 bytes for a node or an edge.
    """
    own, n, edges = with_numbers(
        graph.distinct_nodes.select(F.col("id").alias("v"), F.col("ord").alias("rank")),
        graph.edges.select("id", "ord", F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.coalesce("weight", F.lit(1.0)).alias("w"), graph.is_directed().alias("directed")),
    )
    edges = stored(edges, "edges")
    roots = least_numbers(n, edges.select(F.col("s").alias("a"), F.col("t").alias("b")))
    few = F.broadcast(roots) if n <= BROADCAST_ROWS else roots
    edges = edges.join(few.select(F.col("n").alias("s"), "root"), "s")
    rows = roots.groupBy("root").count().unionByName(edges.groupBy("root").count()).groupBy("root").agg(F.sum("count").alias("rows"))
    count, total = edges.agg(F.count("*"), F.sum("w")).first()
    size, total = n + count, total or 0.0
    large = F.broadcast(stored(rows.filter(F.col("rows") > PART_ROWS // 4), "large").select("root", F.lit(True).alias("large")))  # 4 for PART_ROWS rows at most
    shared = -1 - F.pmod(F.xxhash64("root"), F.lit(size // PART_ROWS + 1))
    none = lambda kind: F.lit(None).cast(kind)
    begun = roots.withColumn("place", none("long"))
    if starts is not None:
        begun = roots.join(own.join(starts.withColumnRenamed("id", "v"), "v").select("n", "place"), "n", "left")
    both = begun.select("root", F.lit(False).alias("edge"), F.col("n").alias("ord"), F.lit("").alias("id"), F.col("n").alias("s"), F.coalesce("place", F.lit(-1)).alias("t"), none("double").alias("w"), none("boolean").alias("directed"))
    both = both.unionByName(edges.select("root", F.lit(True).alias("edge"), "ord", "id", "s", "t", "w", "directed"))
    both = both.join(large, "root", "left").withColumn("part", F.when(F.col("large"), F.col("root")).otherwise(shared))
    dealt = both.repartition("part").sortWithinPartitions("part", "edge", "ord", "id").select("part", "edge", "s", "t", "w", "directed")
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)

    def apply(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)

        def made(columns):
            table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)
            yield from table.to_batches(max_chunksize=100_000)

        def whole(held):
            nodes, place, s, t, w, d = (np.concatenate([x[i] for x in held]) for i in range(6))
            held.clear()
            at = lambda x: np.searchsorted(nodes, x).astype(np.int32)
            return Part(nodes, place, at(s), at(t), w, d, total)

        held, now = [], None
        for batch in batches:
            part, edge = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if held and part[low] != now:
                    yield from made(kernel(whole(held)))
                now = part[low]
                first = low + int(np.count_nonzero(~edge[low:high]))
                own, rest = batch.slice(low, first - low), batch.slice(first, high - first)
                held.append((
                    own.column(2).to_numpy(), own.column(3).to_numpy(), rest.column(2).to_numpy(), rest.column(3).to_numpy(),
                    rest.column(4).to_numpy(zero_copy_only=False), rest.column(5).to_numpy(zero_copy_only=False).astype(bool),
                ))
        if held:
            yield from made(kernel(whole(held)))

    return dealt.mapInArrow(apply, schema), own


def run(graph: Graph, kernel: Callable[[LocalGraph], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that ``kernel`` yields for the whole graph, as a DataFrame."""
    import pyarrow as pa

    nodes = graph.nodes.select(F.lit(0).alias("g"), "id", "ord", "parent_id", "initial_node_id")
    edges = graph.edges.select(F.lit(0).alias("g"), "id", "source_id", "target_id", graph.edge_mode().alias("mode"), "weight", "ord")
    size = nodes.count() + edges.count()
    if size > KERNEL_ROWS:
        raise GraphError(f"this operator takes {KERNEL_ROWS} nodes and edges at most; the graph has {size}")
    mode, first = graph.mode, graph.initial_node_id
    names = [x.split()[0] for x in _columns(schema)]

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        last: dict[str, tuple] = {}
        for row in sorted(left.to_pylist(), key=lambda r: r["ord"]):
            last.pop(row["id"], None)
            last[row["id"]] = row
        rows = sorted(right.to_pylist(), key=lambda r: (r["ord"], r["id"]))
        local = LocalGraph(
            list(last), [(r["id"], r["source_id"], r["target_id"], r["mode"], r["weight"]) for r in rows], mode, first,
            {k: r["parent_id"] for k, r in last.items()}, {k: r["initial_node_id"] for k, r in last.items()},
        )
        out = list(kernel(local))
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    # a marker row on each side, so that an empty graph is a group too
    spark = graph.spark
    out = nodes.groupBy("g").cogroup(edges.groupBy("g")).applyInArrow(apply, schema)
    if size == 0:
        rows = list(kernel(LocalGraph([], [], mode, first)))
        return spark.createDataFrame(rows, schema)
    return out


def _columns(schema: str) -> list[str]:
    depth, out, now = 0, [], ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]
