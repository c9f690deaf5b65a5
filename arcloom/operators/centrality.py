"""Centrality measures: joins and aggregates over arcs, iterated on the driver where they need rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph, GraphError
from ..plans.iterate import until
from ..plans.storage import stored
from .queries import degrees
from .traversal import distances_between_all


def _share(graph: Graph, column: str) -> DataFrame:
    n = graph.distinct_nodes.count()
    return degrees(graph).select("id", (F.col(column) / F.lit(float(n - 1)) if n > 1 else F.lit(0.0)).alias("score"))


def get_degree_centrality(graph: Graph) -> DataFrame:
    """id, score: degree / (n - 1); parallel edges and loops can take it above 1."""
    return _share(graph, "degree")


def get_in_degree_centrality(graph: Graph) -> DataFrame:
    return _share(graph, "in_degree")


def get_out_degree_centrality(graph: Graph) -> DataFrame:
    return _share(graph, "out_degree")


def get_closeness_centrality(graph: Graph) -> DataFrame:
    """id, score: (r / sum of distances) * (r / (n - 1)), with r other nodes in reach along arcs."""
    n = graph.distinct_nodes.count()
    reached = distances_between_all(graph).filter("distance > 0").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("r"), F.sum("distance").alias("d"))
    score = (F.col("r") / F.col("d")) * (F.col("r") / F.lit(float(max(n - 1, 1))))
    return graph.distinct_nodes.select("id").join(reached, "id", "left").select("id", F.coalesce(score, F.lit(0.0)).alias("score"))


def get_betweenness_centrality(graph: Graph) -> DataFrame:
    """id, score: shares of shortest hop paths through a node; parallel arcs are paths of their own.

    Distributed for all sources at once: path counts go level by level outward, dependencies level by level back.
    Scaled by the graph's own mode; unscaled for two nodes or fewer.
    """
    arcs = stored(graph.arcs().groupBy("src", "dst").agg(F.count("*").cast("double").alias("n")), "arcs")
    start = graph.distinct_nodes.select(F.col("id").alias("s"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.lit(1.0).alias("paths"))
    levels = [stored(start, "level")]
    seen = levels[0].select("s", "node")
    while True:
        met = levels[-1].join(arcs, F.col("node") == F.col("src")).groupBy("s", F.col("dst").alias("node")).agg(F.sum(F.col("paths") * F.col("n")).alias("paths"))
        fresh = stored(met.join(seen, ["s", "node"], "left_anti").select("s", "node", F.lit(len(levels)).alias("depth"), "paths"), "level")
        if fresh.isEmpty():
            break
        levels.append(fresh)
        seen = seen.unionByName(fresh.select("s", "node"))
    below, sums = None, None
    for level in reversed(levels[1:]):
        own = level
        if below is not None:
            part = below.join(arcs, F.col("node") == F.col("dst")).select("s", F.col("src").alias("node"), ((1 + F.col("delta")) / F.col("paths") * F.col("n")).alias("part")).groupBy("s", "node").agg(F.sum("part").alias("part"))
            own = level.join(part, ["s", "node"], "left")
            own = own.select("s", "node", "paths", (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("delta"))
        else:
            own = level.select("s", "node", "paths", F.lit(0.0).alias("delta"))
        below = stored(own, "delta")
        sums = below.select("node", "delta") if sums is None else sums.unionByName(below.select("node", "delta"))
    n = graph.distinct_nodes.count()
    scale = 1.0 if n <= 2 else 1.0 / ((n - 1) * (n - 2))  # an undirected pair is met from both its ends, and halved
    ids = graph.distinct_nodes.select("id")
    if sums is None:
        return ids.select("id", F.lit(0.0).alias("score"))
    total = sums.groupBy(F.col("node").alias("id")).agg(F.sum("delta").alias("d"))
    return ids.join(total, "id", "left").select("id", (F.coalesce("d", F.lit(0.0)) * F.lit(scale)).alias("score"))


def _pulled(state: DataFrame, arcs: DataFrame, value: Column) -> DataFrame:
    """id, got: for each node, the sum of ``value`` over the arcs that enter it, from the states of their sources."""
    return state.join(arcs, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("at")).agg(F.sum(value).alias("got"))


def get_page_rank(graph: Graph, alpha: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """id, score: ranks that flow evenly along arcs (parallel arcs each take a share); dead ends spread to all nodes."""
    n = graph.distinct_nodes.count()
    arcs = graph.arcs().groupBy("src", "dst").agg(F.count("*").alias("n"))
    out = arcs.groupBy("src").agg(F.sum("n").alias("ways"))
    arcs = stored(arcs.join(out, "src").select("src", "dst", (F.col("n") / F.col("ways")).alias("share")), "arcs")
    ends = arcs.select(F.col("src").alias("id")).distinct().withColumn("goes", F.lit(True))
    state = graph.distinct_nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("goes", F.lit(False)).alias("goes"), F.lit(1.0 / max(n, 1)).alias("score"))

    def step(s: DataFrame) -> DataFrame:
        dead = s.filter("NOT goes").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        got = _pulled(s, arcs, F.col("score") * F.col("share"))
        base = (1 - alpha) / n + alpha * dead / n
        return s.join(got, F.col("id") == F.col("at"), "left").select("id", "goes", (F.lit(base) + alpha * F.coalesce("got", F.lit(0.0))).alias("score"))

    if not n:
        return state.select("id", "score")
    state, _ = until(state, step, _largest("score"), tolerance, max_iterations)
    total = state.agg(F.sum("score")).first()[0]
    return state.select("id", (F.col("score") / F.lit(total)).alias("score"))


def _largest(*columns: str):
    def change(a: DataFrame, b: DataFrame) -> float:
        both = a.select("id", *[F.col(c).alias(f"old_{c}") for c in columns]).join(b, "id")
        return both.agg(F.max(F.greatest(*[F.abs(F.col(c) - F.col(f"old_{c}")) for c in columns], F.lit(0.0)))).first()[0] or 0.0

    return change


def _summed(column: str):
    def change(a: DataFrame, b: DataFrame) -> float:
        return a.select("id", F.col(column).alias("old")).join(b, "id").agg(F.sum(F.abs(F.col(column) - F.col("old")))).first()[0] or 0.0

    return change


def _unit(state: DataFrame, column: str) -> DataFrame:
    """The column scaled to length 1; left as it is when it is 0 everywhere."""
    norm = state.agg(F.sqrt(F.sum(F.col(column) ** 2))).first()[0] or 0.0
    return state.withColumn(column, F.col(column) / F.lit(norm)) if norm > 0 else state


def get_hits(graph: Graph, max_iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """id, hub, authority: authorities from the hubs that point to them, then hubs from the new authorities."""
    n = max(graph.distinct_nodes.count(), 1)
    arcs = stored(graph.arcs().groupBy("src", "dst").agg(F.count("*").alias("n")), "arcs")
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    state = graph.distinct_nodes.select("id", F.lit(1.0 / n).alias("hub"), F.lit(1.0 / n).alias("authority"))

    def step(s: DataFrame) -> DataFrame:
        got = _pulled(s, arcs, F.col("hub") * F.col("n"))
        s = _unit(stored(s.join(got, F.col("id") == F.col("at"), "left").select("id", "hub", F.coalesce("got", F.lit(0.0)).alias("authority")), "auth"), "authority")
        got = _pulled(s, back, F.col("authority") * F.col("n"))
        return _unit(stored(s.join(got, F.col("id") == F.col("at"), "left").select("id", "authority", F.coalesce("got", F.lit(0.0)).alias("hub")), "hub"), "hub").select("id", "hub", "authority")

    return until(state, step, _largest("hub", "authority"), tolerance, max_iterations)[0]


def _weights(graph: Graph, weight: Column | None) -> DataFrame:
    own = graph if weight is None else graph.with_(edges=graph.edges.withColumn("weight", weight.cast("double")))
    return stored(own.arcs().groupBy("src", "dst").agg(F.sum(F.lit(1.0) if weight is None else F.col("w")).alias("w")), "arcs")


def get_eigenvector_centrality(graph: Graph, weight: Column | None = None, max_iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """id, score: the leading eigenvector over incoming arcs, by power steps of A + I; an error if they do not settle.

    Every arc weighs 1 unless a weight expression is given.
    """
    n = graph.distinct_nodes.count()
    arcs = _weights(graph, weight)
    state = graph.distinct_nodes.select("id", F.lit(1.0 / max(n, 1)).alias("score"))

    def step(s: DataFrame) -> DataFrame:
        got = _pulled(s, arcs, F.col("score") * F.col("w"))
        return _unit(stored(s.join(got, F.col("id") == F.col("at"), "left").select("id", (F.col("score") + F.coalesce("got", F.lit(0.0))).alias("score")), "eigen"), "score")

    state, settled = until(state, step, _summed("score"), n * tolerance, max_iterations)
    if not settled and n:
        raise GraphError(f"eigenvector centrality did not settle in {max_iterations} rounds")
    return state


def get_katz_centrality(graph: Graph, alpha: float = 0.1, beta: float = 1.0, weight: Column | None = None, max_iterations: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """id, score: alpha times the scores that enter, plus beta, from 0 on; scaled to length 1 at the end."""
    n = graph.distinct_nodes.count()
    arcs = _weights(graph, weight)
    state = graph.distinct_nodes.select("id", F.lit(0.0).alias("score"))

    def step(s: DataFrame) -> DataFrame:
        got = _pulled(s, arcs, F.col("score") * F.col("w"))
        return s.join(got, F.col("id") == F.col("at"), "left").select("id", (F.lit(float(alpha)) * F.coalesce("got", F.lit(0.0)) + F.lit(float(beta))).alias("score"))

    state, settled = until(state, step, _summed("score"), n * tolerance, max_iterations)
    if not settled and n:
        raise GraphError(f"Katz centrality did not settle in {max_iterations} rounds")
    return _unit(state, "score")
