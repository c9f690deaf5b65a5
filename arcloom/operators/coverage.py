"""Path sets, what they cover, and walks. A path set is a DataFrame (path, source, steps) ordered by path."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random32 import numbers
from ..model import DIRECTED, Graph, GraphError
from ..plans.kernels import LocalGraph, run
from ..plans.storage import stored
from .paths import as_path, shortest_costs, tied_paths, weighted


def get_path_nodes() -> Column:
    """A path row's node ids: its source and each step's node."""
    return F.concat(F.array("source"), F.transform("steps", lambda s: s["node"]))


def get_path_edges() -> Column:
    return F.transform("steps", lambda s: s["edge"])


def get_path_weights(graph: Graph, paths: DataFrame) -> DataFrame:
    """path, weight: the edges' summed weights, 1 where an edge has none."""
    weights = graph.edges.select(F.col("id").alias("edge"), F.coalesce("weight", F.lit(1.0)).alias("w"))
    each = paths.select("path", F.explode_outer("steps.edge").alias("edge")).join(weights, "edge", "left")
    return each.groupBy("path").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("weight"))


def valid_paths(graph: Graph, paths: DataFrame) -> DataFrame:
    """path, valid: whether every step's edge leads, in a direction it allows, from the node before to the step's node."""
    steps = paths.select("path", F.posexplode("steps").alias("at", "s"), get_path_nodes().alias("nodes")).select("path", F.col("s.edge").alias("edge_id"), F.col("s.node").alias("dst"), F.get("nodes", F.col("at")).alias("src"))
    good = steps.join(graph.arcs("once").select("edge_id", "src", "dst").distinct(), ["edge_id", "src", "dst"], "left_anti").select("path").distinct().withColumn("bad", F.lit(True))
    known = paths.join(graph.distinct_nodes.select(F.col("id").alias("source"), F.lit(True).alias("starts")), "source", "left")
    return known.join(good, "path", "left").select("path", (F.col("starts").isNotNull() & F.col("bad").isNull()).alias("valid"))


def has_subpath(whole: Column, part: Column, containment: str = "contiguous") -> Column:
    """Whether a path struct (source, steps) contains another, as its beginning or anywhere."""
    nodes = lambda p: F.concat(F.array(p["source"]), F.transform(p["steps"], lambda s: s["node"]))
    here = lambda i: (F.get(nodes(whole), i) == part["source"]) & (F.slice(whole["steps"], i + 1, F.size(part["steps"])) == part["steps"])
    fits = F.size(part["steps"]) <= F.size(whole["steps"])
    if containment == "prefix":
        return fits & here(F.lit(0))
    return fits & F.exists(F.sequence(F.lit(0), F.greatest(F.size(whole["steps"]) - F.size(part["steps"]), F.lit(0))), here)


def get_reduced_paths(paths: DataFrame, containment: str = "contiguous") -> DataFrame:
    """The paths that no other one contains; of equal ones the first. Only paths that share the first step meet."""
    key = F.when(F.size("steps") > 0, F.concat_ws("\x00", F.lit("e"), F.get("steps", F.lit(0))["edge"])).otherwise(F.concat_ws("\x00", F.lit("n"), "source"))
    small = paths.select("path", F.struct("source", "steps").alias("p"), key.alias("key"))
    places = F.concat(F.transform("steps", lambda s: F.concat_ws("\x00", F.lit("e"), s["edge"])), F.transform(get_path_nodes(), lambda n: F.concat_ws("\x00", F.lit("n"), n)))
    large = paths.select(F.col("path").alias("other"), F.struct("source", "steps").alias("q"), F.explode(F.array_distinct(places)).alias("key"))
    longer = F.size("q.steps") > F.size("p.steps")
    met = small.join(large, "key").filter((longer | ((F.size("q.steps") == F.size("p.steps")) & (F.col("other") < F.col("path")))) & has_subpath(F.col("q"), F.col("p"), containment))
    return paths.join(met.select("path").distinct(), "path", "left_anti").orderBy("path")


def get_coverage_targets(graph: Graph, kind: str = "edges") -> DataFrame:
    """target, kind, source, edges: nodes, edges, pairs of edges passed one after the other, or longest simple paths."""
    if kind == "nodes":
        return graph.distinct_nodes.select(F.concat(F.lit("node:"), "id").alias("target"), F.lit("node").alias("kind"), F.col("id").alias("source"), F.array().cast("array<string>").alias("edges"))
    if kind == "edges":
        return graph.edges.select(F.concat(F.lit("edge:"), "id").alias("target"), F.lit("edge").alias("kind"), F.lit(None).cast("string").alias("source"), F.array("id").alias("edges")).distinct()
    if kind == "edge-pairs":
        arcs = graph.arcs("once")
        a = arcs.select("src", F.col("edge_id").alias("one"), F.col("dst").alias("via"))
        pairs = a.join(arcs.select(F.col("src").alias("via"), F.col("edge_id").alias("two")), "via").select("src", F.array("one", "two").alias("edges")).distinct()
        return pairs.select(F.concat(F.lit("path:"), F.to_json(F.struct("src", "edges"))).alias("target"), F.lit("subpath").alias("kind"), F.col("src").alias("source"), "edges")
    if kind == "maximal-simple-paths":
        from .paths import get_simple_paths

        alone = graph.distinct_nodes.select(F.col("id").alias("source"), F.array().cast("array<struct<edge:string,node:string>>").alias("steps"), F.lit(0.0).alias("cost"))
        found = get_simple_paths(graph, everywhere=True).unionByName(alone)
        paths = stored(found.withColumn("path", F.monotonically_increasing_id()), "simple")
        best = get_reduced_paths(paths).select(F.col("source"), get_path_edges().alias("edges"))
        return best.select(F.concat(F.lit("path:"), F.to_json(F.struct("source", "edges"))).alias("target"), F.lit("subpath").alias("kind"), "source", "edges")
    raise GraphError(f"unknown kind of targets {kind!r}")


def covered(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """path, target: which targets each path covers."""
    nodes = paths.select("path", F.explode(get_path_nodes()).alias("n")).select("path", F.concat(F.lit("node:"), "n").alias("target"))
    edges = paths.select("path", F.explode("steps.edge").alias("e")).select("path", F.concat(F.lit("edge:"), "e").alias("target"))
    plain = nodes.unionByName(edges).distinct().join(targets.select("target"), "target", "left_semi")
    sub = targets.filter("kind = 'subpath'").select("target", F.col("source").alias("at"), F.col("edges").alias("want"))
    where = paths.select("path", F.posexplode(get_path_nodes()).alias("i", "at"), get_path_edges().alias("own"))
    inner = where.join(sub, "at").filter((F.size("want") <= F.size("own") - F.col("i")) & (F.slice("own", F.col("i") + 1, F.size("want")) == F.col("want"))).select("path", "target")
    return plain.select("path", "target").unionByName(inner).distinct()


def get_path_coverage(paths: DataFrame, targets: DataFrame) -> dict:
    """Ratio, and the covered and the uncovered targets; the ratio of nothing is 1."""
    hit = stored(covered(paths, targets).select("target").distinct(), "covered")
    n, k = targets.select("target").distinct().count(), hit.count()
    return {"ratio": k / n if n else 1.0, "covered": targets.join(hit, "target", "left_semi"), "uncovered": targets.join(hit, "target", "left_anti")}


def get_coverage_preserving_paths(paths: DataFrame, targets: DataFrame, strategy: str = "greedy", exact_limit: int = 24) -> DataFrame:
    """Fewer paths that cover the same targets: greedily by gain, then fewer steps, then place; or exactly."""
    pairs = stored(covered(paths, targets).join(paths.select("path", F.size("steps").alias("length")), "path"), "pairs")
    if strategy == "exact":
        n = paths.count()
        if n > exact_limit:
            raise GraphError(f"exact reduction takes {exact_limit} paths at most, not {n}")
        sets: dict[int, set[str]] = {r[0]: set() for r in paths.select("path").orderBy("path").collect()}
        for r in pairs.collect():
            sets[r["path"]].add(r["target"])
        everything = set().union(*sets.values()) if sets else set()
        for k in range(len(sets) + 1):
            for choice in combinations(sets, k):
                if set().union(*(sets[p] for p in choice)) == everything:
                    return paths.filter(F.col("path").isin(*choice) if choice else F.lit(False)).orderBy("path")
    left, chosen = pairs, []
    while True:
        gain = left.groupBy("path").agg(F.count("*").alias("gain"), F.first("length").alias("length")).orderBy(F.desc("gain"), "length", "path").first()
        if gain is None:
            return paths.filter(F.col("path").isin(*chosen) if chosen else F.lit(False)).orderBy("path")
        chosen.append(gain["path"])
        left = stored(left.join(left.filter(F.col("path") == gain["path"]).select("target"), "target", "left_anti"), "left")


def get_edge_coverage_paths(graph: Graph, source: str | None = None, target: str | None = None, reduce: str | None = "greedy", weight: Column | None = None) -> DataFrame:
    """Paths that together pass every edge in reach: for each edge the cheapest way to it, over it (and on to target)."""
    own = weighted(graph, weight)

    def kernel(g: LocalGraph):
        ways = g.arcs("once")
        starts = g.starts(source)
        reach = {s: shortest_costs(ways, s) for s in starts}
        after = {v: shortest_costs(ways, v) for v in range(len(ways))} if target is not None else {}
        at = 0
        for k, e, s, t in g.valid:
            best = None
            for a, b in ((s, t),) if g.directed(e) or s == t else ((s, t), (t, s)):
                w = 1.0 if e[4] is None else e[4]
                for start in starts:
                    cost = reach[start][0][a] + w + (after[b][0][g.place[target]] if target is not None else 0.0)
                    if cost < float("inf") and (best is None or cost < best[0]):
                        best = (cost, start, a, b)
            if best:
                cost, start, a, b = best
                steps = [*next(tied_paths(reach[start][1], start, a)), (k, b)]
                if target is not None:
                    steps += next(tied_paths(after[b][1], b, g.place[target]))
                yield (at, *as_path(g, start, steps, cost))
                at += 1

    paths = stored(run(own, kernel, "path long, source string, steps array<struct<edge:string,node:string>>, cost double"), "candidates")
    if reduce is None:
        return paths
    if reduce == "prefix":
        return get_reduced_paths(paths, "prefix")
    return get_coverage_preserving_paths(paths, get_coverage_targets(graph, "edges"), reduce)


# walks: DataFrames (step, edge, node), steps from 0

WALK = "step long, edge string, node string"


def _open(g: LocalGraph) -> list[list[tuple[int, int, float]]]:
    """Edges to go on by: those that leave a node, then non-directed ones that enter it."""
    out: list[list[tuple[int, int, float]]] = [[] for _ in g.ids]
    back: list[list[tuple[int, int, float]]] = [[] for _ in g.ids]
    for k, e, s, t in g.valid:
        w = 1.0 if e[4] is None else e[4]
        out[s].append((t, k, w))
        if s != t and e[3] != DIRECTED:
            back[t].append((s, k, w))
    return [a + b for a, b in zip(out, back, strict=True)]


def _walk(graph: Graph, choose: Callable, seed: int | None, start: str | None, steps: int, allowed: Column | None) -> DataFrame:
    """``choose(ways, place, seen edges, draw)`` gives the next edges to take, one after the other."""
    import random

    own = graph if allowed is None else graph.with_(edges=graph.edges.filter(allowed))
    first = seed if seed is not None else random.getrandbits(32)

    def kernel(g: LocalGraph):
        draw, ways, seen, made = numbers(first), _open(g), set(), 0
        places = g.starts(start)
        at = places[0] if places else None
        while at is not None and made < steps:
            taken = choose(ways, at, seen, draw)
            if not taken:
                return
            for t, k in taken:
                if made < steps:
                    yield made, g.edges[k][0], g.ids[t]
                made, at = made + 1, t
                seen.add(k)

    return run(own, kernel, WALK)


def gen_random_walk(graph: Graph, steps: int, seed: int | None = None, start: str | None = None, allowed: Column | None = None) -> DataFrame:
    """A walk by even chances over the edges that lead on, up to a dead end or ``steps``."""

    def choose(ways, at, seen, draw):
        return [ways[at][int(draw() * len(ways[at]))][:2]] if ways[at] else []

    return _walk(graph, choose, seed, start, steps, allowed)


def gen_weighted_random_walk(graph: Graph, steps: int, seed: int | None = None, start: str | None = None, allowed: Column | None = None) -> DataFrame:
    """As gen_random_walk(), with chances by weight; negative weights count as 0, and the walk ends where all are 0."""

    def choose(ways, at, seen, draw):
        weights = [max(0.0, w) for _, _, w in ways[at]]
        total = 0.0
        for w in weights:
            total += w
        if not total:
            return []
        r = draw() * total
        for arc, w in zip(ways[at], weights, strict=True):
            r -= w
            if r <= 0:
                return [arc[:2]]
        return [ways[at][0][:2]]

    return _walk(graph, choose, seed, start, steps, allowed)


def gen_quick_random_walk(graph: Graph, steps: int, seed: int | None = None, start: str | None = None, allowed: Column | None = None) -> DataFrame:
    """A walk over edges not yet passed, where there are any; else by fewest edges to the nearest one."""

    def choose(ways, at, seen, draw):
        fresh = [a for a in ways[at] if a[1] not in seen]
        if fresh:
            return [fresh[int(draw() * len(fresh))][:2]]
        came, queue = {at: None}, deque([at])
        while queue:
            v = queue.popleft()
            for t, k, _ in ways[v]:
                if k not in seen:
                    path = [(t, k)]
                    while came[v]:
                        u, e = came[v]
                        path.append((v, e))
                        v = u
                    return path[::-1]
                if t not in came:
                    came[t] = (v, k)
                    queue.append(t)
        return []

    return _walk(graph, choose, seed, start, steps, allowed)


def gen_predefined_walk(graph: Graph, edge_ids: list[str], start: str | None = None) -> DataFrame:
    """The walk along given edges; an error where one is missing or does not go on from the node reached."""

    def kernel(g: LocalGraph):
        places, names = g.starts(start), {e[0]: k for k, e in enumerate(g.edges)}
        at, ways = places[0] if places else None, _open(g)
        for n, name in enumerate(edge_ids):
            if name not in names:
                raise GraphError(f"edge {name} does not exist")
            onward = [t for t, k, _ in ways[at] if k == names[name]] if at is not None else []
            if not onward:
                raise GraphError(f"edge {name} does not go on from the walk's node")
            at = onward[0]
            yield n, name, g.ids[at]

    return run(graph, kernel, WALK)


def gen_walk_steps(walk: DataFrame, n: int) -> DataFrame:
    """The first n steps, one at least."""
    return walk.filter(F.col("step") < max(n, 1))


def _until(walk: DataFrame, done: Column) -> DataFrame:
    """The steps up to the first for which ``done`` holds, that one included."""
    end = walk.filter(done).agg(F.min("step")).first()[0]
    return walk if end is None else walk.filter(F.col("step") <= end)


def gen_walk_until_node(walk: DataFrame, node_id: str) -> DataFrame:
    return _until(walk, F.col("node") == node_id)


def gen_walk_until_edge(walk: DataFrame, edge_id: str) -> DataFrame:
    return _until(walk, F.col("edge") == edge_id)


def _new_so_far(walk: DataFrame, column: str) -> DataFrame:
    """The walk with ``met``: how many different values the steps up to each have shown; first sights are summed up."""
    first = walk.groupBy(column).agg(F.min("step").alias("step")).withColumn("new", F.lit(1)).select("step", "new")
    marked = walk.join(first, "step", "left").withColumn("g", F.lit(0))
    return marked.withColumn("met", F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy("g").orderBy("step"))).drop("g", "new")


def gen_walk_until_node_coverage(walk: DataFrame, graph: Graph, share: float, start: str) -> DataFrame:
    """Up to the step at which a share of all nodes is met, the start included."""
    import math

    goal = math.ceil(share * graph.distinct_nodes.count())
    seen = _new_so_far(walk.filter(F.col("node") != start), "node").select("step", F.col("met").alias("m"))
    end = seen.filter(F.col("m") + 1 >= goal).agg(F.min("step")).first()[0] if goal > 1 else -1
    return walk if end is None else walk.filter(F.col("step") <= end)


def gen_walk_until_edge_coverage(walk: DataFrame, graph: Graph, share: float) -> DataFrame:
    import math

    goal = math.ceil(share * graph.edges.count())
    end = _new_so_far(walk, "edge").filter(F.col("met") >= goal).agg(F.min("step")).first()[0] if goal > 0 else -1
    return walk if end is None else walk.filter(F.col("step") <= end)


take_steps, take_until_node, take_until_edge = gen_walk_steps, gen_walk_until_node, gen_walk_until_edge
take_until_node_coverage, take_until_edge_coverage = gen_walk_until_node_coverage, gen_walk_until_edge_coverage


def get_coverage(graph: Graph, walk: DataFrame, start: str | None = None) -> dict[str, float]:
    """Shares of nodes and edges that a walk has met, its start included; of nothing, 1."""
    met = walk.select(F.col("node").alias("id"))
    if start is not None:
        met = met.unionByName(walk.sparkSession.createDataFrame([(start,)], "id string"))
    nodes, edges = graph.distinct_nodes, graph.edges.select("id").distinct()
    n, m = nodes.count(), edges.count()
    return {"nodes": nodes.join(met, "id", "left_semi").count() / n if n else 1.0, "edges": edges.join(walk.select(F.col("edge").alias("id")), "id", "left_semi").count() / m if m else 1.0}
