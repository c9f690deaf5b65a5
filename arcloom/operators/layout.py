"""Places and sizes: reading, moving and blending them, and two layouts of our own (tree, springs)."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..plans.kernels import LocalGraph, run
from .queries import ancestry

WIDTH, HEIGHT = 100.0, 50.0


def get_node_sizes(graph: Graph, measured: DataFrame | None = None) -> DataFrame:
    """id, width, height: as measured (id, width, height), else the node's own if positive, else 100 by 50."""
    own = graph.nodes.select("id", F.when(F.col("width") > 0, F.col("width")).alias("w"), F.when(F.col("height") > 0, F.col("height")).alias("h"))
    if measured is not None:
        own = own.join(measured.select("id", F.col("width").alias("mw"), F.col("height").alias("mh")), "id", "left").select("id", F.coalesce("mw", "w").alias("w"), F.coalesce("mh", "h").alias("h"))
    return own.select("id", F.coalesce("w", F.lit(WIDTH)).alias("width"), F.coalesce("h", F.lit(HEIGHT)).alias("height"))


def get_graph_with_layout_frame(graph: Graph, frame: DataFrame) -> Graph:
    """The graph with x and y from a frame (id, x, y); nodes without a row keep their place."""
    new = frame.select("id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    moved = graph.nodes.join(new, "id", "left").withColumns({"x": F.coalesce("_x", "x"), "y": F.coalesce("_y", "y")})
    return graph.with_(nodes=moved.select(*graph.nodes.columns))


apply_layout_frame = get_graph_with_layout_frame


def get_layout_bounds(graph: Graph) -> dict | None:
    """The rectangle around all placed nodes and edge points; None if nothing is placed."""
    box = graph.nodes.filter("x IS NOT NULL AND y IS NOT NULL").select("x", "y", (F.col("x") + F.coalesce("width", F.lit(0.0))).alias("x2"), (F.col("y") + F.coalesce("height", F.lit(0.0))).alias("y2"))
    points = graph.edges.select(F.explode("points").alias("p")).select("p.x", "p.y", F.col("p.x").alias("x2"), F.col("p.y").alias("y2"))
    r = box.unionByName(points).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x2").alias("x2"), F.max("y2").alias("y2")).first()
    return None if r["x"] is None else {"x": r["x"], "y": r["y"], "width": r["x2"] - r["x"], "height": r["y2"] - r["y"]}


def gen_layout_transition(start: DataFrame, end: DataFrame, steps: int = 30, ease: Callable[[Column], Column] | None = None) -> DataFrame:
    """frame, id, x, y for frames 1 .. steps between two placements; eased by 3t^2 - 2t^3 unless told otherwise."""
    both = end.select("id", F.col("x").alias("x2"), F.col("y").alias("y2")).join(start.select("id", F.col("x").alias("x1"), F.col("y").alias("y1")), "id", "left")
    t = F.col("frame") / F.lit(float(steps))
    s = ease(t) if ease else t * t * (3 - 2 * t)
    between = lambda a, b: F.coalesce(F.col(a), F.col(b)) + (F.col(b) - F.coalesce(F.col(a), F.col(b))) * s
    return both.withColumn("frame", F.explode(F.sequence(F.lit(1), F.lit(steps)))).select("frame", "id", between("x1", "x2").alias("x"), between("y1", "y2").alias("y"))


def get_translated_graph(graph: Graph, dx: float, dy: float) -> Graph:
    """The whole drawing moved: root nodes, and edges whose ends share no node above them (others move with it)."""
    root = F.col("parent_id").isNull()
    move = lambda c, d, when: F.when(when, F.col(c) + d).otherwise(F.col(c))
    nodes = graph.nodes.withColumns({"x": move("x", dx, root), "y": move("y", dy, root)})
    up = ancestry(graph).select("id", "ancestor")
    inner = graph.edges.select(F.col("id").alias("_e"), "source_id", "target_id").join(up.select(F.col("id").alias("source_id"), "ancestor"), "source_id").join(up.select(F.col("id").alias("target_id"), "ancestor"), ["target_id", "ancestor"]).select("_e").distinct()
    edges = graph.edges.join(inner.withColumn("_inner", F.lit(True)), F.col("id") == F.col("_e"), "left")
    free = F.col("_inner").isNull()
    points = F.when(free, F.transform("points", lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))).otherwise(F.col("points"))
    return graph.with_(nodes=nodes, edges=edges.withColumns({"x": move("x", dx, free), "y": move("y", dy, free), "points": points}).select(*graph.edges.columns))


translate_graph = get_translated_graph


def get_centered_graph(graph: Graph, x: float, y: float, width: float, height: float) -> Graph:
    """The drawing moved so that its middle lies in the middle of a rectangle."""
    box = get_layout_bounds(graph)
    return graph if box is None else get_translated_graph(graph, x + width / 2 - box["x"] - box["width"] / 2, y + height / 2 - box["y"] - box["height"] / 2)


center_graph = get_centered_graph


def get_tidy_tree_layout(graph: Graph, root: str | None = None, gap: tuple[float, float] = (140.0, 90.0)) -> DataFrame:
    """id, x, y: a spanning tree by breadth, leaves side by side and each node above the middle of its children."""

    def kernel(g: LocalGraph):
        around = g.around()
        depth: dict[int, int] = {}
        children: dict[int, list[int]] = {}
        x: dict[int, float] = {}
        at = 0.0
        starts = [g.place[root]] if root in g.place else []
        for start in [*starts, *range(len(g.ids))]:
            if start in depth:
                continue
            depth[start], queue = 0, deque([start])
            while queue:
                v = queue.popleft()
                children[v] = []
                for u, _, _ in around[v]:
                    if u not in depth:
                        depth[u] = depth[v] + 1
                        children[v].append(u)
                        queue.append(u)
            stack = [(start, False)]
            while stack:
                v, done = stack.pop()
                if not children[v]:
                    x[v], at = at, at + gap[0]
                elif done:
                    x[v] = (x[children[v][0]] + x[children[v][-1]]) / 2
                else:
                    stack.append((v, True))
                    stack += [(u, False) for u in reversed(children[v])]
        yield from ((g.ids[v], x[v], depth[v] * gap[1]) for v in range(len(g.ids)))

    return run(graph, kernel, "id string, x double, y double")


def gen_force_layout(graph: Graph, ticks: int = 50, length: float = 100.0) -> DataFrame:
    """tick, id, x, y: edges pull, nodes push apart, and the moves grow smaller; from a fixed spiral, so repeatable."""

    def kernel(g: LocalGraph):
        n = len(g.ids)
        place = [(10 * math.sqrt(i + 0.5) * math.cos(i * 2.4), 10 * math.sqrt(i + 0.5) * math.sin(i * 2.4)) for i in range(n)]
        for tick in range(ticks):
            force = [[0.0, 0.0] for _ in range(n)]
            for i in range(n):
                for j in range(i + 1, n):
                    dx, dy = place[i][0] - place[j][0], place[i][1] - place[j][1]
                    d2 = dx * dx + dy * dy or 1e-6
                    for k, sign in ((i, 1), (j, -1)):
                        force[k][0] += sign * dx / d2 * length * length / 10
                        force[k][1] += sign * dy / d2 * length * length / 10
            for _, _, s, t in g.valid:
                dx, dy = place[t][0] - place[s][0], place[t][1] - place[s][1]
                d = math.hypot(dx, dy) or 1e-3
                pull = (d - length) / d / 4
                for k, sign in ((s, 1), (t, -1)):
                    force[k][0] += sign * dx * pull
                    force[k][1] += sign * dy * pull
            cool = 1 - tick / ticks
            place = [(x + max(-length, min(length, fx)) * cool, y + max(-length, min(length, fy)) * cool) for (x, y), (fx, fy) in zip(place, force, strict=True)]
            yield from ((tick, v, *p) for v, p in zip(g.ids, place, strict=True))

    return run(graph, kernel, "tick long, id string, x double, y double")


def get_force_layout(graph: Graph, ticks: int = 50, length: float = 100.0) -> DataFrame:
    frames = gen_force_layout(graph, ticks, length)
    return frames.filter(F.col("tick") == ticks - 1).drop("tick")
