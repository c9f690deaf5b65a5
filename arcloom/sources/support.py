"""What each document format keeps of a graph, found by writing a probe and reading it back."""

from __future__ import annotations

from functools import cache

from ..model import DIRECTED, UNDIRECTED, GraphError
from .json_documents import Record, edge, node, record
from .registry import FORMATS

FULL, PARTIAL, NONE = "full", "partial", "none"
FEATURES = ("directed", "undirected", "hierarchy", "ports", "visual", "style", "weight", "round_trip")


def _probe(mode: str = DIRECTED, nodes: dict | None = None, edges: dict | None = None) -> Record:
    """Two nodes and an edge, with further fields of the first node and of the edge."""
    return record(mode, [node("A", **(nodes or {})), node("B")], [edge("e0", "A", "B", **(edges or {}))])


def _back(name: str, probe: Record) -> Record | None:
    read, write = FORMATS[name]
    try:
        return read(write(probe))
    except (GraphError, ValueError, KeyError, TypeError, AttributeError):
        return None


def _level(kept: list[bool]) -> str:
    return FULL if kept and all(kept) else PARTIAL if any(kept) else NONE


def _same(name: str, nodes: dict | None = None, edges: dict | None = None) -> str:
    """How many of the given fields come back as they were."""
    r = _back(name, _probe(nodes=nodes, edges=edges))
    if r is None or not r["edges"] or not r["nodes"]:
        return NONE
    own = next((n for n in r["nodes"] if n["id"] == "A"), r["nodes"][0])
    return _level([own.get(k) == v for k, v in (nodes or {}).items()] + [r["edges"][0].get(k) == v for k, v in (edges or {}).items()])


def _mode(name: str, mode: str) -> str:
    r = _back(name, _probe(mode))
    if r is None or not r["edges"]:
        return NONE
    return FULL if (r["edges"][0].get("mode") or r["mode"]) == mode else NONE


def _nested(name: str) -> str:
    r = _back(name, record(DIRECTED, [node("P", label="P"), node("A", parent_id="P"), node("B")], [edge("e0", "A", "B")]))
    return NONE if r is None else _level([any((n.get("parent_id") or "").endswith("P") for n in r["nodes"])])


@cache
def get_format_support(name: str) -> dict[str, str]:
    """For each feature whether a format keeps it: full, partial (some of its fields) or none."""
    if name not in FORMATS:
        raise GraphError(f"unknown format {name!r}; known are {', '.join(sorted(FORMATS))}")
    port = {"name": "out", "direction": "out"}
    out = {
        "directed": _mode(name, DIRECTED), "undirected": _mode(name, UNDIRECTED), "hierarchy": _nested(name), "ports": _same(name, {"ports": [port]}, {"source_port": "out"}),
        "visual": _same(name, {"x": 1.0, "y": 2.0, "width": 3.0, "height": 4.0}), "style": _same(name, {"shape": "circle", "color": "red"}, {"color": "blue"}), "weight": _same(name, None, {"weight": 2.5}),
    }
    whole = _probe(nodes={"label": "First", "data": {"k": [1, "x"]}}, edges={"label": "to", "weight": 2.5, "data": {"k": 1}})
    r = _back(name, whole)
    return out | {"round_trip": NONE if r is None else _level([r["nodes"] == whole["nodes"], r["edges"] == whole["edges"], r["mode"] == whole["mode"]])}


def format_support() -> dict[str, dict[str, str]]:
    """The support of every format."""
    return {name: get_format_support(name) for name in FORMATS}
