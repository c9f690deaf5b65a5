"""JSON graph formats. A record is a dict: mode, id, initial_node_id, data, nodes and edges (lists of field dicts)."""

from __future__ import annotations

import json
from typing import Any

from ..model import BIDIRECTIONAL, DIRECTED, UNDIRECTED, GraphError

Record = dict[str, Any]
NODE_EXTRA = ("parent_id", "initial_node_id", "label", "data", "ports", "x", "y", "width", "height", "shape", "color", "style")
EDGE_EXTRA = ("mode", "weight", "label", "data", "source_port", "target_port", "points", "routing", "x", "y", "width", "height", "color", "style")


def some(fields: dict, names: tuple[str, ...]) -> dict:
    """The named fields that are there and not null."""
    return {k: fields[k] for k in names if fields.get(k) is not None}


def known(fields: dict, names: tuple[str, ...], skip: tuple[str, ...] = ()) -> dict:
    """Fields of the model among ``fields``; the others go into data."""
    out = some(fields, names)
    rest = {k: v for k, v in fields.items() if k not in names and k not in skip and v is not None}
    if rest:
        out["data"] = {**(out["data"] if isinstance(out.get("data"), dict) else {} if out.get("data") is None else {"value": out["data"]}), **rest}
    return out


def node(id: Any, **fields: Any) -> dict:  # noqa: A002
    return {"id": str(id), **{k: v for k, v in fields.items() if v is not None}}


def edge(id: Any, source: Any, target: Any, **fields: Any) -> dict:  # noqa: A002
    return {"id": str(id), "source_id": str(source), "target_id": str(target), **{k: v for k, v in fields.items() if v is not None}}


def record(mode: str, nodes: list, edges: list, **values: Any) -> Record:
    return {"mode": mode, "nodes": nodes, "edges": edges, **{k: v for k, v in values.items() if v is not None}}


def effective(r: Record, e: dict) -> str:
    return e.get("mode") or r["mode"]


def number(value: Any) -> float | None:
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else None


# networkx node-link


def from_networkx(text: str) -> Record:
    d = json.loads(text)
    links = d.get("edges", d.get("links", []))
    nodes = [node(n["id"], **known(n, NODE_EXTRA, ("id",))) for n in d.get("nodes", [])]
    edges = [edge(e.get("id", e.get("key") if isinstance(e.get("key"), str) else f"e{i}"), e["source"], e["target"], **known(e, EDGE_EXTRA, ("id", "source", "target", "key"))) for i, e in enumerate(links)]
    return record(DIRECTED if d.get("directed") else UNDIRECTED, nodes, edges, data=d.get("graph") or None)


def to_networkx(r: Record) -> str:
    nodes = [{"id": n["id"], **some(n, NODE_EXTRA)} for n in r["nodes"]]
    links = [{"source": e["source_id"], "target": e["target_id"], "key": e["id"], "id": e["id"], **some(e, EDGE_EXTRA)} for e in r["edges"]]
    return json.dumps({"directed": r["mode"] == DIRECTED, "multigraph": True, "graph": r.get("data") or {}, "nodes": nodes, "edges": links})


# graphology


def from_graphology(text: str) -> Record:
    d = json.loads(text)
    options = d.get("options") or {}
    mode, multi = options.get("type", "mixed"), options.get("multi", False)
    seen, edges = set(), []
    for i, e in enumerate(d.get("edges", [])):
        loose = e.get("undirected", mode == "undirected")
        pair = (loose, *(sorted((e["source"], e["target"])) if loose else (e["source"], e["target"])))
        if pair in seen and not multi:
            raise GraphError(f"edge {e['source']} - {e['target']} is there twice in a simple graph")
        seen.add(pair)
        own = UNDIRECTED if loose else DIRECTED
        edges.append(edge(e.get("key", f"e{i}"), e["source"], e["target"], mode=own if mode == "mixed" else None, **known(e.get("attributes") or {}, tuple(k for k in EDGE_EXTRA if k != "mode"))))
    nodes = [node(n["key"], **known(n.get("attributes") or {}, NODE_EXTRA)) for n in d.get("nodes", [])]
    return record(UNDIRECTED if mode == "undirected" else DIRECTED, nodes, edges, data=d.get("attributes") or None)


def to_graphology(r: Record) -> str:
    kinds = {effective(r, e) for e in r["edges"]} or {r["mode"]}
    if BIDIRECTIONAL in kinds:
        raise GraphError("this format has no bidirectional edges")
    mode = kinds.pop() if len(kinds) == 1 else "mixed"
    nodes = [{"key": n["id"], "attributes": some(n, NODE_EXTRA)} for n in r["nodes"]]
    edges = [{"key": e["id"], "source": e["source_id"], "target": e["target_id"], **({"undirected": True} if effective(r, e) == UNDIRECTED else {}), "attributes": some(e, tuple(k for k in EDGE_EXTRA if k != "mode"))} for e in r["edges"]]
    return json.dumps({"options": {"type": mode, "multi": True, "allowSelfLoops": True}, "attributes": r.get("data") or {}, "nodes": nodes, "edges": edges})


# graphlib


def from_graphlib(text: str) -> Record:
    d = json.loads(text)
    nodes = [node(n["v"], parent_id=n.get("parent"), **_value(n.get("value"), NODE_EXTRA)) for n in d.get("nodes", [])]
    parents = {n["id"]: n.get("parent_id") for n in nodes}
    for start in parents:
        at, seen = parents[start], set()
        while at is not None:
            if at not in parents or at in seen or at == start:
                raise GraphError(f"node {start}: its parents must exist and form no cycle")
            seen.add(at)
            at = parents[at]
    edges = [edge(json.dumps([e["v"], e["w"], e.get("name")]), e["v"], e["w"], **_value(e.get("value"), EDGE_EXTRA)) for e in d.get("edges", [])]
    return record(DIRECTED if (d.get("options") or {}).get("directed", True) else UNDIRECTED, nodes, edges, data=d.get("value"))


def _value(value: Any, names: tuple[str, ...]) -> dict:
    return known(value, names) if isinstance(value, dict) else {} if value is None else {"data": value}


def to_graphlib(r: Record) -> str:
    nodes = [{"v": n["id"], **({"parent": n["parent_id"]} if n.get("parent_id") else {}), "value": some(n, tuple(k for k in NODE_EXTRA if k != "parent_id"))} for n in r["nodes"]]
    edges = [{"v": e["source_id"], "w": e["target_id"], "name": e["id"], "value": some(e, EDGE_EXTRA)} for e in r["edges"]]
    return json.dumps({"options": {"directed": r["mode"] == DIRECTED, "multigraph": True, "compound": True}, "nodes": nodes, "edges": edges, "value": r.get("data")})


# cytoscape


def from_cytoscape(text: str) -> Record:
    d = json.loads(text)
    parts = d.get("elements", d)
    flat = parts if isinstance(parts, list) else [*({"group": "nodes", **n} for n in parts.get("nodes", [])), *({"group": "edges", **e} for e in parts.get("edges", []))]
    nodes, edges = [], []
    for item in flat:
        own = item.get("data", {})
        if item.get("group") == "edges" or "source" in own and "target" in own:
            edges.append(edge(own.get("id", f"e{len(edges)}"), own["source"], own["target"], **known(own, EDGE_EXTRA, ("id", "source", "target"))))
        else:
            place = item.get("position") or {}
            nodes.append(node(own["id"], parent_id=own.get("parent"), x=number(place.get("x")), y=number(place.get("y")), **known(own, tuple(k for k in NODE_EXTRA if k not in ("parent_id", "x", "y")), ("id", "parent"))))
    own = (d.get("data") if isinstance(d, dict) else None) or {}
    return record(own.get("mode", DIRECTED), nodes, edges, id=own.get("id"), data=own.get("data"))


def to_cytoscape(r: Record) -> str:
    nodes = [{"data": {"id": n["id"], **({"parent": n["parent_id"]} if n.get("parent_id") else {}), **some(n, tuple(k for k in NODE_EXTRA if k not in ("parent_id", "x", "y")))}, **({"position": {"x": n["x"], "y": n["y"]}} if n.get("x") is not None and n.get("y") is not None else {})} for n in r["nodes"]]
    edges = [{"data": {"id": e["id"], "source": e["source_id"], "target": e["target_id"], **some(e, EDGE_EXTRA)}} for e in r["edges"]]
    return json.dumps({"data": {"mode": r["mode"], "id": r.get("id", ""), "data": r.get("data")}, "elements": {"nodes": nodes, "edges": edges}})


# d3


def from_d3(text: str) -> Record:
    d = json.loads(text)
    nodes = [node(n.get("id", i), **known(n, NODE_EXTRA, ("id", "index", "vx", "vy", "fx", "fy"))) for i, n in enumerate(d.get("nodes", []))]
    ids = {n["id"] for n in nodes}

    def end(x: Any) -> str:
        if isinstance(x, dict):
            return str(x.get("id", x.get("index")))
        return nodes[x]["id"] if isinstance(x, int) and str(x) not in ids and 0 <= x < len(nodes) else str(x)

    edges = [edge(e.get("id", f"e{i}"), end(e["source"]), end(e["target"]), weight=number(e.get("weight", e.get("value"))), **known(e, tuple(k for k in EDGE_EXTRA if k != "weight"), ("id", "source", "target", "index", "weight", "value"))) for i, e in enumerate(d.get("links", []))]
    own = d.get("metadata") or {}
    return record(own.get("mode", DIRECTED), nodes, edges, id=own.get("id"), data=own.get("data"))


def to_d3(r: Record) -> str:
    nodes = [{"id": n["id"], **some(n, NODE_EXTRA)} for n in r["nodes"]]
    links = [{"id": e["id"], "source": e["source_id"], "target": e["target_id"], **some(e, EDGE_EXTRA)} for e in r["edges"]]
    return json.dumps({"metadata": {"mode": r["mode"], "id": r.get("id", ""), "data": r.get("data")}, "nodes": nodes, "links": links})


# JSON Graph Format


def from_jgf(text: str) -> Record:
    d = json.loads(text)
    g = d.get("graph") or (d.get("graphs") or [{}])[0]
    if g.get("hyperedges"):
        raise GraphError("hyperedges have no place in this model")
    raw = g.get("nodes", {})
    pairs = raw.items() if isinstance(raw, dict) else [(n["id"], n) for n in raw]
    nodes = [node(k, label=n.get("label"), **known(n.get("metadata") or {}, tuple(x for x in NODE_EXTRA if x != "label"))) for k, n in pairs]
    whole = g.get("directed", True)
    edges = []
    for i, e in enumerate(g.get("edges", [])):
        own = e.get("directed", whole)
        mode = None if own == whole else DIRECTED if own else UNDIRECTED
        extra = known(e.get("metadata") or {}, tuple(x for x in EDGE_EXTRA if x != "label"))
        edges.append(edge(e.get("id", f"e{i}"), e["source"], e["target"], label=e.get("relation", e.get("label")), **({"mode": mode} if mode and "mode" not in extra else {}), **extra))
    return record(DIRECTED if whole else UNDIRECTED, nodes, edges, id=g.get("id"), data=g.get("metadata"))


def to_jgf(r: Record) -> str:
    nodes = {n["id"]: {**some(n, ("label",)), "metadata": some(n, tuple(x for x in NODE_EXTRA if x != "label"))} for n in r["nodes"]}
    edges = [{"id": e["id"], "source": e["source_id"], "target": e["target_id"], "directed": effective(r, e) == DIRECTED, **({"relation": e["label"]} if e.get("label") else {}), "metadata": some(e, tuple(x for x in EDGE_EXTRA if x != "label"))} for e in r["edges"]]
    return json.dumps({"graph": {"id": r.get("id", ""), "directed": r["mode"] == DIRECTED, "metadata": r.get("data") or {}, "nodes": nodes, "edges": edges}})


# flow editors: nodes with positions, parents first


def from_xyflow(text: str) -> Record:
    d = json.loads(text)
    nodes = []
    for n in d.get("nodes", []):
        own, size = n.get("data") or {}, n.get("measured") or {}
        nodes.append(node(n["id"], parent_id=n.get("parentId", n.get("parentNode")), label=own.get("label"), x=number((n.get("position") or {}).get("x")), y=number((n.get("position") or {}).get("y")), width=number(n.get("width", size.get("width"))), height=number(n.get("height", size.get("height"))), shape=n.get("type"), data=own or None))
    edges = [edge(e["id"], e["source"], e["target"], source_port=e.get("sourceHandle"), target_port=e.get("targetHandle"), label=e.get("label"), data=e.get("data"), weight=number((e.get("data") or {}).get("weight"))) for e in d.get("edges", [])]
    return record(DIRECTED, nodes, edges)


def to_xyflow(r: Record) -> str:
    order, placed, left = [], set(), list(r["nodes"])
    while left:
        ready = [n for n in left if not n.get("parent_id") or n["parent_id"] in placed]
        ready = ready or left
        order += ready
        placed |= {n["id"] for n in ready}
        left = [n for n in left if n["id"] not in placed]
    data = lambda x: {**(x["data"] if isinstance(x.get("data"), dict) else {} if x.get("data") is None else {"value": x["data"]}), **({"label": x["label"]} if x.get("label") else {})}
    nodes = [{"id": n["id"], "position": {"x": n.get("x") or 0, "y": n.get("y") or 0}, "data": data(n), **({"parentId": n["parent_id"]} if n.get("parent_id") else {}), **some(n, ("width", "height")), **({"type": n["shape"]} if n.get("shape") else {})} for n in order]
    edges = [{"id": e["id"], "source": e["source_id"], "target": e["target_id"], **({"sourceHandle": e["source_port"]} if e.get("source_port") else {}), **({"targetHandle": e["target_port"]} if e.get("target_port") else {}), **some(e, ("label",)), "data": {**data(e), **({"weight": e["weight"]} if e.get("weight") is not None else {})}} for e in r["edges"]]
    return json.dumps({"nodes": nodes, "edges": edges})


# ELK: nested children, edges by sources and targets


def from_elk(text: str) -> Record:
    d, nodes, edges, port_of = json.loads(text), [], [], {}

    def text_of(x: dict) -> str | None:
        return (x.get("labels") or [{}])[0].get("text")

    stack = [(c, None) for c in reversed(d.get("children", []))]
    found = list(d.get("edges", []))
    while stack:
        n, parent = stack.pop()
        ports = [{"name": p["id"], **some(p, ("x", "y", "width", "height"))} for p in n.get("ports", [])]
        port_of.update({p["name"]: n["id"] for p in ports})
        nodes.append(node(n["id"], parent_id=parent, label=text_of(n), ports=ports or None, data=n.get("layoutOptions"), **some(n, ("x", "y", "width", "height"))))
        found += n.get("edges", [])
        stack += [(c, n["id"]) for c in reversed(n.get("children", []))]
    for e in found:
        ends = [(e.get("sources") or [e.get("source")]), (e.get("targets") or [e.get("target")])]
        if len(ends[0]) != 1 or len(ends[1]) != 1:
            raise GraphError(f"edge {e.get('id')} has more than two ends")
        s, t = ends[0][0], ends[1][0]
        line = (e.get("sections") or [{}])[0]
        points = [p for p in (line.get("startPoint"), *line.get("bendPoints", []), line.get("endPoint")) if p]
        edges.append(edge(e["id"], port_of.get(s, s), port_of.get(t, t), source_port=s if s in port_of else e.get("sourcePort"), target_port=t if t in port_of else e.get("targetPort"), label=text_of(e), points=points or None))
    return record(DIRECTED, nodes, edges, id=d.get("id"))


def to_elk(r: Record) -> str:
    made = {n["id"]: {"id": n["id"], **some(n, ("x", "y", "width", "height")), **({"labels": [{"text": n["label"]}]} if n.get("label") else {}), **({"ports": [{"id": p["name"], **some(p, ("x", "y", "width", "height"))} for p in n["ports"]]} if n.get("ports") else {})} for n in r["nodes"]}
    top = []
    for n in r["nodes"]:
        (made[n["parent_id"]].setdefault("children", []) if n.get("parent_id") in made else top).append(made[n["id"]])
    edges = [{"id": e["id"], "sources": [e.get("source_port") or e["source_id"]], "targets": [e.get("target_port") or e["target_id"]], **({"labels": [{"text": e["label"]}]} if e.get("label") else {})} for e in r["edges"]]
    return json.dumps({"id": r.get("id") or "root", "children": top, "edges": edges})


# CX2: a list of aspects


def from_cx2(text: str) -> Record:
    parts = {k: v for aspect in json.loads(text) for k, v in aspect.items()}
    declared = (parts.get("attributeDeclarations") or [{}])[0]

    def values(v: dict, kind: str) -> dict:
        names = {d.get("a", k): k for k, d in declared.get(kind, {}).items()}
        plain = {k: d["v"] for k, d in declared.get(kind, {}).items() if "v" in d}
        return {**plain, **{names.get(k, k): x for k, x in v.items()}}

    nodes = []
    for n in parts.get("nodes", []):
        v = values(n.get("v", {}), "nodes")
        nodes.append(node(v.pop("_id", n["id"]), label=v.pop("name", None), x=number(n.get("x")), y=number(n.get("y")), **known(v, tuple(k for k in NODE_EXTRA if k not in ("label", "x", "y")))))
    at = {n["id"]: m["id"] for n, m in zip(parts.get("nodes", []), nodes, strict=True)}
    edges = []
    for e in parts.get("edges", []):
        v = values(e.get("v", {}), "edges")
        edges.append(edge(v.pop("_id", e["id"]), at.get(e["s"], e["s"]), at.get(e["t"], e["t"]), label=v.pop("interaction", None), **known(v, tuple(k for k in EDGE_EXTRA if k != "label"))))
    own = (parts.get("networkAttributes") or [{}])[0]
    return record(own.get("mode", DIRECTED), nodes, edges, id=own.get("name"))


def to_cx2(r: Record) -> str:
    place = {n["id"]: i for i, n in enumerate(r["nodes"])}
    nodes = [{"id": i, **some(n, ("x", "y")), "v": {"_id": n["id"], **({"name": n["label"]} if n.get("label") else {}), **some(n, tuple(k for k in NODE_EXTRA if k not in ("label", "x", "y")))}} for i, n in enumerate(r["nodes"])]
    edges = [{"id": i, "s": place[e["source_id"]], "t": place[e["target_id"]], "v": {"_id": e["id"], **({"interaction": e["label"]} if e.get("label") else {}), **some(e, tuple(k for k in EDGE_EXTRA if k != "label"))}} for i, e in enumerate(r["edges"])]
    kind = lambda x: {"d": "boolean" if isinstance(x, bool) else "double" if isinstance(x, int | float) else "string"}
    declare = {"nodes": {k: kind(x) for n in nodes for k, x in n["v"].items()}, "edges": {k: kind(x) for e in edges for k, x in e["v"].items()}, "networkAttributes": {"mode": {"d": "string"}, "name": {"d": "string"}}}
    return json.dumps([{"CXVersion": "2.0", "hasFragments": False}, {"attributeDeclarations": [declare]}, {"networkAttributes": [{"mode": r["mode"], "name": r.get("id", "")}]}, {"nodes": nodes}, {"edges": edges}, {"status": [{"success": True}]}])


# GraphSON 3: typed values, one vertex with its outgoing edges per line or a whole graph


def _plain(x: Any) -> Any:
    if isinstance(x, dict) and "@type" in x:
        kind, v = x["@type"], x.get("@value")
        if kind in ("g:List", "g:Set"):
            return [_plain(i) for i in v]
        if kind == "g:Map":
            return {str(_plain(k)): _plain(w) for k, w in zip(v[::2], v[1::2], strict=True)}
        return _plain(v)
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(i) for i in x] if isinstance(x, list) else x


def _typed(x: Any) -> Any:
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, int):
        return {"@type": "g:Int64", "@value": x}
    if isinstance(x, float):
        return {"@type": "g:Double", "@value": x}
    if isinstance(x, list):
        return {"@type": "g:List", "@value": [_typed(i) for i in x]}
    return {"@type": "g:Map", "@value": [i for k, v in x.items() for i in (k, _typed(v))]}


def from_graphson(text: str) -> Record:
    try:
        whole = [json.loads(text)]
    except json.JSONDecodeError:
        whole = [json.loads(line) for line in text.splitlines() if line.strip()]
    first = whole[0]
    body = first["@value"] if isinstance(first, dict) and first.get("@type") == "tinker:graph" else first if isinstance(first, dict) and "vertices" in first else None
    vertices = body["vertices"] if body else whole
    nodes, edges = [], []
    for v in vertices:
        v = v.get("@value", v)
        own = {k: _plain(p[0].get("@value", p[0]).get("value")) for k, p in (v.get("properties") or {}).items()}
        nodes.append(node(_plain(v["id"]), label=v.get("label"), **known(own, tuple(k for k in NODE_EXTRA if k != "label"))))
        for label, out in (v.get("outE") or {}).items():
            for e in out:
                edges.append(edge(_plain(e["id"]), _plain(v["id"]), _plain(e["inV"]), label=label, **known(_plain(e.get("properties") or {}), tuple(k for k in EDGE_EXTRA if k != "label"))))
    for e in (body or {}).get("edges", []):
        e = e.get("@value", e)
        own = {k: _plain(p.get("@value", p).get("value") if isinstance(p, dict) and p.get("@type") == "g:Property" else p) for k, p in (e.get("properties") or {}).items()}
        edges.append(edge(_plain(e["id"]), _plain(e["outV"]), _plain(e["inV"]), label=e.get("label"), **known(own, tuple(k for k in EDGE_EXTRA if k != "label"))))
    return record(DIRECTED, nodes, edges)


def to_graphson(r: Record) -> str:
    vertices = [{"@type": "g:Vertex", "@value": {"id": n["id"], "label": n.get("label") or "vertex", "properties": {k: [{"@type": "g:VertexProperty", "@value": {"id": f"{n['id']}.{k}", "label": k, "value": _typed(v)}}] for k, v in some(n, tuple(k for k in NODE_EXTRA if k != "label")).items()}}} for n in r["nodes"]]
    edges = [{"@type": "g:Edge", "@value": {"id": e["id"], "label": e.get("label") or "edge", "outV": e["source_id"], "inV": e["target_id"], "properties": {k: {"@type": "g:Property", "@value": {"key": k, "value": _typed(v)}} for k, v in some(e, tuple(k for k in EDGE_EXTRA if k != "label")).items()}}} for e in r["edges"]]
    return json.dumps({"@type": "tinker:graph", "@value": {"vertices": vertices, "edges": edges}})


# Graphviz' own JSON output


def from_graphviz_json(text: str) -> Record:
    d = json.loads(text)
    skip = ("_gvid", "name", "nodes", "edges", "subgraphs", "tail", "head", "label", "pos", "width", "height", "shape", "color", "_draw_", "_ldraw_", "_hdraw_", "_tdraw_", "_hldraw_", "_tldraw_")
    objects = {o["_gvid"]: o for o in d.get("objects", [])}
    parent: dict[int, str] = {}
    clusters = {i for i, o in objects.items() if "nodes" in o or "subgraphs" in o or o["name"].startswith("cluster")}
    for i in clusters:
        for k in (*objects[i].get("nodes", []), *objects[i].get("subgraphs", [])):
            parent[k] = objects[i]["name"]
    nodes = []
    for i, o in objects.items():
        place = [float(x) for x in o["pos"].split(",")[:2]] if isinstance(o.get("pos"), str) and "," in o["pos"] else [None, None]
        inch = lambda k: float(o[k]) * 72 if o.get(k) else None  # noqa: B023, E731
        rest = {k: v for k, v in o.items() if k not in skip}
        nodes.append(node(o["name"], parent_id=parent.get(i), label=o.get("label") if o.get("label") != "\\N" else None, x=place[0], y=place[1], width=inch("width"), height=inch("height"), shape=o.get("shape"), color=o.get("color"), data=rest or None))
    edges = [edge(e.get("id", f"e{i}"), objects[e["tail"]]["name"], objects[e["head"]]["name"], label=e.get("label"), weight=float(e["weight"]) if "weight" in e else None, color=e.get("color"), source_port=e.get("tailport"), target_port=e.get("headport")) for i, e in enumerate(d.get("edges", []))]
    return record(DIRECTED if d.get("directed", True) else UNDIRECTED, nodes, edges, id=d.get("name"))


def to_graphviz_json(r: Record) -> str:
    place = {n["id"]: i for i, n in enumerate(r["nodes"])}
    inner = {n["parent_id"] for n in r["nodes"] if n.get("parent_id")}
    objects = []
    for i, n in enumerate(r["nodes"]):
        o: dict[str, Any] = {"_gvid": i, "name": n["id"], **some(n, ("label", "shape", "color"))}
        if n.get("x") is not None and n.get("y") is not None:
            o["pos"] = f"{n['x']:g},{n['y']:g}"
        if n["id"] in inner:
            own = [m for m in r["nodes"] if m.get("parent_id") == n["id"]]
            o |= {"nodes": [place[m["id"]] for m in own if m["id"] not in inner], "subgraphs": [place[m["id"]] for m in own if m["id"] in inner]}
        objects.append(o)
    edges = [{"_gvid": i, "tail": place[e["source_id"]], "head": place[e["target_id"]], "id": e["id"], **some(e, ("label", "color")), **({"weight": str(e["weight"])} if e.get("weight") is not None else {})} for i, e in enumerate(r["edges"])]
    return json.dumps({"name": r.get("id", ""), "directed": r["mode"] == DIRECTED, "strict": False, "objects": objects, "edges": edges})
