"""XML graph formats: GraphML, GEXF, DGML and draw.io pages."""

from __future__ import annotations

import json
import zlib
from base64 import b64decode
from typing import Any
from urllib.parse import unquote
from xml.etree import ElementTree as X
from xml.sax.saxutils import escape, quoteattr

from ..model import BIDIRECTIONAL, DIRECTED, UNDIRECTED, GraphError
from .json_documents import EDGE_EXTRA, NODE_EXTRA, Record, edge, effective, known, node, record, some

NUMBERS = ("weight", "x", "y", "width", "height")


def _tree(text: str) -> X.Element:
    if "<!ENTITY" in text:
        raise GraphError("documents that declare entities are not read")
    try:
        return X.fromstring(text)
    except X.ParseError as e:
        raise GraphError(f"not well-formed XML: {e}") from e


def _name(e: X.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(e: X.Element, name: str) -> list[X.Element]:
    return [c for c in e if _name(c) == name]


def _cast(value: str | None, kind: str) -> Any:
    if value is None:
        return None
    if kind in ("int", "long", "integer"):
        return int(value)
    if kind in ("float", "double"):
        return float(value)
    return value.strip().lower() in ("true", "1") if kind == "boolean" else value


def _fields(values: dict[str, Any], names: tuple[str, ...]) -> dict:
    """Values by attribute name as model fields; nested ones come as JSON text."""
    out = {}
    for k, v in values.items():
        k = {"parentId": "parent_id", "initialNodeId": "initial_node_id", "sourcePort": "source_port", "targetPort": "target_port"}.get(k, k)
        if k in NUMBERS and isinstance(v, str):
            v = float(v)
        if k in ("data", "ports", "points", "style") and isinstance(v, str):
            try:
                v = json.loads(v)
            except json.JSONDecodeError:
                pass
        out[k] = v
    return known(out, names)


def from_graphml(text: str) -> Record:
    root = _tree(text)
    keys = {k.get("id"): (k.get("attr.name", k.get("id")), k.get("attr.type", "string"), k.get("for", "all"), next((d.text or "" for d in _all(k, "default")), None)) for k in _all(root, "key")}
    graphs = _all(root, "graph")
    if not graphs:
        return record(DIRECTED, [], [])
    top = graphs[0]

    def values(e: X.Element, kind: str) -> dict:
        out = {name: _cast(default, t) for name, t, where, default in keys.values() if default is not None and where in (kind, "all")}
        for d in _all(e, "data"):
            name, t = keys.get(d.get("key"), (d.get("key"), "string"))[:2]
            out[name] = _cast(d.text or "", t)
        return out

    whole = UNDIRECTED if top.get("edgedefault") == "undirected" else DIRECTED
    nodes, edges = [], []
    stack = [(top, None, whole)]
    while stack:
        g, parent, base = stack.pop()
        if any(_name(e) == "hyperedge" for e in g):
            raise GraphError("hyperedges have no place in this model")
        for n in _all(g, "node"):
            own = _fields(values(n, "node"), NODE_EXTRA)
            own.setdefault("parent_id", parent)
            ports = [{"name": p.get("name")} for p in _all(n, "port")]
            nodes.append(node(n.get("id"), **own, **({"ports": ports} if ports and "ports" not in own else {})))
            for inner in _all(n, "graph"):
                stack.append((inner, n.get("id"), {"undirected": UNDIRECTED, "directed": DIRECTED}.get(inner.get("edgedefault"), base)))
        for e in _all(g, "edge"):
            own = _fields(values(e, "edge"), EDGE_EXTRA)
            flag = e.get("directed")
            if flag is not None and flag not in ("true", "false", "1", "0"):
                raise GraphError(f"directed={flag!r} is neither true nor false")
            mode = base if flag is None else DIRECTED if flag in ("true", "1") else UNDIRECTED
            if "mode" not in own and mode != whole:
                own["mode"] = mode
            own = {"source_port": e.get("sourceport"), "target_port": e.get("targetport"), **own}
            edges.append(edge(e.get("id") or f"{e.get('source')}-{e.get('target')}-{len(edges)}", e.get("source"), e.get("target"), **own))
    seen: dict[str, int] = {}
    for k, e in enumerate(edges):
        if e["id"] in seen:
            e["id"] = f"{e['id']}#e{k}"
        seen[e["id"]] = k
    return record(whole, nodes, edges, id=top.get("id"))


def _kind(v: Any) -> str:
    return "boolean" if isinstance(v, bool) else "long" if isinstance(v, int) else "double" if isinstance(v, float) else "string"


def _shown(v: Any) -> str:
    return v if isinstance(v, str) else json.dumps(v)


def to_graphml(r: Record) -> str:
    keys: dict[tuple[str, str], str] = {}

    def data(fields: dict, where: str, names: tuple[str, ...]) -> str:
        out = ""
        for k, v in some(fields, names).items():
            key = keys.setdefault((where, k), _kind(v))
            if key != _kind(v):
                keys[where, k] = "double" if {key, _kind(v)} <= {"long", "double"} else "string"
            out += f"<data key={quoteattr(where[0] + '_' + k)}>{escape(_shown(v))}</data>"
        return out

    children: dict[str | None, list[dict]] = {}
    ids = {n["id"] for n in r["nodes"]}
    for n in r["nodes"]:
        children.setdefault(n.get("parent_id") if n.get("parent_id") in ids else None, []).append(n)

    def body(parent: str | None) -> str:
        out = []
        for n in children.get(parent, []):
            inner = f'<graph edgedefault="{"directed" if r["mode"] == DIRECTED else "undirected"}">{body(n["id"])}</graph>' if n["id"] in children else ""
            ports = "".join(f"<port name={quoteattr(p['name'])}/>" for p in n.get("ports") or ())
            out.append(f"<node id={quoteattr(n['id'])}>{data(n, 'node', tuple(k for k in NODE_EXTRA if k != 'parent_id'))}{ports}{inner}</node>")
        return "".join(out)

    edges = ""
    whole = body(None)
    for e in r["edges"]:
        flag = "" if effective(r, e) == r["mode"] else f' directed="{"true" if effective(r, e) == DIRECTED else "false"}"'
        ports = "".join(f" {a}={quoteattr(e[k])}" for a, k in (("sourceport", "source_port"), ("targetport", "target_port")) if e.get(k))
        edges += f"<edge id={quoteattr(e['id'])} source={quoteattr(e['source_id'])} target={quoteattr(e['target_id'])}{flag}{ports}>{data(e, 'edge', tuple(k for k in EDGE_EXTRA if k not in ('source_port', 'target_port')))}</edge>"
    head = "".join(f'<key id={quoteattr(w[0] + "_" + k)} for="{w}" attr.name={quoteattr(k)} attr.type="{t}"/>' for (w, k), t in keys.items())
    return f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{head}<graph id={quoteattr(r.get("id") or "G")} edgedefault="{"directed" if r["mode"] == DIRECTED else "undirected"}">{whole}{edges}</graph></graphml>'


MODES = {"mutual": BIDIRECTIONAL, "directed": DIRECTED}


def from_gexf(text: str) -> Record:
    top = next((g for g in _tree(text) if _name(g) == "graph"), None)
    if top is None:
        return record(UNDIRECTED, [], [])
    names = {a.get("class"): {x.get("id"): (x.get("title"), x.get("type", "string")) for x in _all(a, "attribute")} for a in _all(top, "attributes")}
    whole = MODES.get(top.get("defaultedgetype"), UNDIRECTED)

    def values(e: X.Element, kind: str) -> dict:
        return {t: _cast(v.get("value"), k) for box in _all(e, "attvalues") for v in _all(box, "attvalue") for t, k in [names.get(kind, {}).get(v.get("for"), (v.get("for"), "string"))]}

    nodes, edges = [], []
    stack = [(n, None) for box in _all(top, "nodes") for n in reversed(_all(box, "node"))]
    while stack:
        n, parent = stack.pop()
        own = _fields(values(n, "node"), NODE_EXTRA)
        place = next((c for c in n if _name(c) == "position"), None)
        size = next((float(c.get("value")) for c in n if _name(c) == "size"), None)
        color = next((c for c in n if _name(c) == "color"), None)
        shape = next((c.get("value") for c in n if _name(c) == "shape"), None)
        extra = {"label": n.get("label"), "parent_id": n.get("pid") or own.get("parent_id") or parent, "width": size, "height": size, "shape": shape}
        if place is not None:
            extra |= {k: float(place.get(k)) for k in "xy" if place.get(k)}
        if color is not None:
            extra["color"] = color.get("hex") or f"rgb({color.get('r')},{color.get('g')},{color.get('b')})"
        nodes.append(node(n.get("id"), **{**own, **{k: v for k, v in extra.items() if v is not None}}))
        stack += [(c, n.get("id")) for box in _all(n, "nodes") for c in reversed(_all(box, "node"))]
    for box in _all(top, "edges"):
        for e in _all(box, "edge"):
            own = _fields(values(e, "edge"), EDGE_EXTRA)
            mode = MODES.get(e.get("type"), UNDIRECTED) if e.get("type") else whole
            extra = {"label": e.get("label"), "weight": float(e.get("weight")) if e.get("weight") else None, "mode": mode if mode != whole else None}
            edges.append(edge(e.get("id") or f"e{len(edges)}", e.get("source"), e.get("target"), **{**{k: v for k, v in extra.items() if v is not None}, **own}))
    return record(whole, nodes, edges)


def to_gexf(r: Record) -> str:
    kinds: dict[str, dict[str, str]] = {"node": {}, "edge": {}}
    types = {BIDIRECTIONAL: "mutual", DIRECTED: "directed", UNDIRECTED: "undirected"}

    def values(fields: dict, where: str, names: tuple[str, ...]) -> str:
        own = some(fields, names)
        for k, v in own.items():
            kinds[where].setdefault(k, _kind(v))
        return "<attvalues>" + "".join(f"<attvalue for={quoteattr(k)} value={quoteattr(_shown(v))}/>" for k, v in own.items()) + "</attvalues>"

    nodes = ""
    for n in r["nodes"]:
        spot = f'<viz:position x="{n["x"]}" y="{n["y"]}"/>' if n.get("x") is not None and n.get("y") is not None else ""
        pid = f" pid={quoteattr(n['parent_id'])}" if n.get("parent_id") else ""
        label = f" label={quoteattr(n['label'])}" if n.get("label") else ""
        nodes += f"<node id={quoteattr(n['id'])}{label}{pid}>{values(n, 'node', tuple(k for k in NODE_EXTRA if k not in ('label', 'parent_id', 'x', 'y')))}{spot}</node>"
    edges = ""
    for e in r["edges"]:
        more = "".join(f" {k}={quoteattr(str(e[k]))}" for k in ("label", "weight") if e.get(k) is not None)
        edges += f'<edge id={quoteattr(e["id"])} source={quoteattr(e["source_id"])} target={quoteattr(e["target_id"])} type="{types[effective(r, e)]}"{more}>{values(e, "edge", tuple(k for k in EDGE_EXTRA if k not in ("label", "weight", "mode")))}</edge>'
    head = "".join(f'<attributes class="{w}">' + "".join(f'<attribute id={quoteattr(k)} title={quoteattr(k)} type="{t}"/>' for k, t in own.items()) + "</attributes>" for w, own in kinds.items())
    return f'<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://gexf.net/1.3" xmlns:viz="http://gexf.net/1.3/viz" version="1.3"><graph defaultedgetype="{types[r["mode"]]}">{head}<nodes>{nodes}</nodes><edges>{edges}</edges></graph></gexf>'


def from_dgml(text: str) -> Record:
    root = _tree(text)
    nodes = {n.get("Id"): node(n.get("Id"), label=n.get("Label"), data={k: v for k, v in n.attrib.items() if k not in ("Id", "Label")} or None) for box in _all(root, "Nodes") for n in _all(box, "Node")}
    edges = []
    for box in _all(root, "Links"):
        for e in _all(box, "Link"):
            s, t = e.get("Source"), e.get("Target")
            for end in (s, t):
                nodes.setdefault(end, node(end))
            if e.get("Category") == "Contains":
                nodes[t]["parent_id"] = s
            else:
                rest = {k: v for k, v in e.attrib.items() if k not in ("Source", "Target", "Label", "Id")}
                edges.append(edge(e.get("Id") or f"e{len(edges)}", s, t, label=e.get("Label"), data=rest or None))
    return record(DIRECTED, list(nodes.values()), edges)


def to_dgml(r: Record) -> str:
    label = lambda x: f" Label={quoteattr(x['label'])}" if x.get("label") else ""
    inner = {n["parent_id"] for n in r["nodes"] if n.get("parent_id")}
    nodes = "".join(f"<Node Id={quoteattr(n['id'])}{label(n)}{' Group=' + quoteattr('Expanded') if n['id'] in inner else ''}/>" for n in r["nodes"])
    links = "".join(f'<Link Source={quoteattr(n["parent_id"])} Target={quoteattr(n["id"])} Category="Contains"/>' for n in r["nodes"] if n.get("parent_id"))
    links += "".join(f"<Link Id={quoteattr(e['id'])} Source={quoteattr(e['source_id'])} Target={quoteattr(e['target_id'])}{label(e)}/>" for e in r["edges"])
    return f'<?xml version="1.0" encoding="utf-8"?><DirectedGraph xmlns="http://schemas.microsoft.com/vs/2009/dgml"><Nodes>{nodes}</Nodes><Links>{links}</Links></DirectedGraph>'


def from_drawio(text: str) -> Record:
    root = _tree(text)
    page = next((d for d in root.iter() if _name(d) == "diagram"), root)
    model = next((m for m in page.iter() if _name(m) == "mxGraphModel"), None)
    if model is None and (page.text or "").strip():  # pages are deflated, in base 64
        model = _tree(unquote(zlib.decompress(b64decode(page.text.strip()), -15).decode()))
    nodes, edges = [], []
    for c in model.iter() if model is not None else ():
        wrapped = _name(c) in ("object", "UserObject")
        cell = next((x for x in c if _name(x) == "mxCell"), None) if wrapped else c if _name(c) == "mxCell" else None
        if cell is None or not (wrapped or cell.get("id")):
            continue
        own, label = c.get("id"), c.get("label") if wrapped else c.get("value")
        shape = next((g for g in cell if _name(g) == "mxGeometry"), None)
        if cell.get("edge") == "1":
            if cell.get("source") and cell.get("target"):
                loose = "endArrow=none" in (cell.get("style") or "")
                edges.append(edge(own, cell.get("source"), cell.get("target"), label=label or None, mode=UNDIRECTED if loose else None))
        elif cell.get("vertex") == "1":
            size = {k: float(shape.get(k)) for k in ("x", "y", "width", "height") if shape is not None and shape.get(k)}
            nodes.append(node(own, parent_id=cell.get("parent"), label=label or None, **size))
    ids = {n["id"] for n in nodes}
    for n in nodes:
        if n.get("parent_id") not in ids:
            n.pop("parent_id", None)
    return record(DIRECTED, nodes, edges)


def to_drawio(r: Record) -> str:
    cells = '<mxCell id="0"/><mxCell id="1" parent="0"/>'
    for n in r["nodes"]:
        size = " ".join(f'{k}="{n[k] if n.get(k) is not None else d}"' for k, d in (("x", 0), ("y", 0), ("width", 100), ("height", 50)))
        cells += f'<mxCell id={quoteattr(n["id"])} value={quoteattr(n.get("label") or "")} style="rounded=0;" vertex="1" parent={quoteattr(n.get("parent_id") or "1")}><mxGeometry {size} as="geometry"/></mxCell>'
    for e in r["edges"]:
        style = "" if effective(r, e) == DIRECTED else "endArrow=none;"
        cells += f'<mxCell id={quoteattr(e["id"])} value={quoteattr(e.get("label") or "")} style="{style}" edge="1" parent="1" source={quoteattr(e["source_id"])} target={quoteattr(e["target_id"])}><mxGeometry relative="1" as="geometry"/></mxCell>'
    return f'<mxfile><diagram name="Page-1"><mxGraphModel><root>{cells}</root></mxGraphModel></diagram></mxfile>'
