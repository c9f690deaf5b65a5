"""Line and block text formats: TGF, Pajek, GML, DOT, D2, PlantUML."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

from ..model import BIDIRECTIONAL, DIRECTED, UNDIRECTED, GraphError
from .json_documents import EDGE_EXTRA, NODE_EXTRA, Record, edge, effective, known, node, record, some


def from_tgf(text: str) -> Record:
    head, _, tail = re.sub(r"\r\n?", "\n", text).partition("\n#")
    if text.startswith("#"):
        head, tail = "", text[1:]
    nodes = [node(*(p := line.strip().split(None, 1))[:1], label=p[1] if len(p) > 1 else None) for line in head.split("\n") if line.strip()]
    edges = []
    for line in tail.split("\n"):
        p = line.strip().split(None, 2)
        if len(p) == 1:
            raise GraphError(f"an edge needs two ends: {line!r}")
        if p:
            edges.append(edge(f"e{len(edges)}", p[0], p[1], label=p[2] if len(p) > 2 else None))
    return record(DIRECTED, nodes, edges)


def to_tgf(r: Record) -> str:
    for n in r["nodes"]:
        if re.search(r"\s|^#", n["id"]):
            raise GraphError(f"id {n['id']!r} cannot be written: it has white space or starts with #")
    line = lambda *p: " ".join(str(x).replace("\n", " ") for x in p if x)
    return "\n".join([*(line(n["id"], n.get("label")) for n in r["nodes"]), "#", *(line(e["source_id"], e["target_id"], e.get("label")) for e in r["edges"])]) + "\n"


MAX_PAJEK = 16 << 20


def from_pajek(text: str) -> Record:
    """Vertices by number with their labels; further words of a line are kept in data.attributes.

    An edge is named by its kind, its ends (in order if undirected) and how many such edges there were before it.
    """
    if len(text) > MAX_PAJEK:
        raise GraphError(f"files of more than {MAX_PAJEK} characters are not read")
    section, name, nodes, edges, kinds = "", None, [], [], set()
    seen: dict[str, int] = {}

    def place(word: str) -> str:
        if not re.fullmatch(r"\d+", word) or not 1 <= int(word) <= len(nodes):
            raise GraphError(f"Pajek: there is no vertex {word!r}")
        return str(int(word))

    def add(s: str, t: str, rest: list[tuple[str, str]], mode: str) -> None:
        s, t = place(s), place(t)
        pair = json.dumps([mode, *(sorted((s, t)) if mode == UNDIRECTED else (s, t))], separators=(",", ":"))
        k = seen[pair] = seen.get(pair, -1) + 1
        weight = None
        if rest and not rest[0][0] and re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", rest[0][1]):
            weight, rest = float(rest[0][1]), rest[1:]
        words = [a or b for a, b in rest]
        if len(words) % 2:
            raise GraphError("Pajek: attributes of an edge are pairs of a name and a value")
        named = list(zip(words[::2], words[1::2], strict=True))
        label = next((v for n, v in named if n.lower() == "l"), None)
        attributes = [w for n, v in named if n.lower() != "l" for w in (n, v)]
        ident = json.dumps([pair, k], separators=(",", ":"))
        edges.append(edge(f"pajek:edge:{ident}", s, t, weight=weight, mode=mode, label=label, data={"attributes": attributes} if attributes else None))

    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("%"):
            continue
        words = re.findall(r'"([^"]*)"|(\S+)', line)
        parts = [a or b for a, b in words]
        if line.startswith("*"):
            section = parts[0].lower()
            if section == "*network":
                name = " ".join(parts[1:]) or None
            elif section == "*vertices":
                if nodes or len(parts) < 2 or not parts[1].isdigit():
                    raise GraphError("Pajek: one set of vertices with its size is wanted")
                nodes = [node(i) for i in range(1, int(parts[1]) + 1)]
            elif section not in ("*arcs", "*edges", "*arcslist", "*edgeslist"):
                raise GraphError(f"Pajek: section {section!r} is not read")
            continue
        if any(not a and re.search(r"[\[\]]", b) for a, b in words):
            raise GraphError("Pajek: times in brackets are not read")
        if section == "*vertices":
            own = nodes[int(place(parts[0])) - 1]
            if len(parts) > 1:
                own["label"] = parts[1]
            if len(parts) > 2:
                own["data"] = {"attributes": parts[2:]}
        elif section in ("*arcs", "*edges"):
            kinds.add(section)
            add(parts[0], parts[1], words[2:], DIRECTED if section == "*arcs" else UNDIRECTED)
        elif section in ("*arcslist", "*edgeslist"):
            kinds.add(section.replace("list", ""))
            for t in parts[1:]:
                add(parts[0], t, [], DIRECTED if section == "*arcslist" else UNDIRECTED)
        else:
            raise GraphError("Pajek: a line outside all sections")
    mode = UNDIRECTED if kinds == {"*edges"} else DIRECTED
    for e in edges:
        if e["mode"] == mode:
            del e["mode"]
    return record(mode, nodes, edges, id=name)


def to_pajek(r: Record) -> str:
    place = {n["id"]: i for i, n in enumerate(r["nodes"], 1)}
    words = lambda x: "".join(f" {w}" if re.fullmatch(r"[^\s\"\[\]]+", w) else f' "{w}"' for w in (x.get("data") or {}).get("attributes", [])) if isinstance(x.get("data"), dict) else ""
    quoted = lambda t: '"' + t.replace('"', "'") + '"'
    out = [*([f"*Network {quoted(r['id'])}"] if r.get("id") else []), f"*Vertices {len(place)}"]
    out += [f"{place[n['id']]} {quoted(n.get('label') or n['id'])}{words(n)}" for n in r["nodes"]]
    for head, directed in (("*Arcs", True), ("*Edges", False)):
        own = [e for e in r["edges"] if (effective(r, e) == DIRECTED) == directed]
        if own:
            labels = lambda e: f" l {quoted(e['label'])}" if e.get("label") else ""
            out += [head, *(f"{place[e['source_id']]} {place[e['target_id']]} {e['weight'] if e.get('weight') is not None else 1:g}{labels(e)}{words(e)}" for e in own)]
    return "\n".join(out) + "\n"


# GML: keys and values in brackets

GML_TOKEN = re.compile(r'\s+|#[^\n]*|(\[)|(\])|"([^"]*)"|([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?(?=[\s\]]|\Z))|([A-Za-z_]\w*)')
GML_SIGNS = {"&quot;": '"', "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def _gml(text: str) -> list[tuple[str, Any]]:
    top: list[tuple[str, Any]] = []
    stack, key, at = [top], None, 0
    while at < len(text):
        m = GML_TOKEN.match(text, at)
        if not m:
            raise GraphError(f"cannot read GML at {text[at : at + 20]!r}")
        at = m.end()
        if m[1]:
            inner: list[tuple[str, Any]] = []
            stack[-1].append((key, inner))
            stack.append(inner)
            key = None
        elif m[2]:
            stack.pop()
        elif m[5] and key is None:
            key = m[5]
        elif m[3] is not None or m[4] or m[5]:
            value: Any = re.sub("&(?:quot|lt|gt|amp);", lambda s: GML_SIGNS[s[0]], m[3]) if m[3] is not None else (float(m[4]) if re.search(r"[.eE]", m[4]) else int(m[4])) if m[4] else m[5]
            stack[-1].append((key, value))
            key = None
    return top


def _simple(pairs: list[tuple[str, Any]], skip: tuple[str, ...]) -> dict:
    return {k: dict(v) if isinstance(v, list) else v for k, v in pairs if k not in skip}


def from_gml(text: str) -> Record:
    top = next((v for k, v in _gml(text) if k == "graph"), [])
    flat = dict(p for p in top if not isinstance(p[1], list))
    mode = flat.get("mode") or (DIRECTED if flat.get("directed") == 1 else UNDIRECTED)
    nodes, edges = [], []
    names = {"parentId": "parent_id", "initialNodeId": "initial_node_id", "sourcePort": "source_port", "targetPort": "target_port", "value": "weight"}

    def fields(pairs, skip, extra):
        own = {names.get(k, k): v for k, v in _simple(pairs, skip).items()}
        for k in ("x", "y", "w", "h"):
            if isinstance(own.get("graphics"), dict) and k in own["graphics"]:
                own[{"w": "width", "h": "height"}.get(k, k)] = float(own["graphics"][k])
        own.pop("graphics", None)
        for k in ("data", "ports", "points", "style"):
            if isinstance(own.get(k), str):
                try:
                    own[k] = json.loads(own[k])
                except json.JSONDecodeError:
                    pass
        for k in ("weight", "x", "y", "width", "height"):
            if isinstance(own.get(k), int):
                own[k] = float(own[k])
        for k in ("parent_id", "label"):
            if k in own:
                own[k] = str(own[k])
        return known(own, extra)

    stack = [(v, None) for k, v in reversed(top) if k == "node"]
    while stack:
        n, parent = stack.pop()
        own = fields(n, ("id", "node", "edge"), NODE_EXTRA)
        own.setdefault("parent_id", parent)
        i = str(dict(p for p in n if not isinstance(p[1], list))["id"])
        nodes.append(node(i, **own))
        stack += [(v, i) for k, v in reversed(n) if k == "node"]
    for k, v in top:
        if k == "edge":
            d = dict(p for p in v if not isinstance(p[1], list))
            edges.append(edge(d.get("id", f"e{len(edges)}"), d["source"], d["target"], **fields(v, ("id", "source", "target"), EDGE_EXTRA)))
    return record(mode, nodes, edges, id=str(flat["id"]) if "id" in flat else None)


def to_gml(r: Record) -> str:
    def text(v: Any) -> str:
        if isinstance(v, bool | int | float):
            return str(int(v) if isinstance(v, bool) else v)
        v = v if isinstance(v, str) else json.dumps(v)
        return '"' + v.replace("&", "&amp;").replace('"', "&quot;") + '"'

    names = {"parent_id": "parentId", "initial_node_id": "initialNodeId", "source_port": "sourcePort", "target_port": "targetPort"}
    block = lambda kind, head, x, extra: f"  {kind} [\n" + "".join(f"    {k} {text(v)}\n" for k, v in {**head, **{names.get(k, k): v for k, v in some(x, extra).items()}}.items()) + "  ]\n"
    body = "".join(block("node", {"id": n["id"]}, n, NODE_EXTRA) for n in r["nodes"]) + "".join(block("edge", {"id": e["id"], "source": e["source_id"], "target": e["target_id"]}, e, EDGE_EXTRA) for e in r["edges"])
    return f'graph [\n  directed {int(r["mode"] == DIRECTED)}\n  mode "{r["mode"]}"\n{body}]\n'


# DOT

DOT_TOKEN = re.compile(r'\s+|//[^\n]*|/\*.*?\*/|^\s*#[^\n]*|"((?:[^"\\]|\\.)*)"|(->|--|[{}\[\];,=:])|([A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*|-?(?:\.\d+|\d+(?:\.\d*)?))|<((?:[^<>]|<[^<>]*>)*)>', re.S | re.M)


def from_dot(text: str) -> Record:
    """The first graph: defaults hold for the subgraph they stand in, clusters are parents, strict graphs have no repeats."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        m = DOT_TOKEN.match(text, at)
        if not m:
            raise GraphError(f"cannot read DOT at {text[at : at + 20]!r}")
        at = m.end()
        for i, kind in ((1, "id"), (2, "sign"), (3, "id"), (4, "id")):
            if m[i] is not None:
                tokens.append((kind, re.sub(r'\\(["\n])', lambda s: s[1].strip("\n"), m[i]) if i == 1 else m[i]))
    pos = 0

    def take(value: str | None = None) -> str:
        nonlocal pos
        if pos >= len(tokens) or value is not None and tokens[pos][1] != value:
            raise GraphError(f"DOT: {value or 'more'} expected")
        pos += 1
        return tokens[pos - 1][1]

    def at_sign(*signs: str) -> bool:
        return pos < len(tokens) and tokens[pos] in [("sign", s) for s in signs]

    def word() -> str:
        return tokens[pos][1].lower() if pos < len(tokens) and tokens[pos][0] == "id" else ""

    strict = word() == "strict" and bool(take())
    kind = take().lower()
    if kind not in ("graph", "digraph"):
        raise GraphError("DOT: graph or digraph expected")
    name = None if at_sign("{") else take()
    mode = DIRECTED if kind == "digraph" else UNDIRECTED
    nodes: dict[str, dict] = {}
    edges: list[dict] = []

    def attributes() -> dict:
        out = {}
        while at_sign("["):
            take()
            while not at_sign("]"):
                k = take()
                out[k] = take() if at_sign("=") and take() else "true"
                if at_sign(",", ";"):
                    take()
            take()
        return out

    def put(i: str, own: dict, scope: dict) -> str:
        if i not in nodes:
            nodes[i] = {"id": i, "attrs": dict(scope["node"]), "parent_id": scope["cluster"]}
        nodes[i]["attrs"].update(own)
        scope["members"].append(i)
        return i

    def operand(scope: dict) -> list[tuple[str, str | None]]:
        if word() == "subgraph" or at_sign("{"):
            title = None
            if word() == "subgraph":
                take()
                title = None if at_sign("{") else take()
            inner = {"node": dict(scope["node"]), "edge": dict(scope["edge"]), "cluster": scope["cluster"], "members": []}
            if title and title.startswith("cluster"):
                title = title.removeprefix("cluster_")
                nodes.setdefault(title, {"id": title, "attrs": {}, "parent_id": scope["cluster"]})
                inner["cluster"] = title
            statements(inner)
            scope["members"] += inner["members"]
            return [(i, None) for i in dict.fromkeys(inner["members"])]
        i, port = take(), None
        while at_sign(":"):
            take()
            port = take() if port is None else port + ":" + take()
        return [(put(i, {}, scope), port)]

    def statements(scope: dict) -> None:
        take("{")
        while not at_sign("}"):
            if at_sign(";", ","):
                take()
            elif word() in ("node", "edge", "graph") and tokens[pos + 1 : pos + 2] == [("sign", "[")]:
                what, own = take().lower(), None
                own = attributes()
                if what == "graph" and scope["cluster"]:
                    nodes[scope["cluster"]]["attrs"].update(own)
                elif what != "graph":
                    scope[what].update(own)
            elif tokens[pos][0] == "id" and tokens[pos + 1 : pos + 2] == [("sign", "=")]:
                k = take()
                take()
                v = take()
                if scope["cluster"]:
                    nodes[scope["cluster"]]["attrs"][k] = v
            else:
                chain = [operand(scope)]
                while at_sign("->", "--"):
                    take()
                    chain.append(operand(scope))
                own = attributes()
                if len(chain) == 1:
                    if len(chain[0]) == 1 and own:
                        nodes[chain[0][0][0]]["attrs"].update(own)
                    continue
                for left, right in zip(chain, chain[1:], strict=False):
                    for s, sp in left:
                        for t, tp in right:
                            edges.append({"s": s, "t": t, "attrs": {**scope["edge"], **own}, "sp": sp, "tp": tp})
        take("}")

    statements({"node": {}, "edge": {}, "cluster": None, "members": []})
    if strict:
        seen: dict[tuple, dict] = {}
        for e in edges:
            pair = (e["s"], e["t"]) if mode == DIRECTED else tuple(sorted((e["s"], e["t"])))
            seen.setdefault(pair, e)["attrs"].update(e["attrs"])
        edges = list(seen.values())

    def fields(a: dict, names: tuple[str, ...]) -> dict:
        a = dict(a)
        out: dict[str, Any] = {}
        if re.fullmatch(r"-?[\d.]+,-?[\d.]+!?", a.get("pos", "")):
            out["x"], out["y"] = (float(v) for v in a.pop("pos").rstrip("!").split(","))
        for k in ("width", "height", "weight"):
            if k in a and k in names:
                out[k] = float(a.pop(k))
        return known({**out, **a}, names, ("id",))

    made = [node(n["id"], parent_id=n["parent_id"], **fields(n["attrs"], tuple(k for k in NODE_EXTRA if k not in ("parent_id", "data", "style")))) for n in nodes.values()]
    lines = []
    for k, e in enumerate(edges):
        own = {**{"none": UNDIRECTED, "both": BIDIRECTIONAL}, "forward": None}.get(e["attrs"].get("dir"), None) if mode == DIRECTED else None
        lines.append(edge(e["attrs"].get("id", f"e{k}"), e["s"], e["t"], source_port=e["sp"], target_port=e["tp"], mode=own, **fields({a: b for a, b in e["attrs"].items() if a != "dir"}, ("label", "weight", "color"))))
    return record(mode, made, lines, id=name)


def _quoted(v: Any) -> str:
    return '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"' if not re.fullmatch(r"[A-Za-z_]\w*|-?\d+(\.\d+)?", str(v)) else str(v)


def to_dot(r: Record) -> str:
    attrs = lambda d: " [" + ", ".join(f"{k}={_quoted(v)}" for k, v in d.items()) + "]" if d else ""
    children: dict[str | None, list[dict]] = {}
    ids = {n["id"] for n in r["nodes"]}
    for n in r["nodes"]:
        children.setdefault(n.get("parent_id") if n.get("parent_id") in ids else None, []).append(n)
    title = lambda i: f"cluster_{i}"

    def body(parent: str | None, pad: str) -> str:
        out = ""
        for n in children.get(parent, []):
            own = some(n, ("label", "shape", "color"))
            if n["id"] in children:
                out += f"{pad}subgraph {_quoted(title(n['id']))} {{\n" + "".join(f"{pad}  {k}={_quoted(v)};\n" for k, v in own.items()) + body(n["id"], pad + "  ") + f"{pad}}}\n"
            else:
                spot = {"pos": f"{n['x']:g},{n['y']:g}"} if n.get("x") is not None and n.get("y") is not None else {}
                out += f"{pad}{_quoted(n['id'])}{attrs({**own, **spot})};\n"
        return out

    arrow = "->" if r["mode"] == DIRECTED else "--"
    lines = ""
    for e in r["edges"]:
        extra = {} if effective(r, e) == r["mode"] or r["mode"] != DIRECTED else {"dir": "none" if effective(r, e) == UNDIRECTED else "both"}
        end = lambda i, p: _quoted(i) + (f":{_quoted(p)}" if p else "")
        lines += f"  {end(e['source_id'], e.get('source_port'))} {arrow} {end(e['target_id'], e.get('target_port'))}{attrs({'id': e['id'], **some(e, ('label', 'weight', 'color')), **extra})};\n"
    return f"{'digraph' if r['mode'] == DIRECTED else 'graph'} {_quoted(r['id']) + ' ' if r.get('id') else ''}{{\n{body(None, '  ')}{lines}}}\n"


# D2: shapes, containers in braces or by dots, connections


# fixed values: words of the language that are fields and not shapes
D2_FIELDS = frozenset(
    """shape label style icon tooltip link near width height direction constraint class classes vars top left grid-rows grid-columns grid-gap vertical-gap horizontal-gap
    source-arrowhead target-arrowhead layers scenarios steps""".split()
)
D2_SIGN = re.compile(r"\s*(<->|->|<-|--)\s*")


def _d2_statements(text: str) -> Iterator[tuple[str, str]]:
    """Statements and how each ends: '{', '}' or ''. Quoted texts and comments hold no signs; | ... | blocks are texts."""
    line = ""
    for m in re.finditer(r"\|(?:md|[a-z]+)?\s[\s\S]*?\|(?=\s|$)|\"(?:[^\"\\\\]|\\\\.)*\"|'[^']*'|(?:(?<=\s)|^)#[^\n]*|[{};\n]|[^\"'{};\n#|]+|.", text, re.M):
        part = m[0]
        if part in "{};\n":
            if line.strip() or part == "{":
                yield line.strip(), "{" if part == "{" else ""
            if part == "}":
                yield "", "}"
            line = ""
        elif not part.startswith("#"):
            line += part
    if line.strip():
        yield line.strip(), ""


def _d2_parts(path: str) -> list[str]:
    return [p.strip().strip("\"'") for p in re.findall(r'"[^"]*"|\'[^\']*\'|[^.]+', path)]


def from_d2(text: str) -> Record:
    """Shapes, containers, connections and their fields. Fields of the model stay fields, others (style.stroke, tooltip,
    source-arrowhead.shape ...) are kept in data under their path; those of the drawing itself in the record's data."""
    nodes: dict[str, dict] = {}
    edges: list[dict] = []
    whole: dict = {}
    #: Open braces: the path of a container, or the entities whose fields they hold with the fields' common beginning.
    stack: list[tuple[list[str] | None, list[dict], list[str]]] = []
    modes = {"->": DIRECTED, "<-": DIRECTED, "<->": BIDIRECTIONAL, "--": UNDIRECTED}

    def here() -> list[str]:
        return next((path for path, _, _ in reversed(stack) if path is not None), [])

    def place(path: str) -> str:
        base, parts = here(), _d2_parts(path)
        while parts and parts[0] == "_":  # the container around
            base, parts = base[:-1], parts[1:]
        parts = [*base, *parts]
        for k in range(1, len(parts) + 1):
            i = ".".join(parts[:k])
            if i not in nodes:
                nodes[i] = node(i, label=parts[k - 1], parent_id=".".join(parts[: k - 1]) or None)
        return ".".join(parts)

    def put(target: dict, path: list[str], value: str) -> None:
        if path in (["label"], ["shape"]):
            target[path[0]] = value
        elif path in (["width"], ["height"]) and re.fullmatch(r"\d+(\.\d+)?", value):
            target[path[0]] = float(value)
        else:
            target.setdefault("data", {})[".".join(path)] = value

    for line, ends_with in _d2_statements(text):
        if ends_with == "}":
            if not stack:
                raise GraphError("D2: a brace closes nothing")
            stack.pop()
            continue
        head, _, value = line.partition(":") if not line.startswith("(") else (*line.rpartition(")")[:1], "", line.rpartition(")")[2])
        head, value = head.strip(), value.strip()
        value = value.strip("|").removeprefix("md").strip() if value.startswith("|") else value.strip("\"'")
        inside = stack[-1] if stack else (None, [], [])
        targets, path = inside[1], [*inside[2], *_d2_parts(head)]
        if inside[0] is None and targets:  # within a connection's or a field's own braces
            if value or ends_with != "{":
                for target in targets:
                    put(target, path, value)
            if ends_with:
                stack.append((None, targets, path))
            continue
        if m := re.match(r"\((.+)\)\[(\d+)\]\.?(.*)$", line):  # a connection by its place among those between two ends
            s, way, t = D2_SIGN.split(m[1])
            s, t = (place(t), place(s)) if way == "<-" else (place(s), place(t))
            found = [e for e in edges if (e["source_id"], e["target_id"]) == (s, t)][int(m[2]) : int(m[2]) + 1]
            field, _, value = m[3].partition(":")
            if field.strip():
                for target in found:
                    put(target, _d2_parts(field), value.strip().strip("\"'"))
            if ends_with:
                stack.append((None, found or [{}], []))
            continue
        ways = D2_SIGN.split(head)
        if len(ways) > 1:
            made = []
            for k in range(0, len(ways) - 2, 2):
                s, way, t = place(ways[k]), ways[k + 1], place(ways[k + 2])
                made.append(edge(f"e{len(edges) + len(made)}", *((t, s) if way == "<-" else (s, t)), label=value or None, mode=None if modes[way] == DIRECTED else modes[way]))
            edges += made
            if ends_with:
                stack.append((None, made, []))
            continue
        parts = _d2_parts(head)
        at = next((k for k, p in enumerate(parts) if p in D2_FIELDS), None)
        if at is not None:
            owner = nodes[place(".".join(f'"{p}"' for p in parts[:at]))] if at else nodes[".".join(here())] if here() else whole
            if value or not ends_with:
                put(owner, parts[at:], value)
            if ends_with:
                stack.append((None, [owner], parts[at:]))
            continue
        if not head:
            raise GraphError("D2: a brace without a name before it")
        i = place(head)
        if value:
            nodes[i]["label"] = value
        if ends_with:
            stack.append((i.split(".") if "." not in head.strip("\"'") or '"' not in head else [*here(), *_d2_parts(head)], [], []))
    if stack:
        raise GraphError("D2: a brace is not closed")
    return record(DIRECTED, list(nodes.values()), edges, **({"data": whole.get("data", {}) | {k: v for k, v in whole.items() if k != "data"}} if whole else {}))


def to_d2(r: Record) -> str:
    own = {n["id"]: n for n in r["nodes"]}

    def path(i: str) -> str:
        parts = []
        while i in own:
            parent = own[i].get("parent_id")
            parts.append(i.removeprefix(f"{parent}.") if parent else i)
            i = parent
        return ".".join(f'"{p}"' if re.search(r"[^\w -]", p) else p for p in reversed(parts))

    ways = {DIRECTED: "->", BIDIRECTIONAL: "<->", UNDIRECTED: "--"}
    fields = lambda x: [(k, v) for k, v in x.get("data", {}).items() if isinstance(v, str) and k.split(".")[0] in D2_FIELDS] if isinstance(x.get("data"), dict) else []
    shown = lambda v: v if re.fullmatch(r"[\w .%-]+", v) else '"' + v.replace('"', "'") + '"'
    lines = [f"{k}: {shown(v)}" for k, v in fields(r)]
    for n in r["nodes"]:
        lines.append(path(n["id"]) + (f': "{n["label"]}"' if n.get("label") else ""))
        lines += [f"{path(n['id'])}.shape: {n['shape']}"] if n.get("shape") else []
        lines += [f"{path(n['id'])}.{k}: {shown(v)}" for k, v in fields(n)]
    for e in r["edges"]:
        inner = "; ".join(f"{k}: {shown(v)}" for k, v in fields(e))
        lines.append(f"{path(e['source_id'])} {ways[effective(r, e)]} {path(e['target_id'])}" + (f': "{e["label"]}"' if e.get("label") else ":" if inner else "") + (f" {{{inner}}}" if inner else ""))
    return "\n".join(lines) + "\n"


# PlantUML: components and classes

PUML_NODE = re.compile(r'^(?:abstract\s+)?(class|interface|enum|component|node|database|actor|package|rectangle|object|state|entity|cloud|folder|usecase)\s+("[^"]+"|\[[^\]]+\]|[\w.]+)(?:\s+as\s+("[^"]+"|[\w.]+))?\s*(\{)?\s*$')
PUML_EDGE = re.compile(r'^("[^"]+"|\[[^\]]+\]|\(\)?[^)]*\)|[\w.]+)\s*(?:"[^"]*"\s*)?([<|*o#x+^]*)([-.]+(?:\w+[-.]+)?)([>|*o#x+^]*)\s*(?:"[^"]*"\s*)?("[^"]+"|\[[^\]]+\]|[\w.]+)\s*(?::\s*(.*))?$')


def from_plantuml(text: str) -> Record:
    nodes: dict[str, dict] = {}
    edges: list[dict] = []
    stack: list[str | None] = []
    plain = lambda x: x.strip('"[]()')
    inside_body = False
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith(("@", "'", "skinparam", "hide", "title", "!", "left to", "top to")):
            continue
        if line == "}":
            inside_body = False
            if stack:
                stack.pop()
            continue
        if m := PUML_NODE.match(line):
            i = plain(m[3] or m[2]) if not (m[3] or "").startswith('"') else plain(m[2])
            label = plain(m[2]) if m[3] and not m[3].startswith('"') else plain(m[3]) if m[3] else None
            nodes.setdefault(i, node(i)).update({"shape": m[1], **({"label": label} if label else {}), **({"parent_id": p} if (p := next((x for x in reversed(stack) if x), None)) else {})})
            if m[4]:
                inside_body = m[1] in ("class", "interface", "enum", "object", "entity")
                stack.append(i if not inside_body else None)
        elif not inside_body and (m := PUML_EDGE.match(line)):
            s, t = plain(m[1]), plain(m[5])
            for i in (s, t):
                nodes.setdefault(i, node(i))
            back, ahead = bool(m[2]), bool(m[4])
            mode = BIDIRECTIONAL if back and ahead else UNDIRECTED if not back and not ahead else None
            edges.append(edge(f"e{len(edges)}", *((t, s) if back and not ahead else (s, t)), label=m[6] or None, mode=mode, data={"arrow": m[2] + m[3] + m[4]}))
        elif re.fullmatch(r"\[[^\]]+\]", line):
            nodes.setdefault(plain(line), node(plain(line), shape="component"))
    return record(DIRECTED, list(nodes.values()), edges)


def to_plantuml(r: Record) -> str:
    children: dict[str | None, list[dict]] = {}
    ids = {n["id"] for n in r["nodes"]}
    for n in r["nodes"]:
        children.setdefault(n.get("parent_id") if n.get("parent_id") in ids else None, []).append(n)
    name = lambda i: i if re.fullmatch(r"[\w.]+", i) else f'"{i}"'

    def body(parent: str | None) -> str:
        out = ""
        for n in children.get(parent, []):
            shape = "package" if n["id"] in children and n.get("shape") in (None, "component") else n.get("shape") or "component"
            head = f'{shape} "{n["label"]}" as {name(n["id"])}' if n.get("label") else f"{shape} {name(n['id'])}"
            out += head + (" {\n" + body(n["id"]) + "}\n" if n["id"] in children else "\n")
        return out

    ways = {DIRECTED: "-->", BIDIRECTIONAL: "<-->", UNDIRECTED: "--"}
    lines = "".join(f"{name(e['source_id'])} {ways[effective(r, e)]} {name(e['target_id'])}" + (f" : {e['label']}" if e.get("label") else "") + "\n" for e in r["edges"])
    return f"@startuml\n{body(None)}{lines}@enduml\n"
