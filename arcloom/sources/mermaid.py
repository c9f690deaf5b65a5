"""Mermaid diagrams as graphs: one reader and one writer for each kind of diagram, over lines of text."""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..model import BIDIRECTIONAL, DIRECTED, UNDIRECTED, GraphError
from .json_documents import Record, edge, effective, node, record


def _lines(text: str, *heads: str) -> Iterator[str]:
    """The diagram's lines after its heading, without comments and empty ones; indentation stays."""
    body = re.sub(r"\A---\n.*?\n---\n", "", text.replace("\r\n", "\n"), flags=re.S)
    lines = [line.rstrip() for line in body.split("\n") if line.strip() and not line.strip().startswith("%%")]
    if not lines or not any(re.match(rf"{h}\b", lines[0].strip()) for h in heads):
        raise GraphError(f"the diagram must start with {' or '.join(heads)}")
    yield from lines


class _Made:
    """Nodes by id in order of first mention, and edges."""

    def __init__(self) -> None:
        self.nodes: dict[str, dict] = {}
        self.edges: list[dict] = []

    def node(self, i: str, **fields) -> str:
        own = self.nodes.setdefault(i, node(i))
        own.update({k: v for k, v in fields.items() if v is not None})
        return i

    def edge(self, s: str, t: str, **fields) -> None:
        self.node(s), self.node(t)
        self.edges.append(edge(f"e{len(self.edges)}", s, t, **fields))

    def record(self, mode: str = DIRECTED, **values) -> Record:
        return record(mode, list(self.nodes.values()), self.edges, **values)


def _tree(r: Record) -> dict[str | None, list[dict]]:
    ids = {n["id"] for n in r["nodes"]}
    out: dict[str | None, list[dict]] = {}
    for n in r["nodes"]:
        out.setdefault(n.get("parent_id") if n.get("parent_id") in ids else None, []).append(n)
    return out


def _label(x: dict) -> str:
    return str(x.get("label") or x.get("id"))


# flowcharts

# fixed values: the brackets of each shape
SHAPES = {"rounded": ("(", ")"), "stadium": ("([", "])"), "subroutine": ("[[", "]]"), "cylinder": ("[(", ")]"), "circle": ("((", "))"), "rhombus": ("{", "}"), "hexagon": ("{{", "}}"), "asymmetric": (">", "]"), "rectangle": ("[", "]")}
_BY_LENGTH = sorted(SHAPES.items(), key=lambda x: -len(x[1][0]))
LINK = re.compile(r"\s*(<|x|o)?(--+|==+|-\.+-)(?:\s+\"?([^-=.|>\"][^|>\"]*?)\"?\s+(?:--+|==+|\.+-))?(>|x(?=[\s|])|o(?=[\s|]))?\s*(?:\|\"?([^|\"]*)\"?\|)?\s*")


def _flow_node(text: str, made: _Made, parent: str | None) -> tuple[str, str]:
    """The node a text starts with, and what follows it."""
    m = re.match(r"\s*([\w.-]*\w)", text)
    if not m:
        raise GraphError(f"a node is expected at {text[:20]!r}")
    i, rest = m[1], text[m.end() :]
    for shape, (a, b) in _BY_LENGTH:
        if rest.startswith(a) and (end := rest.find(b, len(a))) > 0:
            made.node(i, label=rest[len(a) : end].strip().strip('"'), shape=shape)
            rest = rest[end + len(b) :]
            break
    fresh = i not in made.nodes
    made.node(i)
    if parent and (fresh or "parent_id" not in made.nodes[i]) and i != parent:
        made.nodes[i]["parent_id"] = parent
    return i, re.sub(r"^:::[\w-]+", "", rest)


def from_mermaid_flowchart(text: str) -> Record:
    made, stack, way = _Made(), [], None
    for k, line in enumerate(_lines(text, "flowchart", "graph")):
        for part in line.strip().rstrip(";").split(";"):
            part = part.strip()
            if not k:
                way = (part.split() + ["TB"])[1]
            elif m := re.match(r"subgraph\s+([\w.-]+)(?:\s*\[\"?([^\]\"]*)\"?\])?$|subgraph\s+\"?([^\"]+)\"?$", part):
                i = m[1] or m[3]
                made.node(i, label=m[2] or m[3], parent_id=stack[-1] if stack else None)
                stack.append(i)
            elif part == "end":
                stack.pop()
            elif part and not re.match(r"(style|classDef|class|click|linkStyle|direction)\b", part):
                rest, ends = part, None
                group, link = [], None
                while True:
                    group = []
                    while True:
                        i, rest = _flow_node(rest, made, stack[-1] if stack else None)
                        group.append(i)
                        if m := re.match(r"\s*&\s*", rest):
                            rest = rest[m.end() :]
                        else:
                            break
                    if ends is not None:
                        back, ahead = bool(link[1]), bool(link[4])
                        mode = BIDIRECTIONAL if back and ahead else None if ahead else UNDIRECTED
                        for s in ends:
                            for t in group:
                                made.edge(s, t, label=(link[5] or link[3] or "").strip() or None, mode=mode)
                    link = LINK.match(rest)
                    if not rest.strip() or not link:
                        break
                    ends, rest = group, rest[link.end() :]
    directions = {"TB": "down", "TD": "down", "BT": "up", "LR": "right", "RL": "left"}
    return made.record(direction=directions.get(way))


def to_mermaid_flowchart(r: Record) -> str:
    children = _tree(r)
    ways = {DIRECTED: "-->", BIDIRECTIONAL: "<-->", UNDIRECTED: "---"}

    def body(parent: str | None, pad: str) -> str:
        out = ""
        for n in children.get(parent, []):
            if n["id"] in children:
                out += f'{pad}subgraph {n["id"]} ["{_label(n)}"]\n{body(n["id"], pad + "  ")}{pad}end\n'
            else:
                a, b = SHAPES.get(n.get("shape"), SHAPES["rectangle"])
                out += f'{pad}{n["id"]}{a}"{_label(n)}"{b}\n' if n.get("label") or n.get("shape") else f"{pad}{n['id']}\n"
        return out

    lines = "".join(f"  {e['source_id']} {ways[effective(r, e)]}{f'|{e["label"]}|' if e.get('label') else ''} {e['target_id']}\n" for e in r["edges"])
    head = {"down": "TD", "up": "BT", "right": "LR", "left": "RL"}.get(r.get("direction"), "TD")
    return f"flowchart {head}\n{body(None, '  ')}{lines}"


# states


def from_mermaid_state(text: str) -> Record:
    made, stack, first = _Made(), [], None
    lines = iter(_lines(text, "stateDiagram-v2", "stateDiagram"))
    next(lines)
    for line in lines:
        line = line.strip()
        parent = stack[-1] if stack else None
        if line == "}":
            stack.pop()
        elif m := re.match(r"state\s+\"([^\"]*)\"\s+as\s+(\S+?)\s*(\{)?$|state\s+(\S+?)\s*(?:<<(\w+)>>)?\s*(\{)?$", line):
            i = made.node(m[2] or m[4], label=m[1], shape=m[5], parent_id=parent)
            if m[3] or m[6]:
                stack.append(i)
        elif m := re.match(r"(\[\*\]|\S+)\s*-->\s*(\[\*\]|\S+?)\s*(?::\s*(.*))?$", line):
            s, t = m[1], m[2]
            for i in (s, t):
                if i != "[*]" and i not in made.nodes:
                    made.node(i, parent_id=parent)
            if s == "[*]":
                if parent:
                    made.nodes[parent].setdefault("initial_node_id", t)
                else:
                    first = first or t
            elif t == "[*]":
                made.node(s, shape="final")
            else:
                made.edge(s, t, label=m[3] or None)
        elif m := re.match(r"(\w+)\s*:\s*(.+)$", line):
            made.node(m[1], label=m[2], parent_id=parent)
    return made.record(initial_node_id=first)


def to_mermaid_state(r: Record) -> str:
    children = _tree(r)

    def body(parent: str | None, start: str | None, pad: str) -> str:
        out = f"{pad}[*] --> {start}\n" if start else ""
        for n in children.get(parent, []):
            if n.get("label") and n["label"] != n["id"]:
                out += f'{pad}state "{n["label"]}" as {n["id"]}\n'
            if n["id"] in children:
                out += f"{pad}state {n['id']} {{\n{body(n['id'], n.get('initial_node_id'), pad + '  ')}{pad}}}\n"
            elif not n.get("label"):
                out += f"{pad}state {n['id']}\n"
            if n.get("shape") == "final":
                out += f"{pad}{n['id']} --> [*]\n"
        return out

    return "stateDiagram-v2\n" + body(None, r.get("initial_node_id"), "  ") + "".join(f"  {e['source_id']} --> {e['target_id']}{' : ' + e['label'] if e.get('label') else ''}\n" for e in r["edges"])


# classes, entities, requirements

CLASS_LINK = re.compile(r"^(\S+)\s*(?:\"([^\"]*)\"\s*)?(<\|--|<\|\.\.|\*--|o--|<--|<\.\.|--\|>|\.\.\|>|--\*|--o|-->|\.\.>|--|\.\.)\s*(?:\"([^\"]*)\"\s*)?(\S+)\s*(?::\s*(.*))?$")


def from_mermaid_class(text: str) -> Record:
    made, inside = _Made(), None
    lines = iter(_lines(text, "classDiagram-v2", "classDiagram"))
    next(lines)
    members: dict[str, list[str]] = {}
    for line in lines:
        line = line.strip()
        if inside is not None:
            if line == "}":
                inside = None
            else:
                members.setdefault(inside, []).append(line)
        elif m := re.match(r"class\s+([\w`~.-]+)(?:\[\"([^\"]*)\"\])?\s*(\{)?$", line):
            i = made.node(m[1].strip("`"), label=m[2], shape="class")
            inside = i if m[3] else None
        elif m := CLASS_LINK.match(line):
            turned = m[3][0] in "<*o"
            s, t = (m[5], m[1]) if turned else (m[1], m[5])
            mode = UNDIRECTED if m[3] in ("--", "..") else None
            ends = {k: v for k, v in (("source", m[4] if turned else m[2]), ("target", m[2] if turned else m[4])) if v}
            made.edge(s, t, label=m[6] or None, mode=mode, data={"relation": m[3], **({"cardinality": ends} if ends else {})})
        elif m := re.match(r"([\w`.-]+)\s*:\s*(.+)$", line):
            members.setdefault(made.node(m[1].strip("`"), shape="class"), []).append(m[2])
    for i, own in members.items():
        made.node(i, data={"members": own})
    return made.record()


def to_mermaid_class(r: Record) -> str:
    out = "classDiagram\n"
    for n in r["nodes"]:
        own = (n.get("data") or {}).get("members", []) if isinstance(n.get("data"), dict) else []
        title = f'["{n["label"]}"]' if n.get("label") else ""
        out += f"  class {n['id']}{title}" + (" {\n" + "".join(f"    {m}\n" for m in own) + "  }\n" if own else "\n")
    for e in r["edges"]:
        relation = (e.get("data") or {}).get("relation") if isinstance(e.get("data"), dict) else None
        relation = relation or ("--" if effective(r, e) != DIRECTED else "-->")
        s, t = (e["target_id"], e["source_id"]) if relation[0] in "<*o" else (e["source_id"], e["target_id"])
        out += f"  {s} {relation} {t}{' : ' + e['label'] if e.get('label') else ''}\n"
    return out


def from_mermaid_er(text: str) -> Record:
    made, inside = _Made(), None
    lines = iter(_lines(text, "erDiagram"))
    next(lines)
    for line in lines:
        line = line.strip()
        if inside:
            if line == "}":
                inside = None
            else:
                kind, name, *more = line.split(None, 2)
                own = made.nodes[inside].setdefault("data", {"attributes": []})["attributes"]
                own.append({"type": kind, "name": name, **({"key": more[0]} if more else {})})
        elif m := re.match(r"([\w-]+)\s*([|}o]{2})(--|\.\.)([|{o]{2})\s*([\w-]+)\s*:\s*\"?([^\"]*)\"?$", line):
            made.edge(m[1], m[5], label=m[6] or None, mode=UNDIRECTED, data={"left": m[2], "line": m[3], "right": m[4]})
        elif m := re.match(r"([\w-]+)(?:\[\"?([^\]\"]*)\"?\])?\s*(\{)?$", line):
            i = made.node(m[1], label=m[2], shape="entity")
            inside = i if m[3] else None
    return made.record()


def to_mermaid_er(r: Record) -> str:
    out = "erDiagram\n"
    for n in r["nodes"]:
        own = (n.get("data") or {}).get("attributes", []) if isinstance(n.get("data"), dict) else []
        out += f"  {n['id']}" + (f'["{n["label"]}"]' if n.get("label") else "") + (" {\n" + "".join(f"    {a['type']} {a['name']}{' ' + a['key'] if a.get('key') else ''}\n" for a in own) + "  }\n" if own else "\n")
    for e in r["edges"]:
        d = e["data"] if isinstance(e.get("data"), dict) else {}
        out += f'  {e["source_id"]} {d.get("left", "||")}{d.get("line", "--")}{d.get("right", "o{")} {e["target_id"]} : "{e.get("label") or ""}"\n'
    return out


def from_mermaid_requirement(text: str) -> Record:
    made, inside = _Made(), None
    lines = iter(_lines(text, "requirementDiagram"))
    next(lines)
    for line in lines:
        line = line.strip()
        if inside:
            if line == "}":
                inside = None
            elif ":" in line:
                k, _, v = line.partition(":")
                made.nodes[inside].setdefault("data", {})[k.strip()] = v.strip().strip('"')
        elif m := re.match(r"(\w*[rR]equirement|element|\w+Constraint)\s+([\w.-]+)\s*\{$", line):
            inside = made.node(m[2], shape=m[1])
        elif m := re.match(r"([\w.-]+)\s*-\s*(\w+)\s*->\s*([\w.-]+)$", line):
            made.edge(m[1], m[3], label=m[2])
        elif m := re.match(r"([\w.-]+)\s*<-\s*(\w+)\s*-\s*([\w.-]+)$", line):
            made.edge(m[3], m[1], label=m[2])
    return made.record()


def to_mermaid_requirement(r: Record) -> str:
    own = lambda n: n["data"] if isinstance(n.get("data"), dict) else {}
    nodes = "".join(f"  {n.get('shape') or 'requirement'} {n['id']} {{\n" + "".join(f"    {k}: {v}\n" for k, v in own(n).items()) + "  }\n" for n in r["nodes"])
    return "requirementDiagram\n" + nodes + "".join(f"  {e['source_id']} - {e.get('label') or 'traces'} -> {e['target_id']}\n" for e in r["edges"])


# trees by indentation


def _indented(text: str, *heads: str) -> Record:
    made, stack = _Made(), []
    lines = iter(_lines(text, *heads))
    next(lines)
    for line in lines:
        depth, body = len(line) - len(line.lstrip()), line.strip()
        if body.startswith("::"):
            continue
        m = re.match(r"([\w.-]*)(\(\(|\[|\(|\{\{|\)\)?)(.+?)(\)\)|\]|\)|\}\}|\(\(?)$", body)
        label = (m[3] if m else body).strip('"')
        i = m[1] if m and m[1] else label
        while i in made.nodes:
            i += "'"
        while stack and stack[-1][0] >= depth:
            stack.pop()
        shape = next((s for s, (a, _) in SHAPES.items() if m and a == m[2]), None)
        made.node(i, label=label, shape=shape)
        if stack:
            made.edge(stack[-1][1], i)
        stack.append((depth, i))
    return made.record(initial_node_id=next(iter(made.nodes), None))


def _outlined(r: Record, head: str) -> str:
    below: dict[str, list[str]] = {}
    for e in r["edges"]:
        below.setdefault(e["source_id"], []).append(e["target_id"])
    entered = {e["target_id"] for e in r["edges"]}
    own = {n["id"]: n for n in r["nodes"]}
    out, seen = [head], set()
    stack = [(i, 1) for i in reversed([n["id"] for n in r["nodes"] if n["id"] not in entered])]
    while stack:
        i, depth = stack.pop()
        if i in seen:
            raise GraphError("only trees can be written")
        seen.add(i)
        a, b = SHAPES.get(own[i].get("shape"), ("", ""))
        out.append("  " * depth + (f"{i}{a}{_label(own[i])}{b}" if a else _label(own[i])))
        stack += [(t, depth + 1) for t in reversed(below.get(i, []))]
    return "\n".join(out) + "\n"


def from_mermaid_mindmap(text: str) -> Record:
    return _indented(text, "mindmap")


def to_mermaid_mindmap(r: Record) -> str:
    return _outlined(r, "mindmap")


def from_mermaid_ishikawa(text: str) -> Record:
    return _indented(text, "ishikawa-beta", "ishikawa")


def to_mermaid_ishikawa(r: Record) -> str:
    return _outlined(r, "ishikawa")


# flows of amounts


def from_mermaid_sankey(text: str) -> Record:
    import csv

    made = _Made()
    lines = list(_lines(text, "sankey-beta", "sankey"))[1:]
    for row in csv.reader(lines):
        if len(row) != 3:
            raise GraphError(f"three columns are expected: {row}")
        made.edge(row[0].strip(), row[1].strip(), weight=float(row[2]))
    return made.record()


def to_mermaid_sankey(r: Record) -> str:
    cell = lambda x: '"' + x.replace('"', '""') + '"' if re.search(r'[",]', x) else x
    return "sankey-beta\n" + "".join(f"{cell(e['source_id'])},{cell(e['target_id'])},{e['weight'] if e.get('weight') is not None else 1:g}\n" for e in r["edges"])


# systems: architecture, blocks, C4, use cases


def from_mermaid_architecture(text: str) -> Record:
    made = _Made()
    lines = iter(_lines(text, "architecture-beta", "architecture"))
    next(lines)
    for line in lines:
        line = line.strip()
        if m := re.match(r"(group|service|junction)\s+(\w+)(?:\(([^)]*)\))?(?:\[([^\]]*)\])?(?:\s+in\s+(\w+))?$", line):
            made.node(m[2], label=m[4], shape=m[1], parent_id=m[5], data={"icon": m[3]} if m[3] else None)
        elif m := re.match(r"(\w+)(?:\{group\})?:([LRTB])\s*(<)?--(>)?\s*([LRTB]):(\w+)(?:\{group\})?$", line):
            mode = BIDIRECTIONAL if m[3] and m[4] else UNDIRECTED if not m[3] and not m[4] else None
            s, t, sp, tp = (m[6], m[1], m[5], m[2]) if m[3] and not m[4] else (m[1], m[6], m[2], m[5])
            made.edge(s, t, source_port=sp, target_port=tp, mode=mode)
    return made.record()


def to_mermaid_architecture(r: Record) -> str:
    children, out = _tree(r), "architecture-beta\n"
    for n in r["nodes"]:
        icon = n["data"].get("icon") if isinstance(n.get("data"), dict) else None
        kind = "group" if n["id"] in children else n.get("shape") or "service"
        out += f"  {kind} {n['id']}" + (f"({icon or 'server'})" if kind != "junction" else "") + (f"[{n['label']}]" if n.get("label") else "") + (f" in {n['parent_id']}" if n.get("parent_id") else "") + "\n"
    ways = {DIRECTED: "-->", BIDIRECTIONAL: "<-->", UNDIRECTED: "--"}
    return out + "".join(f"  {e['source_id']}:{e.get('source_port') or 'R'} {ways[effective(r, e)]} {e.get('target_port') or 'L'}:{e['target_id']}\n" for e in r["edges"])


def from_mermaid_block(text: str) -> Record:
    made, stack = _Made(), []
    lines = iter(_lines(text, "block-beta", "block"))
    next(lines)
    for line in lines:
        line = line.strip()
        if re.match(r"(columns|space|style|classDef|class)\b", line):
            continue
        if m := re.match(r"block(?::(\w+))?(?::\d+)?$", line):
            stack.append(made.node(m[1] or f"block{len(made.nodes)}", shape="block", parent_id=stack[-1] if stack else None))
        elif line == "end":
            stack.pop()
        elif m := re.match(r"(\w+)\s*(<)?--+\s*(?:\"([^\"]*)\"\s*--+)?(>)?\s*(\w+)$", line):
            made.edge(m[1], m[5], label=m[3], mode=BIDIRECTIONAL if m[2] and m[4] else None if m[4] else UNDIRECTED)
        else:
            for m in re.finditer(r"(\w+)(?:(\(\(|\[\(|\(\[|\[\[|\{\{|\[|\(|\{)\"?([^\"\])}]*)\"?(\)\)|\)\]|\]\)|\]\]|\}\}|\]|\)|\}))?(?::\d+)?", line):
                if m[1] != "space":
                    made.node(m[1], label=m[3], shape=next((s for s, (a, _) in SHAPES.items() if a == m[2]), None), parent_id=stack[-1] if stack else None)
    return made.record()


def to_mermaid_block(r: Record) -> str:
    children = _tree(r)

    def body(parent: str | None, pad: str) -> str:
        out = ""
        for n in children.get(parent, []):
            a, b = SHAPES.get(n.get("shape"), SHAPES["rectangle"])
            out += f"{pad}block:{n['id']}\n{body(n['id'], pad + '  ')}{pad}end\n" if n["id"] in children else f'{pad}{n["id"]}{a}"{_label(n)}"{b}\n' if n.get("label") else f"{pad}{n['id']}\n"
        return out

    ways = {DIRECTED: "-->", BIDIRECTIONAL: "<-->", UNDIRECTED: "---"}
    line = lambda e: f'-- "{e["label"]}" -->' if e.get("label") and effective(r, e) == DIRECTED else ways[effective(r, e)]
    return "block-beta\n" + body(None, "  ") + "".join(f"  {e['source_id']} {line(e)} {e['target_id']}\n" for e in r["edges"])


def _arguments(text: str) -> list[str]:
    return [a.strip().strip('"') for a in re.findall(r'"[^"]*"|[^,]+', text)]


def from_mermaid_c4(text: str) -> Record:
    made, stack = _Made(), []
    lines = iter(_lines(text, "C4Context", "C4Container", "C4Component", "C4Dynamic", "C4Deployment"))
    kind = next(lines).strip()
    for line in lines:
        line = line.strip()
        if line == "}":
            stack.pop()
        elif m := re.match(r"(\w+)\((.*)\)\s*(\{)?$", line):
            what, a = m[1], _arguments(m[2])
            if what.startswith(("Rel", "BiRel")):
                made.edge(a[0], a[1], label=a[2] if len(a) > 2 else None, mode=BIDIRECTIONAL if what.startswith("BiRel") else None, data={"technology": a[3]} if len(a) > 3 else None)
            elif not what.startswith(("Update", "Show", "Lay")):
                made.node(a[0], label=a[1] if len(a) > 1 else None, shape=what, parent_id=stack[-1] if stack else None, data={"description": a[2:]} if len(a) > 2 else None)
                if m[3]:
                    stack.append(a[0])
    return made.record(data={"kind": kind})


def to_mermaid_c4(r: Record) -> str:
    children = _tree(r)

    def body(parent: str | None, pad: str) -> str:
        out = ""
        for n in children.get(parent, []):
            more = n["data"].get("description", []) if isinstance(n.get("data"), dict) else []
            inner = n["id"] in children
            shape = n.get("shape") or ("Boundary" if inner else "System")
            out += f"{pad}{shape}({', '.join([n['id'], *(f'"{x}"' for x in (_label(n), *more))])})" + (f" {{\n{body(n['id'], pad + '  ')}{pad}}}\n" if inner else "\n")
        return out

    kind = r["data"].get("kind") if isinstance(r.get("data"), dict) else None
    return f"{kind or 'C4Context'}\n{body(None, '  ')}" + "".join(f'  {"BiRel" if effective(r, e) == BIDIRECTIONAL else "Rel"}({e["source_id"]}, {e["target_id"]}, "{e.get("label") or ""}")\n' for e in r["edges"])


def from_mermaid_use_case(text: str) -> Record:
    made, stack = _Made(), []
    lines = iter(_lines(text, "usecaseDiagram", "useCaseDiagram", "usecase"))
    next(lines)
    for line in lines:
        line = line.strip()
        if line in ("}", "end"):
            stack.pop()
        elif m := re.match(r"(actor|usecase)\s+(\w+)(?:\s*[\[(]\"?([^\])\"]*)\"?[\])]|\s+as\s+\"?([^\"]+)\"?)?$", line):
            made.node(m[2], label=m[3] or m[4], shape=m[1], parent_id=stack[-1] if stack else None)
        elif m := re.match(r"(?:system|rectangle|subgraph)\s+(\w+)(?:\s*\[?\"?([^\]\"{]*)\"?\]?)?\s*\{?$", line):
            stack.append(made.node(m[1], label=(m[2] or "").strip() or None, shape="system"))
        elif m := re.match(r"(\w+)\s*(--|-->|\.\.>)\s*(\w+)(?:\s*:\s*(.*))?$", line):
            made.edge(m[1], m[3], label=m[4] or None, mode=UNDIRECTED if m[2] == "--" else None)
    return made.record()


def to_mermaid_use_case(r: Record) -> str:
    children = _tree(r)

    def body(parent: str | None, pad: str) -> str:
        out = ""
        for n in children.get(parent, []):
            title = f'["{n["label"]}"]' if n.get("label") else ""
            out += f"{pad}system {n['id']} {title} {{\n{body(n['id'], pad + '  ')}{pad}}}\n" if n["id"] in children else f"{pad}{'actor' if n.get('shape') == 'actor' else 'usecase'} {n['id']}{title}\n"
        return out

    return "usecaseDiagram\n" + body(None, "  ") + "".join(f"  {e['source_id']} {'-->' if effective(r, e) == DIRECTED else '--'} {e['target_id']}{' : ' + e['label'] if e.get('label') else ''}\n" for e in r["edges"])


# commits


def from_mermaid_gitgraph(text: str) -> Record:
    made = _Made()
    lines = iter(_lines(text, "gitGraph"))
    next(lines)
    branch, tips = "main", {"main": None}
    for line in lines:
        line = line.strip()
        named = dict(re.findall(r'(id|tag|type):\s*"?([^"\s]+)"?', line))
        if line.startswith("branch"):
            name = line.split()[1]
            tips[name], branch = tips.get(branch), name
        elif line.startswith(("checkout", "switch")):
            branch = line.split()[1]
            if branch not in tips:
                raise GraphError(f"branch {branch} does not exist")
        elif line.startswith(("commit", "merge", "cherry-pick")):
            i = named.get("id") if not line.startswith("cherry-pick") else None
            i = made.node(i or f"c{len(made.nodes)}", label=named.get("tag"), data={"branch": branch})
            if tips[branch]:
                made.edge(tips[branch], i)
            if line.startswith("merge") and tips.get(line.split()[1]):
                made.edge(tips[line.split()[1]], i, label="merge")
            if line.startswith("cherry-pick"):
                made.edge(named["id"], i, label="cherry-pick")
            tips[branch] = i
    return made.record()


def to_mermaid_gitgraph(r: Record) -> str:
    before: dict[str, list[dict]] = {}
    for e in r["edges"]:
        before.setdefault(e["target_id"], []).append(e)
    at = {n["id"]: (n["data"].get("branch") if isinstance(n.get("data"), dict) else None) or "main" for n in r["nodes"]}
    out, branch, made = ["gitGraph"], "main", {"main"}
    for n in r["nodes"]:
        own = at[n["id"]]
        if own != branch:
            if own not in made:
                origin = next((at[e["source_id"]] for e in before.get(n["id"], []) if e.get("label") != "merge"), "main")
                if origin != branch:
                    out.append(f"  checkout {origin}")
                out.append(f"  branch {own}")
                made.add(own)
            else:
                out.append(f"  checkout {own}")
            branch = own
        merge = next((e for e in before.get(n["id"], []) if e.get("label") == "merge"), None)
        tag = f' tag: "{n["label"]}"' if n.get("label") else ""
        out.append(f'  merge {at[merge["source_id"]]} id: "{n["id"]}"{tag}' if merge else f'  commit id: "{n["id"]}"{tag}')
    return "\n".join(out) + "\n"
