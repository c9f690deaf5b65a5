"""Mermaid sequence diagrams: participants, messages, activations, notes, boxes and control blocks.

Messages and activations are edges in their order (an activation is a loop at its participant). What orders or comments
them is no topology: notes, creations and boxes are kept with the participants, blocks and the whole order of statements
in the record's data, from which the writer puts everything back in its place.
"""

from __future__ import annotations

import re
from itertools import count

from ..model import BIDIRECTIONAL, GraphError
from .json_documents import Record, edge, effective, node, record

# fixed values: the kinds of participants, the signs of messages, and the words of blocks with those of their parts
ACTORS = "participant|actor|boundary|control|entity|database|collections|queue"
HEADS = {
    ">>": "filled", ">": "open", "x": "cross", ")": "async", "|\\": "half-top", "|/": "half-bottom", "\\\\": "stick-half-top", "//": "stick-half-bottom",
}
TAILS = {"/|": "half-reverse-top", "\\|": "half-reverse-bottom", "//": "stick-half-reverse-top", "\\\\": "stick-half-reverse-bottom"}
PARTS = {"loop": None, "opt": None, "break": None, "rect": None, "alt": "else", "par": "and", "critical": "option"}

_ARROW = r"<<--?>>|--?(?:>>|>|x|\)|\|\\|\|/|\\\\|//)|(?:/\||\\\||//|\\\\)--?"
MESSAGE = re.compile(rf"(\S+?)\s*({_ARROW})(\(\))?\s*(\S+?)\s*:\s*(.*)$")
DECLARED = re.compile(rf"(create\s+)?({ACTORS})\s+([^\s@]+)(?:@\{{(.+?)\}})?(?:\s+as\s+(.+))?$")
NOTE = re.compile(r"note\s+(left of|right of|over)\s+([^:]+):\s*(.*)$", re.I)
BOX = re.compile(r"box\b\s*(rgba?\([^)]*\)|#[0-9a-fA-F]+|[a-zA-Z]+)?\s*(.*)$")
BLOCK = re.compile(rf"({'|'.join(PARTS)})\s+(.+)$")
NUMBERED = re.compile(r"autonumber(?:\s+([\d.]+)(?:\s+([\d.]+))?)?$")


def _arrow(sign: str) -> dict:
    """What a message's sign says: how its line is drawn, what its end looks like, and whether it has two ends."""
    stroke = {"stroke": "dotted" if "--" in sign else "solid"}
    if sign.startswith("<<"):
        return stroke | {"arrowType": "filled", "bidirectional": True}
    bare = sign.replace("-", "")
    return stroke | {"arrowType": HEADS[bare] if sign.startswith("-") else TAILS[bare]}


def _sign(data: dict, both: bool) -> str:
    line, kind = "--" if data.get("stroke") == "dotted" else "-", data.get("arrowType", "filled")
    if both:
        return f"<<{line}>>"
    heads, tails = ({v: k for k, v in x.items()} for x in (HEADS, TAILS))
    return line + heads[kind] if kind in heads else tails[kind] + line


class _Script:
    """The statements read so far, as nodes, edges and the order of everything."""

    def __init__(self) -> None:
        self.nodes: dict[str, dict] = {}
        self.edges: list[dict] = []
        self.order: list[list] = []
        self.blocks: list[dict] = []
        self.open: list[dict] = []
        self.box: dict | None = None
        self.unknown: list[str] = []
        self.notes, self.number, self.step = count(), None, 1.0

    def actor(self, i: str, kind: str | None = None) -> dict:
        own = self.nodes.setdefault(i, node(i, label=i, data={"actorType": "participant"}))
        if kind:
            own["data"]["actorType"] = kind
        return own

    def edge(self, s: str, t: str, label: str, data: dict, mode: str | None = None) -> None:
        if self.number is not None and "stroke" in data:
            data["sequenceNumber"] = self.number
            self.number += self.step
        own = edge(f"{s}-{t}-{len(self.edges)}", s, t, label=label, mode=mode, data=data)
        self.edges.append(own)
        self.order.append(["edge", own["id"]])
        for block in self.open:
            block["branches"][-1]["edgeIds"].append(own["id"])

    def activate(self, i: str, on: bool) -> None:
        self.actor(i)
        self.edge(i, i, "", {"kind": "activation" if on else "deactivation"})

    def message(self, m: re.Match) -> None:
        (s, sign, center, t, text), marks = m.groups(), {}
        turns = []
        if t[0] in "+-" and len(t) > 1:
            turns.append((t := t[1:], m[4][0] == "+"))
        if s[-1] in "+-" and len(s) > 1:
            turns.append((s[:-1], s[-1] == "+"))
            s = s[:-1]
        if s.endswith("()"):
            s, marks = s[:-2], {"centralSource": True}
        self.actor(s), self.actor(t)
        arrow = _arrow(sign)
        self.edge(s, t, text.strip(), {"kind": "message", **arrow, **marks, **({"centralTarget": True} if center else {})}, BIDIRECTIONAL if arrow.get("bidirectional") else None)
        for i, on in turns:
            self.activate(i, on)

    def declare(self, m: re.Match) -> None:
        created, kind, i, fields, alias = m.groups()
        own = self.actor(i, kind)
        if alias:
            own["label"] = own["data"]["alias"] = alias.strip()
        if fields:
            own["data"]["configuration"] = {k.strip().strip("\"'"): v.strip().strip("\"'") for k, _, v in (x.partition(":") for x in fields.split(","))}
        if self.box is not None:
            own["data"]["box"] = dict(self.box)
        if created:
            own["data"]["created"] = True
            self.order.append(["create", i])

    def note(self, m: re.Match) -> None:
        where, over, text = m[1].lower().removesuffix(" of"), [x.strip() for x in m[2].split(",")], m[3].strip()
        made = {"id": f"note_{next(self.notes)}", "position": where, "text": text} | ({"over": over} if len(over) > 1 else {})
        for i in over:
            self.actor(i)["data"].setdefault("notes", []).append(made)
        self.order.append(["note", over[0], made["id"]])

    def begin(self, kind: str, label: str) -> None:
        self.open.append({"type": kind, "label": label, "branches": [{"label": label, "edgeIds": []}]})
        self.order.append(["open", kind, label])

    def part(self, label: str) -> None:
        self.open[-1]["branches"].append({"label": label, "edgeIds": []})
        self.order.append(["part", PARTS[self.open[-1]["type"]], label])

    def end(self) -> None:
        if self.open:
            block = self.open.pop()
            if PARTS[block["type"]] is None:
                block["edgeIds"] = block.pop("branches")[0]["edgeIds"]
            self.blocks.append(block)
            self.order.append(["close"])
        elif self.box is not None:
            self.box = None
        else:
            raise GraphError("sequence: an end closes nothing")


def from_mermaid_sequence(text: str) -> Record:
    """The graph of a sequence diagram; statements of no known form are kept in data.unknown and written back."""
    from .mermaid import _lines

    lines = _lines(text, "sequenceDiagram")
    next(lines)
    own = _Script()
    numbered = None
    for line in map(str.strip, lines):
        word = line.split()[0]
        inner = PARTS[own.open[-1]["type"]] if own.open else None
        if m := NUMBERED.match(line):
            numbered = {"autonumber": True, **{k: float(v) for k, v in (("autonumberStart", m[1]), ("autonumberIncrement", m[2])) if v}}
            own.number, own.step = float(m[1] or 1), float(m[2] or 1)
        elif line == "end":
            own.end()
        elif inner and word == inner:
            own.part(line[len(word) :].strip())
        elif m := DECLARED.match(line):
            own.declare(m)
        elif m := re.match(r"destroy\s+(\S+)$", line):
            own.actor(m[1])["data"]["destroyed"] = True
            own.order.append(["destroy", m[1]])
        elif m := re.match(r"(activate|deactivate)\s+(\S+)$", line):
            own.activate(m[2], m[1] == "activate")
        elif m := NOTE.match(line):
            own.note(m)
        elif m := MESSAGE.match(line):
            own.message(m)
        elif m := BLOCK.match(line):
            own.begin(m[1], m[2].strip())
        elif word == "box" and (m := BOX.match(line)):
            own.box = {k: v for k, v in (("color", m[1]), ("title", m[2].strip())) if v}
        else:
            own.unknown.append(line)
            own.order.append(["text", line])
    if own.open:
        raise GraphError(f"sequence: a block {own.open[-1]['type']!r} is not closed")
    data = {"diagramType": "sequence", **(numbered or {}), **({"blocks": own.blocks} if own.blocks else {}), **({"unknown": own.unknown} if own.unknown else {})}
    return record("directed", list(own.nodes.values()), own.edges, data=data | ({"order": own.order} if own.order else {}))


def _declared(n: dict, word: str = "") -> str:
    data = n.get("data") if isinstance(n.get("data"), dict) else {}
    kind = data.get("actorType") or (n["shape"] if n.get("shape") in ACTORS.split("|") else "participant")
    fields = "@{ " + ", ".join(f'"{k}": "{v}"' for k, v in data["configuration"].items()) + " }" if data.get("configuration") else ""
    return f"{word}{kind} {n['id']}{fields}" + (f" as {n['label']}" if n.get("label") and n["label"] != n["id"] else "")


def to_mermaid_sequence(r: Record) -> str:
    """The diagram; edges, notes and blocks that were read stand where they stood, new edges at the end."""
    data = r.get("data") if isinstance(r.get("data"), dict) else {}
    nodes, edges = {n["id"]: n for n in r["nodes"]}, {e["id"]: e for e in r["edges"]}
    of = lambda x: x.get("data") if isinstance(x.get("data"), dict) else {}
    notes = {m["id"]: (m, n["id"]) for n in r["nodes"] for m in of(n).get("notes", [])}
    order = [x for x in data.get("order", []) if x[0] != "edge" or x[1] in edges]
    placed = {x[1] for x in order if x[0] == "edge"}
    order += [["edge", i] for i in edges if i not in placed]
    created = {x[1] for x in order if x[0] == "create"}
    out, depth, box = ["sequenceDiagram"], 1, None
    put = lambda line: out.append("  " * depth + line)
    if data.get("autonumber"):
        put(" ".join(["autonumber", *(f"{data[k]:g}" for k in ("autonumberStart", "autonumberIncrement") if k in data)]))
    for n in r["nodes"]:
        if n["id"] in created:
            continue
        if of(n).get("box") != box:
            if box is not None:
                put("end")
            box = of(n).get("box")
            if box is not None:
                put(" ".join(["box", *(box[k] for k in ("color", "title") if box.get(k))]))
        put(_declared(n))
    if box is not None:
        put("end")
    for what, *rest in order:
        if what == "edge":
            e = edges[rest[0]]
            kind = of(e).get("kind")
            if kind in ("activation", "deactivation"):
                put(f"{'activate' if kind == 'activation' else 'deactivate'} {e['source_id']}")
            else:
                sign = _sign(of(e), effective(r, e) == BIDIRECTIONAL)
                put(f"{e['source_id']}{'()' * bool(of(e).get('centralSource'))}{sign}{'()' * bool(of(e).get('centralTarget'))}{e['target_id']}: {e.get('label') or ''}")
        elif what == "note" and rest[1] in notes:
            m, first = notes[rest[1]]
            put(f"Note {m['position']}{'' if m['position'] == 'over' else ' of'} {','.join(m.get('over', [first]))}: {m['text']}")
        elif what == "open":
            put(" ".join(rest))
            depth += 1
        elif what in ("part", "close"):
            depth -= 1
            put("end" if what == "close" else " ".join(rest).strip())
            depth += what == "part"
        elif what == "create" and rest[0] in nodes:
            put(_declared(nodes[rest[0]], "create "))
        elif what == "destroy" and rest[0] in nodes:
            put(f"destroy {rest[0]}")
        elif what == "text":
            put(rest[0])
    return "\n".join(out) + "\n"
