"""All document formats by name, and documents in bulk as Spark tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DIRECTED, EDGE_KINDS, NODE_KINDS, Graph, GraphError, _row, create_edge, create_graph, create_node
from . import json_documents as J
from . import mermaid as M
from . import text_documents as T
from . import xml_documents as X
from .json_documents import Record
from .mermaid_sequence import from_mermaid_sequence, to_mermaid_sequence

#: name: (reader, writer)
FORMATS: dict[str, tuple[Callable[[str], Record], Callable[[Record], str]]] = {
    "tgf": (T.from_tgf, T.to_tgf), "pajek": (T.from_pajek, T.to_pajek), "gml": (T.from_gml, T.to_gml), "dot": (T.from_dot, T.to_dot), "d2": (T.from_d2, T.to_d2), "plantuml": (T.from_plantuml, T.to_plantuml),
    "networkx": (J.from_networkx, J.to_networkx), "graphology": (J.from_graphology, J.to_graphology), "graphlib": (J.from_graphlib, J.to_graphlib), "cytoscape": (J.from_cytoscape, J.to_cytoscape), "d3": (J.from_d3, J.to_d3),
    "jgf": (J.from_jgf, J.to_jgf), "xyflow": (J.from_xyflow, J.to_xyflow), "elk": (J.from_elk, J.to_elk), "cx2": (J.from_cx2, J.to_cx2), "graphson": (J.from_graphson, J.to_graphson), "graphviz-json": (J.from_graphviz_json, J.to_graphviz_json),
    "graphml": (X.from_graphml, X.to_graphml), "gexf": (X.from_gexf, X.to_gexf), "dgml": (X.from_dgml, X.to_dgml), "drawio": (X.from_drawio, X.to_drawio),
    "mermaid/flowchart": (M.from_mermaid_flowchart, M.to_mermaid_flowchart), "mermaid/state": (M.from_mermaid_state, M.to_mermaid_state), "mermaid/sequence": (from_mermaid_sequence, to_mermaid_sequence),
    "mermaid/class": (M.from_mermaid_class, M.to_mermaid_class), "mermaid/er": (M.from_mermaid_er, M.to_mermaid_er), "mermaid/requirement": (M.from_mermaid_requirement, M.to_mermaid_requirement),
    "mermaid/mindmap": (M.from_mermaid_mindmap, M.to_mermaid_mindmap), "mermaid/ishikawa": (M.from_mermaid_ishikawa, M.to_mermaid_ishikawa), "mermaid/sankey": (M.from_mermaid_sankey, M.to_mermaid_sankey),
    "mermaid/architecture": (M.from_mermaid_architecture, M.to_mermaid_architecture), "mermaid/block": (M.from_mermaid_block, M.to_mermaid_block), "mermaid/c4": (M.from_mermaid_c4, M.to_mermaid_c4),
    "mermaid/usecase": (M.from_mermaid_use_case, M.to_mermaid_use_case), "mermaid/gitgraph": (M.from_mermaid_gitgraph, M.to_mermaid_gitgraph),
}


def _format(name: str) -> tuple[Callable[[str], Record], Callable[[Record], str]]:
    if name not in FORMATS:
        raise GraphError(f"unknown format {name!r}; known are {', '.join(sorted(FORMATS))}")
    return FORMATS[name]


def from_document(spark: SparkSession, text: str, name: str) -> Graph:
    """The graph of one document."""
    r = _format(name)[0](text)
    return create_graph(spark, r["nodes"], r["edges"], r["mode"], **{k: r[k] for k in ("id", "initial_node_id", "data", "direction") if r.get(k) is not None})


def to_record(graph: Graph) -> Record:
    """A graph that fits the driver as a record; data, ports and styles as plain values."""

    def plain(row) -> dict:
        d = {k: v for k, v in row.asDict(True).items() if v is not None and k != "ord"}
        for k in ("data",):
            if isinstance(d.get(k), str):
                try:
                    d[k] = json.loads(d[k])
                except json.JSONDecodeError:
                    pass
        if "style" in d:
            d["style"] = {k: json.loads(v) for k, v in d["style"].items()}
        for p in d.get("ports", []):
            for k in [k for k, v in p.items() if v is None]:
                del p[k]
        return d

    rows = lambda df: [plain(r) for r in df.orderBy("ord").collect()]
    return J.record(graph.mode, rows(graph.nodes), rows(graph.edges), id=graph.id or None, initial_node_id=graph.initial_node_id, data=graph.data, direction=graph.direction)


def to_document(graph: Graph, name: str) -> str:
    """One document of a graph that fits the driver."""
    return _format(name)[1](to_record(graph))


def convert(text: str, source: str, target: str) -> str:
    """A document of one format as one of another."""
    return _format(target)[1](_format(source)[0](text))


def read_documents(documents: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and graphs of many documents (graph_id, text), parsed where they lie.

    Nodes and edges carry graph_id; graphs have graph_id, mode, initial_node_id and error, which is null where the
    document could be read.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    _format(name)
    shape = f"nodes array<struct<{','.join(f'{k}:{v}' for k, v in NODE_KINDS.items())}>>, edges array<struct<{','.join(f'{k}:{v}' for k, v in EDGE_KINDS.items())}>>"
    schema = f"graph_id string, mode string, initial_node_id string, error string, {shape}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda rows, kinds, make: [dict(zip(kinds, _styled(_row(make(**x), kinds, i), kinds), strict=True)) for i, x in enumerate(rows)]
        for batch in batches:
            for graph, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    r = FORMATS[name][0](text or "")
                    row = [graph, r["mode"], r.get("initial_node_id"), None, named(r["nodes"], NODE_KINDS, create_node), named(r["edges"], EDGE_KINDS, create_edge)]
                except (GraphError, ValueError, KeyError, IndexError, TypeError, AttributeError) as e:  # the document's fault, kept with it
                    row = [graph, None, None, f"{type(e).__name__}: {e}", [], []]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, arrow.types, strict=True)], schema=arrow)

    parsed = documents.select(F.col("graph_id").cast("string"), "text").mapInArrow(parse, schema)
    spread = lambda c: parsed.select("graph_id", F.explode(c).alias("x")).select("graph_id", "x.*")
    return spread("nodes"), spread("edges"), parsed.select("graph_id", F.coalesce("mode", F.lit(DIRECTED)).alias("mode"), "initial_node_id", "error")


def _styled(row: tuple, kinds: dict[str, str]) -> tuple:
    """Tuples of nested values as the dicts that Arrow wants."""
    ports = ("name", "direction", "label", "data", "x", "y", "width", "height", "style")
    out = []
    for k, v in zip(kinds, row, strict=True):
        if k == "ports" and v is not None:
            v = [dict(zip(ports, p, strict=True)) for p in v]
        elif k == "points" and v is not None:
            v = [{"x": x, "y": y} for x, y in v]
        elif k == "style" and v is not None:
            v = list(v.items())
        out.append(v)
    return tuple(out)


