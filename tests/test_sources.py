"""Formats: round trips, stated defaults, and documents in bulk."""

import json

import pytest
from pyspark.sql import functions as F

from arcloom.model import GraphError, create_graph
from arcloom.sources import tables
from arcloom.sources.json_documents import edge, node, record
from arcloom.sources.registry import FORMATS, convert, from_document, read_documents, to_document, to_record

PLAIN = record("directed", [node("a", label="A"), node("b", label="B", parent_id="p"), node("p", label="P"), node("c", label="C")], [edge("e0", "a", "b", label="x", weight=2.0), edge("e1", "b", "c"), edge("e2", "c", "a", mode="undirected")])
TREE = record("directed", [node("A", label="A"), node("B", label="B"), node("C", label="C")], [edge("e0", "A", "B"), edge("e1", "A", "C")])
LINE = record("directed", [node("a"), node("b"), node("c")], [edge("e0", "a", "b"), edge("e1", "b", "c")])
#: Formats that have no nodes of their own, or whose ids are places in the document.
OWN = {"mermaid/mindmap": TREE, "mermaid/ishikawa": TREE, "mermaid/sankey": LINE, "mermaid/gitgraph": LINE}


@pytest.mark.parametrize("name", [n for n in FORMATS if n not in ("pajek", "d2")])
def test_round_trip(name):
    read, write = FORMATS[name]
    source = OWN.get(name, PLAIN)
    back = read(write(source))
    assert [n["id"] for n in sorted(back["nodes"], key=lambda n: n["id"])] == sorted(n["id"] for n in source["nodes"])
    assert [(e["source_id"], e["target_id"]) for e in back["edges"]] == [(e["source_id"], e["target_id"]) for e in source["edges"]]


def test_rich_formats_keep_fields():
    for name in ("networkx", "graphlib", "cytoscape", "d3", "jgf", "cx2", "graphson", "graphml", "gexf", "gml", "graphology"):
        read, write = FORMATS[name]
        back = read(write(PLAIN))
        own = {n["id"]: n for n in back["nodes"]}
        assert own["b"]["parent_id"] == "p" and own["a"]["label"] == "A", name
        assert back["edges"][0]["weight"] == 2.0 and back["edges"][2].get("mode") == "undirected", name


def test_defaults():
    read = lambda name, text: FORMATS[name][0](text)
    assert read("gml", "graph [ node [ id 1 ] node [ id 2 ] edge [ source 1 target 2 ] ]")["mode"] == "undirected"
    g = read("dot", "strict digraph g { node [shape=box]; a -> b -> c; a -> b; subgraph cluster_x { d; label=L } d -> a [dir=none] }")
    assert len(g["edges"]) == 3 and {n["id"]: n.get("parent_id") for n in g["nodes"]}["d"] == "x" and g["nodes"][0]["shape"] == "box" and g["edges"][2]["mode"] == "undirected"
    g = read("graphml", '<graphml><key id="w" for="edge" attr.name="weight" attr.type="double"><default>3</default></key><graph edgedefault="undirected"><node id="a"/><node id="b"/><edge source="a" target="b"/><edge source="a" target="b" directed="true"><data key="w">1.5</data></edge></graph></graphml>')
    assert [(e["id"], e["weight"], e.get("mode")) for e in g["edges"]] == [("a-b-0", 3.0, None), ("a-b-1", 1.5, "directed")]
    assert read("gexf", '<gexf><graph><nodes><node id="a"/><node id="b" pid="a"/></nodes><edges><edge id="0" source="a" target="b" type="mutual"/></edges></graph></gexf>')["edges"][0]["mode"] == "bidirectional"
    g = read("pajek", '*Vertices 3\n1 "one" 0.1 0.2\n*Arcs\n1 2 3.5\n*Edges\n2 3\n')
    assert [(e["weight"] if "weight" in e else None, e.get("mode")) for e in g["edges"]] == [(3.5, None), (None, "undirected")] and len(g["nodes"]) == 3
    assert read("tgf", "a A b\nb\n#\na b go on")["edges"][0]["label"] == "go on"
    assert read("d3", json.dumps({"nodes": [{"id": "x"}, {"id": "y"}], "links": [{"source": 0, "target": "y"}]}))["edges"][0]["source_id"] == "x"
    assert read("d2", "a -> b: go\nc: {\n  d\n}\nc.d -- a")["edges"][1]["mode"] == "undirected"
    f = read("mermaid/flowchart", "flowchart LR\n  a[Start] --> b{Is it?}\n  b -->|yes| c & d\n  subgraph s [Sub]\n    c\n  end\n  c --- d")
    assert len(f["edges"]) == 4 and f["edges"][1]["label"] == "yes" and {n["id"]: n.get("parent_id") for n in f["nodes"]}["s"] is None and f["direction"] == "right"
    for name, bad in (("graphology", '{"nodes":[{"key":"a"}],"edges":[{"source":"a","target":"a"},{"source":"a","target":"a"}]}'), ("graphlib", '{"nodes":[{"v":"a","parent":"a"}]}'), ("jgf", '{"graph":{"hyperedges":[1]}}'), ("graphml", "<graphml><graph"), ("graphml", '<!DOCTYPE a [<!ENTITY x "y">]><graphml/>')):
        with pytest.raises(GraphError):
            read(name, bad)
    with pytest.raises(GraphError):
        convert("", "nothing", "dot")


SEQUENCE = """sequenceDiagram
  autonumber 10 5
  box Aqua Front end
  actor A as Ann
  participant B
  end
  A->>+B: hello
  Note over A,B: both, see
  loop every day
    B-->>A: again
    alt good
      A-)B: go
    else bad
      A--xB: stop
    end
  end
  B<<->>A: talk
  create participant C
  A->>C: born
  destroy C
  deactivate B
  links A: {"x": "y"}
"""


def test_sequences_keep_blocks_notes_and_activations():
    read, write = FORMATS["mermaid/sequence"]
    r = read(SEQUENCE)
    assert [(e["id"], e["label"], e.get("mode")) for e in r["edges"]][:3] == [("A-B-0", "hello", None), ("B-B-1", "", None), ("B-A-2", "again", None)]
    assert [e["data"]["kind"] for e in r["edges"]].count("activation") == 1 and r["edges"][5].get("mode") == "bidirectional"
    assert [e["data"].get("sequenceNumber") for e in r["edges"]][:3] == [10.0, None, 15.0]
    own = {n["id"]: n for n in r["nodes"]}
    assert own["A"]["label"] == "Ann" and own["A"]["data"]["actorType"] == "actor" and own["B"]["data"]["box"] == {"color": "Aqua", "title": "Front end"}
    assert own["A"]["data"]["notes"] == own["B"]["data"]["notes"] == [{"id": "note_0", "position": "over", "text": "both, see", "over": ["A", "B"]}]
    assert own["C"]["data"]["created"] and own["C"]["data"]["destroyed"]
    alt, loop = r["data"]["blocks"]
    assert [b["label"] for b in alt["branches"]] == ["good", "bad"] and [len(b["edgeIds"]) for b in alt["branches"]] == [1, 1] and len(loop["edgeIds"]) == 3
    assert r["data"]["unknown"] == ['links A: {"x": "y"}']
    again = read(write(r))
    assert again == r  # nothing is lost or moved
    for sign in ("->", "-->", "->>", "-->>", "-x", "--x", "-)", "--)", "<<->>", "<<-->>", "-|\\", "--|/", "/|-", "\\|--", "-//", "--\\\\", "//-"):
        one = read(f"sequenceDiagram\n  A{sign}B: x")
        assert len(one["edges"]) == 1 and f"A{sign}B: x" in write(one), sign
    for bad in ("sequenceDiagram\n  end", "sequenceDiagram\n  loop x\n  A->>B: y"):
        with pytest.raises(GraphError):
            read(bad)


def test_d2_connections_have_fields():
    read, write = FORMATS["d2"]
    r = read('''direction: right # a comment
a: Alpha {shape: circle; style.fill: "#ff0; x"}
a -> b: go {
  style.stroke: red
  source-arrowhead: 1 { shape: diamond }
}
c: {
  d -> _.a
  "e.f".tooltip: dotted
}
(a -> b)[0].style.opacity: 0.4
b <- a <-> c.d: twice
''')
    own = {n["id"]: n for n in r["nodes"]}
    assert r["data"] == {"direction": "right"} and own["a"]["label"] == "Alpha" and own["a"]["shape"] == "circle" and own["a"]["data"] == {"style.fill": "#ff0; x"}
    first = r["edges"][0]
    assert (first["source_id"], first["target_id"], first["label"]) == ("a", "b", "go")
    assert first["data"] == {"style.stroke": "red", "source-arrowhead": "1", "source-arrowhead.shape": "diamond", "style.opacity": "0.4"}
    assert [(e["source_id"], e["target_id"], e.get("mode")) for e in r["edges"][1:]] == [("c.d", "a", None), ("a", "b", None), ("a", "c.d", "bidirectional")]
    assert own["c.d"]["parent_id"] == "c" and own["c.e.f"]["data"] == {"tooltip": "dotted"}
    again = read(write(r))
    assert [(n["id"], n.get("shape"), n.get("data")) for n in again["nodes"] if n["id"] in ("a", "b")] == [(n["id"], n.get("shape"), n.get("data")) for n in r["nodes"] if n["id"] in ("a", "b")]
    assert [(e["source_id"], e["target_id"], e.get("data")) for e in again["edges"]] == [(e["source_id"], e["target_id"], e.get("data")) for e in r["edges"]]
    for bad in ("a: {", "}"):
        with pytest.raises(GraphError):
            read(bad)


def test_pajek_names_edges_and_keeps_attributes():
    read, write = FORMATS["pajek"]
    r = read('*Network "net"\n*Vertices 3\n1 "one" 0.1 0.2 ic Red\n2\n*Arcs\n1 2 3.5 l "first" c Blue\n1 2\n*Edges\n3 2\n')
    assert r["id"] == "net" and r["nodes"][0] == {"id": "1", "label": "one", "data": {"attributes": ["0.1", "0.2", "ic", "Red"]}}
    assert [e["id"] for e in r["edges"]] == ['pajek:edge:["[\\"directed\\",\\"1\\",\\"2\\"]",0]', 'pajek:edge:["[\\"directed\\",\\"1\\",\\"2\\"]",1]', 'pajek:edge:["[\\"undirected\\",\\"2\\",\\"3\\"]",0]']
    assert r["edges"][0]["label"] == "first" and r["edges"][0]["data"] == {"attributes": ["c", "Blue"]} and r["edges"][0]["weight"] == 3.5
    again = read(write(r))
    assert [e["id"] for e in again["edges"]] == [e["id"] for e in r["edges"]] and again["nodes"][0] == r["nodes"][0]
    for bad in ("*Vertices 1\n*Arcs\n1 2", "*Vertices 2\n1 \"a\" [1-2]", "*Matrix\n1", "*Vertices 2\n*Arcs\n1 2 1 l"):
        with pytest.raises(GraphError):
            read(bad)


def test_support_is_what_a_probe_shows():
    from arcloom.sources.support import FEATURES, format_support, get_format_support

    table = format_support()
    assert set(table) == set(FORMATS) and all(set(x) == set(FEATURES) and set(x.values()) <= {"full", "partial", "none"} for x in table.values())
    assert table["graphml"]["weight"] == table["jgf"]["hierarchy"] == table["gml"]["undirected"] == "full"
    assert table["tgf"]["weight"] == table["tgf"]["hierarchy"] == table["mermaid/sequence"]["undirected"] == "none"
    assert {k for k, x in table.items() if x["directed"] == "none"} == {"mermaid/er"}  # relations have no direction
    with pytest.raises(GraphError):
        get_format_support("nothing")


def test_documents_and_spark(spark):
    g = create_graph(spark, PLAIN["nodes"], PLAIN["edges"])
    back = from_document(spark, to_document(g, "graphml"), "graphml")
    assert to_record(back)["edges"][0]["weight"] == 2.0 and back.nodes.count() == 4
    docs = spark.createDataFrame([("one", FORMATS["dot"][1](PLAIN)), ("two", "graph { a -- b }"), ("bad", "graph {")], "graph_id string, text string")
    nodes, edges, graphs = read_documents(docs, "dot")
    assert {(r["graph_id"], r["n"]) for r in edges.groupBy("graph_id").agg(F.count("*").alias("n")).collect()} == {("one", 3), ("two", 1)}
    assert nodes.filter("graph_id = 'two'").count() == 2 and graphs.filter("error IS NOT NULL").first()["graph_id"] == "bad"


def test_tables(spark, tmp_path):
    g = create_graph(spark, PLAIN["nodes"], PLAIN["edges"])
    texts = tables.to_csv(g)
    back = tables.from_csv(spark, texts["nodes"], texts["edges"])
    assert back.edges.filter("id = 'e0'").first()["weight"] == 2.0 and back.nodes.filter("id = 'b'").first()["parent_id"] == "p"
    tables.write_csv(g, f"file://{tmp_path}/g")
    assert tables.read_csv(spark, f"file://{tmp_path}/g").edges.filter("id = 'e2'").first()["mode"] == "undirected"
    for bad in ("", "id\nx,y", 'id,label\r"a",b'):
        with pytest.raises((GraphError, Exception)):
            tables.from_csv(spark, bad, texts["edges"])
    lists = spark.createDataFrame([(0, "a", ["b", "b"]), (1, "b", ["a"])], "ord long, id string, targets array<string>")
    assert tables.from_adjacency_list(lists, "undirected").edges.count() == 1
    assert tables.from_adjacency_list(lists, "undirected", "preserve").edges.count() == 2 and tables.from_adjacency_list(lists).edges.count() == 2
    m = tables.from_matrix_market(spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate real symmetric"), (1, "% c"), (2, "3 3 2"), (3, "2 1 0"), (4, "3 3 1.5")], "at long, value string"))
    assert m.mode == "undirected" and [(r["source_id"], r["target_id"], r["weight"]) for r in m.edges.orderBy("ord").collect()] == [("2", "1", 0.0), ("3", "3", 1.5)]
    quads = spark.createDataFrame([("<a> <p> <b> .",), ("<a> <p> <b> .",), ('<a> <q> "x y"@en <g> .',), ("# no",)], "value string")
    rdf = tables.from_rdf(quads)
    assert rdf.edges.count() == 2 and sorted(r[0] for r in tables.to_rdf(rdf).collect()) == ['<a> <p> <b> .', '<a> <q> "x y"@en <g> .']


def test_streaming(spark, tmp_path):
    from arcloom.streaming.degrees import running_degrees, windowed_degrees

    rows = [("a", "b", "2024-01-01 00:00:01"), ("a", "c", "2024-01-01 00:00:30"), ("b", "c", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "source_id string, target_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("source_id string, target_id string, ts timestamp").parquet(f"{tmp_path}/in")
    for name, df in (("run", running_degrees(stream)), ("win", windowed_degrees(stream, "ts", "1 minute", "1 minute"))):
        q = df.writeStream.outputMode("complete" if name == "run" else "update").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    assert {r["id"]: r["degree"] for r in spark.table("run").collect()} == {"a": 2, "b": 2, "c": 2}
    assert {(r["id"], r["degree"]) for r in spark.table("win").collect() if r["start"].minute == 0} == {("a", 2), ("b", 1), ("c", 1)}


def test_queries_have_sql_for_their_columns():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())
