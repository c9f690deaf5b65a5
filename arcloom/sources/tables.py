"""Table-like formats: edge and adjacency lists, matrices, Matrix Market, CSV and TSV, RDF quads. Joins and aggregates only."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import DIRECTED, EDGE_KINDS, NODE_KINDS, UNDIRECTED, Graph, GraphError, complete, graph_from_tables
from ..plans.numbering import numbered


def to_edge_list(graph: Graph) -> DataFrame:
    """ord, source, target of every edge."""
    return graph.edges.select("ord", F.col("source_id").alias("source"), F.col("target_id").alias("target"))


def from_edge_list(pairs: DataFrame, mode: str = DIRECTED) -> Graph:
    """Edges e<ord> from (ord, source, target); nodes in the order in which the list names them."""
    edges = pairs.select(F.concat(F.lit("e"), F.col("ord").cast("string")).alias("id"), "ord", F.col("source").alias("source_id"), F.col("target").alias("target_id"))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("source").alias("id"), (2 * F.col("ord")).alias("at")), F.struct(F.col("target").alias("id"), (2 * F.col("ord") + 1).alias("at")))).alias("n"))
    nodes = ends.groupBy(F.col("n.id").alias("id")).agg(F.min("n.at").alias("ord"))
    return graph_from_tables(nodes, edges, mode)


def to_adjacency_list(graph: Graph) -> DataFrame:
    """ord, id, targets of every node; non-directed edges are listed at both ends."""
    edges = graph.edges.withColumn("mode", graph.edge_mode())
    ways = edges.select("ord", F.col("source_id").alias("id"), F.col("target_id").alias("t")).unionByName(edges.filter("mode <> 'directed' AND source_id <> target_id").select("ord", F.col("target_id").alias("id"), F.col("source_id").alias("t")))
    lists = ways.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]).alias("targets"))
    return graph.nodes.select("ord", "id").join(lists, "id", "left").select("ord", "id", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))


def from_adjacency_list(lists: DataFrame, mode: str = DIRECTED, parallel: str = "collapse") -> Graph:
    """Edges e0 ... from (ord, id, targets). An undirected pair counts once; with ``parallel="preserve"``, as often as
    the end that lists it more often does."""
    each = lists.select("ord", F.col("id").alias("s"), F.posexplode("targets").alias("at", "t"))
    nth = F.row_number().over(Window.partitionBy("s", "t").orderBy("ord", "at"))
    each = each.withColumn("nth", nth)
    if mode != DIRECTED:
        each = each.withColumns({"a": F.least("s", "t"), "b": F.greatest("s", "t")})
        if parallel != "preserve":
            each = each.withColumn("nth", F.lit(1))
        each = each.groupBy("a", "b", "nth").agg(F.min(F.struct("ord", "at", "s", "t")).alias("e")).select("e.*")
    elif parallel != "preserve":
        each = each.filter("nth = 1")
    edges = numbered(each, "ord", "at").select("n", "s", "t")
    edges = edges.select(F.concat(F.lit("e"), "n").alias("id"), F.col("n").alias("ord"), F.col("s").alias("source_id"), F.col("t").alias("target_id"))
    last = lists.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0] + 1
    more = edges.groupBy(F.col("target_id").alias("id")).agg((F.min("ord") + last).alias("ord")).join(lists.select("id"), "id", "left_anti")
    return graph_from_tables(lists.select("id", "ord").unionByName(more.select("id", "ord")), edges, mode)


def to_adjacency_matrix(graph: Graph, aggregation: str = "reject", max_cells: int = 1_000_000) -> DataFrame:
    """i, row (array of weights, 0 for none) and present (array of whether there is an edge), in node order."""
    n = graph.distinct_nodes.count()
    if n * n > max_cells:
        raise GraphError(f"a matrix of {n} x {n} has more than {max_cells} cells")
    kinds = graph.edges.select(graph.is_directed().alias("d")).distinct().count()
    if kinds > 1:
        raise GraphError("a matrix takes edges of one mode")
    place = graph.distinct_nodes.select("id", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ord")) - 1).alias("p"))  # max_cells bounds it
    cells = graph.arcs("once").join(place.select(F.col("id").alias("src"), F.col("p").alias("i")), "src").join(place.select(F.col("id").alias("dst"), F.col("p").alias("j")), "dst")
    how = {"sum": F.sum("w"), "min": F.min("w"), "max": F.max("w"), "count": F.count("*").cast("double"), "reject": F.when(F.count("*") > 1, F.raise_error(F.lit("parallel edges: choose an aggregation")).cast("double")).otherwise(F.first("w"))}
    cells = cells.groupBy("i", "j").agg(how[aggregation].alias("w"))
    rows = cells.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "w"))).alias("m"))
    every = place.select(F.col("p").alias("i"), "id").join(rows, "i", "left")
    at = F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")
    value = F.transform(at, lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0)))
    return every.select("i", "id", value.alias("row"), F.transform(at, lambda j: F.coalesce(F.map_contains_key("m", j), F.lit(False))).alias("present"))


def from_adjacency_matrix(matrix: DataFrame, mode: str = DIRECTED) -> Graph:
    """The graph of (i, id, row[, present]); a 0 is an edge only where ``present`` says so. Undirected: the upper half."""
    has = "present" in matrix.columns
    cells = matrix.select("i", F.posexplode("row").alias("j", "w"), *(["present"] if has else []))
    cells = cells.filter(F.get("present", F.col("j")) if has else F.col("w") != 0)
    if mode != DIRECTED:
        cells = cells.filter("i <= j")
    ids = matrix.select(F.col("i").alias("p"), "id")
    named = cells.join(ids.select(F.col("p").alias("i"), F.col("id").alias("source_id")), "i").join(ids.select(F.col("p").alias("j"), F.col("id").alias("target_id")), "j")
    edges = numbered(named, "i", "j", name="ord").select("ord", "source_id", "target_id", F.col("w").alias("weight")).withColumn("id", F.concat(F.lit("e"), "ord"))
    return graph_from_tables(ids.select("id", F.col("p").alias("ord")), edges, mode)


def to_matrix_market(graph: Graph) -> DataFrame:
    """The lines (at, value) of a coordinate file of real numbers."""
    place = numbered(graph.distinct_nodes, "ord", "id", name="p", start=1).select("id", "p")
    symmetric = graph.mode != DIRECTED and graph.edges.filter(graph.is_directed()).isEmpty()
    e = graph.valid_edges().join(place.select(F.col("id").alias("source_id"), F.col("p").alias("i")), "source_id").join(place.select(F.col("id").alias("target_id"), F.col("p").alias("j")), "target_id")
    i, j = (F.greatest("i", "j"), F.least("i", "j")) if symmetric else (F.col("i"), F.col("j"))
    lines = e.select((F.col("ord") + 2).alias("at"), F.concat_ws(" ", i, j, F.coalesce("weight", F.lit(1.0))).alias("value"))
    n, m = place.count(), lines.count()
    head = [(0, f"%%MatrixMarket matrix coordinate real {'symmetric' if symmetric else 'general'}"), (1, f"{n} {n} {m}")]
    return graph.spark.createDataFrame(head, "at long, value string").unionByName(lines)


def from_matrix_market(lines: DataFrame) -> Graph:
    """A graph on nodes 1 .. n from the lines (at, value) of a file; a coordinate entry of 0 is an edge too."""
    head = lines.orderBy("at").first()["value"].lower().split()
    if head[:2] != ["%%matrixmarket", "matrix"]:
        raise GraphError("not a Matrix Market file")
    layout, field, symmetry = head[2:5]
    body = lines.filter(~F.col("value").startswith("%") & (F.trim("value") != "")).select("at", F.split(F.trim("value"), r"\s+").alias("v"))
    first = body.orderBy("at").first()
    n, rows = int(first["v"][0]), body.filter(F.col("at") > first["at"])
    if layout == "coordinate":
        cells = rows.select("at", F.col("v")[0].alias("s"), F.col("v")[1].alias("t"), (F.lit(1.0) if field == "pattern" else F.get("v", F.lit(2)).cast("double")).alias("w"))
    else:
        k = numbered(rows, "at").select(F.col("n").alias("at"), F.col("v")[0].cast("double").alias("w"))
        if symmetry == "symmetric":  # columns of the lower half: column c starts after n + (n - 1) + ... entries
            starts = [c * n - c * (c - 1) // 2 for c in range(n)]
            column = F.size(F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s <= F.col("at"))) - 1
            k = k.withColumn("c", column).withColumn("r", F.col("at") - F.element_at(F.array(*[F.lit(s) for s in starts]), F.col("c") + 1) + F.col("c"))
        else:
            k = k.withColumns({"c": F.floor(F.col("at") / n), "r": F.col("at") % n})
        cells = k.filter("w <> 0").select("at", (F.col("r") + 1).cast("string").alias("s"), (F.col("c") + 1).cast("string").alias("t"), "w")
    ids = lines.sparkSession.range(1, n + 1).select(F.col("id").cast("string").alias("id"), F.col("id").alias("ord"))
    edges = numbered(cells, "at").select(F.concat(F.lit("e"), "n").alias("id"), F.col("at").alias("ord"), F.col("s").alias("source_id"), F.col("t").alias("target_id"), F.col("w").alias("weight"))
    return graph_from_tables(ids, edges, UNDIRECTED if symmetry == "symmetric" else DIRECTED)


_NESTED = ("ports", "points", "style")


def _flat(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.select(*[F.to_json(c).alias(c) if c in _NESTED else F.col(c) for c in kinds])


def write_csv(graph: Graph, path: str, separator: str = ",") -> None:
    """Two folders, nodes and edges, of CSV files with a header; nested columns are JSON text, quotes are doubled."""
    for name, df, kinds in (("nodes", graph.nodes, NODE_KINDS), ("edges", graph.edges, EDGE_KINDS)):
        _flat(df, kinds).write.option("header", True).option("sep", separator).option("escape", '"').option("quoteAll", True).option("nullValue", "\\N").csv(f"{path}/{name}")


def read_csv(spark: SparkSession, path: str, separator: str = ",", mode: str = DIRECTED) -> Graph:
    """A graph from the folders (or files) nodes and edges under ``path``; columns that are absent are null."""

    def read(name: str, kinds: dict[str, str]) -> DataFrame:
        raw = spark.read.option("header", True).option("sep", separator).option("escape", '"').option("multiLine", True).option("nullValue", "\\N").csv(f"{path}/{name}")
        cast = [F.from_json(c, kinds[c]).alias(c) if c in _NESTED else F.col(c).cast(kinds[c]).alias(c) for c in raw.columns if c in kinds]
        return complete(raw.select(*cast), kinds)

    return Graph(read("nodes", NODE_KINDS), read("edges", EDGE_KINDS), mode)


def to_csv(graph: Graph, delimiter: str = ",") -> dict[str, str]:
    """Nodes and edges as two texts; for graphs that fit the driver."""

    def text(df: DataFrame, kinds: dict[str, str]) -> str:
        out = io.StringIO()
        w = csv.writer(out, delimiter=delimiter, lineterminator="\n")
        w.writerow(kinds)
        for row in _flat(df, kinds).orderBy("ord").toLocalIterator():
            w.writerow(["" if v is None else v for v in row])
        return out.getvalue()

    return {"nodes": text(graph.nodes, NODE_KINDS), "edges": text(graph.edges, EDGE_KINDS)}


def from_csv(spark: SparkSession, nodes: str, edges: str, mode: str = DIRECTED, delimiter: str = ",") -> Graph:
    """A graph from two texts with headers; all rows must be as wide as the header, a lone carriage return is an error."""

    def rows(text: str, kinds: dict[str, str]) -> DataFrame:
        if "\r" in text.replace("\r\n", ""):
            raise GraphError("a lone carriage return ends no row")
        table = list(csv.reader(io.StringIO(text), delimiter=delimiter, strict=True))
        if not table or not table[0]:
            raise GraphError("a header is needed")
        if any(len(r) != len(table[0]) for r in table):
            raise GraphError("rows differ in width")
        raw = spark.createDataFrame([(i, *[v or None for v in r]) for i, r in enumerate(table[1:])], ", ".join(["_at long", *[f"`{c}` string" for c in table[0]]]))
        cast = [F.from_json(c, kinds[c]).alias(c) if c in _NESTED else F.col(c).cast(kinds[c]).alias(c) for c in table[0] if c in kinds]
        return complete(raw.select(*cast, *([] if "ord" in table[0] else [F.col("_at").alias("ord")])), kinds)

    return Graph(rows(nodes, NODE_KINDS), rows(edges, EDGE_KINDS), mode)


def to_tsv(graph: Graph) -> dict[str, str]:
    return to_csv(graph, "\t")


def from_tsv(spark: SparkSession, nodes: str, edges: str, mode: str = DIRECTED) -> Graph:
    return from_csv(spark, nodes, edges, mode, "\t")


def from_rdf_dataset(quads: DataFrame) -> Graph:
    """Terms as nodes and statements as edges from (subject, predicate, object, graph); repeated statements are one."""
    one = quads.select("subject", "predicate", "object", F.coalesce("graph", F.lit("")).alias("graph")).distinct()
    data = F.to_json(F.struct("predicate", "graph"))
    edges = one.select(F.to_json(F.array("subject", "predicate", "object", "graph")).alias("id"), F.col("subject").alias("source_id"), F.col("object").alias("target_id"), F.col("predicate").alias("label"), data.alias("data"))
    return graph_from_tables(None, edges, DIRECTED)


def to_rdf_dataset(graph: Graph) -> DataFrame:
    own = F.from_json("data", "predicate string, graph string")
    return graph.edges.select(F.col("source_id").alias("subject"), F.coalesce(own["predicate"], "label").alias("predicate"), F.col("target_id").alias("object"), F.coalesce(own["graph"], F.lit("")).alias("graph")).distinct()


#: An N-Quads line: subject, predicate, object, an optional graph, a point.
QUAD = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$'


def from_rdf(lines: DataFrame) -> Graph:
    """A graph from N-Quads lines (value); comments and empty lines are left out."""
    part = lambda i: F.regexp_extract("value", QUAD, i)
    quads = lines.filter(F.col("value").rlike(QUAD)).select(part(1).alias("subject"), part(2).alias("predicate"), part(3).alias("object"), part(4).alias("graph"))
    return from_rdf_dataset(quads)


def to_rdf(graph: Graph) -> DataFrame:
    return to_rdf_dataset(graph).select(F.concat_ws(" ", "subject", "predicate", "object", F.nullif("graph", F.lit("")), F.lit(".")).alias("value"))


