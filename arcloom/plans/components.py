"""Connected components by neighbor minimum and pointer jumping, or by joining sets where a graph fits one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import numbered
from .storage import drop_stored, stored

#: Vertices that one table of names and numbers is broadcast for.
BROADCAST_ROWS = 2_000_000
#: Links that a task thins at a time, with about 100 bytes for each.
THINNED_AT_ONCE = 1_000_000
#: Numbered vertices and thinned links that one task joins, with about 20 bytes for each.
NUMBERS_IN_ONE_TASK = 40_000_000
#: Vertices and links of a graph that one task joins, with about 100 bytes for each.
IN_ONE_TASK = 2_000_000


def joined_labels(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """The result of min_labels() from one task that keeps a tree of sets."""
    import pyarrow as pa

    kinds = dict(vertices.dtypes)
    schema = f"v {kinds['v']}, root {kinds['v']}, root_rank {kinds['rank']}"

    def join(batches):
        first: dict = {}
        pairs: list[tuple] = []
        for batch in batches:
            v, rank, other = (c.to_pylist() for c in batch.columns)
            for a, r, b in zip(v, rank, other, strict=True):
                if b is None:
                    first[a] = ((r is not None, r) if r is not None else (False, 0), a, r)
                else:
                    pairs.append((a, b))
        above = {v: v for v in first}

        def top(v):
            while above[v] != v:
                above[v] = v = above[above[v]]
            return v

        for a, b in pairs:
            if a in above and b in above:
                x, y = top(a), top(b)
                if x != y:
                    low, high = (x, y) if first[x] < first[y] else (y, x)
                    above[high] = low
        names = list(above)
        for at in range(0, len(names), 100_000):
            part = names[at : at + 100_000]
            roots = [top(v) for v in part]
            yield pa.RecordBatch.from_pydict({"v": part, "root": roots, "root_rank": [first[r][2] for r in roots]}, schema=made)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    made = to_arrow_schema(_parse_datatype_string(schema))
    alone = vertices.select("v", "rank", F.lit(None).cast(kinds["v"]).alias("other"))
    both = alone.unionByName(links.select(F.col("a").alias("v"), F.lit(None).cast(kinds["rank"]).alias("rank"), F.col("b").alias("other")))
    return both.repartition(1).mapInArrow(join, schema)


def _hooked(n: int, a, b):
    """For the vertices 0 to n - 1 the least one of each component, by arrays; a and b are the links' ends."""
    import numpy as np

    root = np.arange(n, dtype=a.dtype)
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while not np.array_equal(further := root[root], root):
            root = further
        a, b = root[low], root[high]
        apart = a != b
        a, b = a[apart], b[apart]
    return root


def _pairs(batches, at_least: int):
    """Two arrays at a time from batches of two columns."""
    import numpy as np

    kept, rows = [], 0
    for batch in batches:
        kept.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        rows += batch.num_rows
        if rows >= at_least:
            yield tuple(np.concatenate(x) for x in zip(*kept, strict=True))
            kept, rows = [], 0
    if kept:
        yield tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def thinned(links: DataFrame) -> DataFrame:
    """Fewer links (a, b: numbers) with the same components: each task keeps stars of the components it sees."""

    def thin(batches):
        import numpy as np
        import pyarrow as pa

        made = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a = b = np.empty(0, np.int64)
        for more in _pairs(batches, THINNED_AT_ONCE):
            a, b = np.concatenate([a, more[0]]), np.concatenate([b, more[1]])
            names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = _hooked(len(names), at[: len(a)], at[len(a) :])
            off = root != np.arange(len(names))
            a, b = names[off], names[root[off]]
            if len(a) > THINNED_AT_ONCE:
                yield made(a, b)
                a = b = np.empty(0, np.int64)
        yield made(a, b)

    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").repartition("a").mapInArrow(thin, "a long, b long")


def least_numbers(n: int, links: DataFrame) -> DataFrame:
    """n, root: for the vertices 0 to n - 1 the least one of their component; links (a, b) join vertices of these only."""
    thin = stored(thinned(links), "thin")
    if n + thin.count() > NUMBERS_IN_ONE_TASK:
        every = links.sparkSession.range(n).select(F.col("id").alias("v"), F.lit(None).cast("long").alias("rank"))
        return _spread(every, thin).select(F.col("v").alias("n"), "root")

    def join(batches):
        import numpy as np
        import pyarrow as pa

        kind = np.int32 if n < 2**31 else np.int64
        parts = [(a.astype(kind), b.astype(kind)) for a, b in _pairs(batches, 1)]
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, kind),) * 2
        del parts
        root = _hooked(n, a, b)
        for at in range(0, n, 1_000_000):
            part = root[at : at + 1_000_000].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part), dtype=np.int64)), pa.array(part)], names=["n", "root"])

    return stored(thin.repartition(1).mapInArrow(join, "n long, root long"), "roots")


def with_numbers(vertices: DataFrame, links: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """Vertices (v, rank) with their place n by (rank, v), how many there are, and the links between them with s and t,
    the places of a and b in place of these."""
    own = stored(numbered(vertices.select("v", "rank"), "rank", "v"), "numbers")
    n = own.count()
    names = own.select("v", "n")
    names = F.broadcast(names) if n <= BROADCAST_ROWS else names
    for end, place in (("a", "s"), ("b", "t")):
        links = links.join(names.select(F.col("v").alias(end), F.col("n").alias(place)), end).drop(end)
    return own, n, links


def min_labels(vertices: DataFrame, links: DataFrame, in_one_task: int = 0) -> DataFrame:
    """Vertices (v, rank) with the smallest (rank, v) of their component as ``root`` and ``root_rank``.

    ``links`` has columns a and b, taken as undirected; links to unknown vertices are ignored. A graph of at most
    ``in_one_task`` vertices and links is joined in one task; a larger one is numbered in the order of (rank, v), its
    links are thinned where they lie, and numbers are joined; all with the same result. With 0, vertices and links stay as they are.
    """
    if not in_one_task:
        return _spread(vertices, links)
    own, held = stored(vertices.select("v", "rank"), "vertices"), stored(links.select("a", "b"), "links")
    if own.count() + held.count() <= in_one_task:
        return joined_labels(own, held.filter("a <> b"))
    own, n, held = with_numbers(own, held)
    roots = least_numbers(n, held.select(F.col("s").alias("a"), F.col("t").alias("b")))
    first = own.select(F.col("n").alias("root"), F.col("v").alias("root_v"), F.col("rank").alias("root_rank"))
    return own.join(roots, "n").join(first, "root").select("v", F.col("root_v").alias("root"), "root_rank")


def _spread(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """min_labels() by joins alone: a round takes the neighbors' minimum and then the label's own label, so that rounds
    grow with the logarithm of a component's width."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(vertices.select("v", F.struct(F.col("rank"), F.col("v").alias("id")).alias("label")), "labels")
    while True:
        heard = both.join(labels, both.a == labels.v).groupBy("b").agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, labels.v == heard.b, "left").select("v", "label", F.least("label", F.coalesce("heard", "label")).alias("near"))
        nearer = stored(nearer, "near")
        ends = nearer.select(F.col("v").alias("end"), F.col("near").alias("far"))
        moved = nearer.filter("near <> label")
        if moved.isEmpty():
            drop_stored(both)
            return nearer.select("v", F.col("label.id").alias("root"), F.col("label.rank").alias("root_rank"))
        jumped = nearer.join(ends, F.col("near.id") == F.col("end"), "left").select("v", F.least("near", F.coalesce("far", "near")).alias("label"))
        drop_stored(labels)
        labels = stored(jumped, "labels")
        drop_stored(nearer)
