"""Exact top-k inner products by term-at-a-time accumulation.

Vectors are sparse rows of (component, weight). A block of candidates is kept as postings for each component; each
query scatters its weighted postings into a dense array of scores, a partition selection finds the block's best, and
the blocks' lists are merged. Every query meets every candidate block once.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a candidate block and of a query block; the scores of one query over a block fit the processor's cache. Each
#: candidate is shuffled once for a query block, against some millions of multiplications that it then serves.
BLOCK, QUERIES = 16_384, 32_768
#: Lists of a query that are merged at a time.
MERGED = 64


def integer_vectors(table: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id and floor(scale * x) of every component; vectors null or with null or non-finite components are left out.

    Rows repeated under one vec_id count once, with the smallest of their vectors.
    """
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    floors = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    valid = table.filter(F.col("vec_id").isNotNull()).filter(whole).select(F.col("vec_id").cast("long").alias("vec_id"), floors.alias("v"))
    return valid.groupBy("vec_id").agg(F.min("v").alias("v"))


def postings(vectors: list) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(component, rows, weights) for each component that some vector of the block has."""
    width = max((len(v) for v in vectors), default=0)
    dense = np.zeros((width, len(vectors)), dtype=np.int64)
    for i, v in enumerate(vectors):
        dense[: len(v), i] = v
    return [(t, rows, row[rows]) for t, row in enumerate(dense) if len(rows := np.flatnonzero(row))]


def top_k(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, ties to the smaller id: selection first, an exact order of what is left."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
        if len(at) > 4 * k:  # many ties at the limit: of these, the smallest ids are enough
            tied = at[scores[at] == least]
            need = k - int((scores > least).sum())
            at = np.concatenate([np.flatnonzero(scores > least), tied[np.argpartition(ids[tied], need - 1)[:need]]])
    else:
        at = np.arange(len(scores))
    order = np.lexsort((ids[at], -scores[at]))[:k]
    return ids[at][order], scores[at][order]


def top_k_search(table: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k highest inner products with all other rows.

    ``table`` needs vec_id and embedding (array of numbers, of any lengths; missing components count as 0); other
    columns are ignored. Empty vectors score 0 with all. Ties go to the smaller vec_id; a query with fewer than k
    other rows has them all, a lone row has none.
    """
    import pyarrow as pa

    vectors = integer_vectors(table, scale)
    n = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    n_blocks, n_queries = max(1, -(-n[0] // block)), max(1, -(-n[1] // queries))
    least = max(1, vectors.sparkSession.sparkContext.defaultParallelism)
    if n[0] > 64 * least:
        n_blocks = max(n_blocks, -(-least // n_queries))
    deal = lambda salt, many: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(many)).cast("int")
    candidates = vectors.select(deal(0, n_blocks).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("q"), "vec_id", "v")
    asked = vectors.filter(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"), deal(1, n_queries).alias("q"), F.col("vec_id").alias("query_id"), F.col("v").alias("of_query"))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score", "part"]
        if not left.num_rows or not right.num_rows:  # a side without rows lacks columns
            return pa.table({name: pa.array([], pa.int64()) for name in names})
        ids = left.column("vec_id").to_numpy()
        terms = postings(left.column("v").to_pylist())
        out: list[list[np.ndarray]] = [[], [], []]
        scores = np.empty(len(ids), dtype=np.int64)
        dense = {t: np.ascontiguousarray(w) for t, rows, w in terms if len(rows) == len(ids)}
        sparse = {t: (rows, w) for t, rows, w in terms if t not in dense}
        own = np.argsort(ids)
        for query, vector in zip(right.column("query_id").to_pylist(), right.column("of_query").to_pylist(), strict=True):
            scores[:] = 0
            for t, x in enumerate(vector):
                if x and t in dense:
                    scores += x * dense[t]
                elif x and t in sparse:
                    rows, w = sparse[t]
                    scores[rows] += x * w
            at = np.searchsorted(ids, query, sorter=own)
            keep, rest = ids, scores
            if at < len(ids) and ids[own[at]] == query:
                keep, rest = np.delete(ids, own[at]), np.delete(scores, own[at])
            best, score = top_k(rest, keep, k)
            for o, x in zip(out, (np.full(len(best), query), best, score), strict=True):
                o.append(x)
        flat = [pa.array(np.concatenate(o) if o else np.array([], dtype=np.int64), pa.int64()) for o in out]
        own = pa.array(np.full(len(flat[0]), right.column("b")[0].as_py(), dtype=np.int64))
        return pa.Table.from_arrays([*flat, own], names)

    lists = candidates.groupBy("b", "q").cogroup(asked.groupBy("b", "q")).applyInArrow(scored, "query_id long, vec_id long, score long, part long")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k)
    while n_blocks > MERGED:  # no array gets more than MERGED lists
        lists = lists.groupBy("query_id", F.floor(F.col("part") / MERGED).alias("part")).agg(best.alias("best")).select("query_id", "part", F.explode("best").alias("x"))
        lists = lists.select("query_id", F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"), "part")
        n_blocks = -(-n_blocks // MERGED)
    merged = lists.groupBy("query_id").agg(best.alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))
