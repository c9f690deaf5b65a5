"""Near-duplicate documents by one-permutation hashing with optimal densification.

A document is its set of 5-word shingles. One hash of each shingle serves all bins: its top bits choose the bin, its
value competes for the bin's minimum, and empty bins copy a bin that a universal hash of (bin, attempt) picks. Bands of
bins make buckets; in a bucket, one document at its center is first linked with the others (a star), so that most links
grow with documents and not with pairs. Documents whose buckets still hold several components meet once more, by the
rarest shingles of their sets, of which two linked sets must share one: whoever is not in the largest component of a
shingle meets all members of the others there. So every pair that shares a bucket is in one component, tested, or proven
not to be similar enough. Links are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import min_labels
from .common import WordHashes, drop_stored, free, mixed, stored

#: Words of a shingle.
SHINGLE = 5
#: Bands of BAND_ROWS bins each. At a similarity of 0.75 a pair misses all bands with a chance of 5 in a million.
BANDS, BAND_ROWS = 32, 4
BIN_BITS = (BANDS * BAND_ROWS).bit_length() - 1
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Rounds of stars; each takes a new center among the documents that the last left outside its center's component.
ROUNDS = 3
#: Members of a bucket that one task pairs with those outside its largest component, and partners that one copy of a
#: set meets.
BLOCK = 256


def shingle_set(text: bytes, words: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; one for the whole of a shorter text, none without words."""
    each = words.of(text.lower().split())
    n = len(each)
    if not n:
        return each
    span = min(size, n)
    h = each[: n - span + 1].copy()
    for j in range(1, span):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + each[j : n - span + 1 + j]
    return np.unique(mixed(h + np.uint64(span)))


class Densifier:
    """For each bin, the bins to copy from when it is empty, in the order of attempts."""

    def __init__(self, bins: int, attempts: int = 512):
        at = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(0x2545F4914F6CDD1D) + np.arange(1, attempts + 1, dtype=np.uint64)[None, :]
        self.order = (mixed(at) % np.uint64(bins)).astype(np.int64)

    def fill(self, minima: np.ndarray, full: np.ndarray) -> np.ndarray:
        empty = np.flatnonzero(~full)
        if len(empty):
            hits = full[self.order[empty]]
            first = hits.argmax(axis=1)
            source = self.order[empty, first]
            missed = ~hits[np.arange(len(empty)), first]
            source[missed] = np.flatnonzero(full)[0]  # no attempt met a full bin: the first one serves
            minima[empty] = minima[source]
        return minima


def band_keys(shingles: np.ndarray, densifier: Densifier) -> np.ndarray:
    """One 64-bit bucket key for each band, of a non-empty sorted set."""
    bins = (shingles >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    minima, full = np.zeros(1 << BIN_BITS, dtype=np.uint64), np.zeros(1 << BIN_BITS, dtype=bool)
    minima[bins[first]], full[bins[first]] = shingles[first], True
    rows = densifier.fill(minima, full).reshape(BANDS, BAND_ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(BAND_ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def fingerprint(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit name of the whole set, null if empty) and bands of every row."""
    import pyarrow as pa

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, densifier = WordHashes(), Densifier(1 << BIN_BITS)
        for batch in batches:
            n, keys, bands = [], [], []
            for value in batch.column(1):
                own = shingle_set(value.as_buffer() and value.as_buffer().to_pybytes() or b"", words)
                n.append(len(own))
                keys.append(fingerprint(own) if len(own) else None)
                bands.append(band_keys(own, densifier) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_key and the full set, as an array of hashes, of each key in ``wanted`` (doc_id, set_key)."""
    import pyarrow as pa

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            keys, sets = [], []
            for value, key in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = shingle_set(value.as_buffer() and value.as_buffer().to_pybytes() or b"", words)
                if len(own) and fingerprint(own) == key:  # a repeated doc_id may come with other texts
                    keys.append(key)
                    sets.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["set_key", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # both sides are shuffled at every size: the wanted side grows with the documents
    found = texts.join(wanted.hint("merge"), texts.doc_id.eqNullSafe(wanted.doc_id)).select("text", "set_key")
    return found.mapInArrow(build, "set_key binary, shingles array<long>").dropDuplicates(["set_key"])


def with_sets(pairs: DataFrame, side: str, sets: DataFrame) -> DataFrame:
    """``pairs`` with the set of one side as ``of_<side>``; a set with many partners is dealt out with blocks of them."""
    blocks = pairs.groupBy(side).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(blocks, side).withColumn("block", F.pmod(F.xxhash64("a", "b"), "blocks").cast("int")).drop("blocks")
    copies = sets.join(blocks, F.col("set_key") == F.col(side)).select(side, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("shingles").alias(f"of_{side}"))
    return dealt.join(copies, [side, "block"]).drop("block")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = with_sets(with_sets(pairs, "b", sets), "a", sets)
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.select("a", "b", shared.alias("shared"), (F.size("of_a") + F.size("of_b")).alias("total")).filter(100 * F.col("shared") >= PERCENT * (F.col("total") - F.col("shared"))).select("a", "b")


def prefixes(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """bucket, set_key, n and at: for each key, the shingles of which two linked sets share one at least, and their places.

    All shingles have one order, from those in the fewest of these sets on. Linked sets of n and m shingles share s =
    PERCENT / (100 + PERCENT) of n + m at least, so the first that they share has a place (from 0) of n - s at most in
    the one and of m - s in the other; s is PERCENT of n at least. Shingles that no other set has come first and need no
    rows; a set with too many of them has no link at all.
    """
    rows = sets.join(keys, "set_key", "left_semi").select("set_key", F.size("shingles").alias("n"), F.explode("shingles").alias("bucket"))
    often = rows.groupBy("bucket").agg(F.count("*").alias("times")).filter("times > 1")
    own = rows.join(often, "bucket").groupBy("set_key", "n").agg(F.sort_array(F.collect_list(F.struct("times", "bucket"))).alias("shared"))
    alone = F.col("n") - F.size("shared")
    room = F.col("n") - F.expr(f"({PERCENT} * n + 99) div 100") + 1 - alone
    first = F.transform(F.slice("shared", F.lit(1), room.cast("int")), lambda x, i: F.struct(x["bucket"].alias("bucket"), (alone + i).alias("at")))
    return own.filter(room > 0).select("set_key", "n", F.explode(first).alias("x")).select("x.bucket", "set_key", "n", "x.at")


def remaining_pairs(members: DataFrame, roots: DataFrame) -> DataFrame:
    """All pairs (a, b) with different roots that share one of their prefixes() as linked sets do.

    Of two members of a bucket with different roots one is outside the bucket's largest component; those meet all
    others, which are dealt out in blocks.
    """
    placed = members.join(roots.select(F.col("v").alias("set_key"), "root"), "set_key").select("bucket", "set_key", "n", "at", "root")
    parts = placed.groupBy("bucket", "root").agg(F.count("*").alias("own"))
    several = parts.groupBy("bucket").agg(F.max(F.struct("own", "root"))["root"].alias("largest"), F.sum("own").alias("all"), F.count("*").alias("parts"))
    several = several.filter("parts > 1").select("bucket", "largest", F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"))
    open_ones = placed.join(several, "bucket")
    dealt = open_ones.select("bucket", F.expr("pmod(xxhash64(set_key), blocks)").cast("int").alias("block"), F.col("set_key").alias("y"), F.col("n").alias("n_y"), F.col("at").alias("at_y"), F.col("root").alias("root_y"))
    outside = open_ones.filter("root <> largest").select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("set_key").alias("x"), "n", "at", "root")
    shared = f"(({PERCENT} * (n + n_y) + {99 + PERCENT}) div {100 + PERCENT})"
    near = F.expr(f"root <> root_y AND 100 * least(n, n_y) >= {PERCENT} * greatest(n, n_y) AND at <= n - {shared} AND at_y <= n_y - {shared}")
    met = outside.join(dealt, ["bucket", "block"]).filter(near)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``.

    Needs doc_id and text; other columns are ignored. Documents with equal sets are one class and are not compared
    again. Documents without words (null, empty or only white space) are linked with nothing. The component is named by
    its smallest doc_id, null ids first only where a component has no other; of repeated rows each has its own result
    row, and a row with a null id is never kept unless it has no words. Lone documents are their own component.
    """
    spark = docs.sparkSession
    signed = stored(signatures(docs), "signed")
    classes = stored(signed.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("first"), F.max("n_shingles").cast("int").alias("n"), F.first("bands").alias("bands")), "classes")
    rows = classes.select(F.explode("bands").alias("bucket"), "set_key", "n")
    shared = rows.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    crowded = stored(rows.join(shared, "bucket"), "crowded")
    # the more company a document has over all its buckets, the nearer it is to the middle of its group
    weight = crowded.groupBy("set_key").agg(F.sum("members").alias("weight"))
    members = stored(crowded.join(weight, "set_key").select("bucket", "set_key", "n", "weight"), "members")
    drop_stored(crowded)
    vertices = members.select("set_key").distinct().join(classes, "set_key").select(F.col("set_key").alias("v"), F.col("first").alias("rank"))
    vertices = stored(vertices, "vertices")
    free(spark)
    sets = stored(full_sets(docs, vertices.select(F.col("rank").alias("doc_id"), F.col("v").alias("set_key"))), "sets")
    links, tried, roots, left = None, None, None, members
    for number in range(rounds):
        center = left.groupBy("bucket").agg(F.max(F.struct("weight", "set_key", "n")).alias("c"))
        star = left.join(center, "bucket").filter("set_key <> c.set_key AND 100 * least(n, c.n) >= 75 * greatest(n, c.n)")
        pairs = star.select(F.least("set_key", "c.set_key").alias("a"), F.greatest("set_key", "c.set_key").alias("b")).distinct()
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        found = confirmed(pairs, sets)
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = stored(found if links is None else links.unionByName(found), "confirmed")
        free(spark)
        roots = min_labels(vertices, links)
        if number + 1 == rounds or pairs.isEmpty():
            break
        # who shares its center's component is settled in that bucket; the others meet again around a new center
        placed = left.join(roots.select(F.col("v").alias("set_key"), "root"), "set_key")
        middle = center.select("bucket", F.col("c.set_key").alias("v")).join(roots, "v").select("bucket", F.col("root").alias("center_root"))
        outside = placed.join(middle, "bucket").filter("root <> center_root")
        several = outside.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
        left = stored(outside.join(several, "bucket").select("bucket", "set_key", "n", "weight"), "left")
    # what the stars leave: sets in buckets of several components meet again by the shingles that links must share
    placed = members.select("bucket", "set_key").join(roots.select(F.col("v").alias("set_key"), "root"), "set_key")
    several = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
    unsettled = stored(placed.join(several, "bucket", "left_semi").select("set_key").distinct(), "unsettled")
    first = stored(prefixes(unsettled, sets), "prefixes")
    pairs = stored(remaining_pairs(first, roots).join(tried, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        links = stored(links.unionByName(confirmed(pairs, sets)), "confirmed")
        free(spark)
        roots = min_labels(vertices, links)
    rooted = classes.join(roots, classes.set_key == roots.v, "left").select("set_key", F.when(F.col("v").isNull(), F.col("first")).otherwise(F.col("root_rank")).alias("component"))
    named = signed.select("doc_id", "n_shingles", "set_key").join(rooted, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("n_shingles") == 0))
