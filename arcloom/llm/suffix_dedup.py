"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

Every string of WINDOW bytes that starts anywhere else too is cut out of every text. Only suffixes that can matter are
sorted: in each window, the leftmost least hash of its q-grams is its anchor, and equal windows have equal anchors at
equal offsets. An anchor hash is a suffix's first bucket; buckets with one member are dropped. The others are refined
by their order on the bucket identifiers of later offsets (8, 16, 32 ... bytes on), and refined identifiers serve the
next step, until a bucket is a string of WINDOW bytes. A bucket too large for one task is refined across tasks first: its
windows fall into two halves by their offset to the anchor, the bytes that all windows of a half have around the anchor
refine the bucket, and equal contexts become one. Halves of halves end at single windows, which only have to be counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, free, fresh_names, mixed, stored

#: Bytes of a repeated string, and of the q-grams that anchors are chosen by.
WINDOW, GRAM = 200, 32
#: A text is looked at in pieces of so many window starts.
PIECE = 1 << 20
#: Buckets with more members are refined across tasks before they are refined in one.
LARGE = 4096
#: Bytes of contexts that one refinement sorts.
BATCH_BYTES = 1 << 20
#: Exact copies above this number are represented by two of them.
COPIES = 64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(which: str, base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(which)
    if known is None or len(known) < n:
        known = np.full(max(n, PIECE + 2 * WINDOW), base, dtype=np.uint64)
        known[0] = 1
        _powers[which] = known = np.multiply.accumulate(known)
    return known[:n]


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A mixed 64-bit polynomial hash of every run of ``size`` bytes."""
    n = len(data)
    if n < size:
        return np.empty(0, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n), out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * _power("down", _INVERSE, n - size + 1))


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows of one anchor: its hash, the first window's start, the number of consecutive window
    starts, and how far from the first window's start the anchor lies."""
    grams = window_hashes(data, GRAM)
    width = WINDOW - GRAM + 1
    if len(grams) < width:
        return np.empty(0, dtype=np.uint64), *(np.empty(0, dtype=np.int64) for _ in range(3))
    # place in the low bits: among equal hashes the leftmost is the least
    least = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(grams) - width + 1], least[width - span :])
    place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return grams[place[first]], first, np.diff(first, append=len(place)), place[first] - first


def refine(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bucket identifiers of the WINDOW-byte strings at ``starts``; equal strings, and only they, share one.

    ``data`` must be readable for WINDOW bytes from every start. Buckets of 8-byte prefixes are refined by the
    identifiers 8, 16, 32, 64 and at last 72 bytes on; a suffix whose bucket has no other member is done and keeps its
    identifier.
    """
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    prefix = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)]).view("<u8").ravel()
    names, ids, times = np.unique(prefix, return_inverse=True, return_counts=True)
    ids = ids.astype(np.uint64)
    open_ = np.flatnonzero(times[ids.astype(np.int64)] > 1)
    used, known = len(names), 8
    while known < WINDOW and len(open_):
        step = min(known, WINDOW - known)
        later = ids[np.minimum(open_ + step, len(ids) - 1)]  # beyond the end only where no start reads
        names, at, times = np.unique(ids[open_] << np.uint64(32) | later, return_inverse=True, return_counts=True)
        ids[open_] = at.astype(np.uint64) + np.uint64(used)
        open_ = open_[times[at] > 1]
        used, known = used + len(names), known + step
    return ids[starts]


def window_starts(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts as one array, where in it each window starts, and the number of windows of each context."""
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    counts = sizes - (WINDOW - 1)
    heads = np.cumsum(sizes) - sizes
    starts = np.repeat(heads - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return np.frombuffer(b"".join(contexts), dtype=np.uint8), starts, counts


def repeated_starts(contexts: list[bytes]) -> list[np.ndarray]:
    """For each context, which of its window starts hold a string that another start among all contexts holds too."""
    data, starts, counts = window_starts(contexts)
    _, at, times = np.unique(refine(data, starts), return_inverse=True, return_counts=True)
    return np.split(times[at] > 1, np.cumsum(counts)[:-1])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each run of true flags."""
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _pieces(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    whole = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, max(1, len(whole) - WINDOW + 1), PIECE):
        yield at, whole[at : at + PIECE + WINDOW - 1]


def _bytes_of(value) -> bytes:
    buffer = value.as_buffer()
    return buffer.to_pybytes() if buffer is not None else b""


def _slices(batches, column: int, limit: int = 1 << 22):
    """Record batches of about ``limit`` bytes of a column at most, or of one row."""
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")) - at)
            yield batch.slice(at, n)
            at += n


def text_rows(docs: DataFrame) -> DataFrame:
    """doc_id and the text as bytes, with its 128-bit name (k1, k2)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"))


def represented(rows: DataFrame) -> DataFrame:
    """``rows`` without the third and further copies of texts with very many copies, which two of them stand for.

    The classes are few (each has more than one in ten thousand of all rows, and COPIES at least), so they are broadcast.
    """
    classes = rows.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter(F.col("copies") > COPIES)
    classes = stored(classes, "copies")
    limit = (classes.agg(F.sum("copies")).first()[0] or 0) // 10_000
    many = F.broadcast(classes.filter(F.col("copies") > limit).select("k1", "k2", "low", "high"))
    keep = F.col("low").isNull() | (F.col("low") == F.col("high")) | F.col("doc_id").isNull() | F.col("doc_id").isin(F.col("low"), F.col("high"))
    return rows.join(many, ["k1", "k2"], "left").filter(keep).select("k1", "k2", "text")


def anchor_rows(rows: DataFrame) -> DataFrame:
    """One row for each anchor of a piece of a text: where it has its first run of windows, and how many runs."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for at, data in _pieces(_bytes_of(text)):
                    anchor, first, n, gram = anchors(data)
                    if len(anchor):
                        anchor, own, runs = np.unique(anchor, return_index=True, return_counts=True)
                        names = [pa.array(np.full(len(anchor), k, dtype=np.int64)) for k in (k1, k2)]
                        counts = [pa.array(x.astype(np.int32)) for x in (n[own], gram[own], runs)]
                        yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), *names, pa.array(first[own] + at), *counts], ["anchor", "k1", "k2", "first", "n", "gram", "runs"])

    return rows.select("k1", "k2", "text").mapInArrow(joined_batches(find), "anchor long, k1 long, k2 long, first long, n int, gram int, runs int")


def joined_batches(f):
    """``f`` with its small record batches put together before they go back to the JVM."""
    def wrapped(batches):
        held, size = [], 0
        for batch in f(batches):
            held.append(batch)
            size += batch.num_rows
            if size >= 50_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return wrapped


CONTEXTS = "k1 long, k2 long, key long, first long, gram int, large boolean, open boolean, context binary, to long"


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The context of each wanted run of windows, and spans (first, to) that are repeated within a slice of the texts.

    Equal contexts of one anchor in a slice become one row whose owner is not open any more: all owners have their spans.
    """
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.int64())
    for rows in _slices(batches, 2):
        out: list[list] = [[] for _ in types]

        def put(*row, out=out) -> None:
            for o, v in zip(out, row, strict=True):
                o.append(v)

        names = list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))
        held: dict[tuple[int, bytes], list[tuple]] = {}
        for i, (text, wanted) in enumerate(zip(rows.column(2), rows.column(3).to_pylist(), strict=True)):
            data = _bytes_of(text)
            large = {w["anchor"]: w["large"] for w in wanted}
            if len(large) < len(wanted) or any(w["runs"] > 1 for w in wanted):
                runs = []
                for at, piece in _pieces(data):
                    found = anchors(piece)
                    runs += [(k, f + at, n, g) for k, f, n, g in zip(found[0].view(np.int64).tolist(), *(x.tolist() for x in found[1:]), strict=True) if k in large]
            else:
                runs = [(w["anchor"], w["first"], w["n"], w["gram"]) for w in wanted]
            for key, first, n, gram in runs:
                held.setdefault((key, data[first : first + n + WINDOW - 1]), []).append((i, first, gram, large[key]))
        repeated: dict[int, list[tuple[int, int]]] = {}
        for (key, context), owners in held.items():
            i, first, gram, many = owners[0]
            put(*names[i], key, first, gram, many, len(owners) == 1, context, None)
            if len(owners) > 1:
                for i, first, _, _ in owners:
                    repeated.setdefault(i, []).append((first, first + len(context)))
        for i, spans in repeated.items():
            spans.sort()
            starts, ends = np.array(spans, dtype=np.int64).T
            for a, b in zip(*(x.tolist() for x in merged_spans(starts, ends)), strict=True):
                put(*names[i], None, a, None, None, None, None, b)
        yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], [c.split()[0] for c in CONTEXTS.split(", ")])


def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each context as up to two, for the windows of the lower and the upper half of its interval of offsets.

    A window's offset is how far the anchor lies from its start. All windows with offsets in [x, y) have in common what
    is x bytes before the anchor and WINDOW - (y - 1) bytes after its start; those bytes refine the key.
    """
    from struct import pack

    from xxhash import xxh3_64_intdigest

    for batch in batches:
        out: list[list] = [[] for _ in range(9)]
        for k1, k2, key, x, y, first, gram, open_, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            middle, least = (x + y) // 2, gram - (len(context) - WINDOW)
            for a, b in ((x, middle), (middle, y)):
                low, high = max(a, least), min(b - 1, gram)
                if low <= high:
                    core = xxh3_64_intdigest(pack("<qii", key, a, b) + context[gram - a : gram + WINDOW - b + 1])
                    own = (k1, k2, core - (1 << 64) if core >> 63 else core, a, b, first + gram - high, high, open_, context[gram - high : gram - low + WINDOW])
                    for o, v in zip(out, own, strict=True):
                        o.append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], [c.split()[0] for c in LEVEL.split(", ")])


LEVEL = "k1 long, k2 long, key long, x int, y int, first long, gram int, open boolean, context binary"


def by_halves(large: DataFrame) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Refines buckets of more than LARGE members across tasks: spans that are repeated as wholes (k1, k2, from, to),
    members of buckets that are small enough now, and the tables that both are read from.

    Equal contexts of a bucket become one, and their owners get all of it; of what is left, large buckets are halved.
    """
    names = [c.split()[0] for c in LEVEL.split(", ")]
    level = large.withColumns({"x": F.lit(0), "y": F.lit(WINDOW - GRAM + 1)}).select(names)
    whole, refined, kept = [], [], []
    if large.isEmpty():
        return whole, refined, kept
    while True:
        marked = level.withColumns({"c1": F.xxhash64("context"), "c2": F.xxhash64(F.lit(7), "context")})
        same = stored(marked.groupBy("key", "c1", "c2").agg(F.count("*").alias("owners"), F.min(F.struct(*[n for n in names if n != "key"])).alias("r")), "same")
        several = same.filter("owners > 1").select("key", "c1", "c2")
        given = marked.filter("open").join(several, ["key", "c1", "c2"], "left_semi")
        whole.append(given.select("k1", "k2", F.col("first").alias("from"), (F.col("first") + F.length("context")).alias("to")))
        members = same.withColumn("o", F.col("owners") == 1).select("key", "r.*", "o").withColumn("open", F.col("open") & F.col("o")).select(names)
        sizes = stored(members.groupBy("key").count().filter("count > 1"), "sizes")
        refined.append(members.join(sizes.filter(F.col("count") <= LARGE), "key", "left_semi"))
        kept += [same, sizes]
        crowded = sizes.filter(F.col("count") > LARGE)
        if crowded.isEmpty():
            return whole, refined, kept
        level = stored(members.join(crowded, "key", "left_semi").select(names).mapInArrow(halves, LEVEL), "level")
        kept.append(level)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """k1, k2 and spans (sorted array of from, to) of the bytes to cut from each text that has any."""
    spark = docs.sparkSession
    rows = text_rows(docs)
    chosen = represented(rows)
    found = stored(anchor_rows(chosen), "anchors")
    shared = found.groupBy("anchor").agg(F.sum("runs").alias("members")).filter("members > 1")
    wanted = found.join(shared, "anchor").select("k1", "k2", F.struct("anchor", "first", "n", "gram", "runs", (F.col("members") > LARGE).alias("large")).alias("w"))
    wanted = stored(wanted.groupBy("k1", "k2").agg(F.collect_set("w").alias("wanted")), "wanted")
    drop_stored(found)
    free(spark)

    contexts = chosen.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "wanted")
    contexts = stored(contexts.mapInArrow(cut, CONTEXTS), "contexts")

    kinds = "k1 long, k2 long, from long, to long"
    names = [x.split()[0] for x in kinds.split(", ")]

    def sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their keys. Equal contexts of a bucket are repeated as wholes; where a bucket has
        several different contexts, one of each is refined, many buckets together. Owners that are not open have been
        given all of their context."""
        out: list[list] = [[], [], [], []]
        waiting: list[tuple[bytes, list[tuple]]] = []
        bucket: dict[bytes, list[tuple]] = {}
        anchor, size = None, 0

        def put(owners: list[tuple], firsts: list[int], ends: list[int]) -> None:
            for k1, k2, first, _ in owners:
                for a, b in zip(firsts, ends, strict=True):
                    out[0].append(k1), out[1].append(k2), out[2].append(first + a), out[3].append(first + b - 1 + WINDOW)

        def close() -> int:
            for context, owners in bucket.items():
                if len(owners) > 1:
                    put([o for o in owners if o[3]], [0], [len(context) - WINDOW + 1])
            several = [(c, o) for c, o in bucket.items()] if len(bucket) > 1 else []
            waiting.extend(several)
            bucket.clear()
            return sum(len(c) for c, _ in several)

        def sort() -> None:
            for (_, owners), flags in zip(waiting, repeated_starts([c for c, _ in waiting]), strict=True):
                if len(owners) == 1 and owners[0][3] and flags.any():
                    put(owners, *(x.tolist() for x in runs(flags)))
            waiting.clear()

        def handed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names)
            for o in out:
                o.clear()
            return made

        for batch in batches:
            for k1, k2, key, first, open_, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != anchor:
                    size += close()
                    anchor = key
                    if size >= BATCH_BYTES:
                        sort()
                        size = 0
                bucket.setdefault(context, []).append((k1, k2, first, open_))
            yield handed()
        close()
        if waiting:
            sort()
        yield handed()

    columns = ["k1", "k2", "key", "first", "open", "context"]
    small = contexts.filter("NOT large").select(columns)
    whole, refined, kept = by_halves(contexts.filter("large"))
    whole.append(contexts.filter("to IS NOT NULL").select("k1", "k2", F.col("first").alias("from"), "to"))
    for more in refined:
        small = small.unionByName(more.select(columns))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = small.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(sort_buckets, kinds)
    for more in whole:
        both = both.unionByName(more)
    spans = both.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("spans"))
    spans = stored(spans, "spans")
    for used in (contexts, wanted, *kept):
        drop_stored(used)
    free(spark)
    return spans


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans sorted by start, with those that touch or overlap made one."""
    reach = np.maximum.accumulate(ends)
    fresh = np.concatenate([[True], starts[1:] > reach[:-1]])
    first = np.flatnonzero(fresh)
    return starts[first], reach[np.concatenate([first[1:] - 1, [len(starts) - 1]])]


def suffix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``.

    Needs doc_id and text; other columns are ignored. Null text is empty. Repeated rows count as texts of their own, so
    each row of a text of WINDOW bytes or more that is there twice loses it all. An empty table gives no rows.
    """
    spans = repeated_spans(docs)
    rows = text_rows(docs).select("doc_id", "text", "k1", "k2")
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for text, own in zip(batch.column(1), batch.column(2), strict=True):
                data = _bytes_of(text)
                kept, removed, n = _cut(data, own)
                for o, x in zip(out, (len(data), removed, n, sha256(kept).hexdigest()), strict=True):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(o, pa.int64()) for o in out[:3]], pa.array(out[3], pa.string())], [x.split()[0] for x in kinds.split(", ")])

    return rows.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(digest, kinds)


def _cut(data: bytes, own) -> tuple[bytes, int, int]:
    """The kept bytes, how many are removed, and in how many runs; ``own`` is an Arrow list of (from, to) or null."""
    if not own.is_valid or not len(own.values):
        return data, 0, 0
    starts, ends = merged_spans(own.values.field(0).to_numpy(), own.values.field(1).to_numpy())
    edges = [0, *np.column_stack([starts, ends]).ravel().tolist(), len(data)]
    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return kept, len(data) - len(kept), len(starts)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated strings cut from text; n_chars, where there, follows. Bytes of a cut character are dropped.

    Null texts stay null; all rows and all other columns are kept as they are.
    """
    k1, k2, own = fresh_names(docs, "_k1", "_k2", "_spans")
    spans = repeated_spans(docs).withColumnsRenamed({"k1": k1, "k2": k2, "spans": own})
    binary = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.withColumns({k1: F.xxhash64(binary), k2: F.xxhash64(F.lit(7), binary)})

    @F.arrow_udf("string")
    def kept(texts: pa.Array, spans: pa.Array) -> pa.Array:  # the texts that lose something
        return pa.array([_cut(_bytes_of(t), s)[0].decode("utf-8", "ignore") for t, s in zip(texts, spans, strict=True)], pa.string())

    joined = keyed.join(spans, [k1, k2], "left")
    text = F.when(F.col(own).isNull(), F.col("text")).otherwise(kept(F.coalesce("text", F.lit("")), F.coalesce(own, F.expr("cast(array() as array<struct<from:bigint,to:bigint>>)"))))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
