"""Token ids in binary blocks, with Elias-Fano coded document boundaries.

The format is a Parquet table of blocks in document order. A block holds the concatenated ids of a run of documents as
little-endian unsigned integers of 16 or 32 bits, and the documents' end offsets in Elias-Fano code with a select
structure. Parquet is only the container, so any store that Spark reaches can hold it.
"""

from __future__ import annotations

import struct
import sys
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A block is closed when it holds this many ids.
BLOCK_IDS = 1 << 20
#: Every how many set bits the select structure keeps a position.
SELECT_STEP = 256
#: Words kept with their ids in each Python worker, and the longest that is kept.
KEPT_WORDS, KEPT_CHARS = 1_000_000, 48
#: First words of texts kept in each worker, words in one call of the library, and bytes of text encoded at a time.
KEPT_FIRSTS, CALL_WORDS, SLICE_BYTES = 100_000, 256, 1 << 20


class EliasFano:
    """A non-decreasing sequence below ``bound`` in about 2 + log2(bound / n) bits an entry, with select(i)."""

    HEAD = struct.Struct("<QQBI")

    def __init__(self, n: int, bound: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.bound, self.low_bits = n, bound, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        bound = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (bound // n).bit_length() - 1) if n else 0
        shift = np.uint64(low_bits)
        places = (values >> shift).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[places] = 1
        lows = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        return cls(n, bound, low_bits, np.packbits(lows, bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes(), places[::SELECT_STEP].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The i-th value, from the nearest kept position on and without decoding the rest."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = struct.unpack_from("<I", self.samples, 4 * (i // SELECT_STEP))[0]
        left, byte = i % SELECT_STEP, at >> 3
        word = self.high[byte] >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = 8 * byte + (word & -word).bit_length() - 1
        first = i * self.low_bits
        chunk = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3], "little")
        return (place - i) << self.low_bits | chunk >> (first & 7) & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, dtype=np.uint8), bitorder="little"))[: self.n]
        lows = np.unpackbits(np.frombuffer(self.low, dtype=np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (lows.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return ((places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | low

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.bound, self.low_bits, len(self.high)) + self.samples + self.high + self.low

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bound, low_bits, highs = cls.HEAD.unpack_from(data)
        at = cls.HEAD.size
        end = at + 4 * (-(-n // SELECT_STEP))
        return cls(n, bound, low_bits, data[end + highs :], data[end : end + highs], data[at:end])


#: White space that is not the same to every library, and other than ASCII.
ODD_ASCII = "\x1c\x1d\x1e\x1f"
ODD_WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
PAIRS = ("  ", " \n", " \t", " \r", " \x0b", " \x0c")


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class TokenEncoder:
    """Ids by the tokenizers library, with the ids of frequent words kept.

    Byte-level BPE never merges across the start of white space that follows other characters. Where every space in a
    text stands before a word, the text may therefore be cut at its spaces; each distinct word is encoded by the library
    once, many in one call, and looked up afterwards. Other texts go to the library whole, and so do texts with the
    string of a special token, which the library encodes as that token.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        #: Strings that the library takes for one token wherever they stand, so that texts with them go to it whole.
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        size = self.library.get_vocab_size()
        #: Each sign of a token stands for one byte of text.
        self.widths = np.array([len(self.library.id_to_token(i) or "") for i in range(size)], dtype=np.int64)
        self.kept: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {"": b""}

    def plain(self, text: str) -> bool:
        """Whether every space of the text stands before a character that is not white space, and no special string is in it."""
        if text.startswith(" ") or text.endswith(" ") or any(p in text for p in PAIRS) or any(c in text for c in ODD_ASCII):
            return False
        if any(x in text for x in self.special):
            return False
        return text.isascii() or not any(c in text for c in ODD_WIDE)

    def whole(self, text: str) -> bytes:
        return packed(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words that each follow a space, from one call; none is empty or starts with white space."""
        text = " " + " ".join(words)
        flat = packed(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        sizes = map(len, words) if text.isascii() else (len(w.encode("utf-8", "surrogatepass")) for w in words)
        ends = np.cumsum(np.fromiter(sizes, dtype=np.int64, count=len(words)) + 1)
        cuts = (4 * np.searchsorted(np.cumsum(self.widths[np.frombuffer(flat, dtype="<u4")]), ends, side="left") + 4).tolist()
        return {w: flat[a:b] for w, a, b in zip(words, [0, *cuts], cuts, strict=False)}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit integers; new words of all of them go in few calls."""
        split = [t.split(" ") if t and self.plain(t) else None for t in texts]
        heads = [p.pop(0) if p else "" for p in split]
        fresh: set[str] = set()
        for p in split:
            if p:
                fresh.update(p)
        kept, new = self.kept, list(fresh.difference(self.kept))
        for at in range(0, len(new), CALL_WORDS):
            kept.update(self.words(new[at : at + CALL_WORDS]))
        firsts = list({h for h in heads if h and h not in self.firsts})
        self.firsts.update((h, packed(e.ids)) for h, e in zip(firsts, self.library.encode_batch_fast(firsts, add_special_tokens=False), strict=True))
        out = [(self.whole(t) if t else b"") if p is None else self.firsts[h] + b"".join(map(kept.__getitem__, p)) for t, p, h in zip(texts, split, heads, strict=True)]
        if len(kept) > KEPT_WORDS:  # the words met first are the frequent ones
            for w in new:
                del kept[w]
        else:
            for w in new:
                if len(w) > KEPT_CHARS:
                    del kept[w]
        if len(self.firsts) > KEPT_FIRSTS:
            self.firsts = {"": b""}
        return out


def text_slices(batches, column: int = 1, limit: int = SLICE_BYTES):
    """Record batches of about ``limit`` bytes of a text column at most, or of one row."""
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")) - at)
            yield batch.slice(at, n)
            at += n


_encoders: dict[str, TokenEncoder] = {}


def encoder(vocabulary: str) -> TokenEncoder:
    """The worker's one encoder of a vocabulary file, kept between batches."""
    if vocabulary not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[vocabulary] = TokenEncoder(vocabulary)
    return _encoders[vocabulary]


BLOCKS = "shard int, block int, base long, n_docs int, width int, doc_ids array<long>, bounds binary, ids binary"


def write_token_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of all whole texts in ascending doc_id order to ``path``, each followed by ``end_id``.

    Needs doc_id and text; other columns are ignored. Null text is empty, so its document is the end id alone. Null ids
    come first; rows of one id are ordered by a hash of the text and then the text, and repeated rows are each written.
    An empty table gives a file without blocks. ``base`` counts the ids before a block within its shard.
    """
    import pyarrow as pa

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, shard = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        number = base = size = 0
        ids: list[bytes] = []
        names: list[int | None] = []

        def close() -> pa.RecordBatch:
            ends = np.cumsum([len(x) // 4 for x in ids])
            flat = np.frombuffer(b"".join(ids), dtype="<u4")
            width = 2 if flat.max() < 1 << 16 else 4
            row = [[shard], [number], [base], [len(names)], [width], [names], [EliasFano.of(ends).to_bytes()], [flat.astype(f"<u{width}").tobytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in text_slices(batches):
            coded = own.encode_all([t or "" for t in batch.column(1).to_pylist()])
            for doc_id, own_ids in zip(batch.column(0).to_pylist(), coded, strict=True):
                ids.append(own_ids + end)
                names.append(doc_id)
                size += len(ids[-1]) // 4
                if size >= block_ids:
                    yield close()
                    number, base, size, ids, names = number + 1, base + size, 0, [], []
        if names:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").parquet(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (array) of every document in ``path``."""
    return _read(spark, path, whole=True)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids (array) of some documents: of a block only two bounds and the ids between them are decoded for each."""
    import pyarrow as pa

    wanted = set(doc_ids)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = [], []
            for row in batch.to_pylist():
                bounds = EliasFano.from_bytes(row["bounds"])
                for i, name in enumerate(row["doc_ids"]):
                    if name in wanted:
                        a, b = bounds.select(i - 1) if i else 0, bounds.select(i)
                        names.append(name)
                        found.append(np.frombuffer(row["ids"], dtype=f"<u{row['width']}", offset=a * row["width"], count=b - a).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "ids"])

    table = spark.read.schema(BLOCKS).parquet(path).filter(F.arrays_overlap("doc_ids", F.array(*map(F.lit, doc_ids)).cast("array<long>")))
    return table.select("width", "doc_ids", "bounds", "ids").mapInArrow(chosen, "doc_id long, ids array<long>")


def read_token_digest(spark: SparkSession, path: str) -> DataFrame:
    """As read_token_ids(), with the unsigned crc32 of the ids as little-endian 32-bit integers in their place."""
    return _read(spark, path, whole=False)


def _read(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    import pyarrow as pa

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        for batch in batches:
            for row in batch.to_pylist():
                bounds = EliasFano.from_bytes(row["bounds"])
                ends = np.fromiter(map(bounds.select, range(bounds.n)), dtype=np.int64, count=bounds.n)
                starts = np.concatenate([[0], ends[:-1]])
                ids = np.frombuffer(row["ids"], dtype=f"<u{row['width']}").astype("<u4")
                own = [ids[a:b] for a, b in zip(starts, ends, strict=True)]
                last = pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())) if whole else pa.array([crc32(x.tobytes()) for x in own], pa.int64())
                before = row["before"] + row["base"]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + before), pa.array(ends - starts), last], ["doc_id", "start", "n_tokens", kind[0]])

    kind = ("ids", "array<long>") if whole else ("ids_crc32", "long")
    table = spark.read.schema(BLOCKS).parquet(path)
    # one number for each shard, of which there are as many as write tasks
    sizes = sorted(table.withColumn("n", F.col("base") + F.octet_length("ids") / F.col("width")).groupBy("shard").agg(F.max("n").cast("long")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])])
    bases = spark.createDataFrame([(s, int(b)) for (s, _), b in zip(sizes, before, strict=False)] or [], "shard int, before long")
    joined = table.join(F.broadcast(bases), "shard").select("before", "base", "width", "doc_ids", "bounds", "ids")
    return joined.mapInArrow(documents, f"doc_id long, start long, n_tokens long, {kind[0]} {kind[1]}")
