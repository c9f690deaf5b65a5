"""Language-model scores from a log-frequency Bloom filter of quantised word and bigram counts.

Counts are exact, over all training documents; words and bigrams are told apart by 64-bit hashes. An n-gram counted c
times enters the filter once for each level 1 .. 1 + floor(log2 c), so that its level is read back by probing level
after level until one is missing. Nothing is pruned: n-grams counted once enter at level 1.

The filter is cut into buckets by the n-gram's hash; a bucket's counts meet in one task, which sizes the bucket to its
own entries and builds it. A filter of at most MAX_BITS is broadcast, and texts are scored where they are read. Of a
larger one, the buckets stay where they are stored: blocks of texts ask each bucket for the levels of their different
n-grams, and take the answers back. Both give the same levels, and so the same scores.

p(w | h) = a c'(h, w) / c'(h) + (1 - a) p(w), where c' stands for a level's count (the mean count of all n-grams of one
length at that level), a bigram's level is held to those of both its words, a = c'(h) / (c'(h) + T), and
p(w) = (c'(w) + 0.5) / (N + 0.5 (V + 1)); after a word that is not counted it is p(w) alone. No probability exceeds 1. T
is fitted so that, over all training tokens, as much weight goes to p(w) as bigrams counted once have.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, free, mixed, stored

#: Bits of a filter that is broadcast at most, and for each entry; levels that an n-gram can have.
MAX_BITS, ENTRY_BITS, LEVELS = 1 << 30, 10, 64
#: Words whose exact counts are broadcast (16 bytes each), from the commonest on; the counts of all others are joined.
COMMON_WORDS = 1 << 20
#: Tokens whose bigrams a task brings together before it hands them on; a bucket's share of all tokens.
GATHERED, BUCKET_TOKENS = 1 << 20, 1 << 19
#: Bytes of text that are cut into tokens at a time, and different words that a task keeps numbered.
SLICE, KEPT = 1 << 20, 250_000
#: Bytes of text in a block that asks buckets for levels.
BLOCK_BYTES = 1 << 24
END = b""
SPACE = re.compile(rb"[ \t-\r]")

_U = np.uint64


# tokens


class Numbered(dict):
    """Words numbered as they are met, with their hashes in a growing array."""

    def __init__(self):
        from xxhash import xxh3_64_intdigest

        self.hash, self.fresh, self.hashes = xxh3_64_intdigest, [], np.empty(0, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.fresh.append(self.hash(word))
        return number

    def of(self, tokens: list[bytes]) -> np.ndarray:
        """The numbers of ``tokens``; afterwards ``hashes`` reaches to the last of them."""
        out = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        if self.fresh:
            self.hashes = np.concatenate([self.hashes, np.array(self.fresh, dtype=np.uint64)])
            self.fresh.clear()
        return out


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about SLICE bytes, cut at white space."""
    at = 0
    while len(text) - at > SLICE:
        found = SPACE.search(text, at + SLICE)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def token_slices(column) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Tokens of a column of texts, about SLICE bytes at a time, and where in them which text begins or goes on."""
    tokens, starts, owners, size = [], [], [], 0
    for i, value in enumerate(column):
        buffer = value.as_buffer()
        for piece in pieces(buffer.to_pybytes().lower() if buffer is not None else b""):
            starts.append(len(tokens))
            owners.append(i)
            tokens += piece.split()
            size += len(piece) + 8
            if size >= SLICE and len(tokens) > starts[-1]:
                yield tokens, starts, owners
                tokens, starts, owners, size = [], [], [], 0
        if not starts or owners[-1] != i:
            starts.append(len(tokens))
            owners.append(i)
        tokens.append(END)
    if tokens:
        yield tokens, starts, owners


def word_keys(hashes: np.ndarray) -> np.ndarray:
    return mixed(hashes * _U(0x9E3779B97F4A7C15) + _U(0x632BE59BD9B4E019))


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(mixed(before + _U(1)) * _U(0x9E3779B97F4A7C15) + word)


def token_rows(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and text as bytes; the remainder of crc32(doc_id as text) by 5 is 1 for held-out documents."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(name) % 5 == 1).alias("held_out"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


# counts


def word_counts(training: DataFrame) -> DataFrame:
    """word (64-bit hash) and count of every token of the training documents, ends included."""
    import pyarrow as pa

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as hashed

        held: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            words = np.fromiter(map(hashed, held), dtype=np.uint64, count=len(held))
            made = pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.fromiter(held.values(), dtype=np.int64, count=len(held)))], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for tokens, _, _ in token_slices(batch.column(0)):
                held.update(tokens)
                if len(held) > KEPT:
                    yield handed()
        if held:
            yield handed()

    return training.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> _U(32)) * _U(buckets)) >> _U(32)


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of each bucket that has some of the sorted keys."""
    own = bucket_of(keys, buckets)
    cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield int(own[a]), a, b


COUNTS = "bucket int, length int, keys binary, counts binary"


def count_blocks(keys: np.ndarray, counts: np.ndarray, length: int, buckets: int):
    """A batch with the sorted keys of each bucket and their counts."""
    import pyarrow as pa

    cut = list(by_bucket(keys, buckets))
    columns = [[b for b, _, _ in cut], [length] * len(cut), [keys[i:j].tobytes() for _, i, j in cut], [counts[i:j].astype(np.int64).tobytes() for _, i, j in cut]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "length", "keys", "counts"])


def ngram_counts(training: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """The counts of all training words and bigrams by bucket, summed within what a task gathers."""
    import pyarrow as pa

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = Numbered(), [], 0
        last = _U(known.hash(END))
        for batch in batches:
            for tokens, _, _ in token_slices(batch.column(0)):
                if len(known) > KEPT:
                    known = Numbered()
                numbers = known.of(tokens)
                each = known.hashes[numbers]
                held.append(pair_keys(np.concatenate([[last], each[:-1]]), each))
                last, size = each[-1], size + len(each)
                if size >= GATHERED:
                    yield count_blocks(*np.unique(np.concatenate(held), return_counts=True), 2, buckets)
                    held, size = [], 0
        if held:
            yield count_blocks(*np.unique(np.concatenate(held), return_counts=True), 2, buckets)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = word_keys(batch.column(0).to_numpy().view(np.uint64)), batch.column(1).to_numpy()
            order = np.argsort(keys)
            if len(order):
                yield count_blocks(keys[order], n[order], 1, buckets)

    return training.select("text").mapInArrow(bigrams, COUNTS).unionByName(words.select("word", "n").mapInArrow(single, COUNTS))


# filter


def entry(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of its line's eight 64-bit words an n-gram's level lies in, and its four bits there."""
    own = mixed(keys + _U(level * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
    six, one = _U(63), _U(1)
    bits = (one << ((own >> _U(3)) & six)) | (one << ((own >> _U(9)) & six)) | (one << ((own >> _U(15)) & six)) | (one << ((own >> _U(21)) & six))
    return own & _U(7), bits


def line_of(keys: np.ndarray, lines) -> np.ndarray:
    return ((keys & _U(0xFFFFFFFF)) * np.asarray(lines, dtype=np.uint64)) >> _U(32)


def built(keys: np.ndarray, counts: np.ndarray, entry_bits: int = ENTRY_BITS) -> np.ndarray:
    """A bucket's lines of 512 bits, as many as its entries need, with all levels of the n-grams entered."""
    top = np.frexp(counts.astype(np.float64))[1]  # 1 + floor(log2)
    lines = max(1, -(-int(top.sum()) * entry_bits // 512))
    out = np.zeros(8 * lines, dtype=np.uint64)
    at = line_of(keys, lines) * _U(8)
    for level in range(1, int(top.max(initial=0)) + 1):
        own = top >= level
        word, bits = entry(keys[own], level)
        np.bitwise_or.at(out, (at[own] + word).astype(np.int64), bits)
    return out


def probed(keys: np.ndarray, at: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The level up to which all levels of each key are there, 0 where the first is missing; ``at``: the key's line."""
    found = np.zeros(len(keys), dtype=np.int8)
    left, level = np.arange(len(keys)), 1
    while len(left) and level < LEVELS:
        word, mask = entry(keys, level)
        there = (bits[at + word.astype(np.int64)] & mask) == mask
        keys, at, left = keys[there], at[there], left[there]
        found[left] = level
        level += 1
    return found


class Bloom:
    """A whole filter: its buckets' words one after the other."""

    def __init__(self, parts: list[np.ndarray]):
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.bits = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        self.first, self.lines = np.cumsum(sizes) - sizes, (sizes // 8).astype(np.uint64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        own = bucket_of(keys, len(self.first)).astype(np.int64)
        return probed(keys, self.first[own] + (line_of(keys, self.lines[own]) * _U(8)).astype(np.int64), self.bits)


def build_buckets(counted: DataFrame, entry_bits: int = ENTRY_BITS) -> DataFrame:
    """bucket, its filter's bytes, and for each length and level the number of n-grams and the sum of their counts."""
    import pyarrow as pa

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        length = table["length"].to_numpy()
        every, types, sums = [], np.zeros((2, LEVELS), dtype=np.int64), np.zeros((2, LEVELS), dtype=np.int64)
        for n in (1, 2):
            own = table.filter(pa.array(length == n))
            keys = np.frombuffer(b"".join(own["keys"].to_pylist()), dtype=np.uint64)
            counts = np.frombuffer(b"".join(own["counts"].to_pylist()), dtype=np.int64)
            keys, at = np.unique(keys, return_inverse=True)
            total = np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)
            level = np.frexp(total.astype(np.float64))[1]
            types[n - 1] = np.bincount(level, minlength=LEVELS)[:LEVELS]
            sums[n - 1] = np.bincount(level, weights=total, minlength=LEVELS)[:LEVELS]
            every.append((keys, total))
        bits = built(np.concatenate([k for k, _ in every]), np.concatenate([c for _, c in every]), entry_bits)
        row = [[table["bucket"][0].as_py()], [bits.tobytes()], [types.ravel().tolist()], [sums.ravel().tolist()]]
        return pa.table([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], ["bucket", "bits", "types", "sums"])

    return counted.groupBy("bucket").applyInArrow(build, "bucket int, bits binary, types array<long>, sums array<long>")


def totals(filters: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """The filter's bits, and n-grams and summed counts by length and level, over all buckets."""
    bits = filters.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0] * 8
    each = filters.select(F.posexplode(F.arrays_zip("types", "sums")).alias("at", "x")).groupBy("at").agg(F.sum("x.types").alias("t"), F.sum("x.sums").alias("s"))
    types, sums = np.zeros(2 * LEVELS), np.zeros(2 * LEVELS)
    for at, t, s in each.collect():  # two lengths of LEVELS levels
        types[at], sums[at] = t, s
    return bits, types.reshape(2, LEVELS), sums.reshape(2, LEVELS)


def level_counts(types: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The count that each level stands for: the mean of its n-grams, or the middle of its range where it has none."""
    plain = np.array([0.0, *[(2.0 ** (k - 1) + 2.0**k - 1) / 2 for k in range(1, LEVELS)]])
    return np.where(types > 0, sums / np.maximum(types, 1), plain)


def log_table(types: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """log10 p by the level of the word before, of the word, and of both."""
    words, pairs = level_counts(types[0], sums[0]), level_counts(types[1], sums[1])
    mass, once = sums[0].sum() + 0.5 * (types[0].sum() + 1), types[1][1]
    low, high = 1e-6, 1e18
    for _ in range(200):  # the weight that leaves p(w) grows with T
        middle = (low * high) ** 0.5
        if (sums[0] * middle / (words + middle)).sum() < once:
            low = middle
        else:
            high = middle
    share = (words / (words + low))[:, None, None]
    alone = np.minimum((words + 0.5) / mass, 1.0)[None, :, None]
    of_pair = np.minimum(pairs[None, :], words[:, None])[:, None, :] / np.maximum(words, 1e-300)[:, None, None]
    p = share * of_pair + (1 - share) * alone
    p[0] = alone[0]
    p[:, 0] = alone[:, 0]  # a word that is not counted follows nothing
    return np.log10(np.maximum(p, 1e-300))


# scores


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>"


class Scorer:
    """Sums of texts' tokens, from exact counts of common words, levels of n-grams and log_table()."""

    def __init__(self, common: np.ndarray, counts: np.ndarray, mass: float, logs: np.ndarray):
        self.common, self.logs = common, logs
        self.exact = np.concatenate([np.frexp(counts.astype(np.float64))[1], [0]]).astype(np.int8)
        self.base = np.concatenate([np.log10((counts + 0.5) / mass), [0.0]])
        self.start()

    def start(self) -> None:
        self.known, self.at, self.level = Numbered(), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int8)

    def look_up(self, levels) -> None:
        """Finds for new words their place among the common words (one beyond the last: not there) and their level, which
        comes from the exact count of a common word and from the filter for others."""
        fresh = self.known.hashes[len(self.at) :]
        if len(fresh):
            at = np.searchsorted(self.common, fresh)
            found = self.common[np.minimum(at, len(self.common) - 1)] == fresh if len(self.common) else np.zeros(len(fresh), dtype=bool)
            at[~found] = len(self.common)
            level = self.exact[at]
            level[~found] = levels(word_keys(fresh[~found]))
            self.at, self.level = np.concatenate([self.at, at]), np.concatenate([self.level, level])

    def score(self, column, levels):
        """Arrays n_tokens, n_known, base, score for the texts of a column, and their rare words with owners.

        ``levels`` gives the level of each n-gram key.
        """
        n = len(column)
        n_tokens, n_known = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        base, score = np.zeros(n), np.zeros(n)
        rare, rare_of = [], []
        last = END
        for tokens, starts, owners in token_slices(column):
            if len(self.known) > KEPT:
                self.start()
            numbers = self.known.of([last, *tokens])
            self.look_up(levels)
            level, place = self.level[numbers], self.at[numbers[1:]]
            h, w = level[:-1].astype(np.int64), level[1:].astype(np.int64)
            both = np.zeros(len(h), dtype=np.int64)
            ask = np.flatnonzero((h > 0) & (w > 0))
            hashes = self.known.hashes[numbers]
            both[ask] = levels(pair_keys(hashes[:-1][ask], hashes[1:][ask]))
            both = np.minimum(both, np.minimum(h, w))
            sizes = np.diff([*starts, len(tokens)])
            for out, each in ((n_known, place < len(self.common)), (base, self.base[place]), (score, self.logs[h, w, both])):
                sums = np.concatenate([[0], np.cumsum(each)])
                np.add.at(out, owners, sums[np.add(starts, sizes)] - sums[starts])
            np.add.at(n_tokens, owners, sizes)
            seldom = np.flatnonzero(place == len(self.common))
            rare.append(hashes[1:][seldom])
            rare_of.append(np.repeat(owners, sizes)[seldom])
            last = tokens[-1]
        return n_tokens, n_known, base, score, np.concatenate(rare or [np.empty(0, dtype=np.uint64)]), np.concatenate(rare_of or [np.empty(0, dtype=np.int64)])

    def batch(self, row, doc_id, held_out, column, levels):
        """A record batch of SCORED; the rare words of a text are those whose exact count is still to be added."""
        import pyarrow as pa

        n_tokens, n_known, base, score, rare, rare_of = self.score(column, levels)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rare_of, minlength=len(n_tokens)))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rare.view(np.int64)))
        return pa.RecordBatch.from_arrays([row, doc_id, held_out, *map(pa.array, (n_tokens, n_known, base, score)), lists], [x.split()[0] for x in SCORED.split(", ")])


def scored_with(rows: DataFrame, bloom: Bloom, scorer: tuple) -> DataFrame:
    """SCORED for rows (row, doc_id, held_out, text), by a broadcast filter."""
    import pyarrow as pa

    shared = rows.sparkSession.sparkContext.broadcast((bloom, scorer))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rest = shared.value
        scorer = Scorer(*rest)
        for batch in batches:
            if batch.num_rows:
                yield scorer.batch(*batch.columns, own.levels)

    return rows.select("row", "doc_id", "held_out", "text").mapInArrow(score, SCORED)


def different_keys(column) -> np.ndarray:
    """All different n-gram keys of the texts of a column, sorted."""
    out, known = [], Numbered()
    known.of([END])
    last = END
    for tokens, _, _ in token_slices(column):
        if len(known) > KEPT:
            known = Numbered()
        numbers = known.of([last, *tokens])
        hashes = known.hashes[numbers]
        out.append(np.unique(np.concatenate([word_keys(hashes), pair_keys(hashes[:-1], hashes[1:])])))
        last = tokens[-1]
    return np.unique(np.concatenate(out)) if out else np.empty(0, dtype=np.uint64)


def scored_by_asking(rows: DataFrame, filters: DataFrame, buckets: int, scorer: tuple) -> DataFrame:
    """SCORED for stored rows (row, block, doc_id, held_out, text): blocks of texts ask the buckets for their levels."""
    import pyarrow as pa

    def texts(table: pa.Table):
        return table.column("text").combine_chunks()

    def ask(table: pa.Table) -> pa.Table:
        keys = different_keys(texts(table))
        cut = list(by_bucket(keys, buckets))
        columns = [[b for b, _, _ in cut], [table["block"][0].as_py()] * len(cut), [keys[i:j].tobytes() for _, i, j in cut]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bucket", "block", "keys"])

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        bits = np.frombuffer(own["bits"][0].as_py(), dtype=np.uint64) if own.num_rows else None
        given = []
        for value in asked["keys"].to_pylist():
            keys = np.frombuffer(value, dtype=np.uint64)
            given.append((probed(keys, (line_of(keys, len(bits) // 8) * _U(8)).astype(np.int64), bits) if bits is not None else np.zeros(len(keys), dtype=np.int8)).tobytes())
        return pa.table([asked["block"], asked["bucket"], pa.array(given, pa.binary())], ["block", "bucket", "levels"])

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        column = texts(table)
        keys = different_keys(column)
        order = np.argsort(answers["bucket"].to_numpy())
        given = answers["levels"].to_pylist()
        found = np.frombuffer(b"".join(given[i] for i in order), dtype=np.int8)
        levels = lambda asked: found[np.searchsorted(keys, asked)]
        return pa.Table.from_batches([Scorer(*scorer).batch(*(table[c].combine_chunks() for c in ("row", "doc_id", "held_out")), column, levels)])

    blocks = rows.select("block", "row", "doc_id", "held_out", "text")
    asked = blocks.groupBy("block").applyInArrow(ask, "bucket int, block long, keys binary")
    answers = asked.groupBy("bucket").cogroup(filters.select("bucket", "bits").groupBy("bucket")).applyInArrow(answer, "block long, bucket int, levels binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORED)


def common_words(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the commonest words, ``most`` at most: all from some count on."""
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = dict(words.groupBy(step.alias("s")).count().collect())  # some hundred steps
    least, total = 1 << 20, 0
    for s in sorted(sizes, reverse=True):
        if total + sizes[s] > most:
            break
        least, total = s, total + sizes[s]
    table = words.filter(step >= least).select("word", "n").toArrow()
    hashes, n = table["word"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def lm_scores(docs: DataFrame, common: int = COMMON_WORDS, max_bits: int = MAX_BITS, entry_bits: int = ENTRY_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Needs doc_id and text; other columns are ignored. Null and empty texts are one end token. A null id counts as the
    empty name. Repeated rows are scored, and learnt from, each for itself. Without training documents all counts are
    0 and every token has the base probability 1. ``common`` and ``max_bits`` bound what is broadcast: base_score and
    n_known take the exact count of every word, and score the levels of every n-gram, whatever their values.
    ``entry_bits`` is the room for an entry; with more, the filter errs less.
    """
    spark = docs.sparkSession
    rows = token_rows(docs).withColumn("row", F.monotonically_increasing_id())
    training = rows.filter("NOT held_out")
    words = stored(word_counts(training), "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    mass = float(total + 0.5 * (distinct + 1))
    buckets = max(1, -(-int(total) // BUCKET_TOKENS))
    filters = stored(build_buckets(ngram_counts(training, words, buckets), entry_bits), "filter")
    free(spark)
    bits, types, sums = totals(filters)
    scorer = (*common_words(words, common), mass, log_table(types, sums))
    if bits <= max_bits:
        parts = [np.zeros(8, dtype=np.uint64)] * buckets
        for batch in filters.select("bucket", "bits").toArrow().to_batches():
            for bucket, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts[bucket] = np.frombuffer(own.as_buffer(), dtype=np.uint64)
        bloom = Bloom(parts)
        del parts
        scored = stored(scored_with(rows, bloom, scorer), "scored")
    else:
        placed = stored(rows, "rows")
        size = placed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        blocks = max(1, -(-size // BLOCK_BYTES))
        placed = placed.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("long"))
        scored = stored(scored_by_asking(placed, filters, buckets, scorer), "scored")
        free(spark)
    drop_stored(filters)
    seldom = scored.select("row", F.explode("rare").alias("word")).join(words, "word", "left").groupBy("row").agg(
        F.count("n").alias("known"), F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(mass))).alias("more")
    )
    return scored.join(seldom, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
