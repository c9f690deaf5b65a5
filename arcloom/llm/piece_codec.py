"""Exact merge-type (BPE) encoding by backtracking, and decoding, for sentencepiece models.

A text is cut before every run of spaces, which no piece of such a model crosses. In each part, Aho-Corasick gives the
longest piece that starts at a place; a piece may follow another only if merging the two pieces' text anew gives just
these two; if none fits, the search steps back, and a bitfield keeps the places from which no way leads on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Parts kept with their ids in each Python worker; further parts are encoded anew each time they occur.
KEPT_PARTS = 250_000
#: Pairs of pieces kept with whether the second may follow the first.
KEPT_PAIRS = 200_000
#: Parts longer than this are not kept.
KEPT_CHARS = 48


class PieceCodec:
    """Encoder and decoder of one sentencepiece BPE model with byte fallback and an identity normalizer."""

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.library.vocab_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.scores = {p: self.library.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        # single characters always stand for themselves, other pieces only if merging their own text gives them
        reachable = [p for p in self.ids if len(p) == 1 or self.merged(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in reachable:
            self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        by_prefix = set(reachable)
        #: For each piece, the next shorter one that starts it.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in by_prefix), None) for p in reachable}
        self.fits: dict[tuple[str, str], bool] = {}
        self.kept: dict[str, list[int]] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that plain merging gives: the best-scored adjacent pair first, the leftmost of equals."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts):
                both = parts[i] + parts[j]
                if both in self.scores:
                    heapq.heappush(heap, (-self.scores[both], i, j, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or after[i] != j or parts[j] is None or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def follows(self, left: str, right: str) -> bool:
        """Whether merging the text of both anew gives just these two pieces."""
        known = self.fits.get((left, right))
        if known is None:
            known = self.merged(left + right) == [left, right]
            if len(self.fits) < KEPT_PAIRS:
                self.fits[left, right] = known
        return known

    def longest(self, text: str) -> list[str | None]:
        """The longest piece that starts at each place; a character no piece starts with has none."""
        found: list[str | None] = [None] * len(text)
        for end, (back, piece) in self.automaton.iter(text):
            found[end - back] = piece  # ends come in ascending order, so the longest from a start comes last
        return found

    def part(self, text: str) -> list[int]:
        """The ids of one part, by backtracking over longest matches."""
        ids: list[int] = []
        starts = self.longest(text)
        if None not in starts:
            return [self.ids[p] for p in self.stretch(text, starts)]
        at = 0
        while at < len(text):  # stretches between characters outside the vocabulary, which nothing merges with
            if starts[at] is None:
                ids += [self.byte_ids[b] for b in text[at].encode("utf-8", "surrogatepass")]
                at += 1
                continue
            end = at
            while end < len(text) and starts[end] is not None:
                end += 1
            ids += [self.ids[p] for p in self.stretch(text[at:end], starts[at:end])]
            at = end
        return ids

    def stretch(self, text: str, starts: list[str | None]) -> list[str]:
        """Backtracking over one stretch; ``failed`` is the bitfield of places from which no way leads on."""
        failed, at, path, n = None, 0, [], len(text)  # most words need no bitfield
        piece, fits, shorter = starts[0], self.fits, self.shorter
        while at < n:
            last = path[-1] if path else None
            while piece is not None:
                end = at + len(piece)
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    known = True if last is None else fits.get((last, piece))
                    if known or known is None and self.follows(last, piece):
                        break
                piece = shorter[piece]
            if piece is not None:
                path.append(piece)
                at += len(piece)
                piece = starts[at] if at < n else None
            else:
                if not path:
                    return self.merged(text)
                if failed is None:
                    failed = bytearray((n >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                piece = path.pop()
                at -= len(piece)
                piece = shorter[piece]
        return path

    def encode(self, text: str) -> list[int]:
        """All ids of a text, without begin and end; the empty text has none."""
        if not text:
            return []
        ids: list[int] = []
        kept = self.kept
        for word in parts_of(text):
            known = kept.get(word)
            if known is None:
                # equal scores of runs of spaces break the pair rule, so such parts are merged as they are
                known = self.spaced(word) if word.startswith(SPACE * 2) else self.part(word)
                if len(word) <= KEPT_CHARS and len(kept) < KEPT_PARTS:
                    kept[word] = known
            ids += known
        return ids

    def spaced(self, word: str) -> list[int]:
        known = []
        for p in self.merged(word):
            i = self.ids.get(p)
            known += [i] if i is not None else [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
        return known

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def parts_of(text: str) -> Iterable[str]:
    """The text with its leading space mark, cut before every run of space marks."""
    marked = text.replace(SPACE, " ")
    if "  " not in marked and not marked.startswith(" "):
        return [SPACE + w for w in marked.split(" ")]
    import re

    return re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + marked.replace(" ", SPACE))


_codecs: dict[str, PieceCodec] = {}


def codec(model: str) -> PieceCodec:
    """The worker's one codec of a model, kept between batches."""
    if model not in _codecs:
        _codecs[model] = PieceCodec(model)
    return _codecs[model]


def piece_encode(docs: DataFrame, model: str, with_text: bool = True) -> DataFrame:
    """doc_id, ids (begin and end ids included) and the text decoded from them, for every row of ``docs``.

    Needs doc_id and text; other columns are ignored. Null and empty text give the begin and end ids alone, which
    decode to the empty text. One row for each input row, repeated rows and null ids included; no shuffle.
    """
    import pyarrow as pa

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                ids = [[own.bos, *own.encode(t or ""), own.eos] for t in rows.column(1).to_pylist()]
                texts = [own.decode(x) for x in ids] if with_text else [None] * len(ids)
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, ids array<int>, decoded string")


def piece_digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text; the ids never leave the Python worker."""
    import pyarrow as pa

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from array import array
        from hashlib import sha256

        own = codec(model)
        for batch in batches:
            n, by_ids, by_text = [], [], []
            for value in batch.column(1):
                ids = [own.bos, *own.encode(value.as_py() or ""), own.eos]
                n.append(len(ids))
                by_ids.append(sha256(little(array("I", ids))).hexdigest())
                by_text.append(sha256(own.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def little(ids) -> bytes:
    """An array of unsigned 32-bit ids as little-endian bytes."""
    import sys

    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()
