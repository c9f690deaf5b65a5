"""Helpers shared by the text operators: word rules, hashes and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import drop_stored, free, shared_dir, stored

__all__ = ["SPACES", "WordHashes", "drop_stored", "free", "fresh_names", "mixed", "shared_dir", "stored", "words_col"]

#: The ASCII white space that separates words: space and \x09-\x0D.
SPACES = " \t\n\x0b\f\r"


def words_col(text) -> "F.Column":
    """The words of a text column as an array, without empty ones."""
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, in any case of letters: the given ones, with underscores before them if need be."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


class WordHashes(dict):
    """64-bit hashes of words, the same on every machine; keeps those of frequent words."""

    KEPT = 250_000

    def __init__(self):
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        value = self.hash(word)
        if len(self) < self.KEPT:
            self[word] = value
        return value

    def of(self, words: list[bytes]):
        import numpy as np

        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h):
    """Spreads the entropy of 64-bit hashes over all their bits."""
    import numpy as np

    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
