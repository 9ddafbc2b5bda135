"""Helpers shared by the corpus operators: table reading, shared-folder tables, hashing of words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..session import materialize, ship

__all__ = ["breaks_but", "materialize", "mix64", "partition_count", "place_hashes", "read_table", "shingle_hashes", "word_hashes", "word_places"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partition_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------------------------------
# Words of byte texts, many texts at a time

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: White space as the word rule sees it: space and 0x09-0x0D.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20240611)
_BYTE_KEYS = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.zeros(0, dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    """_STEP ** 0 .. n-1 modulo 2**64."""
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 64, 2 * len(_powers)), _STEP, dtype=np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def word_places(texts: list[bytes], breaks: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all texts as bytes, A-Z lower-cased; where each word starts; where it ends; number of words of each text).

    Words are runs of bytes that `breaks` does not mark; the space must be marked.
    """
    buf = np.frombuffer(b" ".join(texts).translate(_LOWER) + b" ", dtype=np.uint8)
    space = breaks[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    counts = np.diff(np.searchsorted(starts, np.cumsum(lens), side="left"), prepend=0)
    return buf, starts, ends, counts


def word_hashes(texts: list[bytes], breaks: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word in order, number of words of each text); A-Z is lower-cased."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    buf, starts, ends, counts = word_places(texts, breaks)
    return place_hashes(buf, starts, ends, breaks), counts


def place_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, breaks: np.ndarray = _IS_SPACE) -> np.ndarray:
    """64-bit hashes of the words that word_places found."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    word_bytes = np.flatnonzero(~breaks[buf])
    first = np.cumsum(size) - size
    offset = np.arange(len(word_bytes)) - np.repeat(first, size)
    powers = _power_table(int(size.max()) + 1)
    sums = np.add.reduceat(_BYTE_KEYS[buf[word_bytes]] * powers[offset], first)
    return mix64(sums + size.astype(np.uint64))


def breaks_but(*ranges: tuple[int, int]) -> np.ndarray:
    """Marks of the bytes that end a word: all below 0x80 outside `ranges` (both ends included)."""
    out = np.zeros(256, dtype=bool)
    out[:0x80] = True
    for first, last in ranges:
        out[first : last + 1] = False
    return out


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; fewer words make one run; no words make none."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        out = np.array([n], dtype=np.uint64) * _STEP
        for k in range(n):
            out = mix64(out ^ words[k : k + 1])
        return out
    out = np.full(n - width + 1, width, dtype=np.uint64) * _STEP
    for k in range(width):
        out = mix64(out ^ words[k : n - width + 1 + k])
    return out
