"""Small text helpers shared by the operators: byte-level words, 64-bit word
codes and polynomial window hashes (all per document, inside Arrow batches).
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: A-Z to a-z, every other byte unchanged.
LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
#: A-Z to a-z, every other ASCII byte that is no letter or digit to a space.
LOWER_ALNUM = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in LOWER
)

MASK64 = (1 << 64) - 1
#: Odd multiplier of the window polynomial and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def as_bytes(column) -> list[bytes | None]:
    """The UTF-8 bytes of each value of an Arrow string column."""
    return column.cast(pa.binary()).to_pylist()


def words(raw: bytes) -> list[bytes]:
    """`[^\\x20\\x09-\\x0D]+` over UTF-8: bytes.split() cuts at exactly these six."""
    return raw.split()


def release_memory() -> None:
    """Give freed memory back to the system.  Python workers outlive their
    tasks; what their allocators keep would count against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


class WordCodes(dict):
    """word -> XXH64, remembered for the words met most recently.

    ``of`` turns a word list into a uint64 array.  The table is emptied when
    it passes ``limit`` words, so memory is bounded; codes never change."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code

    def of(self, tokens: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive codes: the polynomial
    sum(code[i+j] * BASE**(width-1-j)) modulo 2**64, rolled over the window
    by one multiply-add per position of the window, then mixed."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = codes[:n].copy()
    base = np.uint64(BASE)
    for j in range(1, width):
        h *= base
        h += codes[j:j + n]
    return mix(h)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Boolean array over n positions: inside [s, s + width) of some start."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) > 0
