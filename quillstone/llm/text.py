"""Vectorised work on many texts at once: words, word hashes and shingle hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Characters that part words: space and U+0009 to U+000D (fixed values).
SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)


class Powers:
    """Powers of the hash's odd base and of its inverse, as far as they are needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up = self._to(int(_MULT) | 1, n)
            self.down = self._to(pow(int(_MULT) | 1, -1, 1 << 64), n)
        return self.up, self.down

    @staticmethod
    def _to(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


POWERS = Powers()


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running sums S with hash(i, j) = (S[j] - S[i]) * base**-i, modulo 2**64."""
    up, _ = POWERS.get(len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=out[1:])
    return out


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer of UTF-8 bytes."""
    edge = np.ones(len(buf) + 2, dtype=bool)
    edge[1:-1] = _IS_SPACE[buf]
    turn = np.flatnonzero(edge[1:] != edge[:-1])
    return turn[::2], turn[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = prefix_hash(buf)
    return mix((sums[ends] - sums[starts]) * POWERS.get(len(buf) + 1)[1][starts])


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, each followed by a line feed, and where each starts (and the end)."""
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8), at


def shingle_hashes(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-word shingles and the number of the text each is from.

    A text of fewer words has one shingle, its whole sequence; one without words none.
    """
    buf, at = joined(texts)
    starts, ends = words(buf)
    h = word_hashes(buf, starts, ends)
    first = np.searchsorted(starts, at)
    count = np.diff(first)
    shingles = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(texts)), shingles)
    if not len(doc):
        return np.zeros(0, dtype=np.uint64), doc
    base = np.concatenate(([0], np.cumsum(shingles)))[:-1]
    pos = np.arange(len(doc)) - base[doc] + first[:-1][doc]
    out = np.zeros(len(doc), dtype=np.uint64)
    last = first[1:][doc]
    for k in range(n):
        there = pos + k < last
        step = np.where(there, h[np.minimum(pos + k, len(h) - 1)], np.uint64(0x5851F42D4C957F2D))
        out = mix(out * _MULT + step)
    return out, doc


#: What this process keeps from task to task, by operator.
KEPT: dict[str, dict] = {}
_last = ""


def begin(operator: str) -> None:
    """A task of ``operator`` begins: what the process, which tasks of all operators use in turn, keeps
    from others is given back to the system."""
    global _last
    if operator == _last:
        return
    _last = operator
    for name, x in KEPT.items():
        if name != operator:
            x.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def pieces(items: Iterable, size, limit: int = _PIECE) -> Iterator[list]:
    """Lists of items whose sizes add up to about ``limit``: the bound on a step's memory."""
    got, total = [], 0
    for x in items:
        got.append(x)
        total += size(x)
        if total >= limit:
            yield got
            got, total = [], 0
    if got:
        yield got
