"""Vectorised hashing of the words of many texts, on the UTF-8 bytes of Arrow columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(0x5EED)
_VALUE = _rng.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
_VALUE2 = _rng.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
_BASES = {"bytes": U(0x9E3779B97F4A7C15), "words": U(0xD6E8FEB86659FD93), "bytes2": U(0xA0761D6478BD642F), "words2": U(0xE7037ED1A0B428DB)}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes that aren't ASCII white space, and those of words: ASCII letters, digits, underscore and all non-ASCII.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = False
ALNUM = np.array([c >= 128 or chr(c).isalnum() or c == 95 for c in range(256)])


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base, and those of its inverse, modulo 2^64."""
    have = _powers.get(kind)
    if have is None or len(have[0]) < n:
        base = int(_BASES[kind])
        both = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(max(2 * n, 1 << 16), U(b))
            p[0] = U(1)
            both.append(np.cumprod(p))
        have = _powers[kind] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def give_back() -> None:
    """Return freed memory to the system: a Python worker stays for later tasks, beside others on its machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits without visible structure."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Block(NamedTuple):
    """Words of consecutive rows. bounds[i] to bounds[i + 1] are the words of row first + i."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    total: np.ndarray


def blocks(texts: pa.Array | pa.ChunkedArray, letters: np.ndarray, size: int = 1 << 18) -> Iterator[Block]:
    """Blocks of about size bytes, at least one row each; a null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    bufs = texts.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.empty(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield _block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], letters)
        at = to


def _block(first: int, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> Block:
    n = len(data)
    if not n:
        none = np.empty(0, dtype=np.int64)
        return Block(first, data, offsets, none, none, np.zeros(len(offsets), dtype=np.int64), np.empty(0, dtype=U), np.zeros(1, dtype=U))
    word = letters[data]
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    begins[edge] = word[edge]
    stops[edge - 1] = word[edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = powers("bytes", n)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum(_VALUE[data] * up, out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    return Block(first, data, offsets, starts, ends, np.searchsorted(starts, offsets), hashes, total)


def span_hashes(block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes; that of a whole word is block.hashes."""
    down = powers("bytes", len(block.data))[1]
    return mix((block.total[ends] - block.total[starts]) * down[starts])


def bytes_of(block: Block, start: int, end: int) -> bytes:
    return block.data[start:end].tobytes()


def second_hashes(block: Block) -> np.ndarray:
    """Hashes of the words by other values and another base."""
    up, down = powers("bytes2", len(block.data))
    total = np.zeros(len(block.data) + 1, dtype=U)
    np.cumsum(_VALUE2[block.data] * up, out=total[1:])
    return mix((total[block.ends] - total[block.starts]) * down[block.starts])


class Rolling:
    """Hashes of word windows of any length in a block; second: by hashes that are independent of the first."""

    def __init__(self, block: Block, second: bool = False):
        n, hashes = len(block.hashes), second_hashes(block) if second else block.hashes
        up, self.down = powers("words2" if second else "words", n + 1)
        self.total = np.zeros(n + 1, dtype=U)
        np.cumsum(hashes * up[:n], out=self.total[1:])
        self.bounds = block.bounds

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.down[starts] + (ends - starts).astype(U))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of k words within a row, and the windows' hashes."""
        n = len(self.total) - 1
        if n < k:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=U)
        per_row = np.maximum(np.diff(self.bounds) - k + 1, 0)
        starts = np.repeat(self.bounds[:-1] - (np.cumsum(per_row) - per_row), per_row) + np.arange(per_row.sum())
        return starts, self.spans(starts, starts + k)


def pack(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as variable-length differences."""
    d = np.diff(values, prepend=U(0))
    n = np.ones(len(d), dtype=np.int64)
    for k in range(1, 10):
        more = d >= U(1 << (7 * k))
        if not more.any():
            break
        n += more
    at = np.cumsum(n) - n
    out = np.empty(int(n.sum()), dtype=np.uint8)
    for k in range(int(n.max(initial=0))):
        m = n > k
        out[at[m] + k] = ((d[m] >> U(7 * k)) & U(127)).astype(np.uint8) | ((n[m] > k + 1).astype(np.uint8) << 7)
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return np.empty(0, dtype=U)
    last = np.flatnonzero(b < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.cumsum(np.add.reduceat((b & 127).astype(U) << (place * 7).astype(U), first), dtype=U)
