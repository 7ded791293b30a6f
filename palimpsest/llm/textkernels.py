"""Vectorised text kernels in numpy over Arrow buffers.

A token is a maximal run of ASCII letters and digits and of non-ASCII characters that are neither
spaces nor punctuation, in lower case. Hashes are polynomial in the bytes (random 64-bit value per
byte, modulo 2**64) with a final mix; windows of tokens are hashed the same way over token hashes.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
#: Non-ASCII spaces and punctuation, as the body of a character class.
_PUNCT = [(0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x1680, 0x1680), (0x2000, 0x206F), (0x20A0, 0x20CF), (0x2190, 0x2BFF), (0x2E00, 0x2E7F), (0x3000, 0x3003), (0x3008, 0x3020), (0xFE30, 0xFE4F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20)]
_RE2 = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _PUNCT) + "]"
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xC3, 0xE1, 0xE2, 0xE3, 0xEF]] = True
#: The same tokens, as a pattern over unnormalised text.
TOKEN = re.compile("(?:[0-9A-Za-z]|[^\\x00-\\x7f" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in _PUNCT) + "])+")


def trim() -> None:
    """Give memory that is no longer used back to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to give back by this way
        pass


def thrifty(scan: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """A scan over batches that gives memory back after each batch it takes, and at its end."""

    def run(batches: Iterable) -> Iterator:
        def taken() -> Iterator:
            for batch in batches:
                yield batch
                del batch
                trim()

        yield from scan(taken())
        trim()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _tables[:] = out
    return _tables[0], _tables[1]


def windows(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of values[start:end] for each pair of bounds."""
    n = len(values)
    if not len(start):
        return np.zeros(0, np.uint64)
    p, inv = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * p[:n], out=total[1:])
    return mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))


@dataclass
class Tokens:
    """first: index of each text's first token, and the number of all tokens at the end."""

    hashes: np.ndarray
    first: np.ndarray
    start: np.ndarray  # bytes in the normalised text
    end: np.ndarray
    bytes: np.ndarray
    offsets: np.ndarray

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-token windows and the first window of each text; a shorter text that isn't empty is one window."""
        count = np.diff(self.first)
        have = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
        first = np.zeros(len(have) + 1, np.int64)
        np.cumsum(have, out=first[1:])
        begin = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], have)
        end = np.minimum(begin + n, np.repeat(self.first[1:], have))
        return windows(self.hashes, begin, end), first

    def texts(self) -> np.ndarray:
        """Hash of each text's token sequence; empty texts share one."""
        return windows(self.hashes, self.first[:-1], self.first[1:])


def lowered(texts: pa.Array) -> pa.Array:
    low = pc.utf8_lower(texts)
    _, _, data = low.buffers()
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if _LEADS[raw].any():
        low = pc.replace_substring_regex(low, _RE2, " ")
    return low


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a large_string array without nulls."""
    _, off, data = texts.buffers()
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    o = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return o - o[0], raw[o[0] : o[-1]]


def plain(texts) -> pa.Array:
    """A large_string array; null becomes empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()), "")


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(from, to) rows of about limit bytes each; a longer text is alone."""
    off, _ = buffers(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, to
        at = to


def tokenise(texts: pa.Array, lines: bool = False) -> Tokens:
    """Tokens of each text; with lines, of each line (see line_starts for which)."""
    off, raw = buffers(lowered(texts))
    if lines:
        cut = np.flatnonzero(raw == 10) + 1
        off = np.unique(np.concatenate([off, cut])) if len(cut) else np.unique(off)
        if not len(off):
            off = np.zeros(1, np.int64)
    inside = _WORD[raw]
    change = np.zeros(len(raw) + 1, bool)
    change[1:-1] = inside[1:] != inside[:-1]
    if len(raw):
        change[0] = change[-1] = True
    change[off] = True
    edges = np.flatnonzero(change)
    if len(raw):
        on = inside[edges[:-1]]
        start, end = edges[:-1][on], edges[1:][on]
    else:
        start = end = np.zeros(0, np.int64)
    hashes = windows(_BYTE[raw], start, end)
    return Tokens(hashes, np.searchsorted(start, off), start, end, raw, off)


def per_text(values: np.ndarray, first: np.ndarray, ufunc, empty):
    """ufunc.reduceat over each text's values; empty for texts without any."""
    out = np.full(len(first) - 1, empty, values.dtype)
    have = first[1:] > first[:-1]
    if have.any():
        out[have] = ufunc.reduceat(values, first[:-1][have])
    return out


def permutations(k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 2**31, k).astype(np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 2**32, k, dtype=np.uint32)


def minhash(shingles: np.ndarray, first: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """uint16[texts, k]: low mixed bits of the minima; rows of empty texts are 0."""
    a, b = permutations(k, seed)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    have = first[1:] > first[:-1]
    out = np.zeros((len(first) - 1, k), np.uint16)
    if not have.any():
        return out
    at, h = first[:-1][have], np.empty_like(x)
    low = np.empty((int(have.sum()), k), np.uint32)
    for i in range(k):
        np.multiply(x, a[i], out=h)
        np.add(h, b[i], out=h)
        low[:, i] = np.minimum.reduceat(h, at)
    low = low * np.uint32(0x9E3779B1)
    out[have] = ((low ^ (low >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.uint16)
    return out


def sets(shingles: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Each text's distinct shingles, sorted, as bytes of uint32."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    return [np.unique(x[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]


def jaccard(a: bytes, b: bytes, kind: type = np.uint32) -> float:
    """Exact Jaccard of two sorted sets of hashes; 0 if either is empty."""
    x, y = np.frombuffer(a, kind), np.frombuffer(b, kind)
    if not len(x) or not len(y):
        return 0.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """A binary array of the rows of a two-dimensional array."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    off = pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)[: len(rows) + 1].tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, off, pa.py_buffer(rows.tobytes())])
