"""Arrow text columns as byte buffers, and vectorised 64-bit hashes of spans.

Tasks read texts as Arrow batches and work on slices of a few megabytes of
bytes (a longer text forms a slice of its own), so memory does not depend on
the batch size. Spans are hashed eight bytes at a time, all spans together;
each step multiplies and mixes, so the hash has no algebraic structure that
texts could repeat (a polynomial mod 2**64 gives a Thue-Morse word and its
complement one value, whatever its base)."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20


def trim() -> None:
    """Hand freed memory back to the system; idle Python workers then hold
    little. Does nothing where the C library has no such call."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Lower case of the bytes A-Z, all others as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Longer spans are hashed one by one.
SPAN_BYTES = 512
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)
_SEED, _STRIDE = U(0xD6E8FEB86659FD93), U(0x9E3779B97F4A7C15)
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


class Slice:
    """Consecutive rows: ``start`` row in its batch, joined bytes ``data`` and
    ``offsets`` (one more than rows). Null texts are empty."""

    __slots__ = ("start", "data", "offsets")

    def __init__(self, start: int, data: np.ndarray, offsets: np.ndarray):
        self.start, self.data, self.offsets = start, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    a = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(a):
        return
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    at = 0
    while at < len(a):
        to = int(np.searchsorted(off, off[at] + size, "right")) - 1
        to = min(max(to, at + 1), len(a))
        yield Slice(at, data[off[at]:off[to]], off[at:to + 1] - off[at])
        at = to


def text_batches(batches, size: int = SLICE_BYTES, col: str = "text"):
    """(record batch, slice of it) pairs, in order."""
    for b in batches:
        for s in slices(b.column(col), size):
            yield b, s


class SpanHash:
    """Hashes of byte spans of one buffer; with ``lower`` A-Z count as a-z."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        self.data = np.zeros(len(data) + 8, np.uint8)
        self.data[:len(data)] = LOWER[data] if lower else data
        # the eight bytes from every place on, as one number
        self.eight = np.ndarray((len(data) + 1,), "<u8", self.data, strides=(1,))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = mix(size.astype(U) * _SEED + U(1))
        live = np.flatnonzero(size <= SPAN_BYTES)
        at, left, h = start[live], size[live], out[live]
        while len(live):
            h = mix((h ^ (self.eight[at] & _KEEP[np.minimum(left, 8)])) * _STRIDE)
            done = left <= 8
            out[live[done]] = h[done]
            on = ~done
            live, at, left, h = live[on], at[on] + 8, left[on] - 8, h[on]
        for i in np.flatnonzero(size > SPAN_BYTES).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[start[i]:end[i]], digest_size=8).digest(), "little")
        return out


def words(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of a slice, and
    each row's first word index (one more than rows)."""
    w = IS_WORD[s.data]
    if not len(w):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(s) + 1, np.int64)
    start = w.copy()
    start[1:] &= ~w[:-1]
    end = w.copy()
    end[:-1] &= ~w[1:]
    inner = s.offsets[(s.offsets > 0) & (s.offsets < len(w))]
    start[inner] = w[inner]
    end[inner - 1] = w[inner - 1]
    st, en = np.flatnonzero(start), np.flatnonzero(end) + 1
    return st, en, np.searchsorted(st, s.offsets)


_STEP = mix(np.arange(11, 16, dtype=U))


def shingle_sets(s: Slice, size: int = 5) -> list[np.ndarray]:
    """Per row: the sorted distinct hashes of its shingles of ``size`` words
    (A-Z lower-cased); with fewer words the whole sequence is one shingle."""
    st, en, first = words(s)
    h = SpanHash(s.data, lower=True)(st, en) if len(st) else np.empty(0, U)
    n = len(h)
    full = np.zeros(max(n - size + 1, 0), dtype=U)
    for k in range(size):
        full += h[k:n - size + 1 + k] * (_STEP[k] | U(1)) if len(full) else U(0)
    full = mix(full)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(full[a:b - size + 1]))
        elif b > a:
            part = (h[a:b] * (_STEP[:b - a] | U(1))).sum(dtype=U) + U(b - a)
            out.append(mix(np.array([part], dtype=U)))
        else:
            out.append(np.empty(0, U))
    return out
