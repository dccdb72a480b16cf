"""Vectorised text kernels over Arrow buffers.

All of them work on the UTF-8 bytes of a whole column at once: one byte buffer and the
documents' offsets in it. The byte-level arrays are made a window at a time, so that memory
does not depend on how long a document is; what remains per document is one 64-bit hash a word.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 18
_M64 = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_C1, _C2, _C3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_pow: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + _C3
    x ^= x >> np.uint64(30)
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd constant modulo 2**64, and their inverses."""
    if len(_pow.get("p", ())) < n:
        n = max(n, WINDOW + 1)
        for name, base in (("p", _P), ("q", pow(_P, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _pow[name] = np.multiply.accumulate(x)
    return _pow["p"], _pow["q"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, o, d = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(o, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def of_texts(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [x if isinstance(x, bytes) else (x or "").encode("utf-8", "surrogatepass") for x in texts]
    offs = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) for x in raw], out=offs[1:])
    return np.frombuffer(b"".join(raw), np.uint8), offs


def _windows(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Windows of about WINDOW bytes that cut no word."""
    s, end = 0, len(buf)
    while s < end:
        e = min(s + WINDOW, end)
        step = WINDOW
        while e < end:
            cut = offs[np.searchsorted(offs, e, "right") - 1]
            white = np.flatnonzero(_SPACE[buf[max(s, e - step) : e]])
            cut = max(cut, max(s, e - step) + white[-1] + 1 if len(white) else s)
            if cut > s:
                e = int(cut)
                break
            step = WINDOW
            e = min(e + WINDOW, end)
        yield s, e
        s = e


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, number of words of each document)."""
    hashes, starts = [], []
    buf, offs = buf[offs[0] : offs[-1]], offs - offs[0]
    for s, e in _windows(buf, offs):
        part = buf[s:e]
        n = len(part)
        p, q = powers(n + 1)
        w = ~_SPACE[part]
        first, last = w.copy(), w.copy()
        first[1:] &= ~w[:-1]
        last[:-1] &= ~w[1:]
        lo, hi = np.searchsorted(offs, [s, e])
        d = offs[lo:hi] - s
        first[d] = w[d]
        d = d[d > 0]
        last[d - 1] = w[d - 1]
        a, z = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER[part].astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
        hashes.append(mix((total[z] - total[a]) * q[a]))
        starts.append(a + s)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(max(0, len(offs) - 1), np.int64)
    at = np.concatenate(starts)
    return np.concatenate(hashes), np.diff(np.searchsorted(at, offs))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indexes starts[i] .. starts[i] + counts[i] - 1 of all i, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def shingles(h: np.ndarray, counts: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of n words, number of them of each document); a document of fewer words,
    but one at least, has one run, of all its words."""
    many = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    begin = np.cumsum(counts) - counts
    c, _ = powers(n + 1)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    run = np.zeros(len(h), np.uint64)
    for j in range(n):
        run += padded[j : j + len(h)] * c[j + 1]
    out = run[ragged(begin, many)]
    at = np.cumsum(many) - many
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        own = h[begin[i] : begin[i] + counts[i]]
        out[at[i]] = np.sum(own * c[1 : len(own) + 1], dtype=np.uint64) + np.uint64(len(own))
    return mix(out), many


def doc_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def byte_ngrams(buf: np.ndarray, offs: np.ndarray, sizes: tuple[int, ...], dim: int, table: np.ndarray = _LOWER) -> np.ndarray:
    """Counts of hashed byte n-grams, a row of dim buckets for each document. table maps each byte to its class."""
    n_docs = len(offs) - 1
    buf, offs = buf[offs[0] : offs[-1]], offs - offs[0]
    out = np.zeros((n_docs, dim), np.float32)
    most = max(sizes)
    for s in range(0, len(buf), WINDOW):
        e = min(s + WINDOW, len(buf))
        part = table[buf[s : min(e + most - 1, len(buf))]].astype(np.uint32)
        lo, hi = np.searchsorted(offs, s, "right") - 1, np.searchsorted(offs, e, "left")
        cuts = np.clip(offs[lo : hi + 1], s, e) - s
        doc = np.repeat(np.arange(hi - lo), np.diff(cuts))
        left = np.repeat(offs[lo + 1 : hi + 1] - s, np.diff(cuts)) - np.arange(e - s)
        acc = np.zeros(e - s, np.uint32)
        grams = np.zeros((hi - lo) * dim, np.int64)
        for n in range(1, most + 1):
            fits = np.arange(e - s) + n <= len(part)
            tail = part[n - 1 : n - 1 + e - s]
            acc[: len(tail)] = acc[: len(tail)] * np.uint32(0x01000193) + tail + np.uint32(n)
            if n in sizes:
                ok = fits & (left >= n)
                x = acc[ok]
                x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                x ^= x >> np.uint32(13)
                grams += np.bincount(doc[ok] * dim + (x % np.uint32(dim)), minlength=len(grams))
        out[lo:hi] += grams.reshape(hi - lo, dim)
    return out


def slices(buf: np.ndarray, offs: np.ndarray, most_docs: int = 1024, most_bytes: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents with not more than most_docs documents, nor most_bytes bytes unless it is one document."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(n, i + most_docs, max(i + 1, int(np.searchsorted(offs, offs[i] + most_bytes, "right")) - 1))
        yield i, j
        i = j


class HashIndex:
    """Position of each of some 64-bit keys in the array given, -1 for other keys; a few gathers a key."""

    def __init__(self, keys: np.ndarray):
        self.levels, left = [], np.arange(len(keys))
        shift = 0
        while len(left):
            bits = max(4, int(len(left)).bit_length() + 1)
            slot = self._slot(keys[left], bits, shift)
            table = np.full(1 << bits, -1, np.int64)
            table[slot] = left  # the last of those in one slot stays
            self.levels.append((bits, shift, table))
            left = left[table[slot] != left]
            shift += 1
        self.keys = np.concatenate([keys, np.zeros(1, np.uint64)])
        self.n = len(keys)

    @staticmethod
    def _slot(keys: np.ndarray, bits: int, shift: int) -> np.ndarray:
        x = keys if not shift else mix(keys + np.uint64(shift))
        return (x >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -1, np.int64)
        todo = np.arange(len(x))
        for bits, shift, table in self.levels:
            own = x[todo]
            at = table[self._slot(own, bits, shift)]
            hit = (at >= 0) & (self.keys[at] == own)
            out[todo[hit]] = at[hit]
            todo = todo[~hit & (at >= 0)]  # an empty slot ends the search
        return out
