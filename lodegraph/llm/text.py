"""Vectorised text primitives over Arrow batches: bytes, words, hashes, sharding.

A batch of strings is one byte buffer with offsets. Nothing here loops over
characters in Python; every helper works on a whole slice of documents.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Spans of more bytes are hashed by a digest.
DIGESTED = 2048
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.ones(size, U64)
        k, b = 1, base
        while k < size:
            have[k : 2 * k] = have[:k] * U64(b)
            b = b * b % (1 << 64)
            k *= 2
        _powers[base] = have
    return have[:n]


def window_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of byte spans by one prefix sum. It is linear, so that long regular spans may collide: only for spans of up to a hundred bytes."""
    n = len(buf)
    total = np.zeros(n + 1, U64)
    np.cumsum(byte_codes(seed)[buf] * _power(_P, n), out=total[1:])
    inverse = _power(_PINV, n + 1)
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.lib.stride_tricks.as_strided(padded[:8].view(U64), (len(buf) + 1,), (1,))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of every byte span [start, end): eight bytes at a time through the mixer, long spans by a digest."""
    sizes = ends - starts
    out = mix(sizes.astype(U64) * U64(0xD1342543DE82EF95) + U64(seed + 1))
    eights = _eights(buf)
    lanes, at, left, h = None, starts, sizes, out
    for _ in range(DIGESTED // 8):
        chunk = eights[at] & _LOW[np.minimum(left, 8)]
        h = mix((h ^ chunk) * U64(_P))
        if lanes is None:
            out = h
        else:
            out[lanes] = h
        go = np.flatnonzero(left > 8)
        if not len(go):
            return out
        lanes = go if lanes is None else lanes[go]
        at, left, h = at[go] + 8, left[go] - 8, h[go]
    for k in lanes.tolist():
        digest = hashlib.blake2b(buf[starts[k] : ends[k]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        out[k] = U64(int.from_bytes(digest, "little"))
    return out


def same_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span holds the bytes of the span other[i]."""
    same = ends - starts == (ends - starts)[other]
    eights = _eights(buf)
    lanes = np.flatnonzero(same & (starts != starts[other]))
    a, b, left = starts[lanes], starts[other[lanes]], (ends - starts)[lanes]
    while len(lanes):
        differ = ((eights[a] ^ eights[b]) & _LOW[np.minimum(left, 8)]) != 0
        same[lanes[differ]] = False
        go = np.flatnonzero(~differ & (left > 8))
        if 0 < len(go) < 8:  # the rest of a few long spans
            for k in lanes[go].tolist():
                same[k] = np.array_equal(buf[starts[k] : ends[k]], buf[starts[other[k]] : ends[other[k]]])
            break
        lanes, a, b, left = lanes[go], a[go] + 8, b[go] + 8, left[go] - 8
    return same


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one span of each distinct content, content of each span), by hash and then byte by byte."""
    _, where, inverse = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    wrong = np.flatnonzero(~same_spans(buf, starts, ends, where[inverse])) if len(where) else where
    if len(wrong):
        fresh: dict[bytes, int] = {}
        extra = []
        for k in wrong.tolist():
            raw = buf[starts[k] : ends[k]].tobytes()
            if raw not in fresh:
                fresh[raw] = len(where) + len(extra)
                extra.append(k)
            inverse[k] = fresh[raw]
        where = np.append(where, extra)
    return where, inverse


@cache
def _own_pages() -> None:
    """Let a worker's large arrays come from pages of their own and go back to the system when
    freed (glibc's M_MMAP_THRESHOLD and M_TRIM_THRESHOLD), so that idle workers stay small."""
    if TaskContext.get() is not None:
        with contextlib.suppress(OSError, AttributeError):
            for option in (-3, -1):
                ctypes.CDLL(None).mallopt(option, 4 << 20)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    _own_pages()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the text exceeds `limit` bytes; a longer text stays alone."""
    sizes = np.diff(buffers(batch.column(column))[1])
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), limit, "right")))
        yield batch.slice(at, n)
        at += n


def batched(it: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    for batch in it:
        yield from slices(batch, column, limit)


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of each text of a slice; they never cross texts."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.buf, self.offsets = buffers(column)
        if lower:
            self.buf = LOWER[self.buf]
        n = len(self.buf)
        inside = ~SEPARATOR[self.buf]
        first = np.zeros(n + 1, bool)
        first[self.offsets[:-1]] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (first[:n] | ~before))
        follows = np.zeros(n, bool)
        follows[:-1] = inside[1:]
        final = np.zeros(n, bool)
        bound = self.offsets[1:]
        final[bound[bound > 0] - 1] = True
        self.ends = np.flatnonzero(inside & (final | ~follows)) + 1
        self.at = np.searchsorted(self.starts, self.offsets)  # words of text i: at[i]..at[i+1]
        self.counts = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends, seed)

    def code_points(self) -> np.ndarray:
        """Code points of each word."""
        total = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum((self.buf & 0xC0) != 0x80, out=total[1:])
        return total[self.ends] - total[self.starts]


def windows(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Rolling hash of every n consecutive items (len - n + 1 of them)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, U64)
    total = np.zeros(size, U64)
    for k in range(n):
        total *= U64(_P)
        total += hashes[k : k + size]
    return mix(total + U64(seed))


def window_starts(at: np.ndarray, n: int) -> np.ndarray:
    """Mask over item positions where a window of n items stays in its text."""
    size = max(0, int(at[-1]) - n + 1)
    good = np.ones(size, bool)
    counts = np.diff(at)
    for k in range(1, n):
        cut = at[1:][counts > 0] - k
        good[cut[(cut >= 0) & (cut < size)]] = False
    return good


def covered(size: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Mask of the positions inside [s, s + length) for any s."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, starts, 1) if len(starts) < 64 else step.__iadd__(np.bincount(starts, minlength=size + 1))
    ends = np.minimum(starts + length, size)
    step -= np.bincount(ends, minlength=size + 1)
    return np.cumsum(step[:size]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur twice or more."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.zeros(len(keys), bool)
    if len(keys) > 1:
        equal = ordered[1:] == ordered[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    out = np.zeros(len(keys), bool)
    out[order[same]] = True
    return out


def in_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Make equal hashes of different texts differ."""
    return mix(hashes + doc.astype(U64) * U64(0xA24BAED4963EE407))


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values[at[i]:at[i+1]] for each i, empty ranges included."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    total = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
