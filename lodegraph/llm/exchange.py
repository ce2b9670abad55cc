"""Exchange of packed number columns between shards of text and hash buckets.

Documents are dealt to shards of a few MB by a hash of id and text. A shard sends
what it knows about its items as one row per bucket, a bucket answers with one
row per shard. All rows are compressed columns of numbers, so the shuffle moves
few, dense rows; a hot item counts once a shard however often it occurs there.
As both shards and buckets grow in number with the input, a row holds fewer items
the larger it is: from STEADY_BYTES on both also grow in size, by its square root
and up to MOST_TIMES, so that rows stay as dense as memory allows.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

#: Id that stands for a null one: such rows count as one last document.
NULL_ID = (1 << 63) - 1
_SQUEEZE, _EXPAND = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
MESSAGE = "bucket int, origin int, body binary"
STEADY_BYTES, MOST_TIMES = 64 << 30, 4.0


def times_larger(size: int) -> float:
    """How much larger shards and buckets are for an input of `size` bytes than for a small one."""
    return min(MOST_TIMES, max(1.0, (size / STEADY_BYTES) ** 0.5))


def pack(*columns: np.ndarray | bytes, ordered: bool = False) -> bytes:
    """Columns of numbers as byte planes, compressed. ordered: the first one ascends and is sent as differences."""
    parts = []
    for k, column in enumerate(columns):
        if isinstance(column, bytes):
            column = np.frombuffer(column, np.uint8)
        column = np.ascontiguousarray(column)
        if k == 0 and ordered and len(column):
            column = np.concatenate([column[:1], column[1:] - column[:-1]])
        width = column.dtype.itemsize
        planes = column.view(np.uint8).reshape(-1, width).T.tobytes()
        parts.append(struct.pack("<2sIB", column.dtype.str[1:].encode(), len(column), k == 0 and ordered) + planes)
    return _SQUEEZE.compress(b"".join(parts))


def unpack(body: bytes) -> list[np.ndarray]:
    raw = _EXPAND.decompress(body)
    at, out = 0, []
    while at < len(raw):
        kind, n, ordered = struct.unpack_from("<2sIB", raw, at)
        at += struct.calcsize("<2sIB")
        dtype = np.dtype(kind.decode())
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at)
        at += n * dtype.itemsize
        column = np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).reshape(n)
        out.append(np.cumsum(column, dtype=dtype) if ordered else column)
    return out


def messages(rows: Iterable[tuple[int, int, bytes]]) -> pa.Table:
    rows = list(rows)
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "origin": pa.array([r[1] for r in rows], pa.int32()), "body": pa.array([r[2] for r in rows], pa.binary())})


def deal(codes: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each 64-bit hash by its top bits, so that hashes ascend with buckets; cuts after sorting)."""
    bucket = ((codes >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    return bucket.astype(np.int64), np.searchsorted(bucket, np.arange(n_buckets + 1))


def trim(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Hashes cut to their top bits, for a filter: collisions only let more through."""
    return hashes & np.uint64(((1 << bits) - 1) << (64 - bits))


class Plan:
    """Documents dealt to shards; numbers of shards and buckets, and bits that a filter's hashes need, for their size."""

    def __init__(self, docs: DataFrame, shard_bytes: int, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str | Column, ...] = ()):
        self.rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *((F.col(c) if isinstance(c, str) else c).alias(f"carry_{k}") for k, c in enumerate(carry)))
        got = self.rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
        self.bytes, self.count = int(got.b or 0), int(got.n)
        self.bits = min(64, self.bytes.bit_length() + 10)
        self.shards = max(1, -(-self.bytes // int(shard_bytes * times_larger(self.bytes))))
        # By id and text: rows without an id, or with one and the same, don't all meet in one shard.
        shard: Column = F.pmod(F.xxhash64("id", "text"), F.lit(self.shards)).cast("int")
        self.dealt = self.rows.select(shard.alias("shard"), "*")

    def buckets(self, per: int) -> int:
        return max(1, -(-self.bytes // int(per * times_larger(self.bytes))))

    def send(self, f: Callable[[int, pa.Table], pa.Table], schema: str = MESSAGE) -> DataFrame:
        """f(shard, its documents) for every shard."""
        return self.dealt.groupBy("shard").applyInArrow(lambda key, t: f(key[0].as_py(), t), schema)

    def with_replies(self, replies: DataFrame, f: Callable[[int, pa.Table, list[bytes]], pa.Table], schema: str) -> DataFrame:
        """f(shard, its documents, the bodies of the replies to it); replies without documents are left out."""

        def run(key: tuple[pa.Scalar, ...], t: pa.Table, r: pa.Table) -> pa.Table:
            return f(key[0].as_py(), t, r.column("body").to_pylist())

        return self.dealt.groupBy("shard").cogroup(replies.groupBy("origin")).applyInArrow(run, schema)


def answer(sent: DataFrame, f: Callable[[list[int], list[bytes]], Iterable[tuple[int, int, bytes]]]) -> DataFrame:
    """f(origins, bodies) of every bucket -> rows (bucket, origin, body)."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        return messages(f(t.column("origin").to_pylist(), t.column("body").to_pylist()))

    return sent.groupBy("bucket").applyInArrow(run, MESSAGE)


def census(origins: list[int], bodies: list[bytes]) -> Iterable[tuple[int, int, bytes]]:
    """Answer for messages (hashes ascending, documents of the shard that hold each): to
    each shard those of its hashes that two documents hold, and how many do."""
    sent = [unpack(b) for b in bodies]
    codes = np.concatenate([s[0] for s in sent])
    held = np.concatenate([s[1] for s in sent]).astype(np.int64)
    order, first = by_key(codes)
    size = np.diff(np.append(first, len(codes)))
    total = np.empty(len(codes), np.int64)
    total[order] = np.repeat(np.add.reduceat(held[order], first) if len(first) else held[:0], size)
    at = 0
    for origin, s in zip(origins, sent, strict=True):
        own = slice(at, at + len(s[0]))
        at += len(s[0])
        keep = total[own] > 1
        if keep.any():
            yield 0, origin, pack(s[0][keep], np.minimum(total[own][keep], 2**32 - 1).astype(np.uint32), ordered=True)


def ballot(shard: int, keys: np.ndarray, docs: np.ndarray, n: int) -> pa.Table:
    """Messages for census() from the hashes of a shard and the document of each."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    fresh = np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]))[: len(keys)]
    keys = keys[fresh]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    held = np.diff(np.append(first, len(keys))).astype(np.uint32)
    keys = keys[first]
    _, cuts = deal(keys, n)
    return messages((b, shard, pack(keys[s:e], held[s:e], ordered=True)) for b, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if e > s)


def result(replies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(shared hashes ascending, documents that hold each) from the replies of census()."""
    parts = [unpack(b) for b in replies]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    codes, held = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(codes)
    return codes[order], held[order]


def lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in an ascending table, -1 where it is missing."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def by_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts the keys, first index of each distinct key in that order)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, np.int64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys ascending, a place of each, number of the distinct one at each place): np.unique() by a sort that needn't keep the order of equals."""
    order = np.argsort(keys)
    ordered = keys[order]
    fresh = np.append(True, ordered[1:] != ordered[:-1])[: len(keys)]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(fresh) - 1
    return ordered[fresh], order[fresh], inverse


def in_order(table: pa.Table) -> pa.Table:
    """Documents by id and text: a shuffle hands them over in any order, each time in another one, and places in a shard's text depend on it."""
    return table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")]))


def ids_of(table: pa.Table) -> np.ndarray:
    column = table.column("id").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.int64())
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def spare(df: DataFrame, name: str) -> str:
    """`name`, or with underscores after it a name that `df` has no column of."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def text_of(table: pa.Table) -> pa.Array:
    column = table.column("text").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    return column
