"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

Texts become words of letters and digits, lower-cased. Every item has a 64-bit
SimHash of its weighted shingles. Documents are read in windows of an item's own
number of words, at every start, and a shorter document is one window; a window that holds no shingle of an item of that
length is dissimilar to all of them and is passed over, the others get a SimHash. Fingerprints are cut into
blocks: if two are within the radius, some block differs in at most
radius // blocks bits, so all block values that close to an item's are indexed
and no fingerprint within the radius is missed. Candidates are verified by exact
weighted Jaccard similarity of the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodegraph.llm import text as T

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_FOLD = np.where(_WORD, T.LOWER, 32).astype(np.uint8)
#: Text of the items that are matched in one pass over the documents.
BLOCK_BYTES = 1 << 20
BITS = np.arange(64, dtype=np.uint64)


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    radius: int = 15
    blocks: int = 4


def _words(column: pa.Array) -> T.Words:
    buf, offsets = T.buffers(column)
    folded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(_FOLD[buf].tobytes())])
    return T.Words(folded)


def simhash(codes: np.ndarray, weights: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit SimHash of the weighted shingles begin[i]..end[i] (none of them empty); weights count in steps of 2**-32, so that sums are exact."""
    out = np.zeros(len(begin), np.uint64)
    mixed, steps = T.mix(codes), np.rint(weights * 2.0**32).astype(np.int64)
    total = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(steps, out=total[1:])
    half = total[end] - total[begin]
    for bit in BITS:
        np.cumsum(np.where((mixed >> bit) & np.uint64(1), steps, 0), out=total[1:])
        out |= (2 * (total[end] - total[begin]) > half).astype(np.uint64) << bit
    return out


def _shingles(column: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, shingles of the texts with words, where each of those begins): shorter texts are one shingle."""
    w = _words(column)
    hashes, n = w.hashes(), w.counts[w.counts > 0]
    begin, sizes = w.at[:-1][w.counts > 0], np.minimum(s.words, n)
    count = n - sizes + 1
    at = np.concatenate([[0], np.cumsum(count)])
    codes = np.zeros(int(at[-1]), np.uint64)
    of = np.repeat(np.arange(len(count)), count)
    place = np.repeat(begin, count) + np.arange(len(of)) - np.repeat(at[:-1], count)
    for size in np.unique(sizes):
        own = sizes[of] == size
        codes[own] = T.windows(hashes, int(size), int(size))[place[own]]
    return w.counts, codes, at


def _holders(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles ascending, texts that hold each)."""
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    pairs = np.unique(np.stack([codes, of.astype(np.uint64)], 1), axis=0) if len(of) else np.zeros((0, 2), np.uint64)
    return np.unique(pairs[:, 0], return_counts=True)


class Items:
    """The items of one block, indexed for search. shared: shingles of several items over all blocks, and how many hold each."""

    def __init__(self, ids: list[int], texts: list[str], s: Settings, shared: tuple[np.ndarray, np.ndarray] | None = None):
        self.s = s
        n, self.codes, self.at = _shingles(pa.array(texts, pa.string()), s)
        self.length = n[n > 0]
        self.ids = np.array(ids, np.int64)[n > 0]
        self.size = np.minimum(s.words, self.length)
        count = np.diff(self.at)
        of = np.repeat(np.arange(len(count)), count)
        # A shingle weighs less the more items have it; one of no item weighs 1.
        self.known, held = _holders(self.codes, self.at)
        self.weighed, held = (self.known, held) if shared is None else shared
        self.weight = 1 / held
        self.prints = simhash(self.codes, self.weigh(self.codes), self.at[:-1], self.at[1:]) if len(count) else np.zeros(0, np.uint64)
        self.lengths, rank = np.unique(self.length, return_inverse=True)
        self.by_length = [np.unique(self.codes[rank[of] == k]) for k in range(len(self.lengths))]
        width = 64 // s.blocks
        self.kind = np.uint32 if width + len(self.lengths).bit_length() <= 32 else np.uint64
        near = [0]
        for k in range(1, s.radius // s.blocks + 1):
            near += [sum(1 << b for b in bits) for bits in combinations(range(width), k)]
        near_ = np.array(near, np.uint64)
        self.index = []
        for b in range(s.blocks):
            value = (self.prints >> np.uint64(b * width)) & np.uint64((1 << width) - 1)
            reach = ((value[:, None] ^ near_[None, :]) | (rank.astype(np.uint64) << np.uint64(width))[:, None]).reshape(-1).astype(self.kind)
            item = np.repeat(np.arange(len(value), dtype=np.int32), len(near_))
            order = np.argsort(reach, kind="stable")
            self.index.append((reach[order], item[order]))

    def weigh(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.weighed, codes), max(len(self.weighed) - 1, 0))
        return np.where(self.weighed[at] == codes, self.weight[at], 1.0) if len(self.weighed) else np.ones(len(codes))

    def search(self, prints: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all fingerprints within the radius, among items of the length given with each."""
        width = 64 // self.s.blocks
        rank = np.searchsorted(self.lengths, lengths).astype(np.uint64) << np.uint64(width)
        found = []
        for b, (reach, item) in enumerate(self.index):
            value = (((prints >> np.uint64(b * width)) & np.uint64((1 << width) - 1)) | rank).astype(self.kind)
            low, high = np.searchsorted(reach, value), np.searchsorted(reach, value, "right")
            n = high - low
            window = np.repeat(np.arange(len(prints)), n)
            entry = item[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            same = self.length[entry] == lengths[window]
            found.append(np.stack([window[same], entry[same]], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        distance = np.bitwise_count(prints[pairs[:, 0]] ^ self.prints[pairs[:, 1]])
        keep = distance <= self.s.radius
        return pairs[keep, 0], pairs[keep, 1], distance[keep].astype(np.int32)

    def similarity(self, codes: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's shingles and an item's, as multisets."""
        own = self.codes[self.at[item] : self.at[item + 1]]
        every, where = np.unique(np.concatenate([codes, own]), return_inverse=True)
        a, b = np.bincount(where[: len(codes)], minlength=len(every)), np.bincount(where[len(codes) :], minlength=len(every))
        weight = self.weigh(every)
        return float((weight * np.minimum(a, b)).sum() / (weight * np.maximum(a, b)).sum())

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, float, int]]:
        """(text, item id, first word, Hamming distance, similarity, words) of the best window of each pair."""
        if not len(self.ids):
            return
        w = _words(column)
        hashes = w.hashes()
        grams, hits = {}, {}
        for size in np.unique(self.size).tolist():
            good = np.flatnonzero(T.window_starts(w.at, size))
            grams[size] = T.windows(hashes, size, size)
            codes = grams[size][good]
            hits[size] = good[self.known[np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)] == codes]
        best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        for length, own in zip(self.lengths.tolist(), self.by_length, strict=True):
            size = min(self.s.words, length)
            at, gram = hits[size], grams[size]
            at = at[own[np.minimum(np.searchsorted(own, gram[at]), len(own) - 1)] == gram[at]]
            first, last = w.at[w.doc[at]], w.at[w.doc[at] + 1]
            if not len(at):
                continue
            # All starts of item-sized windows around each shingle, in runs; both ends of them ascend.
            # A text shorter than the item is one window.
            width = np.minimum(length, last - first)
            low, high = np.maximum(first, at - (length - size)), np.minimum(at, last - width)
            fresh = np.flatnonzero(np.append(True, low[1:] > high[:-1] + 1))
            low, high = low[fresh], high[np.append(fresh[1:], len(high)) - 1]
            count = width[fresh] - size + 1
            span, n = high - low + count, high - low + 1
            offset = np.cumsum(span) - span
            codes = gram[np.repeat(low - offset, span) + np.arange(span.sum())]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start, begin = np.repeat(low, n) + step, np.repeat(offset, n) + step
            end = begin + np.repeat(count, n)
            window, item, distance = self.search(simhash(codes, self.weigh(codes), begin, end), np.full(len(start), length))
            for k, i, d in zip(window.tolist(), item.tolist(), distance.tolist(), strict=True):
                value = self.similarity(codes[begin[k] : end[k]], i)
                key, doc = (int(w.doc[start[k]]), i), int(w.doc[start[k]])
                if value >= self.s.similarity and (key not in best or (-value, int(start[k] - w.at[doc])) < (-best[key][0], best[key][1])):
                    best[key] = value, int(start[k] - w.at[doc]), d, int(end[k] - begin[k]) + size - 1
        for (doc, i), (value, first_word, d, words) in sorted(best.items()):
            yield doc, int(self.ids[i]), first_word, d, value, words


Block = tuple[tuple[int, ...], tuple[str, ...], Settings, tuple[bytes, bytes] | None]


@lru_cache(maxsize=2)
def _items(ids: tuple[int, ...], texts: tuple[str, ...], s: Settings, shared: tuple[bytes, bytes] | None) -> Items:
    return Items(list(ids), list(texts), s, shared and (np.frombuffer(shared[0], np.uint64), np.frombuffer(shared[1], np.int64)))


def _shared(items: DataFrame, s: Settings) -> tuple[bytes, bytes]:
    """Shingles that several items hold, ascending, and how many do."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.batched(it, "text"):
            codes, held = _holders(*_shingles(batch.column("text"), s)[1:])
            yield pa.RecordBatch.from_pydict({"code": pa.array(codes.view(np.int64)), "n": pa.array(held.astype(np.int64))})

    got = items.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    codes, held = (got.column(c).to_numpy() for c in ("code", "n"))
    order = np.argsort(codes.view(np.uint64))
    return codes[order].tobytes(), held[order].tobytes()


def _blocks(benchmark: DataFrame, s: Settings) -> Iterator[Block]:
    """What a pass over the documents needs: items by blocks of about BLOCK_BYTES of text, and the shingles that items of any block share."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(-(-total // BLOCK_BYTES)) or 1
    shared = _shared(items, s) if n > 1 else None
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()
        yield tuple(own.column("item_id").to_pylist()), tuple(own.column("text").to_pylist()), s, shared


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, hamming, similarity): documents with an item in them.

    One row for each row of `docs` and item that match, at the most similar
    window (the first of equal ones). Null or empty texts and items match
    nothing, nor do items with a null id; rows of equal items each match; a null
    doc_id is carried along. Items are read in blocks of bounded size, all rows
    against each; a text with fewer words than an item is one window of its own
    length, which n_words gives. Other columns, whatever their names, are not read.
    Texts are read whole; one has to fit a worker's memory some fifty times over.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, first_word long, n_words long, hamming int, similarity double"
    out = None
    for block in _blocks(benchmark, settings or Settings()):

        def run(it: Iterator[pa.RecordBatch], block: tuple = block) -> Iterator[pa.RecordBatch]:
            index = _items(*block)
            for batch in T.batched(it, "text"):
                found = list(index.matches(batch.column("text")))
                rows, item, first, distance, value, words = zip(*found, strict=True) if found else ([], [], [], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(item, pa.int64()), pa.array(first, pa.int64()), pa.array(words, pa.int64()), pa.array(distance, pa.int32()), pa.array(value, pa.float64())],
                    names=["doc_id", "item_id", "first_word", "n_words", "hamming", "similarity"],
                )

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def without_items(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns whatever their names, in which no item is found; null and empty texts stay, repeated rows go or stay together."""
    for block in _blocks(benchmark, settings or Settings()):

        def run(it: Iterator[pa.RecordBatch], block: tuple = block) -> Iterator[pa.RecordBatch]:
            index = _items(*block)
            for batch in T.batched(it, text_col):
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in index.matches(batch.column(text_col))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
