"""Substring dedup over words by difference-cover anchors.

Windows of `period` words are hashed only where the word's index in its
document, modulo the period, lies in a difference cover. For any two positions
some shift below the period brings both onto cover positions, so two equal
windows of 2 * period - 1 words always share an aligned anchor. Anchors that two
documents hold select the windows to extend: those windows are compared by a
96-bit hash of all their words, and each is kept in the smallest document only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodegraph.llm import exchange as X, text as T

PERIOD = 7
#: Differences of these residues cover all residues modulo 7.
COVER = (0, 1, 3)
WINDOW = 2 * PERIOD - 1
SHARD_BYTES = 2 << 20


class _Shard:
    def __init__(self, t: pa.Table):
        self.words = T.Words(X.text_of(t))
        self.ids = X.ids_of(t)
        w = self.words
        self.hashes = w.hashes()
        self.valid = T.window_starts(w.at, WINDOW) if len(self.hashes) >= WINDOW else np.zeros(0, bool)
        index = np.arange(len(self.hashes)) - np.repeat(w.at[:-1], w.counts)
        aligned = np.isin(index % PERIOD, COVER)
        fits = T.window_starts(w.at, PERIOD)
        # Texts below a whole window have no use for anchors.
        long = np.repeat(w.counts >= WINDOW, w.counts)
        self.anchor_at = np.flatnonzero(aligned[: len(fits)] & fits & long[: len(fits)])
        self.anchors = T.windows(self.hashes, PERIOD, 5)[self.anchor_at]
        self.doc = self.ids[w.doc] if len(self.ids) else np.zeros(0, np.int64)


def _fingerprints(s: _Shard, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return T.windows(s.hashes, WINDOW, 11)[at], (T.windows(T.mix(s.hashes), WINDOW, 13)[at] >> np.uint64(32)).astype(np.uint32)


def _smallest(origins: list[int], bodies: list[bytes]) -> Iterable[tuple[int, int, bytes]]:
    """To each shard the windows that a document before one of its own holds."""
    sent = [X.unpack(b) for b in bodies]
    a, b, least, most = (np.concatenate([s[k] for s in sent]) for k in range(4))
    order = np.lexsort((b, a))
    new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
    first = np.flatnonzero(new)
    lowest = np.empty(len(a), np.int64)
    lowest[order] = np.repeat(np.minimum.reduceat(least[order], first), np.diff(np.append(first, len(a))))
    at = 0
    for origin, s in zip(origins, sent, strict=True):
        own = slice(at, at + len(s[0]))
        at += len(s[0])
        use = lowest[own] < most[own]
        if use.any():
            yield 0, origin, X.pack(s[0][use], s[1][use], lowest[own][use], ordered=True)


def drop_repeated_words(docs: DataFrame, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove words covered by a 13-word window that starts in a document with a smaller id.

    One row per row: doc_id, n_words, n_removed, kept_sha256 and, if asked for,
    the kept words joined by one space. Null or empty texts have no words. Rows
    with one id are one document; a null id is the last of all. Windows are
    judged on the input. Other columns, whatever their names, are not read. Texts
    are read whole; one has to fit a worker's memory some fifty times over.
    """
    plan = X.Plan(docs, SHARD_BYTES, id_col, text_col)
    bits, n_anchor, n_window = plan.bits, plan.buckets(16 << 20), plan.buckets(8 << 20)

    def anchors(shard: int, t: pa.Table) -> pa.Table:
        s = _Shard(t)
        return X.ballot(shard, X.trim(s.anchors, bits), s.doc[s.anchor_at], n_anchor)

    def candidates(shard: int, t: pa.Table, replies: list[bytes]) -> pa.Table:
        codes, _ = X.result(replies)
        if not len(codes) or not t.num_rows:
            return X.messages([])
        s = _Shard(t)
        hit = s.anchor_at[X.lookup(codes, X.trim(s.anchors, bits)) >= 0]
        near = np.zeros(len(s.valid) + 1, np.int64)  # windows that hold a shared anchor
        low, high = np.maximum(hit - (WINDOW - PERIOD), 0), np.minimum(hit + 1, len(s.valid))
        near += np.bincount(np.minimum(low, len(s.valid)), minlength=len(near)) - np.bincount(high, minlength=len(near))
        at = np.flatnonzero((np.cumsum(near)[:-1] > 0) & s.valid)
        a, b = _fingerprints(s, at)
        order = np.lexsort((b, a))
        a, b, doc = a[order], b[order], s.doc[at][order]
        if not len(a):
            return X.messages([])
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        least, most = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
        a, b = a[first], b[first]
        _, cuts = X.deal(a, n_window)
        return X.messages((k, shard, X.pack(a[p:q], b[p:q], least[p:q], most[p:q], ordered=True)) for k, (p, q) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if q > p)

    def apply(shard: int, t: pa.Table, replies: list[bytes]) -> pa.Table:
        s = _Shard(t)
        w = s.words
        gone = np.zeros(len(s.hashes), bool)
        if replies and len(s.valid):
            a, b, least = (np.concatenate(c) for c in zip(*map(X.unpack, replies), strict=True))
            order = np.argsort(a, kind="stable")
            a, b, least = a[order], b[order], least[order]
            at = np.flatnonzero(s.valid)
            mine, second = _fingerprints(s, at)
            low, high = np.searchsorted(a, mine), np.searchsorted(a, mine, "right")
            start = np.zeros(len(at), bool)
            for k in range(int((high - low).max(initial=0))):  # more than one only if 64 bits collide
                use = np.flatnonzero(low + k < high)
                e = low[use] + k
                start[use] |= (b[e] == second[use]) & (least[e] < s.doc[at[use]])
            gone = T.covered(len(s.hashes), at[start], WINDOW)
        removed = T.sums(gone, w.at)
        buf = w.buf.tobytes()
        sha, texts = [], []
        starts, ends, keep = w.starts.tolist(), w.ends.tolist(), (~gone).tolist()
        for i in range(len(w.counts)):
            p, q = int(w.at[i]), int(w.at[i + 1])
            kept = b" ".join([buf[starts[k] : ends[k]] for k in range(p, q) if keep[k]])
            sha.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept)
        columns = {"doc_id": t.column("id"), "n_words": pa.array(w.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        if with_text:
            columns["kept_text"] = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.table(columns)

    shared = X.answer(plan.send(anchors), X.census)
    windows = X.answer(plan.with_replies(shared, candidates, X.MESSAGE), _smallest)
    return plan.with_replies(windows, apply, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
