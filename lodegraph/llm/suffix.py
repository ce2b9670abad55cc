"""Suffix-array dedup of repeated byte strings.

Every window of `LENGTH` bytes has one anchor: the leftmost smallest hash among
its shorter grams, which depends on the window's bytes alone. Windows in a row
with the same anchor form a block; equal windows lie in blocks of equal anchors,
so blocks whose anchor no second document holds are set aside, and the others
are dealt by anchor. A bucket of blocks is cut into shards; each gets a suffix
array by Larsson-Sadakane refinement, Kasai common prefixes group its equal
windows, and the sorted runs of the shards are merged by binary search. What
comes back to a document is, for each window, the smallest document holding it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodegraph.llm import exchange as X, text as T

LENGTH = 50
GRAM = 24
SHARD_BYTES = 2 << 20
#: Text of the blocks that one suffix array covers; positions take 21 bits of a sort key.
ARRAY_BYTES = 1 << 20
#: Windows of an anchor that more documents than this hold are dealt one by one.
HOT_DOCUMENTS = 2_000
#: Text that is hashed at a time.
PIECE_BYTES = 1 << 18
_SEED = 3
_CODES = T.byte_codes(_SEED)
_POS = np.uint64(21)
_MASK = np.uint64((1 << 21) - 1)


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Positions of all suffixes in the order of their first `depth` bytes, zero bytes past the end.

    Larsson-Sadakane: suffixes are sorted by a short prefix, then only groups
    that are still tied are sorted again, by the rank of the suffix as many
    bytes further, which doubles the depth. One sort key holds group, rank and
    position, so that a round is a single sort of 64-bit numbers.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    head, h = np.zeros(n, np.uint64), 5
    for k in range(h):
        head = (head << np.uint64(8)) | padded[k : k + n]
    keys = np.sort((head << _POS) | np.arange(n, dtype=np.uint64))
    order = (keys & _MASK).astype(np.int64)
    new = np.append(True, (keys[1:] >> _POS) != (keys[:-1] >> _POS))
    rank = np.zeros(n + depth, np.uint64)  # the group's first slot and one; 0 past the end

    def settle(slots: np.ndarray, fresh: np.ndarray) -> None:
        begins = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank[order[slots]] = (begins + 1).astype(np.uint64)

    settle(np.arange(n), new)
    while h < depth:
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        step = min(h, depth - h)
        at = order[slots]
        group = np.cumsum(new[slots]).astype(np.uint64)
        keys = np.sort((group << np.uint64(42)) | (rank[at + step] << _POS) | at.astype(np.uint64))
        order[slots] = (keys & _MASK).astype(np.int64)
        fresh = np.append(True, (keys[1:] >> _POS) != (keys[:-1] >> _POS))
        new[slots] = fresh
        settle(slots, fresh)
        h += step
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, start: np.ndarray, first: np.ndarray, count: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Common prefix, up to depth, of each chosen suffix with the chosen one before it.

    order: the chosen suffixes as sorted; start: mask of the chosen positions,
    runs of `count` of them from `first`. Kasai: going one position on loses at
    most one byte, if the partner's next suffix is a chosen one too and the two
    differ within the depth (else their next suffixes may sort either way). All
    runs are walked side by side; bytes are compared eight at a time.
    """
    n = len(text)
    before = np.full(n + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    lcp = np.zeros(n + 1, np.int64)
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(padded) - 7,), (1,))
    chosen = np.append(start, [False, False])
    height, partner = np.zeros(len(first), np.int64), np.full(len(first), -1, np.int64)
    room = n - depth  # suffixes before it are at least `depth` bytes long
    for k in range(int(count.max(initial=0))):
        lanes = np.flatnonzero(count > k)
        at = first[lanes] + k
        other, last = before[at], partner[lanes]
        h = np.where((last >= 0) & chosen[last + 1] & (height[lanes] < depth), np.maximum(height[lanes] - 1, 0), 0)
        live = np.flatnonzero(other >= 0)
        for width, table in ((8, eights), (1, padded)):
            go = live[h[live] + width <= depth]
            while len(go):
                go = go[table[at[go] + h[go]] == table[other[go] + h[go]]]
                h[go] += width
                go = go[h[go] + width <= depth]
        over = live[np.maximum(at[live], other[live]) > room]
        h[over] = np.minimum(h[over], n - np.maximum(at[over], other[over]))
        lcp[at] = h
        height[lanes], partner[lanes] = h, other
    return lcp[order]


class _Shard:
    """Blocks of the documents of a shard, found in pieces that stay in a CPU's cache."""

    def __init__(self, t: pa.Table):
        self.buf, self.offsets = T.buffers(X.text_of(t))
        self.ids = X.ids_of(t)
        found, p, n = [], 0, len(self.ids)
        while p < n:
            q = max(p + 1, int(np.searchsorted(self.offsets, self.offsets[p] + PIECE_BYTES, "right")) - 1)
            found.append(self._blocks(int(self.offsets[p]), int(self.offsets[q]), self.offsets[p + 1 : q] - self.offsets[p]))
            p = q
        self.first, self.count, self.anchor, self.key = (np.concatenate(c) for c in zip(*found, strict=True)) if found else _none()
        self.doc = self.ids[np.searchsorted(self.offsets, self.first, "right") - 1]

    def _blocks(self, low: int, high: int, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first window, number of windows, anchor's hash, hash of the bytes) of the blocks in buf[low:high]; texts end at `ends`."""
        buf = self.buf[low:high]
        n = len(buf)
        size = n - LENGTH + 1
        if size <= 0:
            return _none()
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[buf] * T._power(T._P, n), out=total[1:])
        inverse = T._power(T._PINV, n + 1)
        grams = (total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1]
        grams = T.mix(grams)
        mask = np.uint64(0xFFFFFFFF)
        best = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
        span, width = 1, LENGTH - GRAM + 1
        while span * 2 <= width:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        at = (np.minimum(best[:size], best[width - span : width - span + size]) & mask).astype(np.int64)
        change = np.flatnonzero(at[1:] != at[:-1]) + 1
        # Windows that reach over a text's end belong to no block.
        fences = np.unique(np.concatenate([np.maximum(ends - LENGTH + 1, 0), np.minimum(ends, size)]))
        first = np.unique(np.concatenate([np.zeros(1, np.int64), change, fences[fences < size]]))
        last = np.append(first[1:], size)
        reach = np.searchsorted(ends, first, "right")  # the text of the first window
        stop = np.append(ends, n)[reach]
        use = first + LENGTH <= stop
        first, count = first[use], (last - first)[use]
        # Smallest hashes are small numbers: mixed again, they deal evenly.
        return first + low, count, T.mix(grams[at[first]]), T.mix((total[first + count + LENGTH - 1] - total[first]) * inverse[first] + (count + LENGTH - 1).astype(np.uint64))

    def choose(self, found: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window, windows, document, key, code that deals it) of the blocks with shared anchors (found: entry of each anchor or -1); hot ones window by window."""
        use = np.flatnonzero(found >= 0)
        cold = use[~hot[found[use]]]
        warm = self.single(use[hot[found[use]]])
        return tuple(np.concatenate(c) for c in zip((self.first[cold], self.count[cold], self.doc[cold], self.key[cold], self.anchor[cold]), warm, strict=True))

    def single(self, blocks: np.ndarray) -> tuple[np.ndarray, ...]:
        """The windows of these blocks as blocks of their own, dealt by their bytes."""
        n = self.count[blocks]
        begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = np.repeat(begin, n) + step
        key = T.window_hashes(_gather(self.buf, self.first[blocks], n + LENGTH - 1), own, own + LENGTH, _SEED)
        return np.repeat(self.first[blocks], n) + step, np.ones(len(own), np.int64), np.repeat(self.doc[blocks], n), key, key


def _none() -> tuple[np.ndarray, ...]:
    return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def _gather(buf: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return buf[np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _runs(texts: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One shard: (window positions sorted, group of each, first position of each group, smallest owner of each group)."""
    begin = np.cumsum(sizes) - sizes
    count = sizes - (LENGTH - 1)
    start = np.zeros(len(texts), bool)
    at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
    start[at] = True
    order = suffix_array(texts)
    order = order[start[order]]
    lcp = common_prefixes(texts, order, start, begin, count)
    new = np.flatnonzero(np.append(True, lcp[1:] < LENGTH))
    of = np.zeros(len(texts), np.int64)
    of[at] = np.repeat(owner, count)
    least = np.minimum.reduceat(of[order], new)
    group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
    return order, group, order[new], least


def _strings(texts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Windows as comparable fixed strings; the last byte keeps zero bytes from being cut off."""
    rows = np.ones((len(at), LENGTH + 1), np.uint8)
    rows[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(texts, LENGTH)[at]
    return np.ascontiguousarray(rows).view(f"S{LENGTH + 1}").reshape(-1)


def _smallest(texts: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Smallest owner of each window of each block, in block order."""
    cuts, ends = [0], np.cumsum(sizes)
    while cuts[-1] < len(sizes):
        done = ends[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, done + ARRAY_BYTES, "right"))))
    parts, runs = [], []
    for p, q in zip(cuts[:-1], cuts[1:], strict=True):
        low = int(ends[p - 1]) if p else 0
        own = texts[low : int(ends[q - 1])]
        runs.append(_runs(own, sizes[p:q], owner[p:q]))
        parts.append(own)
    if len(runs) > 1:
        # Each run is sorted: a window's place in another one is found by binary search.
        named = [_strings(t, r[2]) for t, r in zip(parts, runs, strict=True)]
        merged, value = named[0], runs[0][3].copy()
        for strings, run in zip(named[1:], runs[1:], strict=True):
            place = np.minimum(np.searchsorted(merged, strings), len(merged) - 1)
            same = merged[place] == strings
            value[place[same]] = np.minimum(value[place[same]], run[3][same])
            into = np.searchsorted(merged, strings[~same])
            merged, value = np.insert(merged, into, strings[~same]), np.insert(value, into, run[3][~same])
        for strings, run in zip(named, runs, strict=True):
            run[3][:] = value[np.searchsorted(merged, strings)]
    out = []
    for (order, group, _, least), own in zip(runs, parts, strict=True):
        value = np.zeros(len(own), np.int64)
        seen = np.zeros(len(own), bool)
        value[order], seen[order] = least[group], True
        out.append(value[seen])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _answer(origins: list[int], bodies: list[bytes]) -> Iterable[tuple[int, int, bytes]]:
    sent = [X.unpack(b) for b in bodies]
    sizes = np.concatenate([s[1] for s in sent]).astype(np.int64) + LENGTH
    keys = np.concatenate([s[0] for s in sent])
    low, high = np.concatenate([s[2] for s in sent]), np.concatenate([s[3] for s in sent])
    texts = np.concatenate([s[4] for s in sent])
    # Blocks of equal bytes from different shards stand once in the text.
    order, first = X.by_key(keys)
    which = np.empty(len(keys), np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    begin = np.cumsum(sizes) - sizes
    wrong = np.flatnonzero(~T.same_spans(texts, begin, begin + sizes, order[first][which]))
    which[wrong] = len(first) + np.arange(len(wrong))  # keys may collide: such blocks stand by themselves
    order, first = X.by_key(which)
    one = order[first]
    least = _smallest(_gather(texts, begin[one], sizes[one]), sizes[one], np.minimum.reduceat(low[order], first))
    count = sizes[one] - (LENGTH - 1)
    at, cut = 0, np.cumsum(count) - count
    for origin, s in zip(origins, sent, strict=True):
        own = which[at : at + len(s[0])]
        mine = high[at : at + len(s[0])]
        at += len(s[0])
        n = count[own]
        values = least[np.repeat(cut[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        smaller = np.minimum.reduceat(values, np.cumsum(n) - n) < mine
        if smaller.any():
            yield 0, origin, X.pack(n[smaller].astype(np.uint8), values[np.repeat(smaller, n)], s[5][smaller], s[6][np.repeat(smaller, s[5])])


def drop_repeated_bytes(docs: DataFrame, with_spans: bool = False, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove bytes covered by a 50-byte string that starts in a document with a smaller id.

    One row per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 and, if asked for, the spans' starts and ends and the remaining
    bytes, also as a text without characters that were cut; `carry` names columns to hand on as carry_0, carry_1 and so on. Null counts as empty. Rows with one id are one document; a null id is
    the last of all. Strings never cross documents and are judged on the input.
    Columns not named, whatever they are called, are not read. Texts are read whole;
    one has to fit a worker's memory some hundred times over.
    """
    plan = X.Plan(docs, SHARD_BYTES, id_col, text_col, carry)
    n_anchor, n_block = plan.buckets(16 << 20), plan.buckets(2 << 20)
    bits, hot_documents = plan.bits, HOT_DOCUMENTS

    def anchors(shard: int, t: pa.Table) -> pa.Table:
        s = _Shard(t)
        return X.ballot(shard, X.trim(s.anchor, bits), s.doc, n_anchor)

    def blocks(shard: int, t: pa.Table, replies: list[bytes]) -> pa.Table:
        codes, held = X.result(replies)
        if not len(codes) or not t.num_rows:
            return X.messages([])
        s = _Shard(X.in_order(t))
        first, count, doc, key, deal = s.choose(X.lookup(codes, X.trim(s.anchor, bits)), held > hot_documents)
        order, new = X.by_key(key)
        if not len(new):
            return X.messages([])
        which = np.empty(len(key), np.int64)
        which[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
        wrong = np.flatnonzero(~T.same_spans(s.buf, first, first + count + (LENGTH - 1), order[new][which]))
        which[wrong] = len(new) + np.arange(len(wrong))  # keys may collide: such blocks stand by themselves
        order, new = X.by_key(which)
        one, times = order[new], np.diff(np.append(new, len(order)))
        low, high = np.minimum.reduceat(doc[order], new), np.maximum.reduceat(doc[order], new)
        bucket, _ = X.deal(deal[one], n_block)
        by = np.lexsort((key[one], bucket))
        one, low, high, bucket, times = one[by], low[by], high[by], bucket[by], times[by]
        # Where each block stands in this shard's texts, in order: the answer brings it back, so that texts needn't be cut into blocks again.
        upto = np.append(0, np.cumsum(times))
        places = first[order][np.repeat(new[by] - upto[:-1], times) + np.arange(len(order))].astype(np.uint32)
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        return X.messages(
            (
                int(bucket[p]), shard,
                X.pack(
                    key[one[p:q]], (count[one[p:q]] - 1).astype(np.uint8), low[p:q], high[p:q], _gather(s.buf, first[one[p:q]], count[one[p:q]] + (LENGTH - 1)),
                    times[p:q].astype(np.uint32), places[upto[p] : upto[q]], ordered=True,
                ),
            )
            for p, q in zip(cuts, np.append(cuts[1:], len(one)), strict=True)
        )

    def apply(shard: int, t: pa.Table, replies: list[bytes]) -> pa.Table:
        t = X.in_order(t)
        buf, offsets = T.buffers(X.text_of(t))
        gone = np.zeros(len(buf), bool)
        marks = []
        for body in replies:
            size, values, times, places = X.unpack(body)
            size, times, places = size.astype(np.int64), times.astype(np.int64), places.astype(np.int64)
            block = np.repeat(np.arange(len(size)), times)
            doc = ids_[np.searchsorted(offsets, places, "right") - 1] if len(ids_ := X.ids_of(t)) else places
            k = size[block]
            step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            value = values[np.repeat((np.cumsum(size) - size)[block], k) + step]
            marks.append((np.repeat(places, k) + step)[value < np.repeat(doc, k)])
        if marks:
            gone = T.covered(len(buf), np.unique(np.concatenate(marks)), LENGTH)
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = gone[offsets[:-1][np.diff(offsets) > 0]]
        kept = buf[~gone].tobytes()
        cut = np.concatenate([[0], np.cumsum(~gone)])[offsets]
        rest = [kept[p:q] for p, q in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        columns = {
            "doc_id": t.column("id"), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(T.sums(gone, offsets), pa.int64()),
            "n_spans": pa.array(T.sums(begins, offsets), pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in rest], pa.string()),
        }
        if with_spans:
            stops = gone.copy()
            stops[:-1] &= ~gone[1:]
            final = offsets[1:][np.diff(offsets) > 0] - 1
            stops[final] = gone[final]
            for name, where in (("span_starts", np.flatnonzero(begins)), ("span_ends", np.flatnonzero(stops) + 1)):
                own = np.searchsorted(np.flatnonzero(begins), offsets)
                base = np.repeat(offsets[:-1], np.diff(own))
                columns[name] = pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(where - base, pa.int32()))
            columns["kept"] = pa.array(rest, pa.binary())
            columns["kept_text"] = pa.array([x.decode("utf-8", "ignore") for x in rest], pa.string())
        columns |= {f"carry_{k}": t.column(f"carry_{k}") for k in range(len(carry))}
        return pa.table(columns)

    shared = X.answer(plan.send(anchors), X.census)
    windows = X.answer(plan.with_replies(shared, blocks, X.MESSAGE), _answer)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", span_starts array<int>, span_ends array<int>, kept binary, kept_text string" * with_spans
    schema += "".join(f", carry_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    return plan.with_replies(windows, apply, schema)
