"""Byte-level BPE: boundaries by transition-function scans, cached pair merging.

Pre-tokenisation is a finite automaton over code-point classes. Every character
is a function from states to states; composing functions is associative, so a
blocked scan yields all states without a regex: functions are composed inside
blocks (one column of all blocks at a time), the block results are scanned, and
each block is replayed from its now known first state. A character then starts
a slice or not by its class and the state before it. Distinct slices are merged
once by rank and cached; the slices' offsets carry over to the token offsets,
from which decoding gathers the bytes again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodegraph.llm import text as T, unicode as U

# States before a character.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_BLANK, IN_SPACE, ONE_LEFT, TWO_LEFT = range(8)
# Classes of characters. GLUE: a blank right before a non-space; EDGE: another
# space there; SHORT and LONG: an apostrophe with a one- or two-letter ending.
OTHER, LETTER, NUMBER, SPACE, GLUE, EDGE, SHORT, LONG, FIRST = range(9)

#: Distinct slices that a worker keeps merged; beyond that it starts anew.
CACHE_SLICES = 200_000
#: Longer slices are merged one by one and not kept.
LONG_SLICE = 48
NO_RANK = 1 << 30
BLOCK = 64


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether the character starts a slice) by class and state."""
    step = np.zeros((8, 8), np.uint8)
    start = np.zeros((8, 8), bool)
    for state in range(8):
        for kind, inside in ((OTHER, IN_OTHER), (LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS)):
            step[kind, state] = inside
            start[kind, state] = state not in (inside, AFTER_BLANK)
        step[SPACE, state], start[SPACE, state] = IN_SPACE, state != IN_SPACE
        step[GLUE, state], start[GLUE, state] = AFTER_BLANK, True
        step[EDGE, state], start[EDGE, state] = FRESH, True
        for kind, left in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
            goes_on = state in (IN_OTHER, AFTER_BLANK)
            step[kind, state] = IN_OTHER if goes_on else left
            start[kind, state] = not goes_on
    step[:, ONE_LEFT], start[:, ONE_LEFT] = FRESH, False
    step[:, TWO_LEFT], start[:, TWO_LEFT] = ONE_LEFT, False
    return step, start


STEP, START = _automaton()


def _classes(cps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Class of each character; first: mask of the characters that begin a text."""
    kind = U.classes()[cps]
    out = np.array([OTHER, LETTER, NUMBER, SPACE], np.uint8)[kind]
    n = len(cps)
    ahead = np.full((3, n + 1), -1, np.int64)  # the next characters in the same text
    upto = ~first
    for k in range(2):
        prior = cps if k == 0 else ahead[0, :n]
        ahead[k, : n - 1] = np.where(upto[1:], prior[1:n], -1)
    after = ahead[0, :n]
    solid = np.zeros(n, bool)
    solid[:-1] = upto[1:] & (kind[1:] != U.SPACE)
    edge = (kind == U.SPACE) & solid
    out[edge] = np.where(cps[edge] == 0x20, GLUE, EDGE)
    mark = np.flatnonzero(cps == 0x27)
    if len(mark):
        a, b = after[mark], ahead[1, mark]
        out[mark[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT
        for x, y in ("re", "ve", "ll"):
            out[mark[(a == ord(x)) & (b == ord(y))]] = LONG
    return out


def boundaries(cps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mask of the characters that start a slice; slices never cross texts."""
    n = len(cps)
    if not n:
        return np.zeros(0, bool)
    kind = _classes(cps, first)
    # A text's first character forgets the state before it.
    width = -(-n // BLOCK)
    padded = np.zeros(width * BLOCK, np.uint8)
    padded[:n] = kind
    forget = np.zeros(width * BLOCK, bool)
    forget[:n] = first
    padded, forget = np.ascontiguousarray(padded.reshape(width, BLOCK).T), np.ascontiguousarray(forget.reshape(width, BLOCK).T)
    step = np.stack([STEP, np.repeat(STEP[:, :1], 8, 1)])  # as it is, and from FRESH only
    code = padded + 8 * forget
    step = step.reshape(16, 8)
    composed = np.tile(np.arange(8, dtype=np.uint8), (width, 1))
    flat = step.reshape(-1)
    for row in code:
        composed = flat[row.astype(np.int32)[:, None] * 8 + composed]
    begin = _prefix(composed)
    state = begin
    before = np.empty((BLOCK, width), np.uint8)
    for k, row in enumerate(code):
        before[k] = state
        state = flat[row.astype(np.int32) * 8 + state]
    before = before.T.reshape(-1)[:n]
    return START[kind, before] | first


def _prefix(functions: np.ndarray) -> np.ndarray:
    """State before each block, from FRESH, by doubling compositions."""
    n = len(functions)
    total, gap = functions.copy(), 1
    while gap < n:
        total[gap:] = np.take_along_axis(total[gap:], total[:-gap], 1)
        gap *= 2
    return np.concatenate([[FRESH], total[:-1, FRESH]]).astype(np.uint8)


def _spread(keys: np.ndarray, size: int) -> np.ndarray:
    return (T.mix(keys.view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


class Ranks:
    """Merge ranks from a file of base64 tokens and numbers."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.rank.values()) + 1
        lengths = np.zeros(size, np.int64)
        tokens = [b""] * size
        for token, i in self.rank.items():
            tokens[i], lengths[i] = token, len(token)
        self.lengths = lengths
        self.begin = np.concatenate([[0], np.cumsum(lengths)])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.byte_pairs: np.ndarray | None = None
        self.table: tuple[np.ndarray, np.ndarray] | None = None
        self.cache: dict[bytes, tuple[bytes, bytes]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one slice: always the lowest rank next, leftmost first."""
        rank = self.rank
        whole = rank.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        right = list(range(1, n + 1))  # end of the part that begins here
        left = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n + [False]
        while heap:
            _, i, end = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if j >= n or right[j] != end:
                continue
            alive[j] = False
            right[i] = end
            if end < n:
                left[end] = i
                if (r := rank.get(piece[i : right[end]])) is not None:
                    heapq.heappush(heap, (r, i, right[end]))
            if (k := left[i]) >= 0 and (r := rank.get(piece[k:end])) is not None:
                heapq.heappush(heap, (r, k, end))
        return [rank[piece[i : right[i]]] for i in range(n) if alive[i]]

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Open-addressed table of the pairs of tokens that join to a token: keys and ranks."""
        if self.table is None:
            rank = self.rank
            found = [(a << 32 | b, r) for t, r in rank.items() for k in range(1, len(t)) if (a := rank.get(t[:k])) is not None and (b := rank.get(t[k:])) is not None]
            keys, ranks_ = (np.array(x, np.int64) for x in zip(*found, strict=True))
            size = 1 << (4 * len(keys)).bit_length()
            table, value = np.full(size, -1, np.int64), np.zeros(size, np.int64)
            place = _spread(keys, size)
            left = np.arange(len(keys))
            while len(left):
                free = left[table[place[left]] < 0]
                table[place[free]], value[place[free]] = keys[free], ranks_[free]
                left = left[table[place[left]] != keys[left]]
                place[left] = (place[left] + 1) & (size - 1)
            self.table = table, value
        return self.table

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, NO_RANK if they don't join."""
        table, value = self._pairs()
        key = left << 32 | right
        place = _spread(key, len(table))
        have = table[place]
        rank = np.where(have == key, value[place], NO_RANK)
        open_ = np.flatnonzero((have != key) & (have >= 0))
        while len(open_):
            place[open_] = (place[open_] + 1) & (len(table) - 1)
            have = table[place[open_]]
            hit = have == key[open_]
            rank[open_[hit]] = value[place[open_[hit]]]
            open_ = open_[~hit & (have >= 0)]
        return rank

    def merge_all(self, text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many short slices at once, without merge()'s look at the whole slice.

        text: their bytes, end to end. In each round every slice joins its lowest
        pair, the leftmost of equal ones; only the pairs beside it are looked up
        again. Returns (tokens, cuts): tokens of slice i are cuts[i] .. cuts[i + 1].
        """
        n = len(sizes)
        token, word = self.single[text], np.repeat(np.arange(n), sizes)
        rank = np.full(len(token), NO_RANK, np.int64)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self._bytes()[text[inside].astype(np.int64) << 8 | text[inside + 1]]
        done_token, done_word = [], []
        while len(token):
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank << 32 | np.arange(len(token)), begin)
            joins = low >> 32 < NO_RANK
            if not joins.all():
                stays = np.repeat(joins, np.diff(np.append(begin, len(token))))
                done_token.append(token[~stays])
                done_word.append(word[~stays])
                at = (np.cumsum(stays) - 1)[low[joins] & 0xFFFFFFFF]
                token, word, rank = token[stays], word[stays], rank[stays]
            else:
                at = low & 0xFFFFFFFF
            if not len(token):
                break
            token[at] = low[joins] >> 32
            stays = np.ones(len(token), bool)
            stays[at + 1] = False
            token, word, rank = token[stays], word[stays], rank[stays]
            at = at - np.arange(len(at))
            pairs = np.concatenate([at, at[at > 0] - 1])
            rank[at] = NO_RANK
            pairs = pairs[pairs + 1 < len(token)]
            pairs = pairs[word[pairs] == word[pairs + 1]]
            rank[pairs] = self._look_up(token[pairs], token[pairs + 1])
        token, word = np.concatenate([*done_token, token]), np.concatenate([*done_word, word])
        order = np.argsort(word, kind="stable")
        return token[order].astype(np.int32), np.searchsorted(word[order], np.arange(n + 1))

    def _bytes(self) -> np.ndarray:
        if self.byte_pairs is None:
            a, b = np.divmod(np.arange(65536), 256)
            self.byte_pairs = self._look_up(self.single[a], self.single[b])
        return self.byte_pairs

    def entries(self, pieces: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids as int32 bytes, ids as decimal text with a comma after each) of each slice."""
        cache = self.cache
        out = [cache.get(p) for p in pieces]
        new = [k for k, e in enumerate(out) if e is None]
        many = [k for k in new if 1 < len(pieces[k]) <= LONG_SLICE and pieces[k] not in self.rank]
        sizes = np.array([len(pieces[k]) for k in many], np.int64)
        token, cuts = self.merge_all(np.frombuffer(b"".join([pieces[k] for k in many]), np.uint8), sizes)
        merged = {k: token[p:q] for k, p, q in zip(many, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)}
        if len(cache) + len(new) > CACHE_SLICES:
            cache.clear()
        for k in new:
            ids = merged[k] if k in merged else np.array(self.merge(pieces[k]), np.int32)
            out[k] = ids.tobytes(), ("%d," * len(ids) % tuple(ids.tolist())).encode()
            if len(pieces[k]) <= LONG_SLICE and len(cache) < CACHE_SLICES:
                cache[pieces[k]] = out[k]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the tokens, gathered by offsets."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.begin[ids] - (ends - sizes), sizes)
        return self.bytes[shift + np.arange(len(shift))]


@cache
def ranks(path: str) -> Ranks:
    return Ranks(path)


class Encoded:
    """Token ids of every text of a slice: ids, at (first id of each text), spans."""

    def __init__(self, column: pa.Array, table: Ranks):
        buf, offsets = T.buffers(column)
        cps, at = U.decode(buf)
        first = np.zeros(len(cps), bool)
        begins = np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])
        first[begins] = True
        starts = at[boundaries(cps, first)]
        ends = np.append(starts[1:], len(buf)) if len(starts) else starts
        raw = buf.tobytes()
        where, inverse = T.distinct_spans(buf, starts, ends)
        entries = table.entries([raw[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
        sizes = np.array([len(e[0]) // 4 for e in entries], np.int64)
        flat = np.frombuffer(b"".join(e[0] for e in entries), np.int32)
        begin = np.cumsum(sizes) - sizes
        per = sizes[inverse] if len(starts) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(per)])
        shift = np.repeat(begin[inverse] - total[:-1], per) if len(starts) else np.zeros(0, np.int64)
        self.ids = flat[shift + np.arange(len(shift))]
        self.cuts = np.searchsorted(starts, offsets)  # slices of text i: cuts[i]..cuts[i+1]
        self.at = total[self.cuts]
        self.starts, self.ends, self.slice_at = starts, ends, total
        texts = np.empty(len(entries), object)
        texts[:] = [e[1] for e in entries]
        self._texts = texts[inverse] if len(starts) else texts

    def decimal(self, i: int) -> bytes:
        """Ids of text i, joined by commas."""
        return b"".join(self._texts[self.cuts[i] : self.cuts[i + 1]].tolist())[:-1]


def byte_bpe(docs: DataFrame, ranks_path: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode it again.

    One row per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked
    for, ids and token_ends (byte offsets). A null or empty text has no token;
    repeated rows give equal rows; a null id is carried along; other columns,
    whatever their names, are not read. Texts are encoded whole, a very long slice by
    itself; a text has to fit a worker's memory some fifty times over.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(ranks_path)
        for batch in T.batched(it, "text", 2 << 20):
            e = Encoded(batch.column("text"), table)
            n = batch.num_rows
            decoded = table.decode(e.ids)
            byte_at = np.concatenate([[0], np.cumsum(table.lengths[e.ids])])
            cut = byte_at[e.at]
            view = memoryview(np.ascontiguousarray(decoded))
            columns = {
                "doc_id": batch.column("id"),
                "n_tokens": pa.array(np.diff(e.at), pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(e.decimal(i)).hexdigest() for i in range(n)]),
                "decoded_sha256": pa.array([hashlib.sha256(view[cut[i] : cut[i + 1]]).hexdigest() for i in range(n)]),
            }
            if with_ids:
                at = pa.array(e.at, pa.int32())
                ends = byte_at[1:] - np.repeat(cut[:-1], np.diff(e.at))
                columns["ids"] = pa.ListArray.from_arrays(at, pa.array(e.ids, pa.int32()))
                columns["token_ends"] = pa.ListArray.from_arrays(at, pa.array(ends, pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, token_ends array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
