"""Language-model scores of documents by a causal self-attention model.

Words are lower-cased and cut into subword ids by public byte-pair ranks. One pass
over whole texts counts the words, and from them the subwords that open or close a
word, the pairs inside words and the places where words end. The attention model,
trained in numpy on the ids that open the words, tells which of a few parts the
next word comes from, from a window of the words before. A part is a distribution
over opening and one over inner subwords: the corpus counts, shared out by what
training finds responsible for each subword. Texts are scored in overlapping
windows, the overlap serving as context only, so that each token is scored once;
windows of many texts go through masked attention as one batch. A text's
probability is, word by word, that the text goes on, that the word's first subword
follows, and that the word does: its discounted share of the words so begun, or
what the discount left times its spelling.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodegraph.llm import bpe, exchange as X, text as T
from lodegraph.operators.checkpoints import cut_alone

#: Distributions that attention weighs.
PARTS = 32
#: Rows of the tables by subword: the most frequent ones, then one for all others.
ROWS = 2048
WIDTH = 16
#: Inputs of a window, and how many of them come before the first scored position.
WINDOW, CONTEXT = 48, 16
STRIDE = WINDOW - CONTEXT
BATCH_BYTES = 2 << 20
#: Words that are cut into subwords at a time.
BLOCK = 16_384
#: Taken off each count, for words and pairs that the corpus lacks.
DISCOUNT, PAIR_DISCOUNT = 0.75, 0.5
#: Weight of attention beside the pairs in a word's spelling.
SPELLED = 0.2
#: Bytes of a word so far, by which its end is counted; weights of what backs off.
LONGEST, STEADY = 24, 3.0
#: One training window for so many words of a text: each word is a target once.
GAP = STRIDE
ROUNDS = 4
#: Windows of a training step; steps of a round at least; windows of a task.
STEP, STEPS, TASK_WINDOWS = 64, 64, 16_384
#: Sums are taken in whole numbers, so that their order does not matter.
FIXED = 2.0**20


def _pieces(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: bpe.Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each) of the words, each with a space before it; block by block, which the cache holds."""
    if len(starts) > BLOCK:
        ids, sizes = zip(*(_pieces(buf, starts[k : k + BLOCK], ends[k : k + BLOCK], table) for k in range(0, len(starts), BLOCK)), strict=True)
        return np.concatenate(ids), np.concatenate(sizes)
    long = np.flatnonzero(ends - starts >= bpe.LONG_SLICE)
    sizes = ends - starts + 1
    sizes[long] = 0
    end = np.cumsum(sizes)
    at = np.repeat(starts - 1 - (end - sizes), sizes) + np.arange(end[-1] if len(end) else 0)
    text = buf[np.maximum(at, 0)]
    text[(end - sizes)[sizes > 0]] = 0x20
    flat, cuts = table.merge_all(text, sizes)
    counts = np.diff(cuts)
    if len(long):
        parts = np.split(flat, cuts[1:-1])
        for k in long.tolist():
            parts[k] = np.array(table.merge(b" " + buf[starts[k] : ends[k]].tobytes()), np.int32)
        flat, counts = np.concatenate(parts), np.array([len(x) for x in parts])
    return flat, counts


class Subwords:
    """Lower-cased words of a slice, and the subword ids of the distinct ones."""

    def __init__(self, column: pa.Array, table: bpe.Ranks):
        self.words = w = T.Words(column, lower=True)
        self.distinct, where, inverse = X.distinct(w.hashes())
        self._keep(inverse, w.at, *_pieces(w.buf, w.starts[where], w.ends[where], table))

    @classmethod
    def sent(cls, inverse: np.ndarray, counts: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> Subwords:
        """From the numbers of the distinct words, words of each text, and ids of the distinct words and number of each; words and distinct are missing."""
        out = cls.__new__(cls)
        out._keep(inverse, np.append(0, np.cumsum(counts)), ids, sizes)
        return out

    def _keep(self, inverse: np.ndarray, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.inverse, self.at, self.ids, self.sizes = inverse, at, ids, sizes  # words of text i: at[i]..at[i+1]
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.opening = self.ids[self.begin].astype(np.int64) if len(self.begin) else np.zeros(0, np.int64)


# ---- what the corpus tells ---------------------------------------------------


@dataclass
class Corpus:
    """Counts over whole training texts, by subword id and by table row."""

    texts: int
    empty: int  # texts without a word
    tokens: int  # words
    words: int  # distinct ones
    used: np.ndarray  # distinct words with each id
    opening: np.ndarray  # times that it opens a word
    opened: np.ndarray  # distinct words that it opens
    inner: np.ndarray  # times that it stands inside of distinct words
    closing: np.ndarray  # times that it closes a word
    final: np.ndarray  # times that it closes a text
    spelled: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # slots and counts of spelling()

    KINDS = ("used", "opening", "opened", "inner", "closing", "final")

    @staticmethod
    def rows(counts: np.ndarray) -> np.ndarray:
        """Table row of each id: the most frequent have their own, the others share the last one."""
        row = np.empty(len(counts), np.int64)
        order = np.argsort(-counts, kind="stable")
        row[order] = np.minimum(np.arange(len(order)), ROWS - 1)
        return row


def tally(flat: np.ndarray, sizes: np.ndarray, times: np.ndarray, finals: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts) of Corpus.KINDS from distinct words: subword ids, number of each, times in training texts and at their ends."""
    ends = np.cumsum(sizes)
    begin, last = flat[ends - sizes], flat[ends - 1]
    inside = np.ones(len(flat), np.int64)
    inside[ends - sizes] = 0
    parts = ((flat, np.repeat(times > 0, sizes)), (begin, times), (begin, times > 0), (flat, inside * np.repeat(times > 0, sizes)), (last, times), (last, finals))
    have = np.concatenate([np.bincount(ids, n, size).astype(np.int64) for ids, n in parts])
    used = np.flatnonzero(have)
    return used, have[used]


def spelling(flat: np.ndarray, sizes: np.ndarray, row: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Counts of pairs, places passed and places closed, end to end, over distinct words."""
    ends = np.cumsum(sizes)
    inside = np.ones(len(flat), bool)
    inside[ends - 1] = False
    r = row[flat]
    total = np.cumsum(lengths[flat])
    place = np.minimum(total - np.repeat(total[ends - sizes] - lengths[flat[ends - sizes]], sizes), LONGEST) - 1
    at = np.flatnonzero(inside)
    spots = r * LONGEST + place
    return np.concatenate([np.bincount(r[at] * ROWS + r[at + 1], minlength=ROWS * ROWS), np.bincount(spots, minlength=ROWS * LONGEST), np.bincount(spots[ends - 1], minlength=ROWS * LONGEST)])


class Spelling:
    """Probabilities that the counts give: a text's end, a word among those so begun, a word's end, the next subword inside it."""

    def __init__(self, c: Corpus, row: np.ndarray):
        have = np.zeros(ROWS * (ROWS + 2 * LONGEST))
        have[c.spelled[0]] = c.spelled[1]
        pairs = have[: ROWS * ROWS].reshape(ROWS, ROWS)
        passed, closed = have[ROWS * ROWS :].reshape(2, ROWS, LONGEST)
        n = np.bincount(row, c.closing, ROWS)
        ended = np.bincount(row, c.final, ROWS)
        usual = (c.texts + 0.5) / (c.texts + c.tokens + 1)
        self.stop = np.append((ended + STEADY * usual) / (n + STEADY), (c.empty + STEADY * usual) / (c.texts + STEADY))
        self.opening = np.maximum(c.opening, 1)
        self.left = np.where(c.opening > 0, DISCOUNT * c.opened / self.opening, 1.0)
        usual_at = (closed.sum(0) + 0.5) / (passed.sum(0) + 1)
        ratio = (closed.sum(1) + STEADY / 2) / (passed @ usual_at + STEADY / 2)
        self.close = (closed + STEADY * np.clip(usual_at * ratio[:, None], 1e-4, 0.98)) / (passed + STEADY)
        total = pairs.sum(1, keepdims=True)
        self.pairs = (np.maximum(pairs - PAIR_DISCOUNT, 0) / np.maximum(total, 1)).astype(np.float32)
        self.pairs_left = np.where(total[:, 0] > 0, 1 - self.pairs.sum(1, dtype=np.float64), 1.0)
        self.row = row.astype(np.int16)
        # A rare id's share of the row that it shares.
        rare = row == ROWS - 1
        self.share = np.where(rare, (c.used + 0.05) / max((c.used + 0.05)[rare].sum(), 1e-9), 1.0).astype(np.float32)


# ---- the network --------------------------------------------------------------


_PLACES = np.arange(-CONTEXT - 1, STRIDE, dtype=np.int32)
_CAUSAL = np.where(np.arange(WINDOW)[None, :] <= np.arange(CONTEXT, WINDOW)[:, None], 1, 0).astype(np.float32)


@dataclass
class Model:
    row: np.ndarray  # table row of each id, and of the mark before a text as the last one
    parts: np.ndarray  # probability of each id in each part, among the opening ids or the inner ones
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def shapes() -> dict[str, tuple[int, ...]]:
        """Queries, keys, values by row and by place, what attention and the last row say of the distributions."""
        return {"q": (ROWS, WIDTH), "k": (ROWS, WIDTH), "v": (ROWS, WIDTH), "pq": (STRIDE, WIDTH), "pk": (WINDOW, WIDTH), "pv": (WINDOW, WIDTH), "o": (WIDTH, PARTS), "g": (ROWS, PARTS), "b": (PARTS,)}

    def begin(self) -> None:
        rng = np.random.default_rng(17)
        scale = {"q": 0.3, "k": 0.3, "v": 0.3, "pq": 0.1, "pk": 0.1, "pv": 0.1, "o": 0.25}
        self.weights = {k: (rng.standard_normal(s) * scale.get(k, 0.0)).astype(np.float32) for k, s in self.shapes().items()}

    def windows(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(inputs and targets of every window, position of each target); ids: those that open the words.

        A window is WINDOW + 1 ids in a row, -1 for padding; the last STRIDE of
        them are its targets. A text's first id follows the mark before a text.
        """
        sizes = np.diff(at)
        count = -(-sizes // STRIDE)
        text = np.repeat(np.arange(len(sizes)), count)
        first = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
        place = first.astype(np.int32)[:, None] + _PLACES  # in the text; -1 is the mark
        inside = (place >= 0) & (place < sizes.astype(np.int32)[text][:, None])
        place += at.astype(np.int32)[text][:, None]
        ids = np.where(inside, np.take(ids.astype(np.int32), place, mode="clip"), np.int32(-1)) if len(ids) else np.full(place.shape, -1)
        ids[np.flatnonzero(first == 0), CONTEXT] = len(self.row) - 1
        return ids, np.where(inside, place, -1)[:, CONTEXT + 1 :]

    def forward(self, windows: np.ndarray) -> dict[str, np.ndarray]:
        """Intermediate values; p: weights of the distributions at the last STRIDE inputs. Logits stay small, so they are not shifted."""
        w, n = self.weights, len(windows)
        source = windows[:, :-1]
        r = self.row[source]  # of blanks any
        late = np.ascontiguousarray(r[:, CONTEXT:])
        k, q = np.take(w["k"], r, 0, mode="clip"), np.take(w["q"], late, 0, mode="clip")
        v = np.take(np.append(w["v"], np.ones((ROWS, 1), np.float32), 1), r, 0, mode="clip")
        v += np.append(w["pv"], np.zeros((WINDOW, 1), np.float32), 1)
        k += w["pk"]
        q += w["pq"]
        q *= np.float32(WIDTH**-0.5)
        a = q @ k.transpose(0, 2, 1)
        np.exp(a, out=a)
        a *= _CAUSAL
        blank = np.flatnonzero(source[:, 0] < 0)
        if len(blank):
            a[blank] *= (source[blank] >= 0)[:, None, :]
        c = (a @ v).reshape(-1, WIDTH + 1)
        total = c[:, WIDTH:] + np.float32(1e-20)
        c = c[:, :WIDTH] / total
        p = c @ w["o"]
        p += np.take(w["g"], late.reshape(-1), 0, mode="clip")
        p += w["b"]
        np.exp(p, out=p)
        return {"r": r, "late": late, "q": q, "k": k, "v": v, "a": a, "total": total, "c": c, "p": p}

    def score(self, ids: np.ndarray, at: np.ndarray, batch: int = 64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(position, probability of each id from there on after those before it in its text, what each part is responsible for in it), batch by batch."""
        windows, place = self.windows(ids, at)
        ones = np.ones(PARTS, np.float32)
        for k in range(0, len(windows), batch):
            p = self.forward(windows[k : k + batch])["p"]
            goal, spot = windows[k : k + batch, CONTEXT + 1 :].reshape(-1), place[k : k + batch].reshape(-1)
            use = np.flatnonzero(goal >= 0)
            if len(use) < len(goal):
                p, goal, spot = np.take(p, use, 0), goal[use], spot[use]
            total = p @ ones
            p *= np.take(self.parts, goal, 0, mode="clip")
            own = p @ ones
            p /= own[:, None]
            yield int(spot[0]), own / total, p

    def gradient(self, windows: np.ndarray, found: np.ndarray | None = None, inner: tuple[np.ndarray, np.ndarray] | None = None, out: dict[str, np.ndarray] | None = None) -> tuple[dict[str, np.ndarray], float]:
        """(gradient of the mean loss, loss); adds to found what each part is responsible for, by id.

        inner: (ids inside of the targets' words, number of them of each target). out: zeros of the shapes, for the gradient.
        """
        w, f, n = self.weights, self.forward(windows), len(windows)
        goal = windows[:, CONTEXT + 1 :].reshape(-1)
        blank = np.flatnonzero(goal < 0)
        if len(blank):
            goal = np.maximum(goal, 0)
        z, ones = f["p"], np.ones(PARTS, f["p"].dtype)
        z /= (z @ ones)[:, None]
        own = z * np.take(self.parts, goal, 0, mode="clip")
        total = own @ ones
        own /= total[:, None]
        own[blank] = 0
        z[blank] = 0
        if found is not None:
            _add(found, goal, own)
            if inner is not None and len(inner[0]):
                _add(found, inner[0], own, np.repeat(np.arange(len(own)), inner[1]))
        # Beside each other, so that the rows are put in order once: of the last inputs and of all.
        both = np.empty((len(z), PARTS + WIDTH), z.dtype)
        z = np.subtract(z, own, out=both[:, :PARTS])
        z *= z.dtype.type(1 / max(1, len(goal) - len(blank)))
        g = {k: np.zeros_like(v) for k, v in w.items()} if out is None else out
        np.matmul(f["c"].T, z, out=g["o"])
        np.matmul(np.ones(len(z), z.dtype), z, out=g["b"])
        dc = np.empty((len(z), WIDTH + 1), z.dtype)
        np.matmul(z, w["o"].T, out=dc[:, :WIDTH])
        dc[:, :WIDTH] /= f["total"]
        np.negative(np.einsum("ij,ij->i", dc[:, :WIDTH], f["c"]), out=dc[:, WIDTH])
        dc = dc.reshape(n, STRIDE, WIDTH + 1)
        da = dc @ f["v"].transpose(0, 2, 1)
        da *= f["a"]
        dkv = np.empty((n, WINDOW, 2 * WIDTH), z.dtype)
        dkv[:, :, :WIDTH] = da.transpose(0, 2, 1) @ f["q"]
        dkv[:, :, WIDTH:] = (f["a"].transpose(0, 2, 1) @ dc)[:, :, :WIDTH]
        dq = da @ f["k"]
        dq *= z.dtype.type(WIDTH**-0.5)
        both[:, PARTS:] = dq.reshape(-1, WIDTH)
        one = np.ones(n, z.dtype)
        g["pq"][:] = (one @ dq.reshape(n, -1)).reshape(STRIDE, WIDTH)
        placed = (one @ dkv.reshape(n, -1)).reshape(WINDOW, 2 * WIDTH)
        g["pk"][:], g["pv"][:] = placed[:, :WIDTH], placed[:, WIDTH:]
        row, both = _by_row(f["late"].reshape(-1), both)
        g["g"][row], g["q"][row] = both[:, :PARTS], both[:, PARTS:]
        row, both = _by_row(f["r"].reshape(-1), dkv.reshape(-1, 2 * WIDTH))
        g["k"][row], g["v"][row] = both[:, :WIDTH], both[:, WIDTH:]
        return g, float(-np.log(np.delete(total, blank)).mean()) if len(blank) < len(goal) else 0.0

    def train(self, windows: np.ndarray, found: np.ndarray, inner: tuple[np.ndarray, np.ndarray] | None, rate: float = 0.03) -> float:
        """Adam over the windows, again and again up to STEPS steps at least.

        inner: ids inside of the targets' words, and cuts between the targets; with them they count in what is found.
        """
        flat = np.concatenate([v.reshape(-1) for v in self.weights.values()])
        slope, mean, square, n = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat), len(windows)
        at = np.cumsum([v.size for v in self.weights.values()])[:-1]
        self.weights, slopes = ({k: v.reshape(self.weights[k].shape) for k, v in zip(self.weights, np.split(x, at), strict=True)} for x in (flat, slope))
        steps = max(STEPS, -(-n // STEP))
        loss = 0.0
        for step in range(steps):
            own = (step * STEP + np.arange(min(STEP, n))) % n
            pace = rate * (1 - step / steps)
            within = None
            if inner is not None:
                low, high = (inner[1][(own * STRIDE)[:, None] + np.arange(STRIDE) + k].reshape(-1) for k in range(2))
                size = high - low
                within = inner[0][np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())], size
            slope.fill(0)
            loss += self.gradient(windows[own], found, within, slopes)[1] / steps
            _adam(flat, slope, mean, square, step, pace)
        return loss


def _adam(flat: np.ndarray, slope: np.ndarray, mean: np.ndarray, square: np.ndarray, step: int, pace: float, block: int = 65_536) -> None:
    """One step, in place and in blocks that the cache holds. mean and square are ten and a hundred times the running means."""
    kind, root = flat.dtype.type, (0.01 / (1 - 0.99 ** (step + 1))) ** 0.5
    pace, least = kind(pace * 0.1 / (1 - 0.9 ** (step + 1)) / root), kind(1e-8 / root)
    for k in range(0, len(flat), block):
        d, m, v = slope[k : k + block], mean[k : k + block], square[k : k + block]
        m *= kind(0.9)
        m += d
        v *= kind(0.99)
        d *= d
        v += d
        np.sqrt(v, out=d)
        d += least
        np.divide(m, d, out=d)
        d *= pace
        flat[k : k + block] -= d


def _add(to: np.ndarray, key: np.ndarray, values: np.ndarray, which: np.ndarray | None = None) -> None:
    """Add each of the values, or of those that which names, to the row of its key."""
    if len(to) <= 65_536:
        key = key.astype(np.uint16)  # sorted by counting
    order, first = X.by_key(key)
    to[key[order[first]]] += _runs(np.take(values, order if which is None else which[order], 0), first)


def _runs(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows from each first one up to the next. Complex numbers take two columns at a time."""
    return np.add.reduceat(values.view(f"c{2 * values.itemsize}"), first).view(values.dtype)


def _by_row(row: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct table rows, sums of the values of each)."""
    order, first = X.by_key(row.astype(np.int16))
    return row[order[first]], _runs(np.take(values, order, 0), first)


def distributions(opens: np.ndarray, opening: np.ndarray, inner: np.ndarray, found: np.ndarray | None) -> np.ndarray:
    """The corpus counts of each id, shared out among the parts by what they were responsible for; at first by chance. opens: ids that open words."""
    if found is None:
        owed = np.random.default_rng(5).random((len(opening), PARTS)) ** 3 + 0.02
    else:
        owed = found + found.sum(0) / max(found.sum(), 1e-9) + 1e-6
    owed /= owed.sum(1, keepdims=True)
    for own, counts in ((opens, opening), (~opens, inner)):
        owed[own] *= (counts + 0.05)[own, None]
        owed[own] /= np.maximum(owed[own].sum(0), 1e-30)
    return owed.astype(np.float32)


def log10(s: Subwords, count: np.ndarray, model: Model, spelled: Spelling, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each text; count: of each distinct word's training tokens."""
    at, n, sizes = s.at, len(s.inverse), s.sizes
    # What a distinct word's spelling is by the pairs alone, and which subwords attention has a say in.
    inside = np.ones(len(s.ids), bool)
    inside[s.begin] = False
    inner = np.flatnonzero(inside)
    size = lengths[s.ids]
    upto = np.cumsum(size)
    word = np.repeat(np.arange(len(sizes)), sizes)
    so_far = np.minimum(upto - (upto - size)[s.begin][word], LONGEST) - 1
    row = spelled.row[s.ids].astype(np.int64)
    close = spelled.close[row, so_far]
    last = s.begin + sizes - 1 if len(sizes) else sizes
    ids = s.ids[inner].astype(np.int64)
    # What is looked up at one place lies side by side.
    pairs = np.empty((len(inner), 2), np.float32)
    pairs[:, 0] = (1 - SPELLED) * spelled.pairs[row[inner - 1], row[inner]] * spelled.share[ids]
    pairs[:, 1] = (1 - SPELLED) * spelled.pairs_left[row[inner - 1]] + SPELLED
    fixed = np.log(close[last]) + np.bincount(word[inner], np.log(1 - close[inner - 1]), len(sizes))
    more = sizes - 1  # inner subwords of each distinct word, and before it
    more = np.stack([more, np.cumsum(more) - more], 1)
    stop = spelled.stop[row[last]] if len(sizes) else np.zeros(0)
    base = np.stack([np.maximum(count - DISCOUNT, 0) / spelled.opening[s.opening], spelled.left[s.opening], np.log(1 - stop), fixed], 1)
    logs = np.zeros(n)
    for k, value, owed in model.score(s.opening[s.inverse], at):
        own = s.inverse[k : k + len(value)]
        m, first = np.take(more, own, 0).T
        token = np.repeat(np.arange(len(m)), m)
        spot = np.repeat(first - (np.cumsum(m) - m), m) + np.arange(len(token))
        attended = np.einsum("ij,ij->i", np.take(owed, token, 0), np.take(model.parts, ids[spot], 0))
        known, left, goes_on, closed = np.take(base, own, 0).T
        paired, rest = np.take(pairs, spot, 0).T
        spelt = closed + np.bincount(token, np.log(np.maximum(paired + rest * attended, 1e-35)), len(m))
        chance = np.log(known + left * np.exp(spelt) + 1e-300)
        # Where the spelling is too small a number, its logarithm stands alone.
        alone = np.flatnonzero(known <= 0)
        chance[alone] = np.log(left[alone] + 1e-300) + spelt[alone]
        logs[k : k + len(value)] = chance + np.log(np.maximum(value, 1e-30)) + goes_on
    # A text goes on after its opening and after each word but the last.
    full = np.flatnonzero(np.diff(at) > 0)
    out = T.sums(logs, at) + np.log(np.where(np.diff(at) > 0, 1 - spelled.stop[ROWS], spelled.stop[ROWS]))
    final = stop[s.inverse[at[1:][full] - 1]]
    out[full] += np.log(final) - np.log(1 - final)
    return out / np.log(10)


# ---- over the cluster -----------------------------------------------------------


@cache
def _table(path: str) -> bpe.Ranks:
    return bpe.Ranks(path)


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """Sums by slot: a table of a size that the model fixes."""
    got = rows.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def _slots(slot: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"slot": pa.array(slot, pa.int32()), "n": pa.array(n, pa.int64())})


def _first(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place of the first target in it) of each training window."""
    n = -(-sizes // GAP)
    text = np.repeat(np.arange(len(n)), n)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * GAP


def window_keys(words: np.ndarray, sizes: np.ndarray, mark: int) -> np.ndarray:
    """A hash of each training window: by its order the windows train."""
    windows = tiles(words, sizes)
    windows[windows == -2] = mark
    return T.mix((windows.astype(np.uint64) * T.byte_codes(1)[: WINDOW + 1]).sum(1))


def tiles(words: np.ndarray, sizes: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Training windows, as of Model.windows(), of texts of so many words each: -1 for none, -2 for the mark before a text; every word is a target once, in order.

    own: numbers of the windows to form, all by default.
    """
    text, first = _first(sizes)
    if own is not None:
        text, first = text[own], first[own]
    place = first.astype(np.int32)[:, None] + _PLACES
    inside = (place >= 0) & (place < sizes.astype(np.int32)[text][:, None])
    found = np.take(words.astype(np.int32), (np.cumsum(sizes) - sizes).astype(np.int32)[text][:, None] + place, mode="clip") if len(words) else place
    return np.where(inside, found, np.where(place == -1, np.int32(-2), np.int32(-1)))


def samples(w: T.Words, inverse: np.ndarray, trains: np.ndarray) -> np.ndarray:
    """All training windows of the texts that train, of the numbers of distinct words."""
    return tiles(inverse[trains[w.doc]], w.counts[trains])


def window_ids(words: np.ndarray, ids: np.ndarray, sizes: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(training windows of opening ids, ids inside of the targets' words, number of them of each target) from samples() and the ids of the distinct words."""
    begin = np.cumsum(sizes) - sizes
    opening = np.append(ids[begin] if len(begin) else begin, [mark, -1])
    goal = words[:, CONTEXT + 1 :].reshape(-1)
    n = np.where(goal >= 0, np.append(sizes, 1)[goal] - 1, 0)
    spot = np.repeat(np.append(begin, 0)[goal] + 1 - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return opening[words], ids[spot], n


def _counted(origins: list[int], bodies: list[bytes], bucket: int, table: bpe.Ranks) -> Iterable[tuple[int, int, bytes]]:
    """To each shard its words' counts in training texts and subword ids; as origin -1 the bucket's tally, as -2 the ids of its distinct training words."""
    for origin, body in zip(origins, bodies, strict=True):
        if origin < 0:
            yield bucket, origin, body
    bodies = [b for o, b in zip(origins, bodies, strict=True) if o >= 0]
    origins = [o for o in origins if o >= 0]
    if not origins:
        return
    sent = [X.unpack(b) for b in bodies]
    times, finals, sizes = (np.concatenate([s[k] for s in sent]).astype(np.int64) for k in range(3))
    text = np.concatenate([s[3] for s in sent])
    ends = np.cumsum(sizes)
    word = T.span_hashes(text, ends - sizes, ends)
    _, one, which = X.distinct(word)
    sums, final = (np.bincount(which, x, len(one)).astype(np.int64) for x in (times, finals))
    flat, counts = _pieces(text, ends[one] - sizes[one], ends[one], table)
    begin = np.cumsum(counts) - counts
    size, short = len(table.lengths), np.uint16 if len(table.lengths) < 65_536 else np.uint32
    seen = sums > 0
    known = flat[np.repeat(seen, counts)]
    if seen.any():
        slots, n = tally(known, counts[seen], sums[seen], final[seen], size)
        kinds = len(Corpus.KINDS) * size
        yield bucket, -1, X.pack(np.append(slots, [kinds, kinds + 1]), np.append(n, [seen.sum(), sums.sum()]))
        yield bucket, -2, X.pack(known.astype(short), counts[seen].astype(np.uint32))
    at = 0
    for origin, s in zip(origins, sent, strict=True):
        own = which[at : at + len(s[0])]
        at += len(own)
        n = counts[own]
        ids = flat[np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        yield bucket, origin, X.pack(sums[own], n.astype(np.uint32), ids.astype(short))


def _replies(bucket: pa.ChunkedArray, body: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(times in training texts, number of ids, ids) of a shard's distinct words, in the order of their hashes."""
    got = [X.unpack(b) for _, b in sorted(zip(bucket.to_pylist(), body.to_pylist(), strict=True))]
    return tuple(np.concatenate(c).astype(np.int64) for c in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 3


class Known:
    """What scoring needs; the tables of spelling are made where they are used, once a task."""

    def __init__(self, corpus: Corpus, model: Model, row: np.ndarray):
        self.corpus, self.model, self.row, self._spelled = corpus, model, row, None

    def spelled(self) -> Spelling:
        if self._spelled is None:
            self._spelled = Spelling(self.corpus, self.row)
        return self._spelled


def score_texts(docs: DataFrame, trains: Column, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    trains: a boolean expression over the columns of `docs`; rows for which it is
    false or null are held out of all that is learnt. Null counts as the empty
    text, which is one end token. Repeated rows and equal texts get equal scores, but
    for rounding; with nothing to learn from, the model has no more than its vocabulary. A null
    id is carried along; extra columns, whatever their names, are not read. Texts
    are scored whole, in windows; one has to fit a worker's memory some fifty times
    over. All counts are over whole training texts, their ends included; the network
    is fitted on every word of them once, in windows, by rounds of local training
    whose results are averaged.
    """
    plan = X.Plan(docs, BATCH_BYTES, id_col, text_col, carry=(F.coalesce(trains, F.lit(False)),))
    path, buckets = ranks_path, plan.buckets(16 << 20)
    table = _table(path)
    size, short = len(table.lengths), np.uint16 if len(table.lengths) < 65_534 else np.uint32
    kinds = len(Corpus.KINDS) * size

    def gather(shard: int, t: pa.Table) -> pa.Table:
        """A shard's distinct words, by hash: times in training texts and at their ends, bytes; how many texts train, as origin -1, and the words of all in order, with what else scoring asks of the texts, as -3 - shard."""
        w = T.Words(X.text_of(t), lower=True)
        trains = t.column("carry_0").to_numpy().astype(bool)
        distinct, where, inverse = X.distinct(w.hashes())
        times = np.bincount(inverse[trains[w.doc]], minlength=len(distinct)).astype(np.uint32)
        closing = w.at[1:][trains & (w.counts > 0)] - 1
        finals = np.bincount(inverse[closing], minlength=len(distinct)).astype(np.uint32)
        sizes = (w.ends - w.starts)[where]
        ends = np.cumsum(sizes)
        text = w.buf[np.repeat(w.starts[where] - (ends - sizes), sizes) + np.arange(sizes.sum())]
        at = np.append(0, ends)
        _, cuts = X.deal(distinct, buckets)
        rows = [
            (b, shard, X.pack(times[p:q], finals[p:q], sizes[p:q].astype(np.uint32), text[at[p] : at[q]]))
            for b, (p, q) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if q > p
        ]
        texts = np.array([trains.sum(), (trains & (w.counts == 0)).sum()])
        rows.append((shard % buckets, -1, X.pack(np.array([kinds + 2, kinds + 3]), texts)))
        ids = t.column("id")
        rows.append((shard % buckets, -3 - shard, X.pack(inverse.astype(np.uint32), w.counts.astype(np.uint32), trains, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy().astype(bool))))
        return X.messages(rows)

    def split(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        return X.messages(_counted(t.column("origin").to_pylist(), t.column("body").to_pylist(), key[0].as_py(), _table(path)))

    def tallies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(kinds + 4, np.int64)
        for batch in it:
            for body in batch.column("body").to_pylist():
                slot, n = X.unpack(body)
                have[slot] += n
        used = np.flatnonzero(have)
        yield _slots(used, have[used])

    answers = cut_alone(plan.send(gather).groupBy("bucket").applyInArrow(split, X.MESSAGE))
    replied = answers.where("origin >= 0")
    have = _summed(answers.where("origin = -1").select("body").mapInArrow(tallies, "slot int, n long"), kinds + 4)
    words, tokens, texts, empty = have[kinds:].tolist()
    corpus = Corpus(texts, empty, tokens, words, *have[:kinds].reshape(-1, size))
    row = Corpus.rows(corpus.used)

    def spellings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, lengths = np.zeros(ROWS * (ROWS + 2 * LONGEST), np.int64), _table(path).lengths
        for batch in it:
            for body in batch.column("body").to_pylist():
                flat, sizes = X.unpack(body)
                have += spelling(flat.astype(np.int64), sizes.astype(np.int64), row, lengths)
        used = np.flatnonzero(have)
        yield _slots(used, have[used])

    have = _summed(answers.where("origin = -2").select("body").mapInArrow(spellings, "slot int, n long"), ROWS * (ROWS + 2 * LONGEST))
    corpus.spelled = np.flatnonzero(have).astype(np.int32), have[have > 0]

    def learn(key: tuple[pa.Scalar, ...], t: pa.Table, r: pa.Table) -> pa.Table:
        """Of a shard's training texts: opening id of each word, words of each text, keys of the windows; ids inside of the words and number of them."""
        out = []
        if r.num_rows:
            _, sizes, ids = _replies(r.column("bucket"), r.column("body"))
            begin = np.cumsum(sizes) - sizes
            for body in t.column("texts").to_pylist():
                words, counts, trains, _, _ = X.unpack(body)
                words, counts = words[np.repeat(trains, counts)], counts[trains]
                n = sizes[words] - 1
                spot = np.repeat(begin[words] + 1 - (np.cumsum(n) - n), n) + np.arange(n.sum())
                opening = ids[begin[words]]
                out.append((X.pack(opening.astype(short), counts, window_keys(opening, counts.astype(np.int64), size)), X.pack(ids[spot].astype(short), n.astype(np.uint32))))
        return pa.table({name: pa.array([x[k] for x in out], pa.binary()) for k, name in enumerate(("body", "inner"))})

    # By a name of its own: of two columns that are one below, a cogroup can lose one.
    worded = answers.where("origin <= -3").select((-3 - F.col("origin")).alias("origin"), F.col("body").alias("texts"))
    lessons = cut_alone(worded.groupBy("origin").cogroup(replied.groupBy("origin")).applyInArrow(learn, "body binary, inner binary"))
    tasks = max(1, -(-(corpus.tokens // GAP + corpus.texts) // TASK_WINDOWS))
    opens = table.bytes[table.begin[:-1]] == 0x20
    model = Model(Corpus.rows(np.append(corpus.opening, corpus.texts)), distributions(opens, corpus.opening, corpus.inner, None))
    model.begin()
    length = sum(int(np.prod(s)) for s in Model.shapes().values())
    lines = -(-length // PARTS)  # rows that hold the weights, after those of the ids

    def local(k: int) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, insides = [], []
            for b in it:
                parts += [X.unpack(body) for body in b.column("body").to_pylist()]
                if last:
                    insides += [X.unpack(body) for body in b.column("inner").to_pylist()]
            if not sum(len(x[0]) for x in parts):
                return
            opening, counts, keys = (np.concatenate([x[j] for x in parts]).astype(kind) for j, kind in enumerate((np.int64, np.int64, np.uint64)))
            # An order that the windows alone give, whatever rows they came in; of it the round's share, and on to further ones for STEPS steps at least.
            order = np.argsort(keys, kind="stable")
            total = len(order)
            begin, stop = total * k // ROUNDS, total * (k + 1) // ROUNDS
            order = order[(begin + np.arange(min(total, max(STEPS, -(-(stop - begin) // STEP)) * STEP))) % total]
            index = tiles(np.arange(len(opening)), counts, order)
            inner = None
            if last:
                ids, n = (np.concatenate([x[j] for x in insides]).astype(np.int64) for j in range(2))
                goal = index[:, CONTEXT + 1 :].reshape(-1)
                sizes, low = np.where(goal >= 0, n[goal], 0), (np.cumsum(n) - n)[goal]
                cuts = np.append(0, np.cumsum(sizes))
                inner = ids[np.repeat(low - cuts[:-1], sizes) + np.arange(cuts[-1])], cuts
            owed = np.zeros((size, PARTS), np.float32)
            model.train(np.append(opening, [size, -1])[index], owed, inner)
            vector = np.zeros(lines * PARTS)
            vector[:length] = np.concatenate([model.weights[x].reshape(-1) for x in Model.shapes()]) * float(total)
            used = np.flatnonzero(owed.any(1))
            table_ = np.rint(np.concatenate([owed[used], vector.reshape(-1, PARTS), np.full((1, PARTS), total)]).astype(np.float64) * FIXED).astype(np.int64)
            slot = np.concatenate([used, size + np.arange(lines + 1)])
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), *(pa.array(np.ascontiguousarray(table_[:, j])) for j in range(PARTS))], names=["slot", *(f"c{j}" for j in range(PARTS))])

        columns, last = [f"c{j}" for j in range(PARTS)], k == ROUNDS - 1
        return lessons.select("body", *["inner"] * last).coalesce(tasks).mapInArrow(run, "slot int, " + ", ".join(f"{c} long" for c in columns)).groupBy("slot").agg(*(F.sum(c).alias(c) for c in columns))

    for k in range(ROUNDS):
        got = local(k).toArrow()
        if not got.num_rows:
            break
        sums = np.zeros((size + lines + 1, PARTS))
        sums[got.column("slot").to_numpy()] = np.stack([got.column(f"c{j}").to_numpy() for j in range(PARTS)], 1) / FIXED
        vector, at = sums[size:-1].reshape(-1) / sums[-1, 0], 0
        for name, shape in Model.shapes().items():
            n = int(np.prod(shape))
            model.weights[name] = vector[at : at + n].reshape(shape).astype(np.float32)
            at += n
        model.parts = distributions(opens, corpus.opening, corpus.inner, sums[:size])

    known = Known(corpus, model, row)

    def score(key: tuple[pa.Scalar, ...], t: pa.Table, r: pa.Table) -> pa.Table:
        times, sizes, ids = _replies(r.column("bucket"), r.column("body"))
        numbers, counts, trains, doc, valid = X.unpack(t.column("texts")[0].as_py())  # a shard has one
        s = Subwords.sent(numbers.astype(np.int64), counts.astype(np.int64), ids, sizes)
        count = times[s.inverse]
        n = np.diff(s.at) + 1
        tokens, words = known.corpus.tokens + known.corpus.texts, known.corpus.words + (known.corpus.texts > 0)
        base = T.sums(np.log10(count + 1), s.at) + np.log10(known.corpus.texts + 1) - n * np.log10(tokens + words + 1)
        return pa.table(
            {
                "doc_id": pa.array(doc, pa.int64(), mask=~valid), "held_out": pa.array(~trains), "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(T.sums(count > 0, s.at) + int(known.corpus.texts > 0), pa.int64()), "train_tokens": pa.array(np.full(len(n), tokens), pa.int64()),
                "base_score": pa.array(base), "score": pa.array(log10(s, times, known.model, known.spelled(), _table(path).lengths)),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return worded.groupBy("origin").cogroup(replied.groupBy("origin")).applyInArrow(score, schema)
