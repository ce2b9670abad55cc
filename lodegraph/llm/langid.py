"""Language identification by multilingual mixture inference.

Hashed letter n-grams of the training texts give every language a smoothed
distribution. A document is a mixture of languages: expectation-maximisation
finds the proportions from its n-gram likelihoods, and the number of languages
is chosen by penalised likelihood. The leading language of the chosen set is
the answer, its proportion weighed by its evidence the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodegraph.llm import text as T, unicode as U

SLOT_BITS = 15
SLOTS = 1 << SLOT_BITS
SIZES = (2, 3, 4)
#: Texts of so many n-grams are counted one by one.
COUNTED = 2_000
#: Steps of a text's mixture after which it is first asked whether another language could pay.
EARLY = (1, 3, 6)
_LETTER = np.full(256, 32, np.uint32)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _slots(column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each size, the slots of the n-grams as they stand in the texts, and cuts between the texts.

    A text begins and ends as a word does, next to a blank; n-grams never cross texts.
    """
    buf, offsets = T.buffers(column)
    n = len(offsets) - 1
    offsets = offsets + 2 * np.arange(n + 1)
    own = np.ones(int(offsets[-1]), bool)
    own[offsets[:-1]] = own[offsets[1:] - 1] = False
    code = np.full(len(own), 32, np.uint32)
    code[own] = _LETTER[buf]
    final = np.zeros(len(code), bool)
    final[offsets[1:] - 1] = True
    keys, cuts = [], []
    h, letters, ends = code, code != 32, final
    for size in range(2, max(SIZES) + 1):
        m = len(code) - size + 1
        if m <= 0:
            break
        h = (h[:m] << np.uint32(8)) | code[size - 1 :]
        letters = letters[:m] | (code[size - 1 :] != 32)
        ends = ends[:m] | (final[size - 2 : size - 2 + m])  # a text ends before the last letter
        if size in SIZES:
            at = np.flatnonzero(letters & ~ends)
            keys.append((T.mix(h[at].astype(np.uint64) + np.uint64(size << 40)) >> np.uint64(64 - SLOT_BITS)).astype(np.int32))
            cuts.append(np.searchsorted(at, offsets))
    return keys, cuts


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, slot, count, n-grams per doc) over the letter n-grams of each text, slots ascending inside of one."""
    n = len(column)
    keys, cuts = _slots(column)
    per = np.sum([np.diff(c) for c in cuts], 0).astype(np.int64) if cuts else np.zeros(n, np.int64)
    found = []
    for i in np.flatnonzero(per >= COUNTED).tolist():
        have = np.bincount(np.concatenate([k[c[i] : c[i + 1]] for k, c in zip(keys, cuts, strict=True)]), minlength=SLOTS)
        slot = np.flatnonzero(have > 0)
        found.append((np.full(len(slot), i), slot, have[slot]))
    # Short texts are sorted all at once.
    small = per < COUNTED
    flat = [(np.repeat(np.arange(n), np.diff(c)), k) for k, c in zip(keys, cuts, strict=True)]
    flat = np.sort(np.concatenate([(d[small[d]] << SLOT_BITS) | k[small[d]] for d, k in flat])) if flat else np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
    found.append((flat[first] >> SLOT_BITS, flat[first] & (SLOTS - 1), np.diff(np.append(first, len(flat)))))
    doc, slot, count = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(found) > 1:
        order = np.argsort(doc, kind="stable")
        doc, slot, count = doc[order], slot[order], count[order]
    return doc, slot, count, per


class Model:
    """log-probability of each slot by language."""

    def __init__(self, langs: list[str], counts: np.ndarray, smoothing: float = 0.5):
        self.langs = langs
        p = counts + smoothing
        self.prob = (p / p.sum(1, keepdims=True)).astype(np.float64).T.copy()  # slot x language
        self.log = np.log(self.prob)

    def infer(self, column: pa.Array, penalty: float, steps: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the leading language, score, proportions of the chosen languages) of every text.

        A mixture of all languages comes first. Its likelihood is concave in the
        proportions, so the gradient bounds, at any step, what any mixture can reach.
        A text that can't pay for a second language goes as soon as the bound says so.
        Sets of the leading languages are compared, one language more at a time, for
        as long as the bound lets a text pay for it.
        """
        doc, slot, count, total = grams(column)
        n, k = len(column), len(self.langs)
        lead, score, shares = np.zeros(n, np.int64), np.zeros(n), np.zeros((n, k))
        if not k or not len(doc):
            return lead, score + (1 / k if k else 0), shares
        p, weight = [np.ascontiguousarray(self.prob[:, j])[slot] for j in range(k)], count.astype(np.float64)
        own, at = np.unique(doc, return_index=True)
        sizes, amount = np.diff(np.append(at, len(doc))), total[own].astype(np.float64)
        alone = np.stack([np.add.reduceat(np.ascontiguousarray(self.log[:, j])[slot] * weight, at) for j in range(k)], 1)
        best, cost = np.argmax(alone, 1), penalty * np.log(np.maximum(amount, 2))
        chosen, value = np.zeros((len(own), k)), alone.max(1) - cost
        chosen[np.arange(len(own)), best] = 1
        open_, every, since = np.arange(len(own)), np.full((len(own), k), 1 / k), 0
        for upto in (*(x for x in EARLY if x < steps), steps):
            every, _, reach = _mixture(p, weight, np.cumsum(sizes) - sizes, sizes, np.ones_like(every), upto - since, amount[open_], every)
            since, still = upto, reach - 2 * cost[open_] > value[open_]
            if not still.all():
                pick = np.repeat(still, sizes)
                p, weight, sizes, open_, every, reach = [x[pick] for x in p], weight[pick], sizes[still], open_[still], every[still], reach[still]
            if not len(open_):
                break
        ranked, limit = np.zeros((len(own), k), np.int64), np.zeros(len(own))
        ranked[open_], limit[open_] = np.argsort(-every, 1, kind="stable"), reach
        for size in range(2, k + 1):
            still = limit[open_] - size * cost[open_] > value[open_]
            if not still.any():
                break
            pick = np.repeat(still, sizes)
            p, weight, sizes, open_ = [x[pick] for x in p], weight[pick], sizes[still], open_[still]
            allowed = np.zeros((len(open_), k))
            np.put_along_axis(allowed, ranked[open_, :size], 1.0, 1)
            share, fit, _ = _mixture(p, weight, np.cumsum(sizes) - sizes, sizes, allowed, 2 * steps, amount[open_])
            better = fit - size * cost[open_] > value[open_]
            value[open_[better]] = (fit - size * cost[open_])[better]
            chosen[open_[better]] = share[better]
        first = np.argmax(chosen, 1)
        evidence = 1 / np.exp(np.maximum(alone - alone.max(1, keepdims=True), -50)).sum(1)
        lead[own], score[total == 0], shares[own] = first, 1 / k, chosen
        score[own] = np.clip(chosen.max(1) * np.where(first == best, evidence, 1 - evidence), 0, 1)
        return lead, score, shares


def _mixture(p: list[np.ndarray], weight: np.ndarray, at: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, steps: int, amount: np.ndarray, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over the allowed languages of each text, from even or given shares: proportions, log-likelihood, a bound on any proportions' likelihood."""
    if share is None:
        share = allowed / np.maximum(allowed.sum(1, keepdims=True), 1)
    for step in range(steps + 1):
        mass = np.repeat(share[:, 0], sizes) * p[0]
        for j in range(1, len(p)):
            mass += np.repeat(share[:, j], sizes) * p[j]
        np.maximum(mass, 1e-300, out=mass)
        ratio = weight / mass
        slope = np.stack([np.add.reduceat(x * ratio, at) for x in p], 1)
        if step < steps:
            share = share * slope
            share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
    fit = np.add.reduceat(np.log(mass) * weight, at)
    return share, fit, fit + amount * np.log(np.maximum((slope * allowed).max(1) / amount, 1))


def fit(training: DataFrame) -> Model:
    """From (text, lang) of all rows; the table has SLOTS rows a language."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, np.ndarray] = {}
        for batch in T.batched(it, "text"):
            langs = batch.column("lang").dictionary_encode()
            names, of = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            for keys, cuts in zip(*_slots(batch.column("text")), strict=True):
                table = np.bincount(np.repeat(of << SLOT_BITS, np.diff(cuts)) | keys, minlength=len(names) * SLOTS).reshape(-1, SLOTS)
                for lang, n in zip(names, table, strict=True):
                    have[lang] = have.get(lang, 0) + n
        for lang, table in have.items():
            used = np.flatnonzero(table)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used), pa.string()), "slot": pa.array(used, pa.int32()), "n": pa.array(table[used])})

    rows = training.select("text", "lang").mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((len(langs), SLOTS))
    if langs:
        of = {x: i for i, x in enumerate(langs)}
        counts[[of[x] for x in rows.column("lang").to_pylist()], rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return Model(langs, counts)


def identify(docs: DataFrame, model: Model, penalty: float = 8.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, langs, shares for every row; `und` without text or letter.

    langs and shares: the languages of the chosen set and their proportions, the
    largest first. Of languages that fit equally well the first by name counts; a
    text of one letter is judged by that letter between blanks. With no language
    learnt all rows are `und` with score 0. Repeated rows give equal rows; a null
    id is carried along; no other column is read, whatever its name. Texts are read
    whole; one has to fit a worker's memory some fifty times over.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, "und"], object)
        for batch in T.batched(it, "text", 2 << 20):
            column = batch.column("text")
            lead, score, shares = model.infer(column, penalty)
            none = ~U.has_letter(*T.buffers(column)) | (not model.langs)
            lead, shares = np.where(none, len(model.langs), lead), np.where(none[:, None], 0, shares)
            order = np.argsort(-shares, 1, kind="stable")
            size = (shares > 0).sum(1)
            kept = np.arange(shares.shape[1])[None, :] < size[:, None]
            cuts = pa.array(np.append(0, np.cumsum(size)), pa.int32())
            langs = pa.ListArray.from_arrays(cuts, pa.array(names[order[kept]].tolist(), pa.string()))
            parts = pa.ListArray.from_arrays(cuts, pa.array(np.take_along_axis(shares, order, 1)[kept], pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names[lead].tolist(), pa.string()), pa.array(np.where(none, 0.0, score)), langs, parts], names=["doc_id", "lang_pred", "score", "langs", "shares"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>")
