"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths mark, inside one document, the
characters that lie in an n-gram seen more than once, and lines seen before. The
same is done with the symbols alone that words carry, as tables and decorated
text repeat those and not their words. Each share has its own ceiling, beside
those on counts of words and of repeated windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodegraph.llm import text as T

#: Share of word characters that may lie in repeated n-grams, by n: above what good documents of one half of the labels reach.
NGRAM_CEILINGS = {2: 0.80, 3: 0.50, 5: 0.48, 7: 0.46, 10: 0.44}
#: Words whose symbols make up one run, and the share of words that may lie in repeated ones.
MARKS, MARK_CEILING = 2, 0.15
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict."""

    min_words: int = 50
    max_repeat_words: float = 0.5
    max_dup_line_chars: float = 0.30
    #: Share of words that carry symbols in a repeated run of MARKS words' symbols.
    max_dup_mark_words: float = MARK_CEILING
    ngram_ceilings: dict[int, float] = field(default_factory=lambda: dict(NGRAM_CEILINGS))


def measure(column: pa.Array, ngrams: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts and coverage shares of every text of a slice."""
    w = T.Words(column)
    n = len(w.counts)
    chars = w.code_points()
    hashes = w.hashes()
    word_chars = T.sums(chars, w.at)
    out = {"n_words": w.counts.astype(np.int64), "word_chars": word_chars}
    out["n_symbols"] = T.sums(_SYMBOL[w.buf], w.offsets)
    out["upper"] = T.sums((w.buf >= 65) & (w.buf <= 90), w.offsets)
    out["lower"] = T.sums((w.buf >= 97) & (w.buf <= 122), w.offsets)

    cuts = np.flatnonzero(w.buf == 10)
    starts = np.unique(np.concatenate([w.offsets[:-1][np.diff(w.offsets) > 0], cuts + 1]))
    starts = starts[starts < len(w.buf)]
    ends = np.append(starts[1:], len(w.buf)) if len(starts) else starts
    ends = ends - ((ends > starts) & (w.buf[ends - 1] == 10)) if len(starts) else ends
    line_doc = np.searchsorted(w.offsets, starts, "right") - 1
    with_word = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, line_doc = starts[with_word], ends[with_word], line_doc[with_word]
    keys = T.distinct_spans(w.buf, starts, ends)[1] * n + line_doc
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n)
    upto = np.concatenate([[0], np.cumsum(chars)])
    line_chars = upto[np.searchsorted(w.starts, ends)] - upto[np.searchsorted(w.starts, starts)]
    dup_chars = np.bincount(line_doc[again], line_chars[again], minlength=n)
    whole = np.maximum(word_chars, 1)
    out["dup_line_chars"] = dup_chars / whole

    # The symbols of each word by themselves, end to end.
    symbols = np.append(0, np.cumsum(_SYMBOL[w.buf]))
    low, high = symbols[w.starts], symbols[w.ends]
    marked = np.flatnonzero(high > low)
    marks = T.span_hashes(w.buf[_SYMBOL[w.buf]], low[marked], high[marked])
    at = np.searchsorted(marked, w.at)
    good = np.flatnonzero(T.window_starts(at, MARKS)) if len(marked) >= MARKS else marked[:0]
    keys = T.in_doc(T.windows(marks, MARKS, 9)[good], w.doc[marked[good]])
    out["dup_mark_words"] = T.sums(T.covered(len(marked), good[T.repeated(keys)], MARKS), at) / np.maximum(w.counts, 1)

    for size in sorted({3, *ngrams}):
        good = np.flatnonzero(T.window_starts(w.at, size))
        keys = T.in_doc(T.windows(hashes, size, size)[good], w.doc[good])
        mark = T.covered(len(hashes), good[T.repeated(keys)], size)
        if size == 3:
            out["n_repeat_words"] = T.sums(mark, w.at)
        out[f"dup_{size}gram_chars"] = T.sums(np.where(mark, chars, 0), w.at) / whole
    return out


def verdict(m: dict[str, np.ndarray], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    words = m["n_words"]
    base = (words < rules.min_words) | (m["n_repeat_words"] > rules.max_repeat_words * words)
    bad = m["dup_line_chars"] > rules.max_dup_line_chars
    bad |= m["dup_mark_words"] > rules.max_dup_mark_words
    for size, most in rules.ngram_ceilings.items():
        bad |= m[f"dup_{size}gram_chars"] > most
    return base, ~base & ~bad


def quality_rules(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: counts, coverage shares, base_failed, kept.

    A null or empty text has no words and fails; a null id is carried along;
    repeated rows are judged one by one; a share equal to its ceiling passes; other
    columns, whatever their names, are not read. Texts are read whole; one has to
    fit a worker's memory some fifty times over.
    """
    rules = rules or Rules()
    sizes = tuple(sorted(rules.ngram_ceilings))
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    shares = ("dup_line_chars", "dup_mark_words", *(f"dup_{k}gram_chars" for k in sizes))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.batched(it, "text"):
            m = measure(batch.column("text"), sizes)
            base, kept = verdict(m, rules)
            columns = [batch.column("id"), *(pa.array(m[k], pa.int64()) for k in longs), *(pa.array(m[k], pa.float64()) for k in shares), pa.array(base), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *longs, *shares, "base_failed", "kept"])

    schema = ", ".join(["doc_id long", *(f"{k} long" for k in longs), *(f"{k} double" for k in shares), "base_failed boolean", "kept boolean"])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def passing(docs: DataFrame, rules: Rules | None = None, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns whatever their names, that the rules keep; null and empty texts go, repeated rows are judged one by one."""
    rules = rules or Rules()
    sizes = tuple(sorted(rules.ngram_ceilings))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.batched(it, text_col):
            yield batch.filter(pa.array(verdict(measure(batch.column(text_col), sizes), rules)[1]))

    return docs.mapInArrow(run, docs.schema)
