"""Shared length of two sequences, and the similarity made of it."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Sequence
from typing import Protocol

# Fixed values of the similarity measures.
SIZE_RATIO_CUTOFF, EXACT_LIMIT = 10.0, 2000


# Lengths of the runs by which blocks are looked for; each is twice the one before.
RUNS = (1, 2, 4, 8, 16)


def block_length(a: Sequence, b: Sequence) -> int:
    """Total size of the matching blocks, every element taken as it is, as difflib's SequenceMatcher finds them. The order of a and b matters.

    The longest block of a segment, the first of equal ones, leaves the segments
    before and after it. It is looked for by runs of 16 elements, which hardly
    repeat, and by shorter ones only if none of 16 is in common.
    """
    levels: list[tuple[list, dict[int, list[int]]]] = []
    known: dict = {}
    x, y = ([known.setdefault(v, len(known)) for v in s] for s in (a, b))
    for q in RUNS:
        if min(len(x), len(y)) < 1:
            break
        if q > 1:
            known = {}
            x, y = ([known.setdefault(v, len(known)) for v in zip(s, s[q // 2 :])] for s in (x, y))
        where: dict[int, list[int]] = {}
        for j, v in enumerate(y):
            where.setdefault(v, []).append(j)
        levels.append((x, where))
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        for q, (ids, where) in zip(RUNS[len(levels) - 1 :: -1], reversed(levels), strict=False):
            if min(ahi - alo, bhi - blo) >= q and (found := _longest(ids, where, alo, ahi - q + 1, blo, bhi - q + 1)):
                i, j, size = found[0], found[1], found[2] + q - 1
                total += size
                todo += [(alo, i, blo, j), (i + size, ahi, j + size, bhi)]
                break
    return total


def _longest(ids: list, where: dict[int, list[int]], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int] | None:
    """(place in a, place in b, length) of the longest block between, the first in a, then in b, of equal ones."""
    best, size, before = None, 0, {}
    for i in range(alo, ahi):
        at, now = where.get(ids[i], ()), {}
        if len(at) > 8:
            at = at[bisect_left(at, blo) : bisect_right(at, bhi - 1)]
        for j in at:
            if blo <= j < bhi:
                k = now[j] = before.get(j - 1, 0) + 1
                if k > size:
                    best, size = (i - k + 1, j - k + 1, k), k
        before = now
    return best


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Longest common subsequence, one machine word of bits at a time.

    Bit i of `row` is 0 where the row's length grows at i; a symbol's positions
    are a bit mask, so that a whole row costs a few operations on long integers.
    """
    where: dict = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def overlap_bound(a: Sequence, b: Sequence) -> int:
    """Elements in common as multisets: no common subsequence is longer."""
    return sum((Counter(a) & Counter(b)).values())


def neighbours_bound(a: Sequence, b: Sequence) -> int:
    """As overlap_bound, by neighbours: each element that a common subsequence leaves out parts two of its others at most."""
    return (overlap_bound(list(zip(a, a[1:])), list(zip(b, b[1:]))) + len(a) + len(b) + 1) // 3


def ratio(shared: int, a: int, b: int) -> float:
    union = a + b - shared
    return shared / union if union > 0 else 0.0


class Measure(Protocol):
    """A similarity of two sequences that are not empty and whose sizes are within the cutoff.

    What it counts as shared must be a common subsequence or less, since pairs
    that can't reach a threshold by their elements alone are not scored.
    """

    def shared(self, a: Sequence, b: Sequence) -> int: ...


class DiffMeasure:
    """Total length of the matching blocks."""

    def shared(self, a: Sequence, b: Sequence) -> int:
        return block_length(a, b)


class TokenMeasure:
    """The longest common subsequence, matching blocks for long sequences."""

    def shared(self, a: Sequence, b: Sequence) -> int:
        return block_length(a, b) if min(len(a), len(b)) > EXACT_LIMIT else lcs_length(a, b)


def similarity(a: Sequence, b: Sequence, measure: Measure, threshold: float | None = None) -> float:
    """Score of a pair in this order, 0.0 without alignment where it can't reach the threshold."""
    if not a and not b:
        return 1.0
    if not a or not b or max(len(a), len(b)) / min(len(a), len(b)) > SIZE_RATIO_CUTOFF:
        return 0.0
    if threshold is not None and ratio(overlap_bound(a, b), len(a), len(b)) < threshold:
        return 0.0
    return ratio(measure.shared(a, b), len(a), len(b))
