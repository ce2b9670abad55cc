"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 1 << 63


def _sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def _key(i):
    return LAST if i is None else i


def _order(rows):
    return sorted(rows, key=lambda r: (_key(r[0]), *map(str, r[1:])))


def _gone(rows, cut, n):
    first = {}
    for i, t in rows:
        x = cut(t)
        for k in range(len(x) - n + 1):
            w = x[k : k + n]
            first[w] = min(first.get(w, LAST), _key(i))
    for i, t in rows:
        x = cut(t)
        mask = bytearray(len(x))
        for k in range(len(x) - n + 1):
            if first[x[k : k + n]] < _key(i):
                mask[k : k + n] = b"\1" * n
        yield i, x, mask


def repeated_bytes(rows, n=50):
    out = []
    for i, x, mask in _gone(rows, lambda t: (t or "").encode(), n):
        spans = sum(1 for k in range(len(mask)) if mask[k] and (k == 0 or not mask[k - 1]))
        out.append((i, len(x), sum(mask), spans, _sha(bytes(b for b, m in zip(x, mask, strict=True) if not m))))
    return _order(out)


def repeated_words(rows, n=13):
    out = []
    for i, x, mask in _gone(rows, lambda t: tuple(WORD.findall(t or "")), n):
        out.append((i, len(x), sum(mask), _sha(" ".join(w for w, m in zip(x, mask, strict=True) if not m).encode())))
    return _order(out)


def jaccard_components(rows, n=3, percent=90):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_id = {}
    for k, (i, _) in enumerate(rows):  # rows of one id are one node
        root[find(k)] = find(by_id.setdefault(i, k))
        for j in range(k):
            both = len(sets[k] & sets[j])
            if sets[k] and sets[j] and 100 * both >= percent * (len(sets[k]) + len(sets[j]) - both):
                root[find(k)] = find(j)
    least = defaultdict(lambda: LAST)
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], _key(i))
    return _order([(i, len(sets[k]), None if least[find(k)] == LAST else least[find(k)]) for k, (i, _) in enumerate(rows)])


def base_scores(rows, trains):
    texts = [(i, [*WORD.findall((t or "").translate(LOW)), None], trains(i)) for i, t in rows]
    count = Counter(w for _, words, learn in texts if learn for w in words)
    n, v = sum(count.values()), len(count)
    return _order([(i, not learn, len(words), sum(count[w] > 0 for w in words), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words)) for i, words, learn in texts])


def quality(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    cover = {k + j for k in range(len(words) - 2) if count[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover)
