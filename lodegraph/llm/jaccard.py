"""N-gram Jaccard join with set-relation skipping, and the groups that it links.

Sets of word n-grams are ordered rarest first. A census of all n-grams leaves
out those that one document holds, and with them every set whose shared n-grams
are too few for any link. Sets that share an n-gram of their prefixes meet at a
leader, the member with the fewest n-grams of its own. There each set is its
difference from the leader's: the answers for the leader give those for a
similar set, as the overlap of two members follows from their differences
alone. Members whose differences are small link at once; the others look up
index lists of the differences, ordered by what an entry still allows, and skip
the rest of a list from the first position that can't reach the threshold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from lodegraph.llm import exchange as X, text as T
from lodegraph.operators.checkpoints import cut
from lodegraph.operators.components import connected_components

SHARD_BYTES = 2 << 20
#: Larger groups of a leader are worked on in parts of about so many members.
PART = 1024


@dataclass(frozen=True)
class Measure:
    words: int = 3
    percent: int = 90  # 100 * intersection >= percent * union


class _Sets:
    """Distinct n-grams of each text: hashes ascending inside a text, at[i]..at[i+1]."""

    def __init__(self, column: pa.Array, words: int):
        w = T.Words(column, lower=True)
        hashes = w.hashes()
        n = len(w.counts)
        good = np.flatnonzero(T.window_starts(w.at, words))
        grams, doc = T.windows(hashes, words, words)[good], w.doc[good]
        short = np.flatnonzero((w.counts > 0) & (w.counts < words))  # the whole sequence is one
        whole = [T.windows(hashes[w.at[i] : w.at[i + 1]], int(w.counts[i]), 1000 + int(w.counts[i])) for i in short]
        grams, doc = np.concatenate([grams, *whole]), np.concatenate([doc, short])
        order = np.lexsort((grams, doc))
        grams, doc = grams[order], doc[order]
        fresh = np.append(True, (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1]))[: len(grams)]
        self.grams, self.doc = grams[fresh], doc[fresh]
        self.at = np.searchsorted(self.doc, np.arange(n + 1))
        self.sizes = np.diff(self.at)
        self.sign = T.mix(T.mix(self.grams) + np.uint64(77))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.sign)])
        other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(self.sign))])
        self.key = np.stack([total[self.at[1:]] - total[self.at[:-1]], other[self.at[1:]] - other[self.at[:-1]]], 1)


def _first_copies(sets: _Sets, ids: np.ndarray) -> np.ndarray:
    """Row of the smallest id with the same set, in this shard; -1 for empty sets."""
    order = np.lexsort((ids, sets.key[:, 1], sets.key[:, 0]))
    k = sets.key[order]
    fresh = np.append(True, (k[1:] != k[:-1]).any(1))[: len(order)]
    out = np.empty(len(ids), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))] if len(order) else order
    return np.where(sets.sizes > 0, out, -1)


def shingle_counts(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles) of every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.batched(it, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_Sets(batch.column("text"), words).sizes, pa.int64())], names=["doc_id", "n_shingles"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long")


def _leaders(origins: list[int], bodies: list[bytes]) -> Iterable[tuple[int, int, bytes]]:
    """To each shard the leader and the number of members for its prefix n-grams that two sets share."""
    sent = [X.unpack(b) for b in bodies]
    code, own, doc, held = (np.concatenate([s[k] for s in sent]) for k in range(4))
    order = np.lexsort((doc, own, code))
    first = np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1]))
    size = np.diff(np.append(first, len(code)))
    lead, members = np.empty(len(code), np.int64), np.empty(len(code), np.int64)
    lead[order] = np.repeat(doc[order][first], size)
    members[order] = np.repeat(np.add.reduceat(held[order].astype(np.int64), first), size)
    at = 0
    for origin, s in zip(origins, sent, strict=True):
        mine = slice(at, at + len(s[0]))
        at += len(s[0])
        keep = members[mine] > 1
        if keep.any():
            yield 0, origin, X.pack(s[0][keep], lead[mine][keep], members[mine][keep].astype(np.uint32), ordered=True)


def differences(sets: list[np.ndarray], leader: int) -> list[np.ndarray]:
    """What each set has and the leader's lacks, or the other way round."""
    return [np.setxor1d(s, sets[leader], assume_unique=True) for s in sets]


def debts(sizes: np.ndarray, own: np.ndarray, length: np.ndarray, percent: int) -> np.ndarray:
    """Two sets link even without a shared difference if their debts are at most 0 together."""
    return (100 + percent) * (length + own) - (100 - percent) * sizes


def group_links(sizes: np.ndarray, own: np.ndarray, sets: list[np.ndarray], leader: int, percent: int) -> list[tuple[int, int]]:
    """Links that connect the members of a group as all their links would.

    sizes: of the sets; own: n-grams that no other set holds; sets: the other
    n-grams, ascending. Two sets link when (100 + percent) * |symmetric
    difference| <= (100 - percent) * (sum of sizes).
    """
    n, base = len(sets), sets[leader]
    diffs = differences(sets, leader)
    length = np.array([len(d) for d in diffs])
    debt = debts(sizes, own, length, percent)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    links = []

    def link(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            links.append((i, j))

    best = int(np.argmin(debt))
    for i in np.flatnonzero(debt + debt[best] <= 0).tolist():
        if i != best:
            link(i, best)
    if len(links) == n - 1:
        return links
    flat = np.concatenate(diffs) if n else base
    member = np.repeat(np.arange(n), length)
    order = np.lexsort((debt[member], flat))
    flat, member = flat[order], member[order]
    new = np.append(True, flat[1:] != flat[:-1])[: len(flat)]
    entry = np.empty(len(flat), np.int64)  # list of each difference, by member
    entry[order] = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(flat))
    owed = debt[member]
    gain, at = 2 * (100 + percent), np.cumsum(length) - length
    for i in range(n):
        lists = entry[at[i] : at[i] + length[i]]
        lists = lists[end[lists] - begin[lists] > 1]
        if not len(lists):
            continue
        most = gain * len(lists) - debt[i]  # a partner's debt can't be larger
        found = [member[b : b + int(np.searchsorted(owed[b:e], most, "right"))] for b, e in zip(begin[lists].tolist(), end[lists].tolist(), strict=True)]
        shared = np.bincount(np.concatenate(found), minlength=n)
        for j in np.flatnonzero((shared > 0) & (debt + debt[i] <= gain * shared)).tolist():
            if j != i:
                link(i, j)
    return links


def links(docs: DataFrame, measure: Measure, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b): pairs of ids that connect documents exactly as all links do."""
    plan = X.Plan(docs, SHARD_BYTES, id_col, text_col)
    bits, n_gram, n_group = plan.bits, plan.buckets(8 << 20), plan.buckets(16 << 20)
    words, percent, part = measure.words, measure.percent, PART

    def grams(shard: int, t: pa.Table) -> pa.Table:
        s, ids = _Sets(X.text_of(t), words), X.ids_of(t)
        one = _first_copies(s, ids) == np.arange(len(ids))
        use = one[s.doc]
        return X.ballot(shard, X.trim(s.grams[use], bits), s.doc[use], n_gram)

    def survivors(shard: int, t: pa.Table, replies: list[bytes]) -> pa.Table:
        """Sets that can link, each with its shared n-grams rarest first; and copies with their first one."""
        s, ids = _Sets(X.text_of(t), words), X.ids_of(t)
        copy = _first_copies(s, ids)
        codes, held = X.result(replies)
        found = X.lookup(codes, X.trim(s.grams, bits))
        shared = T.sums(found >= 0, s.at)
        rows = np.flatnonzero((copy == np.arange(len(ids))) & (100 * shared >= percent * s.sizes) & (s.sizes > 0))
        bodies = []
        for i in rows.tolist():
            at = s.at[i] + np.flatnonzero(found[s.at[i] : s.at[i + 1]] >= 0)
            bodies.append(X.pack(s.grams[at[np.argsort(held[found[at]], kind="stable")]]))
        again = np.flatnonzero((copy >= 0) & (copy != np.arange(len(ids))))
        n = len(rows)
        return pa.table(
            {
                "shard": pa.array(np.full(n + len(again), shard), pa.int32()), "key": pa.array([s.key[i].tobytes() for i in rows.tolist()] + [None] * len(again), pa.binary()), "id": pa.array(np.concatenate([ids[rows], ids[again]]), pa.int64()),
                "copy_of": pa.array([None] * n + ids[copy[again]].tolist(), pa.int64()), "size": pa.array([*s.sizes[rows].tolist(), *[None] * len(again)], pa.int32()),
                "own": pa.array([*(s.sizes - shared)[rows].tolist(), *[None] * len(again)], pa.int32()), "grams": pa.array([*bodies, *[None] * len(again)], pa.binary()),
            }
        )

    census = X.answer(plan.send(grams), X.census)
    kept = cut(plan.with_replies(census, survivors, "shard int, key binary, id long, copy_of long, size int, own int, grams binary"))
    copies = kept.where("copy_of is not null").select(F.col("id").alias("a"), F.col("copy_of").alias("b"))
    sets = kept.where("copy_of is null").select("shard", "id", "size", "own", "grams")
    # Of equal sets in several shards the smallest id goes on; the others only link to it. A key that
    # very many shards hold is combined before the shuffle, and its rows are narrow where they meet it.
    keyed = kept.where("key is not null").select("key", "shard", "id")
    several = keyed.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    later = cut(keyed.join(several, "key").where("id <> first").select("shard", "id", "first"))
    equal = later.select(F.col("id").alias("a"), F.col("first").alias("b"))
    dropped = later.select(F.lit(-1).alias("bucket"), F.col("shard").alias("origin"), F.encode(F.col("id").cast("string"), "UTF-8").alias("body"))

    def without(t: pa.Table, r: pa.Table) -> tuple[pa.Table, list[bytes]]:
        """Sets that go on, and the replies, told from the ids that don't."""
        buckets, bodies = r.column("bucket").to_pylist(), r.column("body").to_pylist()
        gone = pa.array([int(x) for k, x in zip(buckets, bodies, strict=True) if k < 0], pa.int64())
        return t.filter(pc.invert(pc.is_in(t.column("id"), gone))), [x for k, x in zip(buckets, bodies, strict=True) if k >= 0]

    def prefix(size: int, own: int) -> int:
        """Shared n-grams in the prefix: the set's own ones come before them."""
        return max(0, size - -(-percent * size // 100) + 1 - own)

    def prefixes(key: tuple[pa.Scalar, ...], t: pa.Table, r: pa.Table) -> pa.Table:
        t, _ = without(t, r)
        if not t.num_rows:
            return X.messages([])
        code, own, doc = [], [], []
        for i, size, alone, body in zip(*(t.column(c).to_pylist() for c in ("id", "size", "own", "grams")), strict=True):
            head = X.unpack(body)[0][: prefix(size, alone)]
            code.append(head)
            own.append(np.full(len(head), alone, np.int32))
            doc.append(np.full(len(head), i, np.int64))
        c, o, d = (np.concatenate(x) for x in (code, own, doc))
        order = np.lexsort((d, o, c))
        c, o, d = c[order], o[order], d[order]
        first = np.flatnonzero(np.append(True, c[1:] != c[:-1])[: len(c)])
        held = np.diff(np.append(first, len(c))).astype(np.uint32)
        c, o, d = c[first], o[first], d[first]
        _, cuts = X.deal(c, n_gram)
        return X.messages((b, key[0].as_py(), X.pack(c[p:q], o[p:q], d[p:q], held[p:q], ordered=True)) for b, (p, q) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if q > p)

    def join(key: tuple[pa.Scalar, ...], t: pa.Table, r: pa.Table) -> pa.Table:
        """Every set to the leaders of its prefix."""
        t, bodies = without(t, r)
        replies = [X.unpack(b) for b in bodies]
        out = []
        if replies and t.num_rows:
            code, lead, members = (np.concatenate(c) for c in zip(*replies, strict=True))
            order = np.argsort(code)
            code, lead, parts = code[order], lead[order], -(-members[order].astype(np.int64) // part)
            for i, size, alone, body in zip(*(t.column(c).to_pylist() for c in ("id", "size", "own", "grams")), strict=True):
                found = X.lookup(code, X.unpack(body)[0][: prefix(size, alone)])
                found = found[found >= 0]
                for leader, n in set(zip(lead[found].tolist(), parts[found].tolist(), strict=True)):
                    for j in [hash(i) % n] if leader != i else range(n):
                        at = int(T.mix(np.array([(leader * 2654435761 + j * 40503 + n) % (1 << 64)], np.uint64))[0] % np.uint64(n_group))
                        out.append((at, leader, n, j, 0, i, size, alone, body))
        names = ("bucket", "leader", "parts", "j", "k", "id", "size", "own", "grams")
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        columns = zip(*out, strict=True) if out else [[] for _ in names]
        return pa.table({n: pa.array(list(c), k) for n, c, k in zip(names, columns, kinds, strict=True)})

    def meet(t: pa.Table, tell_far: bool) -> pa.Table:
        """Links in each group as (a, b); if asked, of groups in parts also the members that don't link to the leader at once."""
        # One id may bear several sets, so that a set's own n-grams tell it from the others.
        t = t.append_column("mark", pa.array([zlib.crc32(x) for x in t.column("grams").to_pylist()], pa.int64()))
        t = t.sort_by([(c, "ascending") for c in ("leader", "parts", "j", "k", "id", "mark")])
        rows = np.stack([t.column(c).to_numpy() for c in ("leader", "parts", "j", "k", "id", "mark")], 1)
        once = np.append(True, (rows[1:] != rows[:-1]).any(1))[: len(rows)]
        t, group = t.filter(pa.array(once)), rows[once][:, :4]
        ids, sizes, own, bodies = t.column("id").to_numpy(), t.column("size").to_numpy().astype(np.int64), t.column("own").to_numpy().astype(np.int64), t.column("grams")
        first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(1))[: len(group)])
        a, b, far = [], [], []
        for p, q in zip(first, np.append(first[1:], len(ids)), strict=True):
            lead = np.flatnonzero(ids[p:q] == group[p, 0])
            if q - p < 2 or not len(lead):
                continue
            sets, leader = [np.sort(X.unpack(x)[0]) for x in bodies[int(p) : int(q)].to_pylist()], int(lead[0])
            for i, j in group_links(sizes[p:q], own[p:q], sets, leader, percent):
                a.append(ids[p + i])
                b.append(ids[p + j])
            if tell_far and group[p, 1] > 1:
                owed = debts(sizes[p:q], own[p:q], np.array([len(d) for d in differences(sets, leader)]), percent)
                far += (p + np.flatnonzero(owed + owed[leader] > 0)).tolist()
        rest = t.take(pa.array(far, pa.int64())).select(["leader", "parts", "id", "size", "own", "grams"])
        links_ = pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
        return pa.concat_tables([links_, rest], promote_options="default") if tell_far else links_

    leaders = cut(X.answer(sets.groupBy("shard").cogroup(dropped.groupBy("origin")).applyInArrow(prefixes, X.MESSAGE), _leaders))
    member = "bucket int, leader long, parts int, j int, k int, id long, size int, own int, grams binary"
    members = sets.groupBy("shard").cogroup(leaders.union(dropped).groupBy("origin")).applyInArrow(join, member)
    known = copies.union(equal)

    def largest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_pydict({"n": pa.array([int(X.unpack(x)[2].max()) for x in batch.column("body").to_pylist()], pa.int64())})

    if (leaders.mapInArrow(largest, "n long").agg(F.max("n")).first()[0] or 0) <= part:
        return members.groupBy("bucket").applyInArrow(lambda t: meet(t, False), "a long, b long").union(known)

    # Groups in parts: members close to the leader are connected by it. The far ones, in blocks, visit all parts.
    met = cut(members.groupBy("bucket").applyInArrow(lambda t: meet(t, True), "a long, b long, leader long, parts int, id long, size int, own int, grams binary"))
    far = met.where("id is not null").select("leader", "parts", "id", "size", "own", "grams")
    blocks = cut(far.groupBy("leader", "parts").agg(F.ceil(F.count("*") / part).cast("int").alias("blocks")))
    columns = ["leader", "parts", "j", "k", "id", "size", "own", "grams"]
    hosts = members.where("parts > 1").drop("k").join(blocks, ["leader", "parts"]).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    visits = far.join(blocks, ["leader", "parts"]).withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = hosts.select(columns).union(visits.select(columns)).withColumn("bucket", F.pmod(F.xxhash64("leader", "parts", "j", "k"), F.lit(n_group)))
    return both.groupBy("bucket").applyInArrow(lambda t: meet(t, False), "a long, b long").union(met.where("a is not null").select("a", "b")).union(known)


def jaccard_groups(docs: DataFrame, measure: Measure | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) of every row.

    Words are compared with A-Z lowered; a text below the n-gram's length is one
    n-gram; null and empty texts have none and link with nothing. Equal texts
    link whatever their number. A null id counts as larger than all others and
    names its component only where no other id does, as null. Rows of one id are one
    document; extra columns, whatever their names, are not read. Texts are read
    whole; one has to fit a worker's memory some fifty times over.
    """
    measure = measure or Measure()
    groups = connected_components(links(docs, measure, id_col, text_col))
    counts = shingle_counts(docs, measure.words, id_col, text_col)
    key = F.coalesce("doc_id", F.lit(X.NULL_ID))
    found = counts.withColumn("id", key).join(groups, "id", "left")
    component = F.coalesce("component", "id")
    return found.select("doc_id", "n_shingles", F.when(component != X.NULL_ID, component).alias("component_id"))


def first_of_groups(docs: DataFrame, measure: Measure, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, without those that link to a smaller id by any chain.

    Of rows with one id and one text one stays, whichever; rows with a null id all
    stay, as do texts without words. Columns of any names are handed on. Texts are
    read whole; one has to fit a worker's memory some fifty times over.
    """
    groups = connected_components(links(docs.where(F.col(id_col).isNotNull()), measure, id_col, text_col))
    own, copy = X.spare(docs, "later_id"), X.spare(docs, "copy")
    later = groups.where("component < id").select(F.col("id").alias(own))
    left = docs.join(later, F.col(id_col) == F.col(own), "left_anti")
    once = Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.lit("x"))
    named = left.where(F.col(id_col).isNotNull()).withColumn(copy, F.row_number().over(once)).where(F.col(copy) == 1).drop(copy)
    return named.union(left.where(F.col(id_col).isNull()))
