"""The pipeline against a plain version of every stage."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lodegraph.llm import bpe, exchange, quality
from lodegraph.llm.queries import ranks_path
from tests.llm import brute


def kept_by_rules(text, rules=quality.Rules()):
    words = brute.WORD.findall(text or "")
    n_words, chars, _, _, repeats = brute.quality(text)
    if n_words < rules.min_words or repeats > rules.max_repeat_words * n_words:
        return False
    seen, dup = set(), 0
    for line in text.split("\n"):
        if brute.WORD.search(line):
            dup += sum(map(len, brute.WORD.findall(line))) if line in seen else 0
            seen.add(line)
    marks = [m for m in ("".join(c for c in w if c in "#*$%&|<>") for w in words) if m]
    pairs = Counter(zip(marks, marks[1:], strict=False))
    twice = {k + j for k in range(len(marks) - 1) if pairs[marks[k], marks[k + 1]] > 1 for j in (0, 1)}
    if dup > rules.max_dup_line_chars * chars or len(twice) > rules.max_dup_mark_words * n_words:
        return False
    for n, most in rules.ngram_ceilings.items():
        count = Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
        mark = {k + j for k in range(len(words) - n + 1) if count[tuple(words[k : k + n])] > 1 for j in range(n)}
        if sum(len(words[k]) for k in mark) > most * chars:
            return False
    return True


def plain(rows, items):
    docs = [r for r in rows if kept_by_rules(r[1])]
    groups = {(i, c) for i, _, c in brute.jaccard_components([r[:2] for r in docs], 5, 80)}
    docs = [r for r in dict.fromkeys(docs) if r[0] is None or (r[0], r[0]) in groups]
    out = []
    for i, x, mask in brute._gone([r[:2] for r in docs], lambda t: t.encode(), 50):
        out.append((i, bytes(b for b, m in zip(x, mask, strict=True) if not m).decode("utf-8", "ignore")))
    out = [(i, t) for i, t in out if brute.WORD.search(t)]
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(ranks_path()).rank, special_tokens={})
    kept = []
    for i, t in out:
        bare = " ".join(brute.WORD.findall("".join(c if c.isalnum() else " " for c in t.lower())))
        if any(f" {x} " in f" {bare} " for x in items):
            continue
        ids = encoding.encode_ordinary(t)
        kept.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), ids))
    return brute._order(kept)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(2_000)] + ["été", "日本"]

    def some(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [some(25) for _ in range(8)]
    passage = some(60)
    rows = []
    for i in range(160):
        words = some(rng.randrange(30, 200))
        kind = i % 8
        if kind == 1:
            words = words[:40] + passage + words[40:]
        elif kind == 2:
            words[20:20] = [w.upper() for w in rng.choice(items)]
        elif kind == 3:
            words = [w + "$$" for w in words]
        elif kind == 4 and rows:
            words = rows[rng.randrange(len(rows))][1].split()
            words[rng.randrange(len(words))] = "edited"
        rows.append((i, " ".join(words), "en", "s", 0))
    rows = [(i, t, lang, s, len(t)) for i, t, lang, s, _ in rows] + [(900, None, None, None, None), (901, "", "en", "s", 0), rows[8][:4] + (len(rows[8][1]),), (None, rows[0][1], "en", "s", 3)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, [" ".join(x) for x in items]


def test_pipeline(spark, folder):
    at, rows, items = folder
    out = corpus_pipeline.run(spark, at).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")
    want = plain(rows, items)
    assert 0 < len(want) < len(rows)
    assert brute._order([tuple(r) for r in out.collect()]) == want


def test_stages_keep_the_columns(spark, folder):
    at, _, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "suffix_dedup", "decontamination", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, at)
            assert out.dtypes == docs.dtypes
            out.count()
    assert all(r.n_chars == len(r.text) or r.n_chars in (None, 3) for r in corpus_pipeline.without_repeats(spark, docs, at).collect())


def test_odd_columns_and_empty_tables(spark, folder, tmp_path):
    """Names that operators use themselves are handed on; no documents and no items are no error."""
    at, rows, _ = folder
    names = ("later_id", "copy", "carry_0", "kept_text", "shard", "id", "word", "group_copy")
    wide = spark.read.parquet(f"{at}/documents.parquet")
    for k, name in enumerate(names):
        wide = wide.withColumn(name, F.lit(None).cast("string") if k % 2 else F.concat(F.lit(f"{name} "), F.col("doc_id").cast("string")))
    wide.write.parquet(f"{tmp_path}/wide/documents.parquet")
    spark.read.parquet(f"{at}/benchmark.parquet").write.parquet(f"{tmp_path}/wide/benchmark.parquet")
    plain_ = brute._order([tuple(r) for r in corpus_pipeline.run(spark, at).select("doc_id", "ids_sha256").collect()])
    assert brute._order([tuple(r) for r in corpus_pipeline.run(spark, f"{tmp_path}/wide").select("doc_id", "ids_sha256").collect()]) == plain_
    docs = spark.read.parquet(f"{tmp_path}/wide/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/wide").cache()
        assert docs.columns == wide.columns
        assert all(r.later_id is None or r.later_id == f"later_id {r.doc_id}" for r in docs.collect())
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_results_go_once_they_are_read(spark, folder):
    import glob

    corpus_pipeline.run(spark, folder[0]).count()
    kept = [p.rsplit("/", 1)[1] for p in glob.glob(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/pipeline-*/*")]
    assert kept and set(kept) == {"4-byte_bpe"}


def test_repeats_go_in_whatever_order_rows_come(spark, folder, monkeypatch):
    class Shuffled(exchange.Plan):
        seed = 0

        def with_replies(self, replies, f, schema):
            self.seed += 1
            seed = self.seed
            return super().with_replies(replies, lambda shard, t, bodies: f(shard, t.take(np.random.default_rng(seed).permutation(t.num_rows)), bodies), schema)

    at, rows, _ = folder
    monkeypatch.setattr(exchange, "Plan", Shuffled)
    kept = corpus_pipeline.without_repeats(spark, spark.read.parquet(f"{at}/documents.parquet"), at).select("doc_id", "text").collect()
    texts = [(i, bytes(b for b, m in zip(x, mask, strict=True) if not m).decode("utf-8", "ignore")) for i, x, mask in brute._gone([r[:2] for r in rows], lambda t: (t or "").encode(), 50)]
    assert Counter(map(tuple, kept)) == Counter((i, t) for i, t in texts if brute.WORD.search(t))
