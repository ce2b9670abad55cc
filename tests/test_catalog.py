"""Registered queries against their SQL, and what holds for those without."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from lodegraph import catalog, source_catalog  # noqa: F401
from lodegraph.functions.sequences import similarity
from lodegraph.operators.similarity import METHODS

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")


def rounded(rows):
    return sorted(tuple(f"{v:.7f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rounded(tuple(r[c] for c in names) for r in df.collect()) == rounded(found.fetchall())


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and sum(r.weight for r in rows) == pytest.approx(1, abs=1e-5)
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name, method, threshold", [("diff_similarity", "diff", catalog.LOOSE), ("token_similarity", "token", catalog.THRESHOLD)])
def test_pairs_against_all_pairs(spark, name, method, threshold):
    from pyspark.sql import functions as F

    from lodegraph.functions import lines

    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", (lines.split_lines(text) if method == "diff" else lines.js_tokens(text)).alias("seq")).orderBy("doc_id").collect()
    last = {tuple(r.seq): r.doc_id for r in docs}
    first = {}
    for r in docs:
        first.setdefault(tuple(r.seq), r.doc_id)
    want = set()
    for a, i in first.items():
        for b, j in first.items():
            if a != b and i < last[b] and similarity(a, b, METHODS[method], threshold) >= threshold:
                want.add((min(i, j), max(i, j)))
    assert {(r.a, r.b) for r in catalog.QUERIES[name](spark, SF_DIR).collect()} == want


def test_whole_ranking(spark):
    rows = catalog.full_pipeline(spark, SF_DIR).collect()
    assert len(rows) == 200 and min(r["rank"] for r in rows) == 1
    by_class = {}
    for r in rows:
        by_class.setdefault(r.cluster_id, set()).add(r.weight)
    assert all(len(w) == 1 for w in by_class.values()) and sum(w for (w,) in by_class.values()) == pytest.approx(1, abs=1e-6)
    clusters = catalog.document_clusters(spark, SF_DIR).collect()
    assert sorted({r.cluster_id for r in clusters}) == list(range(len(by_class)))
    assert len(catalog.json_rows(spark, SF_DIR).collect()) == catalog.rank_competition(spark, SF_DIR).count()


def test_ranks_of_a_long_chain(spark, tmp_path):
    """Weights that come ever closer to each other along a chain share ranks as in the SQL."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT i::BIGINT AS doc_id, 'text ' || i AS text, CASE WHEN i % 9 = 0 THEN 'de' ELSE 'en' END AS lang FROM range(600) t(i)")
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    found = con.execute(catalog.ORACLES["full_pipeline"])
    names = [d[0] for d in found.description]
    df = catalog.full_pipeline(spark, str(tmp_path))
    assert rounded(tuple(r[c] for c in names) for r in df.collect()) == rounded(found.fetchall())
