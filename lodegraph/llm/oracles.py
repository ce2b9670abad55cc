"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

from lodegraph.llm.quality import NGRAM_CEILINGS, Rules

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

REPEATED_BYTES = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT rid, doc_id, unnest(range(0, length(x) // 2 - 49)) AS k, unnest(list_transform(range(0, length(x) // 2 - 49), lambda k: md5_number(substring(x, 2 * k + 1, 100)))) AS h FROM d),
m AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h HAVING count(*) > 1),
s AS (SELECT rid, k FROM w JOIN m ON m.h = w.h WHERE first < doc_id),
e AS (SELECT rid, k, coalesce(k > 50 + max(k) OVER (PARTITION BY rid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens FROM s),
f AS (SELECT rid, k, sum(opens::INT) OVER (PARTITION BY rid ORDER BY k) AS span FROM e),
p AS (SELECT rid, span, min(k) AS low, max(k) + 50 AS high FROM f GROUP BY ALL),
q AS (SELECT rid, low, high, coalesce(lag(high) OVER (PARTITION BY rid ORDER BY low), 0) AS since FROM p),
g AS (SELECT q.rid, sum(high - low) AS gone, count(*) AS n, string_agg(substring(x, 2 * since + 1, 2 * (low - since)), '' ORDER BY low) || substring(any_value(x), 2 * max(high) + 1) AS kept FROM q JOIN d ON d.rid = q.rid GROUP BY q.rid)
SELECT d.doc_id, (length(d.x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept, d.x))) AS kept_sha256
FROM d LEFT JOIN g ON g.rid = d.rid"""

REPEATED_WORDS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT rid, doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d),
v AS (SELECT rid, doc_id, k, md5(string_agg(x, ' ') OVER o) AS h, count(*) OVER o AS n FROM t WINDOW o AS (PARTITION BY rid ORDER BY k ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
m AS (SELECT h, min(doc_id) AS first FROM v WHERE n = 13 GROUP BY h),
s AS (SELECT rid, k FROM v JOIN m ON m.h = v.h WHERE n = 13 AND first < doc_id),
c AS (SELECT t.rid, t.k, t.x, max((s.k IS NOT NULL)::INT) OVER (PARTITION BY t.rid ORDER BY t.k ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM t LEFT JOIN s ON s.rid = t.rid AND s.k = t.k)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed, sha256(coalesce(string_agg(x, ' ' ORDER BY k) FILTER (WHERE gone = 0), '')) AS kept_sha256
FROM d LEFT JOIN c ON c.rid = d.rid GROUP BY d.rid, d.doc_id, len(d.w)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d WHERE len(w) >= 3),
v AS (SELECT doc_id, string_agg(x, ' ') OVER o AS g, count(*) OVER o AS n FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(g) AS h FROM v WHERE n = 3 UNION ALL SELECT doc_id, md5(array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND 2),
z AS (SELECT doc_id, count(*) AS size FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * n >= 90 * (x.size + y.size - n)),
r(id, root) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE r.root < l.b)
SELECT d.doc_id, coalesce(z.size, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id
FROM d LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) c ON c.id = d.doc_id"""


def _quality() -> str:
    rules, sizes = Rules(), sorted(NGRAM_CEILINGS)
    windows = ", ".join(f"md5(string_agg(x, ' ') OVER o{n}) AS h{n}, count(*) OVER o{n} AS n{n}" for n in sizes)
    frames = ", ".join(f"o{n} AS (PARTITION BY rid ORDER BY k ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)" for n in sizes)
    twice = ", ".join(f"n{n} = {n} AND count(*) OVER (PARTITION BY rid, h{n}, n{n}) > 1 AS r{n}" for n in sizes)
    cover = ", ".join(f"max(r{n}::INT) OVER (PARTITION BY rid ORDER BY k ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in sizes)
    sums = ", ".join(f"coalesce(sum(length(x)) FILTER (WHERE c{n} = 1), 0) AS d{n}" for n in sizes)
    shares = ", ".join(f"coalesce(d{n}, 0) / greatest(coalesce(word_chars, 0), 1) AS dup_{n}gram_chars" for n in sizes)
    within = " AND ".join(f"dup_{n}gram_chars <= {most}" for n, most in NGRAM_CEILINGS.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
t AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d),
v AS (SELECT rid, k, x, {windows} FROM t WINDOW {frames}),
u AS (SELECT rid, k, x, {twice} FROM v),
c AS (SELECT rid, x, {cover} FROM u),
g AS (SELECT rid, sum(length(x)) AS word_chars, sum(c3) AS n_repeat_words, {sums} FROM c GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
m AS (SELECT rid, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars, row_number() OVER (PARTITION BY rid, line ORDER BY k) > 1 AS again FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
q AS (SELECT rid, mark, row_number() OVER (PARTITION BY rid ORDER BY k) AS j FROM (SELECT rid, k, regexp_replace(x, '[^#*$%&|<>]', '', 'g') AS mark FROM t) WHERE mark <> ''),
p AS (SELECT rid, j, mark || ' ' || lead(mark) OVER (PARTITION BY rid ORDER BY j) AS pair FROM q),
e AS (SELECT rid, j, (pair IS NOT NULL AND count(*) OVER (PARTITION BY rid, pair) > 1)::INT AS twice FROM p),
f AS (SELECT rid, sum(c) AS marked FROM (SELECT rid, max(twice) OVER (PARTITION BY rid ORDER BY j ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS c FROM e) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_dup_lines, sum(chars) AS dup_chars FROM m WHERE again GROUP BY rid),
a AS (SELECT d.doc_id, len(w) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
coalesce(dup_chars, 0) / greatest(coalesce(word_chars, 0), 1) AS dup_line_chars, coalesce(marked, 0) / greatest(len(w), 1) AS dup_mark_words, {shares}
FROM d LEFT JOIN g ON g.rid = d.rid LEFT JOIN n ON n.rid = d.rid LEFT JOIN f ON f.rid = d.rid),
b AS (SELECT *, n_words < {rules.min_words} OR n_repeat_words > {rules.max_repeat_words} * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND dup_line_chars <= {rules.max_dup_line_chars} AND dup_mark_words <= {rules.max_dup_mark_words} AND {within} AS kept FROM b"""


QUALITY = _quality()
