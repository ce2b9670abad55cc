"""Registered queries of the language readers and of the alignments, and their SQL.

Sources are written from the rows of nation, region and supplier as Java, Python
and JavaScript files; the SQL states what each file refers to, not how it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodegraph.catalog import _weights_sql, block_sql, query, table
from lodegraph.functions import lines
from lodegraph.operators import references, similarity
from lodegraph.plans.corpus import rank_items

#: Nations are numbered 0 .. 24 and regions 0 .. 4.
NATIONS, REGIONS = 25, 5


def _fill(template: str, **columns: Column) -> Column:
    """The template with %name% for columns and %n+3% for the third nation (%r+1% the first region) after the row's."""
    parts = template.split("%")
    out = []
    for k, part in enumerate(parts):
        if not k % 2:
            out.append(F.lit(part))
        else:
            name, _, step = part.partition("+")
            value = columns[name]
            out.append((F.pmod(value + int(step), F.lit(NATIONS if name == "n" else REGIONS)) if step else value).cast("string"))
    return F.concat(*out)


def _files(rows: DataFrame, first: int, path: str, text: str | Column, **columns: Column) -> DataFrame:
    """Files as a source tree gives them; corpus_index is first + %k%."""
    body = _fill(text, **columns) if isinstance(text, str) else text
    return rows.select((F.lit(first) + columns["k"]).cast("int").alias("corpus_index"), _fill(path, **columns).alias("rel_path"), F.concat(F.lit("/src/"), _fill(path, **columns)).alias("path"), body.alias("text"), F.lit(None).cast("string").alias("error"))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"))
    return region, nation, table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n")).select(F.col("s_suppkey").alias("s"), "n", "r")


def _used(found: DataFrame) -> DataFrame:
    return found.select("corpus_index", "qualified_name", "simple_name", F.explode_outer("uses").alias("used"))


#: Rows of the SQL: what refers to what, by the names that f gives.
_USED = "SELECT f.corpus_index::INT AS corpus_index, f.qualified_name, f.simple_name, u.used FROM f LEFT JOIN (SELECT DISTINCT u.corpus_index, u.used FROM u JOIN known ON known.name = u.used) u USING (corpus_index)"
_ROWS = "s AS (SELECT s_suppkey AS s, n_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey), n AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation), r AS (SELECT r_regionkey AS r FROM region)"


# ---- Java ---------------------------------------------------------------------

_JAVA_REGION = "package geo;\n\n/** A region, used by import geo.R0; as text. */\npublic interface R%r% {\n    int size();\n}\n"
_JAVA_NATION = """package geo.nations;

import geo.R%r%;
import java.util.List;

@Deprecated
public class N%n% extends Base<N%n+1%> implements R%r%, Comparable<N%n%> {
    private final R%r+1% other = null;
    List<N%n+2%> near;
    String text = "new N%n+5%(); // no";

    // N%n+6% gone;
    N%n+3% next(int k) throws Exception {
        return new N%n+4%(k);
    }
}
"""
#: By s_suppkey % 4: a file that can't be one of Java, star imports, single and static imports, an enum.
_JAVA_SUPPLIER = (
    "package shop;\n\npublic class S%s% {\n    N%n% home;\n",
    "package shop;\n\nimport geo.*;\nimport geo.nations.*;\n\npublic class S%s% {\n    void visit(N%n% a, final R%r%[] b) {\n        N%n+1%.Part x;\n        for (N%n+2% y : a.all()) { }\n        try { x = null; } catch (N%n+3% e) { }\n        N%n+4%.make(b);\n    }\n}\n",
    "package shop;\n\nimport static geo.nations.N%n%.make;\nimport geo.nations.N%n+1%;\n\nfinal class S%s% extends N%n+1% {\n    java.util.Map<R%r%, N%n+2%> found = make(\"x\");\n    S%s% self;\n}\n",
    "package shop;\n\npublic enum S%s% implements R%r% {\n    A, B;\n    N%n% home() { return null; }\n}\n",
)
_JAVA_SQL = f"""WITH {_ROWS},
known AS (SELECT 'geo.R' || r AS name FROM r UNION ALL SELECT 'geo.nations.N' || n FROM n UNION ALL SELECT 'shop.S' || s FROM s),
f AS (
  SELECT r AS corpus_index, 'geo.R' || r AS qualified_name, 'R' || r AS simple_name FROM r WHERE r <> 4
  UNION ALL SELECT 10 + n, 'geo.nations.N' || n, 'N' || n FROM n
  UNION ALL SELECT 100 + s, 'shop.S' || s, 'S' || s FROM s WHERE s % 4 <> 0),
u AS (
  SELECT 10 + n AS corpus_index, 'geo.nations.N' || ((n + k) % 25) AS used FROM n, unnest([1, 2, 3, 4]) t(k)
  UNION ALL SELECT 10 + n, 'geo.R' || ((r + k) % 5) FROM n, unnest([0, 1]) t(k)
  UNION ALL SELECT 100 + s, 'geo.nations.N' || ((n + k) % 25) FROM s, unnest([0, 1, 4]) t(k) WHERE s % 4 = 1
  UNION ALL SELECT 100 + s, 'geo.R' || r FROM s WHERE s % 4 = 1
  UNION ALL SELECT 100 + s, 'geo.nations.N' || ((n + k) % 25) FROM s, unnest([1, 2]) t(k) WHERE s % 4 = 2
  UNION ALL SELECT 100 + s, 'geo.R' || r FROM s WHERE s % 4 = 2)
{_USED}"""


def _java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, supplier = _tables(spark, sf_dir)
    r, n, s = F.col("r"), F.col("n"), F.col("s")
    kind = F.when(r == 4, "package geo;\n\npublic @interface R4 {\n}\n").otherwise(_fill(_JAVA_REGION, r=r))
    body = F.lit("")
    for k, template in enumerate(_JAVA_SUPPLIER):
        body = F.when(s % 4 == k, _fill(template, s=s, n=n, r=r)).otherwise(body)
    return (
        _files(region, 0, "geo/R%k%.java", kind, k=r)
        .union(_files(nation, 10, "geo/nations/N%k%.java", _JAVA_NATION, k=n, n=n, r=r))
        .union(_files(supplier, 100, "shop/S%k%.java", body, k=s))
    )


@query(_JAVA_SQL)
def java_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations, headings, imports of all kinds; annotations and broken files are no components but have names."""
    return _used(references.components(_java_files(spark, sf_dir), "java"))


_TOLERANT_JAVA_SQL = f"""WITH {_ROWS},
known AS (SELECT 'geo.R' || r AS name FROM r UNION ALL SELECT 'geo.nations.N' || n FROM n UNION ALL SELECT 'shop.S' || s FROM s WHERE s % 4 = 0),
f AS (SELECT r AS corpus_index, 'geo.R' || r AS qualified_name, 'R' || r AS simple_name FROM r UNION ALL SELECT 10 + n, 'geo.nations.N' || n, 'N' || n FROM n UNION ALL SELECT 100 + s, 'shop.S' || s, 'S' || s FROM s WHERE s % 4 = 0),
u AS (
  SELECT 10 + n AS corpus_index, 'geo.nations.N' || ((n + k) % 25) AS used FROM n, unnest([1, 2, 3, 4]) t(k)
  UNION ALL SELECT 10 + n, 'geo.R' || ((r + k) % 5) FROM n, unnest([0, 1]) t(k)
  UNION ALL SELECT 100 + s, 'geo.nations.N' || n FROM s WHERE s % 4 = 0)
{_USED}"""


@query(_TOLERANT_JAVA_SQL)
def java_tolerant_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fault-tolerant engine over regions, nations and the broken files."""
    files = _java_files(spark, sf_dir).where("corpus_index < 100 or corpus_index % 4 = 0")
    return _used(references.components(files, "java", "treesitter"))


# ---- Python -------------------------------------------------------------------

_PYTHON_NATION = '''"""from pkg.regions import r0"""
from pkg.regions.r%r% import SIZE, Thing
import pkg.nations.n%n+1% as other
import os.path
from . import n%n+2%


class Nation(n%n+3%, other.Nation):
    size: r%r+1% = SIZE  # n%n+7%

    async def f(self, a: dict[str, n%n+4%], *b: "n0") -> n%n+5% | None:
        return n%n+6%.f(a, Thing)
'''
#: By s_suppkey % 3: a module that doesn't parse, packages, its own name.
_PYTHON_SUPPLIER = (
    "from pkg.nations.n%n% import x\ndef f(:\n    pass\nimport pkg.regions.r%r%\n",
    "import pkg\nfrom pkg import regions\nfrom pkg.nations import n%n%, n%n+1%\n",
    "def f(a: s%s%, b: List[r%r%]) -> 'x':\n    pass\n",
)


def _python_sql(broken: bool) -> str:
    whole = "" if broken else " WHERE s % 3 <> 0"
    faulty = "UNION ALL SELECT 100 + s, 'pkg.nations.n' || n FROM s WHERE s % 3 = 0 UNION ALL SELECT 100 + s, 'pkg.regions.r' || r FROM s WHERE s % 3 = 0" if broken else ""
    return f"""WITH {_ROWS},
known AS (SELECT 'pkg' AS name UNION ALL SELECT 'pkg.regions' UNION ALL SELECT 'pkg.regions.r' || r FROM r UNION ALL SELECT 'pkg.nations.n' || n FROM n UNION ALL SELECT 'shop.s' || s FROM s),
f AS (
  SELECT r AS corpus_index, 'pkg.regions.r' || r AS qualified_name, 'r' || r AS simple_name FROM r
  UNION ALL SELECT 6, 'pkg', 'pkg' UNION ALL SELECT 7, 'pkg.regions', 'regions'
  UNION ALL SELECT 10 + n, 'pkg.nations.n' || n, 'n' || n FROM n
  UNION ALL SELECT 100 + s, 'shop.s' || s, 's' || s FROM s{whole}),
u AS (
  SELECT 10 + n AS corpus_index, 'pkg.nations.n' || ((n + k) % 25) AS used FROM n, unnest([1, 3, 4, 5]) t(k)
  UNION ALL SELECT 10 + n, 'pkg.regions.r' || ((r + k) % 5) FROM n, unnest([0, 1]) t(k)
  UNION ALL SELECT 100 + s, x FROM s, unnest(['pkg', 'pkg.regions', 'pkg.nations.n' || n, 'pkg.nations.n' || ((n + 1) % 25)]) t(x) WHERE s % 3 = 1
  UNION ALL SELECT 100 + s, 'pkg.regions.r' || r FROM s WHERE s % 3 = 2 {faulty})
{_USED}"""


def _python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, supplier = _tables(spark, sf_dir)
    r, n, s = F.col("r"), F.col("n"), F.col("s")
    body = F.lit("")
    for k, template in enumerate(_PYTHON_SUPPLIER):
        body = F.when(s % 3 == k, _fill(template, s=s, n=n, r=r)).otherwise(body)
    one = spark.range(1)
    files = _files(region, 0, "pkg/regions/r%k%.py", "SIZE: int = %k%\n", k=r)
    for k, path in enumerate(("__init__.py", "pkg/__init__.py", "pkg/regions/__init__.py")):
        files = files.union(_files(one, 5 + k, path, "", k=F.lit(0)))
    return files.union(_files(nation, 10, "pkg/nations/n%k%.py", _PYTHON_NATION, k=n, n=n, r=r)).union(_files(supplier, 100, "shop/s%k%.py", body, k=s))


@query(_python_sql(broken=False))
def python_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports, bases, annotations; the package file at the root has no name."""
    return _used(references.components(_python_files(spark, sf_dir), "python"))


@query(_python_sql(broken=True))
def python_tolerant_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that don't parse give what their statements do."""
    return _used(references.components(_python_files(spark, sf_dir), "python", "treesitter"))


# ---- JavaScript ---------------------------------------------------------------

_JS_NATION = """import { size } from "../regions/r%r%";
import './n%n+1%.tsx';
import React from 'react';
const a = require( '../regions' );
const b = import(`./n%n+7%`);
const c = import("./n%n+2%");
// import './n%n+3%';
/* from './n%n+4%'
   extends n%n+4% */
export class N%n% extends n%n+5% implements n%n+6%, r%r+1% {}
"""
_JS_SQL = f"""WITH {_ROWS},
known AS (SELECT 'lib.regions' AS name UNION ALL SELECT 'lib.regions.r' || r FROM r UNION ALL SELECT 'lib.nations.n' || n FROM n UNION ALL SELECT 'app.s' || s FROM s),
f AS (
  SELECT r AS corpus_index, 'lib.regions.r' || r AS qualified_name, 'r' || r AS simple_name FROM r UNION ALL SELECT 6, 'lib.regions', 'regions'
  UNION ALL SELECT 10 + n, 'lib.nations.n' || n, 'n' || n FROM n UNION ALL SELECT 100 + s, 'app.s' || s, 's' || s FROM s),
u AS (
  SELECT 10 + n AS corpus_index, 'lib.nations.n' || ((n + k) % 25) AS used FROM n, unnest([1, 2, 5, 6]) t(k)
  UNION ALL SELECT 10 + n, 'lib.regions.r' || ((r + k) % 5) FROM n, unnest([0, 1]) t(k)
  UNION ALL SELECT 10 + n, 'lib.regions' FROM n
  UNION ALL SELECT 6, 'lib.regions.r0'
  UNION ALL SELECT 100 + s, 'lib.nations.n' || n FROM s
  UNION ALL SELECT 100 + s, 'app.s' || (s + 1) FROM s)
{_USED}"""


@query(_JS_SQL)
def js_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four kinds of specifiers, `extends` and `implements`, outside of comments."""
    region, nation, supplier = _tables(spark, sf_dir)
    r, n, s = F.col("r"), F.col("n"), F.col("s")
    files = _files(region, 0, "lib/regions/r%k%.js", "export const size = %k%;\n", k=r).union(_files(spark.range(1), 6, "lib/regions/index.ts", "export * from './r0';\n", k=F.lit(0)))
    files = files.union(_files(nation, 10, "lib/nations/n%k%.tsx", _JS_NATION, k=n, n=n, r=r))
    files = files.union(_files(supplier, 100, "app/s%k%.mjs", "export * from '../lib/nations/./n%n%.js';\nconst x = require('./missing');\nimport y from '../app/../app/s%next%';\n", k=s, n=n, next=s + 1))
    return _used(references.components(files, "javascript"))


# ---- tokens -------------------------------------------------------------------


def _fill_sql(template: str) -> str:
    """_fill() as SQL."""
    out = []
    for k, part in enumerate(template.split("%")):
        name, _, step = part.partition("+")
        quoted = part.replace("'", "''")
        out.append(f"'{quoted}'" if not k % 2 else f"(({name} + {step}) % {NATIONS if name == 'n' else REGIONS})::VARCHAR" if step else f"{name}::VARCHAR")
    return " || ".join(out)


def _token_sql(template: str, pattern: str, comment: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"""WITH {_ROWS} SELECT 10 + n AS corpus_index, token, count(*) AS times
FROM (SELECT n, unnest(list_filter(regexp_extract_all({_fill_sql(template)}, '{pattern}'), lambda x: {comment})) AS token FROM n) GROUP BY ALL"""


def _token_counts(files: DataFrame, language: str) -> DataFrame:
    found = files.where("corpus_index between 10 and 34").select(F.col("corpus_index").cast("long").alias("corpus_index"), F.explode(references.token_column(language, F.col("text"))).alias("token"))
    return found.groupBy("corpus_index", "token").agg(F.count("*").alias("times"))


@query(_token_sql(_JAVA_NATION, r'''"(?:[^"\\]|\\.)*"|//[^\n]*|[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\sA-Za-z0-9_"@]''', "NOT starts_with(x, '//')"))
def java_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_counts(_java_files(spark, sf_dir), "java")


@query(_token_sql(_PYTHON_NATION, r'''"""[\s\S]*?"""|"(?:[^"\\]|\\.)*"|#[^\n]*|[A-Za-z_][A-Za-z0-9_]*|[0-9]+|->|[^\sA-Za-z0-9_"#]''', "NOT starts_with(x, '#')"))
def python_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_counts(_python_files(spark, sf_dir), "python")


# ---- from sources to weights ----------------------------------------------------

_SOURCE_GRAPH = f"""d AS MATERIALIZED ({_python_sql(broken=False)}), n AS (SELECT DISTINCT corpus_index AS node FROM d),
e AS MATERIALIZED (SELECT DISTINCT d.corpus_index AS src, t.corpus_index AS dst FROM d JOIN (SELECT DISTINCT corpus_index, qualified_name FROM d) t ON t.qualified_name = d.used WHERE t.corpus_index <> d.corpus_index),
g AS (SELECT src, count(*) AS degree FROM e GROUP BY 1), k AS (SELECT count(*)::DOUBLE AS n FROM n)"""


@query(f"SELECT DISTINCT qualified_name, round(weight, 7) AS weight FROM ({_weights_sql(160, _SOURCE_GRAPH)}) JOIN ({_python_sql(broken=False)}) ON corpus_index = node")
def ranked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps over the Python files, none of which are equal: components, token similarity, classes, graph, weights."""
    found = references.components(_python_files(spark, sf_dir), "python")
    # Package files are empty; their names keep them apart.
    items = found.select(F.col("corpus_index").alias("idx"), "qualified_name", "uses", F.concat(F.array("qualified_name"), references.token_column("python", F.col("text"))).alias("seq"))
    return rank_items(items, "token", threshold=1.0).select("qualified_name", F.round("weight", 7).alias("weight"))


# ---- alignments -----------------------------------------------------------------

_NAMES = "w AS (SELECT name AS idx, string_split(name, '') AS seq FROM (SELECT p_name AS name FROM part UNION SELECT p_type FROM part UNION SELECT r_name FROM region)), p AS (SELECT a.idx AS i, b.idx AS j, a.seq AS x, b.seq AS y FROM w a JOIN w b ON a.idx < b.idx)"
# One row of the table a step: the best at y is the running maximum of what the row above allows.
_LCS = f"""WITH RECURSIVE {_NAMES},
l(i, j, x, y, k, best) AS (
  SELECT i, j, x, y, 0, list_transform(range(0, len(y) + 1), lambda q: 0) FROM p
  UNION ALL
  SELECT i, j, x, y, k + 1, list_transform(range(1, len(y) + 2), lambda q: list_max(list_transform(range(1, q + 1), lambda z: CASE WHEN z > 1 AND y[z - 1] = x[k + 1] THEN greatest(best[z], best[z - 1] + 1) ELSE best[z] END)))
  FROM l WHERE k < len(x))
SELECT i, j, round(best[len(y) + 1] / (len(x) + len(y) - best[len(y) + 1]), 8) AS score FROM l WHERE k = len(x)"""
_BLOCKS = f"WITH RECURSIVE {_NAMES}, {block_sql()} SELECT i, j, round(score, 8) AS score FROM scored"


def _letters(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    part, region = table(spark, sf_dir, "part"), table(spark, sf_dir, "region")
    named = part.select(F.col("p_name").alias("idx")).union(part.select("p_type")).union(region.select("r_name")).distinct()
    return similarity.all_pairs(named.select("idx", F.split("idx", "").alias("seq")), method).withColumn("score", F.round("score", 8))


@query(_LCS)
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest common subsequences of the letters of names, all pairs."""
    return _letters(spark, sf_dir, "token")


@query(_BLOCKS)
def diff_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching blocks of the letters of names, all pairs."""
    return _letters(spark, sf_dir, "diff")


@query(f"SELECT page_id, x AS specifier FROM pages, unnest(CASE page_id % 4 WHEN 0 THEN ['./m' || page_id] WHEN 1 THEN ['./n' || page_id] WHEN 2 THEN ['../o' || page_id] ELSE ['./p' || page_id] END) t(x)")
def js_specifier_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of specifier by itself, beside a comment that holds one."""
    k = F.col("page_id")
    name = k.cast("string")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("export { a } from './m"), name, F.lit("';")))
        .when(k % 4 == 1, F.concat(F.lit('import "./n'), name, F.lit('";')))
        .when(k % 4 == 2, F.concat(F.lit("const o = require ( '../o"), name, F.lit("' );")))
        .otherwise(F.concat(F.lit("await import( './p"), name, F.lit("')")))
    )
    clean = lines.without_js_comments(F.concat(F.lit("/* import './gone' */ // from './too'\n"), text))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(lines.js_specifiers(clean)).alias("specifier"))
