"""Components of a source tree: names, references and their resolution by joins."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lodegraph.functions import java_refs, lexers, lines, names, python_refs
from lodegraph.operators.checkpoints import cut

PARSED = "status string, package string, simple_name string, refs array<string>, imports array<struct<path:string,all:boolean>>"


@dataclass(frozen=True)
class Engine:
    """How a language's files become names and references."""

    qname: Callable[[], Column]
    parse: Callable[[str], dict] | None  # text -> fields of PARSED; None: by column expressions


def _java(text: str, tolerant: bool) -> dict:
    s = java_refs.tolerant(text) if tolerant else java_refs.read(text)
    skip = not tolerant and (not s.ok or s.kind == "annotation")
    return {"status": "skipped" if skip else "ok", "package": None if tolerant else s.package, "simple_name": None if tolerant else s.name, "refs": s.names, "imports": [{"path": p, "all": a} for p, a in s.imports]}


def _python(text: str, tolerant: bool) -> dict:
    found = python_refs.tolerant_references(text) if tolerant else python_refs.references(text)
    return {"status": "skipped" if found is None else "ok", "package": None, "simple_name": None, "refs": found or [], "imports": []}


ENGINES: dict[tuple[str, str], Engine] = {
    ("java", "javalang"): Engine(lambda: names.java_qname(F.col("text"), F.col("rel_path")), lambda t: _java(t, False)),
    ("java", "treesitter"): Engine(lambda: names.java_qname(F.col("text"), F.col("rel_path")), lambda t: _java(t, True)),
    ("python", "ast"): Engine(lambda: names.python_qname(F.col("rel_path")), lambda t: _python(t, False)),
    ("python", "treesitter"): Engine(lambda: names.python_qname(F.col("rel_path")), lambda t: _python(t, True)),
    ("javascript", "regex"): Engine(lambda: names.js_qname(F.col("rel_path")), None),
}
DEFAULTS = {"java": "javalang", "python": "ast", "javascript": "regex"}


#: Tokenizers by language; None where a column expression does it.
TOKENIZERS: dict[str, Callable[[str], list[str]] | None] = {"java": lexers.java_tokens, "python": lexers.python_tokens, "javascript": None}


def register_engine(language: str, name: str, engine: Engine, default: bool = False) -> None:
    """Make an engine of one's own known, perhaps of a new language, whose first one is its default."""
    ENGINES[language.lower(), name.lower()] = engine
    if default or language.lower() not in DEFAULTS:
        DEFAULTS[language.lower()] = name.lower()


def register_tokenizer(language: str, f: Callable[[str], list[str]]) -> None:
    TOKENIZERS[language.lower()] = f


def languages() -> list[str]:
    return list(DEFAULTS)


def list_engines() -> dict[str, list[str]]:
    return {lang: [e for k, e in ENGINES if k == lang] for lang in DEFAULTS}


def get_engine(language: str, engine: str | None = None) -> tuple[str, str]:
    """Checked (language, engine); ValueError for unknown ones."""
    language = language.lower()
    if language not in DEFAULTS:
        raise ValueError(f"no language is called '{language}'; there are: {', '.join(DEFAULTS)}")
    key = language, (engine or DEFAULTS[language]).lower()
    if key not in ENGINES:
        raise ValueError(f"no engine for {language} is called '{key[1]}'; there are: {', '.join(list_engines()[language])}")
    return key


def tokens(language: str) -> Callable[[str], list[str]] | None:
    """Tokenizer of a language; None where a column expression does it. Unknown languages are read as Java."""
    return TOKENIZERS.get(language.lower(), lexers.java_tokens)


def token_column(language: str, text: Column) -> Column:
    f = tokens(language)
    if f is None:
        return lines.js_tokens(text)
    return F.pandas_udf(lambda s: s.map(f), "array<string>")(text)


def parse(files: DataFrame, language: str, engine: str | None = None) -> DataFrame:
    """files + qualified_name and the parsed fields; unreadable and nameless files have status `unreadable` and `nameless`."""
    key = get_engine(language, engine)
    spec = ENGINES[key]
    named = files.withColumn("qualified_name", F.when(F.col("error").isNull(), spec.qname()) if key[0] == "java" else spec.qname())
    if spec.parse is None:
        clean = lines.without_js_comments(F.col("text"))
        parsed = named.withColumns({"status": F.lit("ok"), "package": F.lit(None).cast("string"), "simple_name": F.lit(None).cast("string"), "refs": lines.js_names(clean), "specifiers": F.filter(lines.js_specifiers(clean), lambda x: x.startswith(".")), "imports": F.lit(None).cast("array<struct<path:string,all:boolean>>")})
    else:
        read = spec.parse

        # Marked so that a filter on its fields doesn't run it again.
        @F.pandas_udf(f"struct<{re.sub(r'(\w+) (string|array)', r'\1:\2', PARSED)}>")
        def run(text: pd.Series) -> pd.DataFrame:
            found = [read(t) if t is not None else {"status": "unreadable", "refs": [], "imports": []} for t in text]
            return pd.DataFrame(found, columns=["status", "package", "simple_name", "refs", "imports"])

        parsed = named.withColumn("p", run.asNondeterministic()("text")).select(*named.columns, "p.*").withColumn("specifiers", F.array().cast("array<string>"))
    status = F.when(F.col("error").isNotNull(), "unreadable").when(F.coalesce("qualified_name", F.lit("")) == "", "nameless").otherwise(F.col("status"))
    parsed = parsed.withColumn("status", status)
    default = names.simple_name(F.col("qualified_name")) if key != ("java", "treesitter") else names.stem(F.col("rel_path"))
    return parsed.withColumns({"simple_name": F.coalesce("simple_name", default), "package": F.coalesce("package", names.package_of(F.col("qualified_name")))})


def name_map(named: DataFrame) -> DataFrame:
    """(simple_name, qualified_names): all files with a name, whether they parse or not."""
    own = named.where("qualified_name is not null and qualified_name <> ''")
    return own.groupBy(names.simple_name(F.col("qualified_name")).alias("simple_name")).agg(F.sort_array(F.collect_list("qualified_name")).alias("qualified_names"))


IMPORTS = "array<struct<path:string,all:boolean>>"


def resolve(refs: DataFrame, universe: DataFrame) -> DataFrame:
    """(corpus_index, ref, target): the first rule that gives a name counts.

    refs: corpus_index, package, ref, once each, and perhaps imports as IMPORTS;
    universe: qualified_name, one row a file. Rules: the name itself; a single
    import (the last one that exists); the same package; packages imported whole,
    if just one has it; the only bearer of the name. Every reference is read
    once, as the rows of its candidates, and meets the names in one join.
    """
    named = universe.where("qualified_name <> ''")
    simple = names.simple_name(F.col("qualified_name"))
    only = named.groupBy(simple.alias("key")).agg(F.count("*").alias("n"), F.min("qualified_name").alias("target")).where("n = 1").select("key", F.lit("simple").alias("kind"), "target")
    known = named.select(F.col("qualified_name").alias("key"), F.lit("whole").alias("kind"), F.col("qualified_name").alias("target")).distinct().union(only)

    def one(rule: int, key: Column, place: Column | None = None, kind: str = "whole") -> Column:
        return F.struct(F.lit(rule).alias("rule"), (F.lit(0) if place is None else place).alias("place"), F.lit(kind).alias("kind"), key.alias("key"))

    ref = F.col("ref")
    tried = F.array(one(0, ref), one(2, F.when(F.col("package") == "", ref).otherwise(F.concat_ws(".", "package", "ref"))), one(4, ref, kind="simple"))
    if "imports" in refs.columns:
        single = F.transform("imports", lambda i, k: F.when(~i["all"] & (names.simple_name(i["path"]) == ref), one(1, i["path"], k)).when(i["all"], one(3, F.concat_ws(".", i["path"], ref), k)))
        tried = F.concat(tried, F.coalesce(F.filter(single, lambda x: x.isNotNull()), F.array().cast("array<struct<rule:int,place:int,kind:string,key:string>>")))
    met = refs.where("ref <> ''").select("corpus_index", "ref", F.explode(tried).alias("c")).select("corpus_index", "ref", "c.*").join(known, ["kind", "key"])

    def found(rule: int) -> Column:
        return F.when(F.col("rule") == rule, F.col("target"))

    first = F.coalesce(F.min(found(0)), F.max_by(found(1), F.when(F.col("rule") == 1, F.col("place"))), F.min(found(2)), F.when(F.count(found(3)) == 1, F.min(found(3))), F.min(found(4)))
    return met.groupBy("corpus_index", "ref").agg(first.alias("target")).where("target is not null")


def resolve_specifiers(specs: DataFrame, universe: DataFrame) -> DataFrame:
    """(corpus_index, target) of (corpus_index, folder, specifier): the first candidate name that exists."""
    known = universe.where("qualified_name <> ''").select(F.col("qualified_name").alias("target")).distinct()
    tried = specs.distinct().select("corpus_index", "specifier", F.posexplode(names.js_candidates(names.normal_path(F.col("folder"), F.col("specifier")))).alias("rule", "target"))
    return tried.join(known, "target", "left_semi").groupBy("corpus_index", "specifier").agg(F.min_by("target", "rule").alias("target")).select("corpus_index", "target")


def components(files: DataFrame, language: str, engine: str | None = None) -> DataFrame:
    """corpus_index, qualified_name, simple_name, file_path, text, uses: files that parse, in corpus order.

    References resolve against the names of all files, parsed or not. Files are
    read and parsed once; the result is kept in the checkpoint folder.
    """
    parsed = cut(parse(files, language, engine))
    universe = parsed.where("error is null" if language.lower() == "java" else "true").select("qualified_name").where("qualified_name is not null")
    good = parsed.where("status = 'ok'")
    raw = F.transform("refs", names.base_type) if language.lower() == "java" else F.col("refs")
    found = resolve(good.select("corpus_index", "package", "imports", F.explode(F.array_distinct(raw)).alias("ref")), universe)
    found = found.select("corpus_index", "target")
    if language.lower() == "javascript":
        folder = F.regexp_extract("rel_path", r"^(.*)/[^/]*$", 1)
        found = found.union(resolve_specifiers(good.select("corpus_index", folder.alias("folder"), F.explode("specifiers").alias("specifier")), universe))
    uses = found.groupBy("corpus_index").agg(F.collect_set("target").alias("targets"))
    own = F.array(F.col("qualified_name"))
    return good.join(uses, "corpus_index", "left").select(
        "corpus_index", "qualified_name", "simple_name", F.col("path").alias("file_path"), "text",
        F.sort_array(F.array_except(F.coalesce("targets", F.array().cast("array<string>")), own)).alias("uses"),
    )
