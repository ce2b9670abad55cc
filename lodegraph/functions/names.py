"""Names of components as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: file endings of modules, the longer ones first.
JS_ENDING = r"(?i)\.(tsx|ts|jsx|mjs|cjs|js)$"


def simple_name(qname: Column) -> Column:
    return F.substring_index(qname, ".", -1)


def package_of(qname: Column) -> Column:
    """All but the last segment; empty for a single one."""
    return F.regexp_extract(qname, r"^(.*)\.[^.]*$", 1)


def stem(rel_path: Column) -> Column:
    return F.regexp_replace(F.substring_index(rel_path, "/", -1), r"\.[^.]*$", "")


def _folder_for_index(path: Column) -> Column:
    return F.when(path.rlike("/index$"), F.regexp_replace(path, "/index$", "")).otherwise(path)


def js_qname(rel_path: Column) -> Column:
    return F.regexp_replace(_folder_for_index(F.regexp_replace(rel_path, JS_ENDING, "")), "/", ".")


def js_candidates(base: Column) -> Column:
    """Names that a specifier's normalised path can stand for, the first that exists counts."""
    as_is, added = js_qname(base), F.regexp_replace(_folder_for_index(base), "/", ".")
    inside = F.when(base == "", F.lit("index")).otherwise(F.regexp_replace(base, "/", "."))
    return F.array(as_is, added, inside)


def python_qname(rel_path: Column) -> Column:
    """Empty for the package file at the root."""
    module = F.regexp_replace(rel_path, r"\.py$", "")
    module = F.when(module == "__init__", "").otherwise(F.regexp_replace(module, "/__init__$", ""))
    return F.regexp_replace(module, "/", ".")


def java_package(text: Column) -> Column:
    """From the first of the leading 50 lines that begins with `package ` and holds a semicolon."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 50), lambda x: F.trim(x))
    found = F.filter(lines, lambda x: x.startswith("package ") & x.contains(";"))
    return F.coalesce(F.trim(F.regexp_extract(F.get(found, 0), r"^package\s([^;]*);", 1)), F.lit(""))


def java_qname(text: Column, rel_path: Column) -> Column:
    return F.concat_ws(".", F.nullif(java_package(text), F.lit("")), stem(rel_path))


def base_type(raw: Column) -> Column:
    """A type's name without generic arguments and array marks."""
    return F.trim(F.substring_index(F.substring_index(raw, "<", 1), "[", 1))


def normal_path(folder: Column, specifier: Column) -> Column:
    """folder/specifier without `.`, `..` and empty segments, as far as they can go."""
    steps = F.split(F.concat_ws("/", folder, specifier), "/")
    none = F.array().cast("array<string>")

    def walk(have: Column, step: Column) -> Column:
        can_go_up = (F.size(have) > 0) & (F.element_at(have, -1) != "..")
        up = F.when(F.size(have) == 0, F.array(F.lit(".."))).when(can_go_up, F.slice(have, 1, F.greatest(F.size(have) - 1, F.lit(0)))).otherwise(F.concat(have, F.array(F.lit(".."))))
        return F.when(step.isin(".", ""), have).when(step == "..", up).otherwise(F.concat(have, F.array(step)))

    return F.array_join(F.aggregate(steps, none, walk), "/")
