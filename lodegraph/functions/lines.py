"""Lines and tokens of texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that end a line (CR LF is one end), and patterns of the JavaScript rules.
LINE_END = r"(?<=\n|\x0B|\x0C|\x1C|\x1D|\x1E|\x{85}|\x{2028}|\x{2029})|(?<=\r)(?!\n)"
BLOCK_COMMENT, LINE_COMMENT = r"/\*[\s\S]*?\*/", r"//[^\n]*"
JS_TOKEN = r"""`(?:[^`\\]|\\.)*`|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|//[^\n]*|/\*[\s\S]*?\*/|[a-zA-Z_$][a-zA-Z0-9_$]*|[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?n?|[^\s\w'"` ]"""
JS_SPECIFIERS = (r"\bfrom\s+['\"]([^'\"]+)['\"]", r"\bimport\s+['\"]([^'\"]+)['\"]", r"\brequire\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", r"\bimport\s*\(\s*['\"]([^'\"]+)['\"]\s*\)")
JS_EXTENDS = r"\bextends\s+([\w$][\w$]*)"
JS_IMPLEMENTS = r"\bimplements\s+([\w$][\w$]*(?:\s*,\s*[\w$][\w$]*)*)"
_UNICODE = "(?U)"


def split_lines(text: Column) -> Column:
    """Lines with their ends kept; an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.filter(F.split(text, LINE_END), lambda x: x != ""))


def without_js_comments(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, BLOCK_COMMENT, " "), LINE_COMMENT, " ")


def js_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?s)" + _UNICODE + JS_TOKEN), F.lit(0))
    return F.filter(found, lambda x: ~(x.startswith("//") | x.startswith("/*")))


def js_specifiers(clean: Column) -> Column:
    return F.concat(*(F.regexp_extract_all(clean, F.lit(_UNICODE + p), F.lit(1)) for p in JS_SPECIFIERS))


def js_names(clean: Column) -> Column:
    """Names after `extends` and `implements`."""
    several = F.transform(F.regexp_extract_all(clean, F.lit(_UNICODE + JS_IMPLEMENTS), F.lit(1)), lambda x: F.split(x, ","))
    return F.transform(F.concat(F.regexp_extract_all(clean, F.lit(_UNICODE + JS_EXTENDS), F.lit(1)), F.flatten(several)), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
