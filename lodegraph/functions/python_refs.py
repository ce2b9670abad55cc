"""Names that a Python source refers to."""

from __future__ import annotations

import ast
import re

_HEADER = re.compile(r"^\s*(?:async\s+def|def|class)\b")
_LINE = re.compile(r"^\s*(?:import\s|from\s|[A-Za-z_][\w.]*\s*:[^=]*(?:=|$))")


def annotation_names(node: ast.expr | None) -> list[str]:
    """Type names of an annotation: names, dotted names, generics with their arguments, unions."""
    match node:
        case ast.Name(id=name):
            return [name]
        case ast.Attribute():
            dotted, at = [], node
            while isinstance(at, ast.Attribute):
                dotted.append(at.attr)
                at = at.value
            return [".".join([at.id, *reversed(dotted)])] if isinstance(at, ast.Name) else []
        case ast.Subscript(value=outer, slice=ast.Tuple(elts=parts)):
            return annotation_names(outer) + [n for p in parts for n in annotation_names(p)]
        case ast.Subscript(value=outer, slice=inner):
            return annotation_names(outer) + annotation_names(inner)
        case ast.BinOp(left=a, right=b):
            return annotation_names(a) + annotation_names(b)
    return []


def _of_node(node: ast.AST) -> list[str]:
    match node:
        case ast.Import(names=names):
            return [n.name for n in names]
        case ast.ImportFrom(module=str(module), names=names) if module:
            return [module, *(f"{module}.{n.name}" for n in names if n.name != "*")]
        case ast.ClassDef(bases=bases):
            return [n for b in bases for n in annotation_names(b)]
        case ast.FunctionDef(args=a, returns=returns) | ast.AsyncFunctionDef(args=a, returns=returns):
            every = [*a.posonlyargs, *a.args, *a.kwonlyargs, *([a.vararg] if a.vararg else []), *([a.kwarg] if a.kwarg else [])]
            return annotation_names(returns) + [n for x in every for n in annotation_names(x.annotation)]
        case ast.AnnAssign(annotation=annotation):
            return annotation_names(annotation)
    return []


def references(text: str) -> list[str] | None:
    """Names in a module that parses; None for one that doesn't."""
    try:
        return [name for node in ast.walk(ast.parse(text)) for name in _of_node(node)]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def tolerant_references(text: str) -> list[str]:
    """As references(), and for a module that doesn't parse, from each statement or header that does."""
    whole = references(text)
    if whole is not None:
        return whole
    out: list[str] = []
    lines = text.split("\n")
    for k, line in enumerate(lines):
        if _HEADER.match(line):
            for last in range(k + 1, min(k + 40, len(lines)) + 1):
                head = "\n".join(lines[k:last]).strip()
                if head.endswith(":") and (got := references(head + " pass")) is not None:
                    out += got
                    break
        elif _LINE.match(line):
            for last in range(k + 1, min(k + 40, len(lines)) + 1):
                if (got := references("\n".join(lines[k:last]).strip())) is not None:
                    out += got
                    break
    return out
