"""Types that a Java source refers to, read from its tokens.

No grammar is at hand: declarations are recognised by their shape, a type
followed by a name and the mark that a declaration goes on with.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from lodegraph.functions.lexers import java_words

# Reserved words.
KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
)
PRIMITIVES = frozenset("boolean byte char double float int long short".split())
MODIFIERS = frozenset("abstract default final native private protected public static strictfp synchronized transient volatile sealed".split())
_PAIRS = {")": "(", "]": "[", "}": "{"}


@dataclass
class JavaSource:
    ok: bool = False
    package: str = ""
    kind: str = ""  # class, interface, enum or annotation; of the first type
    name: str = ""
    imports: list[tuple[str, bool]] = field(default_factory=list)  # path, whether all of a package
    names: list[str] = field(default_factory=list)


def _is_name(t: str) -> bool:
    return (t[0].isalpha() or t[0] in "_$") and t not in KEYWORDS


class _Reader:
    def __init__(self, tokens: list[str]):
        self.t = tokens
        self.n = len(tokens)

    def skip_annotation(self, k: int) -> int:
        """Position after the annotation at k (an `@`)."""
        k += 1
        while k + 1 < self.n and self.t[k + 1] == ".":
            k += 2
        k += 1
        return self.close(k) + 1 if k < self.n and self.t[k] == "(" else k

    def close(self, k: int) -> int:
        """Position of the bracket that closes the one at k."""
        depth = 0
        for j in range(k, self.n):
            depth += (self.t[j] in "([{") - (self.t[j] in ")]}")
            if not depth:
                return j
        return self.n

    def type_at(self, k: int) -> tuple[str, list[str], int] | None:
        """(first segment, names of the generic arguments, position after) of a type at k."""
        while k < self.n and self.t[k] == "@" and self.t[k + 1 : k + 2] != ["interface"]:
            k = self.skip_annotation(k)
        if k >= self.n or not (_is_name(self.t[k]) or self.t[k] in PRIMITIVES):
            return None
        first, arguments = self.t[k], []
        k += 1
        while k < self.n:
            if self.t[k] == "<":
                got = self.arguments(k)
                if got is None:
                    return None
                arguments, k = got
            elif self.t[k] == "." and k + 1 < self.n and _is_name(self.t[k + 1]):
                k += 2
            elif self.t[k] == "[" and self.t[k + 1 : k + 2] == ["]"]:
                k += 2
            elif self.t[k] == "..." or self.t[k] == "@" and self.t[k + 1 : k + 2] != ["interface"]:
                k = k + 1 if self.t[k] == "..." else self.skip_annotation(k)
            else:
                break
        return first, arguments, k

    def arguments(self, k: int) -> tuple[list[str], int] | None:
        """Names of the outermost generic arguments in `<...>` at k, and the position after."""
        out, k = [], k + 1
        while k < self.n and self.t[k] != ">":
            if self.t[k] in (",", "?", "&", "extends", "super"):
                k += 1
                continue
            got = self.type_at(k)
            if got is None:
                return None
            out.append(got[0])
            k = got[2]
        return (out, k + 1) if k < self.n else None


def _balanced(tokens: list[str]) -> bool:
    stack: list[str] = []
    for t in tokens:
        if t in ("(", "[", "{"):
            stack.append(t)
        elif t in _PAIRS and (not stack or stack.pop() != _PAIRS[t]):
            return False
    return not stack


def read(text: str) -> JavaSource:
    """Header, imports and referred types; ok is False where the source can't be one of Java."""
    tokens, whole = java_words(text)
    out = JavaSource()
    r, k = _Reader(tokens), 0
    while k < r.n:
        t = tokens[k]
        if t == "@" and tokens[k + 1 : k + 2] != ["interface"]:
            k = r.skip_annotation(k)
        elif t in ("package", "import"):
            stop = tokens.index(";", k) if ";" in tokens[k:] else r.n
            path = [x for x in tokens[k + 1 : stop] if x != "static"]
            if t == "package":
                out.package = "".join(path)
            elif path[-2:] == [".", "*"]:
                out.imports.append(("".join(path[:-2]), True))
            else:
                out.imports.append(("".join(path), False))
            k = stop + 1
        elif t == ";" or t in MODIFIERS:
            k += 1
        else:
            break
    kinds = {"class": "class", "interface": "interface", "enum": "enum", "@": "annotation", "record": "record"}
    if k + 1 < r.n and tokens[k] in kinds:
        out.kind = kinds[tokens[k]]
        k += 2 if tokens[k] == "@" else 1
        out.name = tokens[k] if k < r.n else ""
    out.ok = whole and _balanced(tokens) and bool(out.kind) and _is_name(out.name or "1")
    if out.ok:
        out.names = _heading(r, k, out.kind) + (_body(r, k) if out.kind in ("class", "record") else [])
    return out


def _heading(r: _Reader, k: int, kind: str) -> list[str]:
    """Types after `extends` and `implements` of the first type; an enum's or interface's own `extends` only, without arguments."""
    out, taking, depth = [], "", 0
    while k < r.n and r.t[k] != "{":
        t = r.t[k]
        if t == "<" and not taking:
            got = r.arguments(k)
            k = got[1] if got else k + 1
            continue
        if t == "(":
            k = r.close(k)
        if t in ("extends", "implements", "permits"):
            taking = t
        elif taking and _is_name(t):
            got = r.type_at(k)
            if got:
                if kind == "class" or kind == "record":
                    out += [got[0], *got[1]] if taking != "permits" else []
                elif taking == "extends":
                    out.append(got[0])
                k = got[2]
                continue
        k += 1
    return out


def _body(r: _Reader, k: int) -> list[str]:
    """Types of fields, methods, parameters, variables and creations, and qualifiers of calls, in the whole source."""
    out: list[str] = []
    resources = 0  # end of the brackets after the last `try`
    while k < r.n:
        t = r.t[k]
        before = r.t[k - 1] if k else ""
        if t == "@" and r.t[k + 1 : k + 2] != ["interface"]:
            k = r.skip_annotation(k)
            continue
        if t == "try" and r.t[k + 1 : k + 2] == ["("]:
            resources = r.close(k + 1)
        if t == "catch" and r.t[k + 1 : k + 2] == ["("]:
            k = r.close(k + 1) + 1  # what is caught isn't declared
            continue
        if t == "new":
            got = r.type_at(k + 1)
            if got and got[2] < r.n and r.t[got[2]] in ("(", "<"):
                out.append(got[0])
            k += 1
            continue
        if _is_name(t) and before != ".":
            end = k + 1
            while end + 1 < r.n and r.t[end] == "." and _is_name(r.t[end + 1]):
                end += 2
            if end > k + 1 and end < r.n and r.t[end] == "(":
                out.append("".join(r.t[k : end - 2]))
                k = end
                continue
            got = r.type_at(k)
            if got and got[2] + 1 < r.n and _is_name(r.t[got[2]]) and before not in ("new", "extends", "implements", "class", "interface", "enum", "goto", "package", "import", "instanceof"):
                after = r.t[got[2] + 1]
                if after == "(":
                    out.append(got[0])  # a method: its result's arguments don't count
                elif after in (";", "=", ",", ")", "[") and k >= resources:  # a colon goes on with what a loop runs over
                    out += [got[0], *got[1]]
                if after in ("(", ";", "=", ",", ")", ":", "["):
                    k = got[2] + 1
                    continue
        k += 1
    return out


def tolerant(text: str) -> JavaSource:
    """As read(), for any source: all capitalised or declared types outside of imports and package."""
    out = read(text)
    tokens, _ = java_words(text)
    r, names, k = _Reader(tokens), [], 0
    while k < r.n:
        t = tokens[k]
        if t in ("package", "import") and (k == 0 or tokens[k - 1] in (";", "}", ")")):
            k = tokens.index(";", k) + 1 if ";" in tokens[k:] else r.n
            continue
        if t == "@" and tokens[k + 1 : k + 2] != ["interface"]:
            k = r.skip_annotation(k)
            continue
        before = tokens[k - 1] if k else ""
        if _is_name(t) and before != ".":
            end = k + 1
            while end + 1 < r.n and tokens[end] == "." and _is_name(tokens[end + 1]):
                end += 2
            follows = tokens[end] if end < r.n else ""
            typed = before in ("extends", "implements", "throws", "new", "instanceof", "<", "permits") or follows == "<" or (before == "(" and follows == ")")
            declares = bool(follows) and _is_name(follows) or follows == "[" and tokens[end + 1 : end + 2] == ["]"] or follows == "::"
            listed = before == "," and t[0].isupper() and follows in (",", "{", ">", ")") or before == "&"
            if (typed or declares or listed) and not (before in ("class", "interface", "enum", "record")):
                names.append("".join(tokens[k:end]))
                if end > k + 1:
                    names.append(tokens[end - 1])
            k = end
            continue
        k += 1
    out.names = names
    return out
