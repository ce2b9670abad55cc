"""Tokens of Java and Python sources, for the similarity of tokens and for references."""

from __future__ import annotations

import io
import re
import tokenize

# Token classes of the Java language.
_JAVA = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>\"\"\".*?\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)+')|(?P<at>@)
    |(?P<number>0[xX][0-9a-fA-F_.]*(?:[pP][+-]?[0-9_]+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[lLfFdD]?)
    |(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<mark>>>>=|<<=|>>=|\.\.\.|->|::|<<|\+\+|--|&&|\|\||[=!<>+\-*/&|^%]=|[-+*/%=<>!~?:&|^;,.(){}\[\]])""",
    re.S | re.X,
)
_NO_TOKENS = {"space", "at"}


def java_tokens(text: str) -> list[str]:
    """Separators, operators, words and literals; up to the first character that fits no token."""
    out, at = [], 0
    while at < len(text):
        m = _JAVA.match(text, at)
        if m is None or m.end() == at:
            break
        at = m.end()
        if m.lastgroup not in _NO_TOKENS:
            out.append(m.group())
    return out


def java_words(text: str) -> tuple[list[str], bool]:
    """Tokens with `@`, and whether the whole text could be read; `>` always stands alone."""
    out, at = [], 0
    while at < len(text):
        m = _JAVA.match(text, at)
        if m is None or m.end() == at:
            return out, False
        at = m.end()
        if m.lastgroup != "space":
            out.append(m.group())
    return out, True


_LAYOUT = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING, tokenize.ENDMARKER, tokenize.ERRORTOKEN}


def python_tokens(text: str) -> list[str]:
    """Names, numbers, strings and operators, as far as the source can be read."""
    out: list[str] = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type not in _LAYOUT:
                out.append(t.string)
    except (tokenize.TokenError, SyntaxError):
        pass
    return out
