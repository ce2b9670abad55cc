"""Main text of web pages by tree scoring.

A tolerant reader turns a page into a tree and a list of text blocks in page
order. Paragraph-like blocks give points for length and commas to their
ancestors, less at each level; a container's points are discounted by its share
of link text. The best container is kept, with siblings that score well enough, but for lists of links in it.
Parts that are never article text (menus, forms, adverts and so on, by element
or by the words of their class, id and role) are left out beforehand; where those
words leave doubt, as `share` or `related` do, the part's own points and links decide.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Comments, tags (a quoted value ends where an attribute can end; else the tag ends at the next `>`), declarations, a tag cut off at the end.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>"']|"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>]))*)>|([^>]*)>)|<[!?][^>]*>?|<(?=[a-zA-Z/])[^>]*\Z""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
NEVER = frozenset("script style textarea title noscript iframe xmp noembed noframes head template svg math object canvas audio video form button select option fieldset dialog nav footer aside menu".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening element ends an open one of these, up to the given boundary.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of class, id or role of parts that are no article text, wherever they stand.
AWAY = frozenset(
    "ad ads advert adverts advertisement advertising adbox breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter outbrain pager pagination popup promo promoted recommended respond sidebar signup skip sponsor sponsored subscribe subscription taboola topbar".split()
)
#: Words of parts that may be: a container so marked goes if it looks like no text, see _looks_aside().
DOUBTFUL = frozenset("alert banner banners disclaimer header notice notices related reply replies share sharing social tags toolbar widget widgets".split())
STAY = frozenset("article content main body post entry story text".split())
#: Such words count even beside one of STAY, as in "post-comments".
_CLEAR = frozenset("ad ads advert comment comments footer menu nav sidebar".split())
_CONTAINERS = frozenset("div section ul ol dl table".split())
_PARAGRAPH = frozenset("p pre blockquote td div section article main li dd body".split())


class _Node:
    __slots__ = ("tag", "parent", "away", "score", "chars", "links", "marks", "blocks")

    def __init__(self, tag: str, parent: _Node | None, away: bool, marks: frozenset[str] = frozenset()):
        self.tag, self.parent, self.away, self.marks = tag, parent, away, marks
        self.score, self.chars, self.links, self.blocks = 0.0, 0, 0, 0


def _away(tag: str, attributes: str, parent: _Node) -> tuple[bool, frozenset[str]]:
    if parent.away or tag in NEVER:
        return True, frozenset()
    if tag == "header":
        at: _Node | None = parent
        while at is not None and at.tag not in ("article", "main"):
            at = at.parent
        if at is None:
            return True, frozenset()
    if not attributes:
        return False, frozenset()
    named = {k.lower(): v.strip("\"'") for k, v in reversed(_ATTRIBUTE.findall(attributes))}
    marks = frozenset(w for k in ("class", "id", "role") for w in _WORD.findall(named.get(k, "").lower()))
    if tag in ("html", "body", "article", "main"):
        return False, marks
    if "hidden" in named and named["hidden"].lower() != "until-found" or named.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(named.get("style", "")):
        return True, marks
    stays = tag in _CONTAINERS and marks & STAY and not marks & _CLEAR
    return bool(marks & AWAY and not stays), marks


def _read(page: str) -> list[tuple[_Node, str, int]]:
    """(innermost block element, text, characters of it in links) in page order."""
    top = _Node("#root", None, False)
    stack, blocks, run, links = [top], [], [], 0
    linked = 0

    def flush() -> None:
        nonlocal links
        if run:
            text = " ".join("".join(run).split())
            if text:
                node = next(n for n in reversed(stack) if n.tag in BLOCK or n is top)
                if not node.away:
                    blocks.append((node, text, min(links, len(text))))
            run.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw and not stack[-1].away:
            text = _html.unescape(raw)
            run.append(text)
            if linked:
                links += len(text.strip())

    def pop_to(k: int) -> None:
        nonlocal linked
        for node in stack[k:]:
            linked -= node.tag == "a"
        del stack[k:]

    def close(tags: set[str], bound: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                flush()
                pop_to(k)
                return
            if stack[k].tag in bound:
                return

    at = 0
    lower = None
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        tag = name.lower()
        if m.group(1):
            if tag == "p" and not any(n.tag == "p" for n in stack):
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if any(n.tag in BLOCK for n in stack[k:]):
                        flush()
                    pop_to(k)
                    break
            continue
        attributes = m.group(3) if m.group(3) is not None else m.group(4)
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find("</" + tag, at) if len(lower) == len(page) else _find(page, tag, at)
            end = len(page) if end < 0 else end
            closing = page.find(">", end)
            at = len(page) if closing < 0 else closing + 1
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            flush()
            close({"p"}, {"button", "table", "td", "th", "caption", "object"})
            if tag in ENDS:
                close(*ENDS[tag])
            if tag[0] == "h" and tag[1:].isdigit() and stack[-1].tag[0] == "h" and stack[-1].tag[1:].isdigit():
                pop_to(len(stack) - 1)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK and tag not in ("a", "b", "i", "em", "strong", "span"):
            continue
        if tag == "a" and linked:
            close({"a"}, set(BLOCK))
        away, marks = _away(tag, attributes, stack[-1])
        if away and not stack[-1].away and tag not in BLOCK:
            add(" ")
        stack.append(_Node(tag, stack[-1], away, marks))
        linked += tag == "a"
    flush()
    return blocks


def _looks_aside(n: _Node) -> bool:
    """Whether a container whose marks are doubtful is no text: mostly links, or without a paragraph that scores; paragraphs and headings so marked stay."""
    if n.tag not in _CONTAINERS or not n.marks & DOUBTFUL or n.marks & STAY:
        return False
    return n.links > 0.3 * n.chars or not n.score


def _find(page: str, tag: str, at: int) -> int:
    m = re.compile("</" + tag, re.I).search(page, at)
    return m.start() if m else -1


def main_text(page: str | None) -> str:
    """The article's blocks, one to a line; empty if there is none."""
    if not page:
        return ""
    blocks = _read(page)
    nodes: dict[int, _Node] = {}
    for node, text, links in blocks:
        points = 0.0
        if node.tag in _PARAGRAPH and len(text) >= 25:
            points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)
        at, level = node if node.tag not in ("p", "pre", "blockquote", "td", "li", "dd") else node.parent, 0
        while at is not None:
            nodes[id(at)] = at
            at.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            at.chars += len(text)
            at.links += links
            at.blocks += 1
            at, level = at.parent, level + 1
        if node.tag in ("p", "pre", "blockquote", "td", "li", "dd"):
            nodes[id(node)] = node
            node.chars += len(text)
            node.links += links

    def worth(n: _Node) -> float:
        return n.score * (1 - n.links / max(n.chars, 1))

    within = [n for n in nodes.values() if n.tag in ("article", "main")]
    scored = [n for n in nodes.values() if n.score > 0 and n.tag not in ("#root", "html")]
    if scored:
        best = max(scored, key=worth)  # the first in page order of equal ones
        at, least = best, 0.1 * worth(best)
        while at is not None:
            # The article around the best container holds its siblings too, if it is worth it: points fade with each level, links take from them.
            if worth(at) >= least and (at.tag == "article" or at.tag == "main" and not any(n.tag == "article" and n is not at for n in within)):
                best = at
            at = at.parent
    elif within:
        best = max(within, key=lambda n: n.chars - n.links)
    else:
        return "" if not blocks else "\n".join(t for n, t, k in blocks if k * 2 < len(t))
    limit = max(10.0, worth(best) * 0.2)
    keep = {id(best)}
    if best.tag not in ("article", "main", "body"):
        for node, text, links in blocks:
            at = node
            while at is not None and at.parent is not best.parent:
                at = at.parent
            if at is None or id(at) in keep or best.parent is None:
                continue
            bonus = worth(best) * 0.2 if at.marks and at.marks == best.marks else 0
            density = at.links / max(at.chars, 1)
            if worth(at) + bonus >= limit or at.tag in ("p", "h1", "h2", "h3") and density < 0.25 and (at.chars > 80 or at.tag != "p" or density == 0 and text[-1:] in ".!?"):
                keep.add(id(at))
    out = []
    for node, text, _ in blocks:
        at, menu = node, False
        while at is not None and id(at) not in keep:
            menu |= at.tag in _CONTAINERS and at.blocks > 1 and at.links > 0.75 * at.chars or _looks_aside(at)
            at = at.parent
        if at is not None and not menu:
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row.

    A null or empty page has the empty text; broken markup is read as far as it
    goes; of containers with equal points the first in the page counts; repeated
    rows give equal rows; null ids and urls are carried along; other columns,
    whatever their names, are not read. Pages are read whole, one at a time, at some
    hundred bytes of memory for each element.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [main_text(h.as_py()) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
