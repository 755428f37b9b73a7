"""Main text of web pages by composite text density.

A page becomes a tree. Elements that can't be content by their name or role (menus, page headers, footers, sidebars,
notices, adverts, fields of forms, scripts, styles) are cut. Forms and dialogs, and what only a class or id calls one of
these, or reader comments, are cut too unless they hold the page: at least `HOLDS` of the text outside of links, which a wrapper does and an advert
doesn't (see `settle`). Every node left gets its composite density: characters per tag, adjusted by the characters and
tags of links in it. A heading in a page's header comes back if the page's title says that it is the page's. Densities of children are summed; the node with the largest sum below the body holds the main text.
The smallest density on the path from that node to the body is the threshold: outside of the chosen node, a subtree is
content only if its root reaches the threshold, has text of its own kind (paragraphs, headings, lists, tables, quotes,
code) and isn't mostly links. In the article or main element that the chosen node lies in, other subtrees are content
unless they are lists of links below the threshold.

Text is returned block by block in page order: character references decoded, white space inside a block turned into one
space, blocks trimmed and joined by a newline.

Defined results: null or empty html gives an empty text; markup that is never closed ends where its parent ends or where
the next block must begin; a page without body is read as one; nothing is cut for length; of equal sums the outermost
node is chosen.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

# A quoted value follows an equals sign; other quotes are plain. Nothing is tried twice, so that broken markup stays linear.
_TAG = re.compile(r"<(?:!--(.*?)(?:--!?>|\Z)|([!?])[^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_TITLE = re.compile(r"<title[^>]*>([^<]*)", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# Names of elements, by what they do to a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template noframes".split())
CUT = frozenset("head script style noscript template iframe object embed svg canvas nav footer aside button select option textarea input label menu title audio video map noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog menu menubar toolbar".split())
#: Elements and roles that are cut unless they hold the page: some frameworks put every page into one form.
FORMS = frozenset("form fieldset dialog".split())
#: Words of a class or id that say what an element is for.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner promo promoted promotion sponsor sponsored sponsors nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer foot masthead topbar header "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus replies respond pagination pager widget widgets toolbar skip search copyright disclaimer outbrain taboola".split()
)
#: Those of them that never hold a page's text, however much they hold, unless there is no other.
COMMENTS = frozenset("comment comments disqus replies respond".split())
#: Share of the text outside of links that an element has to hold, for its class or id not to count.
HOLDS = 0.8
#: Characters that a form without an article, a main element and a first heading has to have to hold a page.
FORM_TEXT = 140
#: These keep their content whatever their class says.
KEPT = frozenset("html body main article".split())
#: A start tag closes an open element of these names, up to the nearest of the fences.
CLOSES = {
    **{x: (("p",), ("table", "td", "th", "button", "li", "article", "div", "section", "body")) for x in BLOCK - {"li", "dd", "dt", "tr", "td", "th", "tbody", "thead", "tfoot", "html", "body"}},
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead"), ("table",)),
    "option": (("option",), ("select",)),
}


class Node:
    __slots__ = ("name", "parent", "parts", "cut", "inside", "chars", "tags", "link_chars", "link_tags", "density", "total", "main", "own", "suspect")

    def __init__(self, name: str, parent: Node | None, cut: bool = False) -> None:
        self.name, self.parent, self.cut = name, parent, cut
        self.inside = name in ("article", "main") or parent is not None and parent.inside
        self.parts: list = []  # text and nodes, in order
        self.main = self.own = False  # whether all of it is content, or its own text
        self.suspect = ""  # the word of its class or id that speaks against it


def _unwanted(name: str, attributes: str, inside: bool) -> tuple[bool, str]:
    """Whether an element can't be content, and the word of its class or id that speaks against it."""
    if name in CUT or name == "header" and not inside:
        return True, ""
    suspect = "form" if name in FORMS else ""
    if not attributes or name in KEPT:
        return False, suspect
    for k, a, b, c in _ATTRIBUTE.findall(attributes):
        k, value = k.lower(), a or b or c
        if k == "role" and value.lower() in ROLES or k == "hidden" or k == "aria-hidden" and value.lower() == "true":
            return True, ""
        if k == "role" and value.lower() in FORMS:
            suspect = suspect or "form"
        if k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, ""
        if k in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in _WORDS.findall(one)]
                # the last word says what it is: "post-header" is a header, "header-post" isn't; "has-sidebar" says what is beside it
                if not words or words[0] in ("has", "no", "with", "without"):
                    continue
                if words[-1] in PARTS and not (words[-1] in ("header", "notice", "banner", "aside", "foot") and inside and len(words) > 1):
                    found = words[-1]
                elif words[0] in PARTS and len(words) > 1 and words[0] not in ("header", "foot", "nav", "search", "share", "social", "skip", "alert", "notice"):
                    found = words[0]
                else:
                    continue
                if not suspect or suspect == "form" or found in COMMENTS:
                    suspect = found
    return False, suspect


def tree(page: str) -> Node:
    """The page's elements; those that are cut keep their place but no content."""
    root = Node("#page", None)
    open_, at, pos = [root], 0, 0
    names_open: Counter[str] = Counter()
    last = page.rfind(">") + 1  # no tag ends after it, but comments and declarations may
    if "<!" in page[last:] or "<?" in page[last:]:
        last = len(page)

    def close(i: int) -> None:
        names_open.subtract(x.name for x in open_[i:])
        del open_[i:]

    while True:
        m = _TAG.search(page, pos, last)
        text = page[at : m.start() if m else len(page)]
        if text:
            open_[-1].parts.append(text)
        if not m:
            break
        pos = at = m.end()
        comment, other, closing, name, attributes = m.groups()
        if name is None:
            continue
        name = name.lower()
        if closing:
            for i in range(len(open_) - 1, 0, -1) if names_open[name] else ():
                if open_[i].name == name:
                    close(i)
                    break
                if open_[i].name in ("table", "article", "section", "body", "html") and name not in BLOCK:
                    break  # a stray end of an inline element
            continue
        if name in CLOSES:
            names, fences = CLOSES[name]
            for i in range(len(open_) - 1, 0, -1) if any(names_open[x] for x in names) else ():
                if open_[i].name in names:
                    close(i)
                    break
                if open_[i].name in fences:
                    break
        if name in ("html", "body") and names_open[name]:
            continue
        parent = open_[-1]
        cut, suspect = _unwanted(name, attributes, parent.inside)
        node = Node(name, parent, parent.cut or cut)
        node.suspect = suspect
        parent.parts.append(node)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, pos)
            pos = at = end.end() if end else len(page)
            continue
        if not (attributes or "").rstrip().endswith("/") or name in BLOCK:
            open_.append(node)
            names_open[name] += 1
    return root


def settle(root: Node) -> None:
    """Cuts forms, dialogs, and the elements whose class or id speaks against them, but for those that hold the page.

    An element holds the page if it has `HOLDS` of the text outside of links, and an article, main element or first
    heading if the page has one; or if it has all of these and, without an article or main element, half of the text.
    Those inside of it are judged within it. Reader comments hold a page only if there is nothing else."""
    order, stack = [], [(root, False)]
    while stack:
        n, link = stack.pop()
        order.append((n, link))
        stack.extend((x, link or n.name == "a") for x in n.parts if isinstance(x, Node) and not x.cut)
    plain: dict[int, int] = {}
    named: dict[int, int] = {}
    strong: dict[int, bool] = {}
    for n, link in reversed(order):
        kids = [x for x in n.parts if isinstance(x, Node) and not x.cut]
        own = 0 if link or n.name == "a" else sum(len("".join(x.split())) for x in n.parts if isinstance(x, str))
        plain[id(n)] = own + sum(plain[id(k)] for k in kids)
        named[id(n)] = sum(named[id(k)] for k in kids) + (n.name in ("article", "main", "h1") and plain[id(n)] > 0)
        strong[id(n)] = n.name in ("article", "main") and plain[id(n)] > 0 or any(strong[id(k)] for k in kids)
    top: Node | None = root
    while top is not None:
        outer, stack = [], [top]
        while stack:
            for x in stack.pop().parts:
                if isinstance(x, Node) and not x.cut:
                    if x.suspect:
                        outer.append(x)
                    else:
                        stack.append(x)
        whole, names = plain[id(top)], named[id(top)]
        top = None
        for x in outer:
            here, name = plain[id(x)], named[id(x)]
            holds = here >= HOLDS * whole and (name or not names) or names and name == names and (strong[id(x)] or 2 * here >= whole)
            small = x.suspect == "form" and not name and here < FORM_TEXT
            if here and not small and (here == whole or holds and x.suspect not in COMMENTS):
                top = x
                x.suspect = ""
            else:
                x.cut = True


def _measure(root: Node) -> None:
    """Characters, tags, link characters and link tags of every node, children first."""
    order, stack = [], [(root, False)]
    while stack:
        n, link = stack.pop()
        order.append((n, link))
        link = link or n.name == "a"
        stack.extend((x, link) for x in n.parts if isinstance(x, Node) and not x.cut)
    for n, link in reversed(order):
        own = sum(len("".join(entities.unescape(x).split())) for x in n.parts if isinstance(x, str))
        kids = [x for x in n.parts if isinstance(x, Node) and not x.cut]
        n.chars = own + sum(k.chars for k in kids)
        n.tags = sum(k.tags + 1 for k in kids)
        if link or n.name == "a":
            n.link_chars, n.link_tags = n.chars, n.tags
        else:
            n.link_chars = sum(k.link_chars for k in kids)
            n.link_tags = sum(k.link_tags + (k.name == "a") for k in kids)
    body_chars, body_links = root.chars, root.link_chars
    share = body_links / body_chars if body_chars else 0.0
    for n, _ in reversed(order):
        c, t, lc, lt = n.chars, max(n.tags, 1), n.link_chars, max(n.link_tags, 1)
        if not c:
            n.density = 0.0
        else:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            x = c / max(lc, 1) * t / lt
            n.density = c / t * (math.log(x) / math.log(base) if x > 1 and base > 1 else 0.0)
        n.total = sum(k.density for k in n.parts if isinstance(k, Node) and not k.cut)


def _nodes(top: Node) -> list[Node]:
    out, stack = [], [top]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(reversed([x for x in n.parts if isinstance(x, Node) and not x.cut]))
    return out


def choose(root: Node) -> list[Node]:
    """Marks the content; returns the marked nodes."""
    _measure(root)
    every = _nodes(root)
    if not root.chars:
        return []
    body = next((n for n in every if n.name == "body"), root)
    # Outermost first, so that of equal sums the larger part is taken.
    pool = [n for n in _nodes(body) if n.chars] or [body]
    best = max(pool, key=lambda n: n.total)
    if best.total == 0.0:
        best = body
    path, n = [best], best
    while n is not body and n.parent is not None:
        n = n.parent
        path.append(n)
    threshold = min(x.density for x in path)
    best.main = True
    marked = [best]
    inside = set(map(id, _nodes(best))) | set(map(id, path))
    context = next((i for i, x in enumerate(path) if x.name in ("article", "main")), 0)
    around = set(map(id, _nodes(path[context]))) if context else set()
    for x in path[1 : context + 1]:
        x.own = True
    stack = [body]
    while stack:
        n = stack.pop()
        for k in n.parts:
            if not isinstance(k, Node) or k.cut or k is best or not k.chars:
                continue
            links = k.link_chars * 2 >= k.chars
            if id(k) in around:
                content = k.density >= threshold or not links or k.link_tags < 3
            else:
                content = k.density >= threshold > 0 and not links and any(x.name in TEXTUAL for x in _nodes(k))
            if id(k) not in inside and content:
                k.main = True
                marked.append(k)
            else:
                stack.append(k)
    return marked


def blocks(root: Node) -> list[str]:
    """The text of the marked nodes, block by block."""
    out, now = [], []

    def flush():
        text = " ".join(entities.unescape("".join(now)).split())
        now.clear()
        if text:
            out.append(text)

    stack: list = [(root, False, None)]
    while stack:
        x, main, end = stack.pop()
        if end is not None:
            flush()
        elif isinstance(x, str):
            if main:
                now.append(x)
        elif x.name == "br" and main:
            now.append(" ")
        elif not x.cut:
            main = main or x.main
            if x.name in BLOCK:
                flush()
                stack.append((None, False, True))
            stack.extend((p, main or x.own and isinstance(p, str), None) for p in reversed(x.parts))
        elif x.name in BLOCK:
            flush()
    flush()
    return out


def title_back(root: Node, page: str) -> None:
    """Takes a page's heading out of a header that was cut, if there is no other and the page's title begins with it, or
    is made of it and other parts: a site's name or slogan isn't that."""
    kept, cut, stack = [], [], [root]
    while stack:
        n = stack.pop()
        if n.name == "h1" and not any(isinstance(x, Node) and x.name == "a" for x in n.parts):
            (cut if n.cut else kept).append(n)
        stack.extend(x for x in n.parts if isinstance(x, Node))
    if kept or len(cut) != 1 or not (m := _TITLE.search(page)):
        return
    plain = lambda x: " ".join(entities.unescape(x).split()).lower()
    words, title = plain(_text(cut[0])), plain(m.group(1))
    if not words or not (title.startswith(words) or words in map(str.strip, re.split(r"[|–—·»:]| - ", title))):
        return
    chain, n = [cut[0]], cut[0].parent
    while n is not None and n.cut:
        chain.append(n)
        n = n.parent
    if chain[-1].name != "header":
        return
    for n in [*chain, *_below(cut[0])]:
        n.cut = False
    for inner, outer in zip(chain, chain[1:]):
        outer.parts = [inner]  # nothing else of the header comes back
    cut[0].main = True


def _below(top: Node) -> list[Node]:
    out, stack = [], [top]
    while stack:
        for x in stack.pop().parts:
            if isinstance(x, Node):
                out.append(x)
                stack.append(x)
    return out


def _text(top: Node) -> str:
    """All text of an element, in order."""
    out, stack = [], [top]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack.extend(reversed(x.parts))
    return "".join(out)


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = tree(page)
    settle(root)
    choose(root)
    title_back(root, page)
    return "\n".join(blocks(root))


def extract_pages(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """All columns but the html, and the main text. One pass, no shuffle; one page at a time."""
    common.ship(pages.sparkSession)
    rest = [c for c in pages.columns if c not in (html, out)]
    picked = pages.select(*rest, html)

    def run(batches):
        common.only("html_density")
        for b in batches:
            texts = [extract(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*rest, out])

    return picked.mapInArrow(run, common.plus(pages.select(*rest), out, "string"))
