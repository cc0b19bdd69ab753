"""Main text of web pages by composite text density.

A page becomes a tree of elements. The density of a node is its characters per tag, adjusted for the
characters and tags that lie in links; its density sum is that of its children. Below the body the node
with the greatest density sum is the main subtree, and nodes of it that are less dense than the threshold
(the least density on the path from the body to it) and no text blocks go. Elements whose tag, class, id or
role tells of a notice (menus, ads, comments, a sidebar) weigh little in these sums and against the threshold,
unless they hold the page's text: names weigh, densities decide. Only what a browser doesn't show is no text.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

# Element names of HTML by their role.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
TEXT_BLOCK = set("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption".split())
UNSEEN = {"head", "select", "svg", "template", "object", "canvas", "audio", "video", "map"} | RAW
NOTICE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button"}
IN_HEAD = {"title", "meta", "link", "base", "script", "style", "noscript", "template"}
SCOPE = {"div", "article", "section", "main", "body", "td", "th", "table", "blockquote", "aside", "nav", "header", "footer", "form", "li"}
_NOTICE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|toolbar|comments?|commentlist|disqus|replies|respond|related|recommended|share|sharing|social|widget|login|search|pagination|pager)(?=$|[\s_-]|\d)", re.I)
#: A name that tells only what an element has or lacks.
_ABOUT = re.compile(r"(?:^|(?<=\s))(?:\S*[_-])?(?:has|have|no|not|with|without)[_-]\S*", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|(?=<)|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
#: What a notice weighs.
LIGHT = 0.02
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}


def attributes(text: str) -> list[tuple[str, str]]:
    """The names, in lower case, and values of a tag's attributes; a word in a value is no name."""
    return [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)]


def is_hidden(found: list[tuple[str, str]]) -> bool:
    return any(k == "hidden" or k == "aria-hidden" and v.strip().lower() == "true" or k == "style" and _NO_DISPLAY.search(v) for k, v in found)


class Node:
    __slots__ = ("tag", "parent", "kids", "junk", "named", "weight", "inside", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, junk: bool = False, named: bool = False):
        self.tag, self.parent, self.kids, self.junk, self.named, self.weight = tag, parent, [], junk, named, 1.0
        self.inside = 0
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


class Open:
    """The open elements of a page, with the depths of each tag's, so that none has to be searched for."""

    def __init__(self, root: Node):
        self.stack, self.depths = [root], {root.tag: [0]}

    def deepest(self, *tags: str) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=-1)

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def close(self, depth: int) -> None:
        """Closes the element at a depth and all below it."""
        while len(self.stack) > depth:
            self.depths[self.stack.pop().tag].pop()


#: The elements that a cell, an item or a term ends, by its tag.
ENDS = {"li": ("li",), "tr": ("tr",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}


def parse(page: str) -> tuple[Node, Node]:
    """The tree of a page and its body; text stands as strings among the children.

    Unclosed elements end with their parents, a paragraph before the next block, a head before what can't
    stand in it. Of several bodies there is one, that goes on to the page's end; without any the root is it.
    """
    root = body = Node("html", None)
    now = Open(root)
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            if now.stack[-1].tag == "head" and text.strip():
                now.close(now.deepest("head"))
            now.stack[-1].kids.append(text)
        if not m:
            break
        at = m.end() if m.end() > m.start() else m.end() + 1
        name = (m[2] or "").lower()
        if not name or name == "html":
            continue
        if m[1]:  # an end tag closes the nearest open element of its name; an inline one not beyond the block around it
            depth = now.deepest(name)
            if depth > 0 and name != "body" and (name in BLOCK or depth > now.deepest(*(SCOPE - {name}))):
                now.close(depth)
            continue
        if name not in IN_HEAD and name != "head" and now.deepest("head") >= 0:
            now.close(now.deepest("head"))
        if name == "body":
            if body is root:
                now.close(1)
                body = Node("body", root)
                root.kids.append(body)
                now.push(body)
            continue
        attrs = m[3] or ""
        if name in BLOCK:  # a new block ends an open paragraph, and the inline elements that were left open in it
            p, scope = now.deepest("p", "ul", "ol", "dl", "tr"), now.deepest(*SCOPE)
            if p > scope and now.stack[p].tag == "p":
                now.close(p)
            elif scope >= p and scope > 0 and name in TEXT_BLOCK:
                now.close(scope + 1)
        if name in ENDS:
            depth = now.deepest(*ENDS[name])
            if depth > now.deepest("ul", "ol", "dl", "table"):
                now.close(depth)
        found = attributes(attrs) if attrs else []
        junk = name in UNSEEN or is_hidden(found)
        named = name in NOTICE or any(_NOTICE.search(_ABOUT.sub("", v)) for k, v in found if k in ("class", "id", "role"))
        kid = Node(name, now.stack[-1], junk, named)
        kid.parent.kids.append(kid)
        if name in RAW:  # up to its own end tag, whatever stands there
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
        elif name not in VOID and not attrs.endswith("/"):
            now.push(kid)
    return root, body


def _post_order(root: Node) -> list[Node]:
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [k for k in x.kids if isinstance(k, Node) and not k.junk]
    return order[::-1]


def densities(body: Node) -> list[Node]:
    """Sets the counts, densities and density sums below the body; gives its nodes, children first."""
    order = _post_order(body)
    for x in order:
        for k in x.kids:
            if isinstance(k, str):
                x.chars += len(" ".join(k.split()))
            elif not k.junk:
                x.chars += k.chars
                x.tags += k.tags + 1
                x.link_chars += k.link_chars
                x.link_tags += k.link_tags + (k.tag == "a")
        if x.tag == "a":
            x.link_chars = x.chars
    share = body.link_chars / body.chars if body.chars else 0
    for x in order:
        tags, link_chars, link_tags = max(x.tags, 1), max(x.link_chars, 1), max(x.link_tags, 1)
        plain = max(x.chars - x.link_chars, 1)
        base = math.log(x.chars / plain * x.link_chars + share * x.chars + math.e)
        x.density = x.chars / tags * math.log(max(x.chars / link_chars * tags / link_tags, 1)) / base if x.chars else 0.0
        x.total = sum(k.weight * k.density for k in x.kids if isinstance(k, Node) and not k.junk)
    return order


def weigh(body: Node) -> list[Node]:
    """Sets densities and weights below the body; gives its nodes, children first.

    Notices are light, but for those that hold an article or main, or most of the density where no article or
    main stands elsewhere.
    """
    order = densities(body)
    around, sums = {body: 0}, {}
    for x in order:
        kids = [k for k in x.kids if isinstance(k, Node) and not k.junk]
        x.inside = sum(k.inside + (k.tag in ("article", "main") and not k.named) for k in kids)
        sums[x] = x.density + sum(sums[k] for k in kids)
    for x in reversed(order):  # parents first
        for k in x.kids:
            if isinstance(k, Node):
                around[k] = around[x] + (x is not body and x.tag in ("article", "main") and not x.named)
        if x.named and not x.inside and x is not body and x.tag not in ("article", "main"):
            x.weight = 1.0 if around[x] == body.inside and 2 * sums[x] > sums[body] else LIGHT
    for x in order:
        x.total = sum(k.weight * k.density for k in x.kids if isinstance(k, Node) and not k.junk)
    return order


def _blocks(top: Node, least: float, main: Node) -> list[str]:
    """Texts of the blocks below top in page order."""
    out, now = [], []

    def end() -> None:
        text = " ".join(entities.unescape("".join(now)).split())
        if text:
            out.append(text)
        now.clear()

    todo: list[Node | str | None] = [top]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag == "br":
            now.append(" ")
        elif not x.junk and not (x is not main and x.weight * x.density < least and (x.weight < 1 or x.tag in BLOCK - TEXT_BLOCK and x.link_chars * 2 > x.chars)):
            if x.tag in BLOCK:
                end()
                todo.append(None)
            todo += reversed(x.kids)
    end()
    return out


def _headings(main: Node, body: Node) -> list[Node]:
    """The headings that stand right before the main subtree, or before what it begins."""
    out, x = [], main
    while x is not body and x.parent:
        before = x.parent.kids[: x.parent.kids.index(x)]
        for k in reversed(before):
            if isinstance(k, Node) and (k.junk or k.tag in VOID):
                continue
            if isinstance(k, str) and not k.strip():
                continue
            if isinstance(k, str) or k.tag not in HEADING or k.weight < 1:
                return out[::-1]
            out.append(k)
        x = x.parent
    return out[::-1]


def main_text(page: str | None) -> str:
    """The text of the densest subtree of a page, a line for each block; empty for a page without text."""
    _, body = parse(page or "")
    order = weigh(body)
    weight = {body: 1.0}
    for x in reversed(order[:-1]):  # parents first: a light element makes all that it holds light
        weight[x] = weight[x.parent] * x.weight
    main = max(reversed(order), key=lambda x: weight[x] * x.total)  # the outermost of equals
    if main.total == 0:
        main = body
    while main.tag in TEXT_BLOCK and main is not body and not any(isinstance(k, Node) and k.tag in BLOCK for k in main.kids):
        main = main.parent
    path, x = [main.density], main
    while x is not body and x.parent:
        x = x.parent
        path.append(x.density)
    # an article or main element around the subtree is the text's own bound
    x = main
    while x is not body and x.parent:
        x = x.parent
        if x.tag in ("article", "main"):
            main = x
    heads = [] if main.tag in ("article", "main") else _headings(main, body)
    return "\n".join([*(t for h in heads for t in _blocks(h, 0.0, h)), *_blocks(main, min(path), main)])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages(page_id, url, html).

    A null page counts as empty and gives an empty text; repeated rows give a row each; nulls in the other
    columns stay; further columns are ignored.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            text = [main_text(x) for x in rows.pop("html")]
            yield rows.assign(text=text, n_chars=[len(x) for x in text])

    small_batches(pages.sparkSession)
    kind = {"page_id": "long", "url": "string", "html": "string"}
    return pages.select(*[F.col(c).cast(k).alias(c) for c, k in kind.items()]).mapInPandas(extract, "page_id long, url string, text string, n_chars long")
