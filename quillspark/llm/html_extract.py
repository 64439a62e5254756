"""Main text of web pages by tree scoring.

The page becomes a tree of elements (tolerant of unclosed and stray tags). Paragraphs pass points to their
ancestors: one, plus one per comma, plus one per 100 characters up to three; the parent takes all of it, the
grandparent half and higher ones a share that falls with the distance. An element's points are discounted by its link
density. The best container is kept, or the article or main element that it lies in. A best container that is no
article keeps its siblings, text without an element included, but for lists of links; beside an article only
headings, paragraphs and what scores near it stay. All in page order.

Elements that are never main text are cut before scoring: scripts, styles, form controls, menus, footers, asides and page
headers (a header inside an article is kept). Names tell more: a class, id or role that is an advert, a menu, a sidebar,
sharing links or reader comments is cut, and so is a form, but not

* where the name is of the page's frame (``with-sidebar``) or of a section of a text (``related-work``),
* where the element holds an article, a main element or a first heading,
* where it holds half of the page's text or more; reader comments go whatever they hold, unless nothing else is there,
* inside an article, where names that a text may well use (``legal``, ``discussion``) cut lists of links only.

Nothing is cut for being short.

Cases: null, empty and text-free pages give an empty text; html of any length is read whole; repeated rows are kept;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_text import slices

# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
CUT = frozenset(
    "script style head nav footer aside form button select option input textarea noscript template iframe svg canvas "
    "object embed dialog menu title math audio video".split()
)
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul caption title".split()
)
PARAGRAPH = frozenset("p pre td th blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
# An opening tag of the key closes an open element of the value, unless one of the stops lies between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
P_STOPS = frozenset("article aside blockquote body button caption div html main nav section table td th footer header form li".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)|[^>]*)>", re.DOTALL
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
# Words in a class, id or role that tell boilerplate from content.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
PLAIN = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion "
    "promoted cookie cookies consent gdpr popup sidebar navbar navigation navi menu menus nav breadcrumb breadcrumbs pagination "
    "pager masthead topbar toolbar share sharing social related recommended recommendations newsletter subscribe "
    "subscription signup contentinfo complementary".split()
)
#: Words that texts use too; inside an article they cut lists of links only.
DOUBTFUL = frozenset(
    "discussion notice notices notification alert modal overlay side widget widgets footer foot copyright legal disclaimer login search skip".split()
)
HEADERISH = frozenset("header banner masthead".split())
CONTENT = frozenset("article articlebody content main story post entry body text blog hentry page".split())
#: A name with one of these says what is beside the element, or names a section of a text.
FRAME = frozenset("with has no without hide hidden layout wrapper work works concept concepts terms theory methods results".split())
HALF = 0.5


class Node:
    __slots__ = ("tag", "parent", "children", "attrs", "score", "cut", "chars", "linked", "whole", "links", "holds")

    def __init__(self, tag: str, parent: "Node | None", attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.children: list[Node | str] = []
        self.score, self.cut, self.chars, self.linked = 0.0, False, 0, 0
        self.whole, self.links, self.holds = 0, 0, False  # characters before names are looked at; whether content lies inside


def parse(page: str) -> Node:
    """Element tree of a page. Every position of the page is read once."""
    root = Node("#root", None)
    open_ = [root]
    at, end = 0, len(page)

    def close(upto: int) -> None:
        del open_[upto:]

    def text(piece: str) -> None:
        if piece:
            open_[-1].children.append(html_lib.unescape(piece) if "&" in piece else piece)

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                open_[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not any(n.tag == "p" for n in open_):
                continue
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    close(k)
                    break
                if open_[k].tag in BLOCK and tag not in BLOCK:
                    break  # a stray inline end tag closes no block
            continue
        if tag in CLOSES_P:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == "p":
                    close(k)
                    break
                if open_[k].tag in P_STOPS:
                    break
        if tag in CLOSES:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag in CLOSES[tag]:
                    close(k)
                    if tag != "tr" or open_[-1].tag != "tr":
                        break
                elif open_[k].tag in STOPS[tag]:
                    break
        node = Node(tag, open_[-1], m[3])
        open_[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            if tag not in CUT:
                node.children.append(html_lib.unescape(page[at : stop.start() if stop else end]))
            at = stop.end() if stop else end
        elif tag not in VOID:  # a slash at the end means nothing in HTML
            open_.append(node)
    return root


def names_of(node: Node) -> tuple[list[set[str]], bool]:
    """Words of each name in class, id and role; whether the element is hidden."""
    names: list[set[str]] = []
    hidden = False
    if node.attrs:
        for m in _ATTR.finditer(node.attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden":
                hidden = True
            elif key == "aria-hidden":
                hidden = hidden or value.lower() == "true"
            else:
                names += ({w.lower() for w in _NAMES.findall(name)} for name in value.split())
    return names, hidden


def walk(root: Node) -> list[tuple[Node, bool, list[set[str]]]]:
    """Elements that may be main text by their tags, parents first, with whether they lie in an article and their names.

    Tags that never are main text, and what is hidden, are cut on the way.
    """
    found: list[tuple[Node, bool, list[set[str]]]] = []
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, in_article = stack.pop()
        names, hidden = names_of(node)
        hard = node.tag in CUT and node.tag != "form"
        if hard or hidden or (node.tag == "header" and not in_article):
            node.cut = True
            continue
        found.append((node, in_article, names))
        inside = in_article or node.tag in ("article", "main")
        stack.extend((c, inside) for c in reversed(node.children) if isinstance(c, Node))
    return found


def measure(found: list[tuple[Node, bool, list[set[str]]]]) -> None:
    """Sum up characters, linked characters and whether there is content inside, children first."""
    for node, _, names in reversed(found):
        for child in node.children:
            if isinstance(child, str):
                node.whole += len(child.strip())
            elif not child.cut:
                node.whole += child.whole
                node.links += child.links
                node.holds = node.holds or child.holds
        if node.tag == "a":
            node.links = node.whole
        commented = any(name & COMMENTS for name in names)
        if node.tag in ("article", "main", "h1") and not commented and node.whole:
            node.holds = True


def is_named(node: Node, names: list[set[str]], in_article: bool, total: int) -> bool:
    """A name, or the tag of a form, says that the element is no main text."""
    if node.tag in ("html", "body", "#root", "main"):
        return False
    telling = [name for name in names if not name & FRAME]
    words = set().union(*telling) if telling else set()
    if words & COMMENTS:
        return not (node.holds and node.tag != "article") and node.whole < total
    if node.tag == "article" or node.holds or node.whole >= HALF * total:
        return False
    if in_article and words <= HEADERISH | CONTENT:
        return node.tag == "form"
    listed = node.links > HALF * node.whole
    return node.tag == "form" or bool(words & PLAIN) or bool(words & DOUBTFUL and (listed or not in_article))


def extract(page: str | None) -> str:
    """Main text of one page."""
    if not page:
        return ""
    root = parse(page)
    found = walk(root)
    measure(found)
    order: list[Node] = []
    for node, in_article, names in found:
        if node.parent is not None and node.parent.cut:
            node.cut = True
        elif is_named(node, names, in_article, root.whole):
            node.cut = True
        else:
            order.append(node)
            if node.tag in ("article", "main") or any(name & CONTENT for name in names):
                node.score += 5
    # Children come after their parents in order, so that sums go up in one backward pass.
    for node in reversed(order):
        if node.cut:
            continue
        own = 0
        for child in node.children:
            if isinstance(child, str):
                own += len(child.strip())
            elif not child.cut:
                own += child.chars
                node.linked += child.linked
        node.chars = own
        if node.tag == "a":
            node.linked = own
    for node in order:
        if node.cut or not node.chars:
            continue
        words = [c for c in node.children if isinstance(c, str) and c.strip()]
        if node.tag in PARAGRAPH or (words and node.tag in BLOCK):
            commas, length = inline_size(node)
            if not length:
                continue
            points = (1 + commas + min(length / 100, 3.0)) * (1 - node.linked / node.chars)
            up, level = node.parent if node.tag in PARAGRAPH else node, 0
            while up is not None and up.tag not in ("#root", "html"):
                up.score += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
                up, level = up.parent, level + 1
    best, top = root, 0.0
    for node in order:
        if node.chars and node.score > 0 and node.tag in BLOCK:
            score = node.score * (1 - node.linked / node.chars)
            if score > top:
                best, top = node, score
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    best = up or best
    if best.parent is None or best.tag in ("body", "html", "main"):
        return " ".join(blocks([best]))
    kept: list[Node | str] = []
    for sibling in best.parent.children:
        if isinstance(sibling, str):
            if best.tag != "article":
                kept.append(sibling)
        elif sibling is best:
            kept.append(sibling)
        elif not sibling.cut and sibling.chars:
            density = sibling.linked / sibling.chars
            near = sibling.score * (1 - density) >= max(10.0, 0.2 * top)
            beside = best.tag != "article" or sibling.tag in PARAGRAPH or sibling.tag == "article"
            if near or (beside and density < 0.25):
                kept.append(sibling)
    return " ".join(blocks(kept))


def inline_size(node: Node) -> tuple[int, int]:
    """Commas and characters of an element up to the blocks inside it."""
    commas = length = 0
    stack: list[Node | str] = list(node.children)
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            commas += item.count(",")
            length += len(item.strip())
        elif not item.cut and item.tag not in BLOCK:
            stack.extend(item.children)
    return commas, length


def blocks(items: list[Node | str]) -> list[str]:
    """Texts of the blocks of some elements and texts in page order."""
    found: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            if words := "".join(line).split():
                found.append(" ".join(words))
            line.clear()

    stack: list[Node | str | None] = [None, *reversed(items)]
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            line.append(item)
        elif item.cut:
            continue
        elif item.tag in BLOCK:
            stack.extend([None, *reversed(item.children), None])
        else:
            stack.extend(reversed(item.children))
    return found


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            texts = [extract(page) for page in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
