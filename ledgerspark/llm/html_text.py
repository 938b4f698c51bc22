"""Main text of web pages by composite text density.

A page becomes a tree. Parts that are never article text (navigation, headers of the page, footers, asides, forms, notices,
adverts, reader comments, scripts) are taken out by element and by class name. For every node left, the composite density
is its characters per tag, adjusted by the share of linked characters and tags:

    (C / T) * log(max(1, C * T / (LC * LT))) / max(1, log(e - 1 + log(C / (C - LC) * LC + LCb / Cb * C + e)))

with C characters, T tags, LC linked characters and LT linked tags below the node, and LCb, Cb those of the body; counts in
denominators are 1 at least. Both bounds keep a density from being negative or infinite where a node is all links or has none.
A node's density sum adds up the densities of its children and, in blocks, the characters that stand in the node itself, which have
no child to count them. The node of the largest sum is the main part; the lowest density on its path from the body is the
threshold, and below every node that reaches it the subtree of the largest sum is article text. An ``article`` or ``main``
element around such a subtree is taken whole. Without one, headings before and paragraphs on either side of the main part's
containers belong to it, and so does a page header that only holds the headline.

A form or a set of fields is taken out unless it is the layout around the main part; a label goes with its control.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose text is no article text.
DROPPED = frozenset(
    "script style noscript template head title nav footer aside button select option textarea input iframe object"
    " embed svg canvas audio video menu dialog noframes noembed xmp datalist".split()
)
BLOCK = frozenset(
    "html body address article blockquote center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CONTROLS = frozenset("input select textarea button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p blockquote pre".split())
CHARS_PER_CONTROL = 25  # a form with less text for each of its controls and one more is not the layout of a page
#: Words that mark such parts as a whole name of class or id, or as its first part: ``header-top``, but not ``article-header`` or ``with-sidebar``.
MARKED = re.compile(
    r"(?:^|\s)(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side-?bar|footer|foot|header|masthead"
    r"|comments?|respond|replies|reply|disqus|cookies?|consent|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login"
    r"|share|sharing|social|related|recommended|widget|pagination|pager|copyright|toolbar|hidden)(?:$|[\s_-])",
    re.IGNORECASE,
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: What an opening tag closes if it is open, as the syntax allows to leave out.
P_CLOSERS = BLOCK - {"html", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

_token = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>|<[!?][^>]*>?|</?[A-Za-z][^>]*\Z", re.DOTALL)
_attribute = re.compile(r"(class|id|role|hidden|aria-hidden|for|type)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
_rights = re.compile(r"\s*(?:©|\(c\)|copyright\b|all rights reserved)", re.IGNORECASE).match
_space = re.compile(r"[\s ]+")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "named", "inside", "controls", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: "Node | None", dropped: bool = False):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.named = False  # dropped only for a name of class or id
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.children: list = []  # nodes and strings
        self.controls = 0  # of forms, in the node and below it
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _is_named(attributes: str) -> bool:
    return any(name.lower() in ("class", "id") and MARKED.search(value.strip("\"'")) for name, value in _attribute.findall(attributes))


def _is_marked(attributes: str) -> bool:
    for name, value in _attribute.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in ROLES:
            return True
    return False


def _settle_forms(root: Node) -> None:
    """Forms and sets of fields are marked like parts with a name, so that the main part can take them back."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.controls += node.controls
    block: dict[int, Node] = {}  # the nearest block of each node
    for node in nodes:
        block[id(node)] = node if node.tag in BLOCK else block.get(id(node.parent), root)
        if node.dropped:
            continue
        if node.tag == "form" or node.tag == "fieldset" and node.controls:
            node.dropped = node.named = True
        elif node.tag == "label":
            node.dropped = bool(node.controls or block[id(node)].controls)


def parse(source: str) -> Node:
    """The tree of a page. Missing end tags are supplied, stray ones ignored, a tag cut off at the end is left out."""
    root = Node("#root", None)
    at, top, end = root, 0, len(source)
    opened: Counter = Counter()  # open elements by tag

    def text(piece: str) -> None:
        if piece:
            at.children.append(html.unescape(piece))

    def close(tags: tuple[str, ...], scope: tuple[str, ...] = ()) -> None:
        nonlocal at
        if not any(opened[t] for t in tags):
            return
        node = at
        while node.tag not in tags:
            if node.tag in scope:
                return
            node = node.parent
        while at is not node.parent:
            opened[at.tag] -= 1
            at = at.parent

    while top < end:
        m = _token.search(source, top)
        if not m:
            text(source[top:])
            break
        text(source[top : m.start()])
        top = m.end()
        if not m.group(2):
            continue
        tag, attributes = m.group(2).lower(), m.group(3) or ""
        if m.group(1):
            close((tag,), ("table", "article", "body") if tag not in BLOCK | {"table", "html"} else ())
            continue
        if tag in P_CLOSERS:
            close(("p",), ("td", "th", "li", "blockquote", "div", "article", "section", "button", "figure", "main", "aside"))
        if tag in SIBLINGS:
            for _ in range(2 if tag == "tr" else 1):
                close(SIBLINGS[tag], SCOPE[tag])
        if tag in ("html", "body") and opened[tag]:
            continue
        own = tag in ("html", "body", "article", "main")
        dropped = tag in DROPPED or tag == "header" and not at.inside or not own and _is_marked(attributes)
        node = Node(tag, at, dropped)
        if not dropped and not own and _is_named(attributes):
            node.dropped = node.named = True
        if tag == "label" and any(name.lower() == "for" for name, _ in _attribute.findall(attributes)):
            node.dropped = True
        if tag in CONTROLS:
            kinds = [value.strip("\"'").lower() for name, value in _attribute.findall(attributes) if name.lower() == "type"]
            node.controls = int(kinds[:1] != ["hidden"])
        at.children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, top)
            if not dropped:
                node.children.append(source[top : stop.start() if stop else end])
            top = stop.end() if stop else end
        elif not attributes.rstrip().endswith("/") or tag in BLOCK:
            at = node
            opened[tag] += 1
    _settle_forms(root)
    return root


def _line(node: Node) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _order(root: Node) -> list[Node]:
    """Nodes that are not dropped, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.dropped:
            out.append(node)
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def _measure(root: Node, body: Node) -> None:
    """Counts, densities and density sums of all nodes that are not dropped."""
    nodes = _order(root)
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = 0.0
        linked = node.tag == "a"
        for child in node.children:
            if isinstance(child, str):
                node.chars += len(_space.sub("", child))
            elif not child.dropped:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags + (child.tag == "a")
        if linked:
            node.link_chars = node.chars
    whole = max(body.chars, 1)
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
        if c:
            base = math.log(c / max(c - lc, 1) * lc + body.link_chars / whole * c + math.e)
            ratio = c / max(lc, 1) * t / lt
            node.density = c / t * math.log(max(ratio, 1.0)) / max(math.log(base + math.e - 1), 1.0)
    for node in nodes:
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and not c.dropped)
        node.total += sum(len(_space.sub("", c)) for c in node.children if isinstance(c, str)) if node.tag in BLOCK else 0.0


def _keep_main_part(root: Node) -> None:
    """Take back the marks by name, and those of forms, around the main part of the page.

    That is the node of the largest density sum, if it is larger than all sums outside of marked parts. As reader comments can be
    longer than the article, a marked part must also hold the headline or the ``article``, unless no part of the page does. A form
    must hold text for its controls.
    """
    named, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.named:
            named.append(node)
        if not node.dropped or node.named:
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    if not named:
        return
    body = lambda: next((n for n in _order(root) if n.tag == "body"), root)
    _measure(root, body())
    most = max(n.total for n in _order(body()))
    for node in named:
        node.dropped = False
    _measure(root, top := body())
    nodes = _order(top)
    around: dict[int, Node | None] = {}  # the nearest marked part of each node
    for node in nodes:
        around[id(node)] = node if node.named else around.get(id(node.parent))
    bare = {id(n) for n in named if n.controls and n.chars < CHARS_PER_CONTROL * (n.controls + 1) and n.tag in ("form", "fieldset")}
    heads = {id(around[id(n)]) for n in nodes if n.tag in ("h1", "article", "main") and n.chars}
    inside = [n for n in nodes if n.chars and (part := around[id(n)]) is not None and id(part) not in bare and (not heads or id(part) in heads)]
    for node in named:
        node.dropped = True
    main = max(inside, key=lambda n: n.total, default=None)
    if main is not None and main.total > most:
        while len(only := [c for c in main.children if isinstance(c, Node) and c.chars == main.chars]) == 1:
            main = only[0]
        for node in _line(main):
            if node.named:
                node.dropped = False


def _chosen(root: Node) -> list[Node]:
    """The article subtrees in page order, none inside another."""
    _keep_main_part(root)
    body = next((n for n in _order(root) if n.tag == "body"), root)
    _measure(root, body)
    nodes = _order(body)
    if not body.chars:
        return []
    main = max(nodes, key=lambda n: n.total)  # the first of equals
    if not main.chars:
        main = body
    line = list(_line(main))
    threshold = min(n.density for n in line[: line.index(body) + 1])
    marked: set[int] = set()
    best: dict[int, Node] = {}
    for node in reversed(nodes):
        below = [best[id(c)] for c in node.children if isinstance(c, Node) and not c.dropped]
        best[id(node)] = max([node, *below], key=lambda n: n.total)
    for node in nodes:
        if node is not body and node.chars and node.density >= threshold or node is main:
            top = best[id(node)]
            marked.add(id(top if top.chars else node))
    holds: set[int] = set()  # nodes with something marked in them
    for node in reversed(nodes):
        if id(node) in marked or id(node) in holds:
            holds |= {id(node), id(node.parent)}
    out: list[Node] = []
    taken: set[int] = set()
    for node in nodes:
        if id(node.parent) in taken:
            taken.add(id(node))
        elif id(node) in marked or node.tag in ("article", "main") and id(node) in holds:
            out.append(node)
            taken.add(id(node))
    if any(n.tag in ("article", "main") for n in line):
        beside = []
    else:
        beside = _beside(line[: line.index(body)], taken, holds, _has_headline(nodes, taken))
    head = None if beside and any(n.tag in HEADINGS for n in beside) or _has_headline(nodes, taken) else _header_before(root, body, out[0])
    if not beside and head is None:
        return out
    if head is not None:
        head.dropped = False
    place = {id(node): i for i, node in enumerate(_order(root))}
    return sorted([*out, *beside, *([head] if head is not None else [])], key=lambda n: place[id(n)])


def _own_text(node: Node) -> bool:
    return any(isinstance(c, str) and c.strip() for c in node.children)


def _has_headline(nodes: list[Node], taken: set[int]) -> bool:
    """True if the taken subtrees hold the page's headline or begin with a heading. ``nodes`` are in page order."""
    if any(n.tag == "h1" and n.chars and id(n) in taken for n in nodes):
        return True
    first = next((n for n in nodes if id(n) in taken and _own_text(n)), None)
    return first is not None and next((n.tag for n in _line(first) if n.tag in BLOCK), "") in HEADINGS


def _beside(line: list[Node], taken: set[int], holds: set[int], has_headline: bool) -> list[Node]:
    """Blocks next to the containers of the main part: headings before them, and paragraphs that are mostly no links."""
    out = []
    for node in line:
        if id(node) in taken and id(node.parent) in taken:
            continue
        before = True
        for other in node.parent.children:
            if other is node:
                before = False
            elif not isinstance(other, Node) or other.dropped or not other.chars or id(other) in taken or id(other) in holds:
                continue
            elif other.tag in HEADINGS and before and not has_headline:
                out.append(other)
            elif other.tag in PARAGRAPHS and 2 * other.link_chars <= other.chars and not _rights(" ".join(_blocks([other]))):
                out.append(other)
    return out


def _header_before(root: Node, body: Node, first: Node) -> Node | None:
    """A header of the page before ``first`` that holds a headline and no menus, pictures, controls or mere links."""
    todo = [root]
    while todo:
        node = todo.pop()
        if node is first:
            return None
        if node.tag == "header" and node.dropped:
            node.dropped = False
            _measure(node, body)
            below = _order(node)
            node.dropped = True
            tags = {c.tag for n in below for c in n.children if isinstance(c, Node)}
            if "h1" in tags and not node.controls and not tags & {"nav", "form", "img", "svg", "ul", "ol"} and 2 * node.link_chars <= node.chars:
                return node
        elif not node.dropped:
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return None


def _blocks(nodes: list[Node]) -> list[str]:
    blocks: list[str] = []
    now: list[str] = []

    def cut() -> None:
        block = _space.sub(" ", "".join(now)).strip()
        if block:
            blocks.append(block)
        now.clear()

    for top in nodes:
        todo: list = [top]
        while todo:
            item = todo.pop()
            if item is None:
                cut()
            elif isinstance(item, str):
                now.append(item)
            elif item.dropped:
                now.append(" ")
            elif item.tag == "br":
                now.append(" ")
            else:
                block = item.tag in BLOCK
                if block:
                    cut()
                    todo.append(None)
                todo += reversed(item.children)
        cut()
    return blocks


def main_text(source: str | None) -> str:
    """The blocks of the article, white space inside each made single, joined by line feeds. Empty for null and empty pages."""
    return "\n".join(_blocks(_chosen(parse(source)))) if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. Whole pages are read whatever their length; repeated pages stay repeated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
