"""Main text of web pages by tree scoring.

The page is read into a tree of its block elements. Each paragraph gives points for itself, its commas and its length to
its container, and half as many to each next ancestor; a container's points are lessened by the share of its text that is
in links. The container with most points is the article, or the article element around it, together with those of its
siblings that score enough or that are long paragraphs with few links, and with siblings of what holds it that are built
alike. Blocks whose names mark them as something else are left out, unless what they hold tells that they are the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tag from its name on. Quotes count only after an equals sign; a quote that is never closed is like any other character.
TAG = re.compile(r"([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+|[^>=])*+)>")
# Elements of HTML.
RAW = {"script", "style", "noscript", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}  # up to their end tag or the page's end
SKIPPED = {"template", "object", "svg", "math", "select"}  # up to their end tag, if there is one
FOREIGN = {"svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "head", "button",
}
DROPPED = {"nav", "footer", "aside", "form", "fieldset", "menu", "head", "button", "dialog", "search"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "blockquote", "td", "th"}
# Words of class, id and role that mark what isn't the article; those that an article may be about as well;
# words of layout, that may stand beside them; and those that mark even a paragraph or a piece of one.
MARKS = {
    "ad", "ads", "adsbox", "advert", "adverts", "advertisement", "advertising", "banner", "banners", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies",
    "disqus", "footer", "gdpr", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "overlay", "pager", "paginate", "pagination", "paywall", "popup", "promo", "promos", "promoted",
    "promotion", "recommendation", "recommendations", "recommended", "related", "replies", "reply", "respond", "responses", "share", "shares", "sharing", "sidebar", "signup", "skip", "sponsor", "sponsored", "subnav",
    "subscribe", "subscription", "subscriptions", "teaser", "teasers", "toolbar", "topbar", "topnav", "widget", "widgets",
}
TOPICS = {"alert", "alerts", "disclaimer", "discussion", "discussions", "feedback", "login", "notice", "notices", "notification", "notifications", "privacy", "search", "social"}
LAYOUT = {
    "a", "all", "and", "area", "article", "articles", "aside", "bar", "block", "blog", "body", "bottom", "box", "button", "buttons", "center", "col", "column", "container", "content", "entry", "fixed", "form", "global",
    "group", "header", "holder", "icon", "icons", "inner", "item", "items", "js", "layout", "left", "link", "links", "list", "lower", "main", "message", "mobile", "more", "news", "outer", "page", "panel", "policy",
    "post", "posts", "primary", "read", "reader", "region", "right", "row", "secondary", "section", "site", "slot", "small", "sticky", "stories", "story", "the", "this", "thread", "title", "to", "tools", "top", "ui", "unit",
    "upper", "user", "view", "web", "wrap", "wrapper", "zone",
}
#: Headers of a site, not of an article.
SITE_HEADER = re.compile(r"(?:site|page|top|global|main)[_-]?header|mast[_-]?head", re.IGNORECASE)
ADVERTS = {"ad", "ads", "advert", "adverts", "advertisement", "sponsored", "share", "sharing", "newsletter", "cookie", "consent"}
#: Marks that are written together with other words.
GLUED = re.compile(r"^(?:advert|subscri|paginat|newsletter|cookie|breadcrumb|related)|(?:sidebar|footer|navbar|comments)$")
WORDS_OF_MARK = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Text of a block that may as well be about its mark; more of it, with few links, is taken for the article's.
TOPIC_TEXT = 300
ARTICLE_HEADER = re.compile(r"(?:entry|post|article|content|story)[_-]?(?:header|head|title)", re.IGNORECASE)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|$)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
LENGTH_POINT, MOST_LENGTH_POINTS = 100, 30
SIBLING_SHARE, LONG_PARAGRAPH, FEW_LINKS = 0.2, 80, 0.25
HEADINGS, HEADING_LEVELS = {"h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup"}, 2
#: Elements that say they hold the article weigh more.
WEIGHTS = {"article": 8.0, "main": 4.0}


PARAGRAPHS = {"p", "pre", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "td", "dd", "dt"}
NEVER_MARKED = {"main", "body", "html"}
KEPT, MAYBE_OTHER, OTHER = 0, 1, 2  # what an element's marks say


class Node:
    __slots__ = ("tag", "parts", "parent", "points", "dropped", "size", "linked", "mark", "kind", "whole")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, mark: int = KEPT, kind: str = ""):
        self.tag, self.parent, self.dropped, self.mark, self.kind = tag, parent, dropped, mark, kind
        self.parts: list[Node | str] = []
        self.points, self.size, self.linked, self.whole = 0.0, 0, 0, False


def _mark(tag: str, value: str, inside: bool) -> int:
    """What a class, id or role says of a block. A name counts if all its words are of marks or layout, so that one of a
    subject, as in social-studies, doesn't."""
    found = KEPT
    for name in value.split():
        words = [x.lower() for x in WORDS_OF_MARK.findall(name)]
        own = [x for x in words if x in MARKS or x in TOPICS or GLUED.search(x)]
        if not inside and (words == ["header"] or SITE_HEADER.fullmatch(name)):
            return OTHER
        if own and all(x in LAYOUT or x in own for x in words):
            found = max(found, MAYBE_OTHER if all(x in TOPICS for x in own) else OTHER)
    return found


def _judged(tag: str, attributes: str, inside: bool, forms: bool) -> tuple[bool, int, str]:
    """Whether a block is left out by its name or because it isn't shown; what its marks say; its class. inside: within an
    article."""
    dropped, mark, kind = tag in DROPPED and not (forms and tag == "form"), KEPT, ""
    if tag == "header" and not inside and not ARTICLE_HEADER.search(attributes or ""):
        dropped = True
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            dropped = True
        elif name in ("class", "id", "role"):
            kind = value if name == "class" else kind
            if tag in PARAGRAPHS and tag not in ("li", "td"):
                mark = max(mark, OTHER if _advert(value) else KEPT)
            elif tag not in NEVER_MARKED:
                mark = max(mark, _mark(tag, value, inside))
    return dropped, mark, kind


def _advert(value: str) -> bool:
    """Whether a paragraph or a piece of one is marked as an advert or the like, beyond doubt."""
    return any(words and any(x in ADVERTS for x in words) and all(x in ADVERTS or x in LAYOUT or x in MARKS for x in words) for words in ([x.lower() for x in WORDS_OF_MARK.findall(n)] for n in value.split()))


def _unseen(attributes: str) -> bool:
    """Whether an inline element isn't shown, or is an advert."""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value) or name in ("class", "id", "role") and _advert(value):
            return True
    return False


def tree(page: str, forms: bool = False) -> Node:
    """Blocks of the page; a part that is text is a run of it, and links are counted in the block's linked."""
    root = here = Node("html", None, False)
    text: list[str] = []
    links, articles, at, end = 0, 0, 0, len(page)
    hidden: list[str] = []  # inline elements that are left out, as they nest
    opened: dict[str, int] = {}  # blocks that are open, by name
    endless: set[str] = set()  # elements whose end tag doesn't come any more

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined and not here.dropped:
                here.parts.append(joined)

    def say(piece: str) -> None:
        if piece and not here.dropped and not hidden:
            text.append(piece)
            if links and (n := len(piece.strip())):
                here.linked += n

    def close(node: Node) -> None:
        nonlocal here, articles
        flush()
        while True:
            articles -= here.tag in WEIGHTS
            opened[here.tag] -= 1
            last, here = here, here.parent
            if last is node:
                return

    def find(tags: set[str], within: set[str]) -> Node | None:
        if not any(opened.get(x) for x in tags):
            return None
        node = here
        while node is not root and node.tag not in tags:
            if node.tag in within:
                return None
            node = node.parent
        return node if node is not root else None

    def after(tag: str, at: int) -> int | None:
        """Where the element's end tag ends; None if it has none."""
        if tag in endless:
            return None
        ended = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>", re.IGNORECASE).search(page, at)
        if ended is None:
            endless.add(tag)
        return ended.end() if ended else None

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        say(page[at:lt])
        at = lt + 1
        if page.startswith("!--", at):
            to = -1 if page.startswith((">", "->"), at + 3) else page.find("-->", at + 3)
            at = page.index(">", at) + 1 if page.startswith((">", "->"), at + 3) else to + 3 if to >= 0 else end
            continue
        if page.startswith("![CDATA[", at):
            to = page.find("]]>", at)
            at = to + 3 if to >= 0 else end
            continue
        if page.startswith(("!", "?"), at):
            to = page.find(">", at)
            at = to + 1 if to >= 0 else end
            continue
        closing = page.startswith("/", at)
        m = TAG.match(page, at + closing)
        if not m:
            if page[at + closing : at + closing + 1].isascii() and page[at + closing : at + closing + 1].isalpha():
                break  # a tag that the page's end cuts off
            if closing:
                to = page.find(">", at)
                at = to + 1 if to >= 0 else end
            else:
                say("<")
            continue
        at = m.end()
        tag = m[1].lower()
        if tag in RAW:
            if not closing:
                to = after(tag, at)
                at = end if to is None else to
        elif tag in SKIPPED:
            if not closing and not (tag in FOREIGN and m[2].rstrip().endswith("/")) and (to := after(tag, at)) is not None:
                at = to
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in ("br", "hr"):
            say(" ")
        elif tag in VOID:
            pass
        elif tag not in BLOCKS:
            if hidden:
                if closing and tag == hidden[-1]:
                    hidden.pop()
                elif not closing and tag == hidden[-1]:
                    hidden.append(tag)
            elif not closing and m[2] and not m[2].rstrip().endswith("/") and _unseen(m[2]):
                hidden.append(tag)
        elif tag in ("html", "body"):
            flush()
        elif closing:
            hidden.clear()
            links = 0
            if (node := find({tag}, set())) is not None:
                close(node)
            else:
                flush()
        else:
            hidden.clear()
            if tag not in ("button",) and (node := find({"p"}, SCOPES)) is not None:
                close(node)
            if tag in CLOSES and (node := find(CLOSES[tag], {"ul", "ol", "dl", "table"})) is not None:
                close(node)
            flush()
            dropped, mark, kind = _judged(tag, m[2], articles > 0, forms)
            here = Node(tag, here, here.dropped or dropped, mark, kind)
            opened[tag] = opened.get(tag, 0) + 1
            articles += tag in WEIGHTS
            if not here.dropped:
                here.parent.parts.append(here)
    flush()
    return root


def _walk(root: Node) -> list[Node]:
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        found.append(node)
        todo.extend(x for x in reversed(node.parts) if isinstance(x, Node))
    return found


def _blocks(node: Node | str) -> list[str]:
    found, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            found.append(x)
        else:
            todo.extend(reversed(x.parts))
    return found


def _density(x: Node) -> float:
    return min(1.0, x.linked / x.size) if x.size else 0.0


def _measure(nodes: list[Node]) -> None:
    """Sizes of text and of links, and whether a heading of the page or an article's element is within."""
    links = {id(x): x.linked for x in nodes}
    for node in nodes:
        node.size = node.linked = 0
        node.whole = node.tag in ("h1", "article", "main") and node.mark == KEPT
    for node in reversed(nodes):
        own = sum(len(x) for x in node.parts if isinstance(x, str))
        node.size += own
        node.linked += min(links[id(node)], own)
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.linked += node.linked
            node.parent.whole |= node.whole and node.mark != OTHER


def _cut(nodes: list[Node]) -> None:
    """Takes blocks out that are marked as something else, unless they hold the page's heading or article and much text, or
    are marked only by what an article may be about and hold much text."""
    for node in nodes:
        if node.mark == KEPT or node.parent is None:
            continue
        much = node.size - node.linked > TOPIC_TEXT and _density(node) < 0.5
        within = any(isinstance(x, Node) and x.whole for x in node.parts)
        if not much or node.mark == OTHER and not within:
            node.parent.parts = [x for x in node.parent.parts if x is not node]


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by a space; empty if the page has none."""
    if not page:
        return ""
    return _main_text(tree(page)) or ("<form" in page.lower() and _main_text(tree(page, forms=True))) or _main_text(tree(page), marks=False)


def _main_text(root: Node, marks: bool = True) -> str:
    nodes = _walk(root)
    if marks and any(x.mark for x in nodes):
        links = [x.linked for x in nodes]
        _measure(nodes)
        _cut(nodes)
        for x, n in zip(nodes, links, strict=True):
            x.linked = n
        nodes = _walk(root)
    _measure(nodes)
    if not root.size:
        return ""
    for node in nodes:
        for x in node.parts:
            if isinstance(x, str):
                points = 1 + x.count(",") + min(len(x) / LENGTH_POINT, MOST_LENGTH_POINTS)
                holder = node.parent if node.tag in PARAGRAPHS and node.parent else node
                holder.points += points * (1 - _density(node))
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.points += node.points / 2
    plain = lambda x: x.points * (1 - _density(x))
    best = max(nodes, key=lambda x: plain(x) * WEIGHTS.get(x.tag, 1.0))
    around = best
    while around is not None and around.tag != "article":
        around = around.parent
    best = around or best
    if best.parent is None:
        return " ".join(_blocks(best))
    kept = _with_siblings(best, plain)
    return " ".join(t for x in kept for t in _blocks(x))


def _with_siblings(best: Node, plain) -> list[Node | str]:  # noqa: ANN001
    """The container and what belongs to it beside it and above it, in page order."""
    said = best.tag in WEIGHTS
    asked, kept = max(1.0, SIBLING_SHARE * plain(best)), []
    for x in best.parent.parts:
        if isinstance(x, str):
            wanted = not said and (len(x) > LONG_PARAGRAPH or best.parent.parent is not None)
        else:
            wanted = x is best or plain(x) >= asked and _density(x) < FEW_LINKS or not said and (x.tag in HEADINGS or _alike(x, best))
            wanted = wanted or x.tag in ("p", "pre", "blockquote") and _density(x) < FEW_LINKS and (x.size > LONG_PARAGRAPH or not x.linked and not said)
        if wanted:
            kept.append(x)
    level, node = 0, best.parent
    while not said and node.parent is not None:
        parts = node.parent.parts
        place = next(k for k, x in enumerate(parts) if x is node)
        wanted = lambda x: isinstance(x, Node) and _alike(x, node) and plain(x) > 0  # noqa: B023, E731
        before = [x for x in parts[:place] if wanted(x) or level < HEADING_LEVELS and isinstance(x, Node) and x.tag in HEADINGS]
        kept = before + kept + [x for x in parts[place + 1 :] if wanted(x)]
        level, node = level + 1, node.parent
    return kept


def _alike(x: Node, other: Node) -> bool:
    """Whether a block is built as the other and has text without links."""
    return x.tag == other.tag and x.kind == other.kind and x.tag not in PARAGRAPHS and x.size > 0 and not x.linked


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with a column `main_text`. A null or empty page gives the empty text. Rows are independent of each other, so
    repeated ones come out alike; a column that is called `main_text` is replaced."""
    names = [c for c in pages.columns if c != "main_text"]
    schema = pages.select(*names, F.lit("").alias("main_text")).schema

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x) for x in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*names, "main_text"])

    return pages.select(*names).mapInArrow(parse, schema)
