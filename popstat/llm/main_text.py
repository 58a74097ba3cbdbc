"""Main text of web pages by tree scoring.

This project keeps no web pages, so the operator is general: any table of pages
with ``page_id``, ``url`` and ``html``.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Elements by their role in a page
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
    "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
DROPPED = {
    "annotation", "annotation-xml", "aside", "audio", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "iframe", "input", "map",
    "menu", "nav", "noembed", "noframes", "noscript", "object", "optgroup", "option", "output", "script", "select", "style",
    "svg", "template", "textarea", "title", "video", "xmp",
}
DROPPED_ROLES = {
    "alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation",
    "search", "status", "toolbar",
}
DROPPED_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "outbrain", "pager", "pagination", "popup", "promo", "promoted",
    "promotion", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "sidebars", "social", "sponsor", "sponsored",
    "subscribe", "subscription", "taboola", "toolbar", "widget",
}
#: Words that may stand before a dropped name ("site-footer"); names that begin with a dropped one are dropped, too.
BEFORE_NAMES = {
    "article", "blog", "bottom", "cookie", "email", "entry", "footer", "global", "google", "header", "left", "main", "mobile",
    "page", "post", "primary", "right", "secondary", "site", "top", "user",
}
#: Words that may follow a dropped name within an article ("ad-slot"); with any other it is a subject ("ad-hoc-tests").
AFTER_NAMES = {
    "area", "bar", "block", "body", "box", "button", "buttons", "container", "content", "form", "icons", "inner", "item",
    "items", "label", "link", "links", "list", "message", "meta", "panel", "post", "posts", "section", "signup", "slot",
    "text", "thread", "title", "unit", "wrap", "wrapper",
}
COMMENT_NAMES = {"comment", "comments", "disqus", "replies", "reply", "respond"}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"},
    "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
SCOPE = {"article", "body", "div", "dl", "html", "main", "ol", "section", "table", "td", "th", "ul"}
ENDS_PARAGRAPH = (BLOCK - {"br", "body", "html", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "option", "legend"})
SCORED = {"blockquote", "dd", "div", "li", "p", "pre", "section", "td", "article", "main"}
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
POINTS_PER_COMMA, LETTERS_PER_POINT, MOST_FOR_LENGTH, SIBLING_SHARE = 1.0, 100, 3.0, 0.2


@dataclass(slots=True, eq=False)
class Node:
    name: str
    parent: Node | None
    drop: bool = False
    named: bool = False
    children: list[Node | str] = field(default_factory=list)
    letters: int = 0
    linked: int = 0
    score: float = 0.0


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)}


def _has_name(words: str, wanted: set[str], after: set[str] | None = None) -> bool:
    """Whether a word is a wanted name, one after words that say where it stands, or one before others (those of ``after`` if given)."""
    for word in words.split():
        parts = [p.lower() for p in NAME_PART.findall(word)]
        if not parts:
            continue
        rest = parts[0] in wanted and (after is None or all(len(p) == 1 or p in after for p in parts[1:]))
        if rest or (parts[-1] in wanted and all(p in BEFORE_NAMES for p in parts[:-1])):
            return True
    return False


def _is_dropped(name: str, attributes: dict[str, str], inside_article: bool) -> tuple[bool, bool]:
    """Whether an element is dropped, and whether it may come back as it holds the page's article.

    Within an article an id is mostly the slug of a heading: only those of reader comments count.
    """
    if name in DROPPED or (name == "header" and not inside_article):
        return True, name == "form"
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""):
        return True, False
    if name in ("html", "body", "main"):
        return False, False
    names, own = attributes.get("class", ""), attributes.get("id", "")
    if name == "article":
        return _has_name(names, COMMENT_NAMES, {"body", "content", "item", "text"}), False
    if attributes.get("role", "").lower() in DROPPED_ROLES:
        return True, False
    if inside_article:
        drop = _has_name(names, DROPPED_NAMES, AFTER_NAMES) or own.lower() in COMMENT_NAMES
    else:
        drop = _has_name(f"{names} {own}", DROPPED_NAMES | {"header"})
    return drop, drop


def parse(page: str) -> Node:
    """The element tree; unclosed and misplaced tags are taken as browsers do in the common cases."""
    root = Node("html", None)
    open_, at, articles = [root], 0, 0
    while at < len(page):
        found = TOKEN.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            open_[-1].children.append(html.unescape(text) if "&" in text else text)
        if not found:
            break
        at = found.end()
        name = found["name"] or found["name2"]
        if not name:
            continue
        if not found[0].endswith(">"):
            break  # the page ends inside a tag
        name, close, rest = name.lower(), found["close"] or found["close2"], found["rest"] or found["rest2"] or ""
        if close:
            if name == "br":
                open_[-1].children.append(Node("br", open_[-1]))
            elif any(n.name == name for n in open_[1:]):
                while True:
                    gone = open_.pop()
                    articles -= gone.name in ("article", "main")
                    if gone.name == name:
                        break
            continue
        if name in ENDS_PARAGRAPH:
            _leave(open_, {"p"})
        if name in CLOSES:
            _leave(open_, CLOSES[name])
        attributes = _attributes(rest) if rest else {}
        node = Node(name, open_[-1], *_is_dropped(name, attributes, articles > 0))
        open_[-1].children.append(node)
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            body = page[at : end.start()] if end else page[at:]
            node.children.append(body)
            at = page.find(">", end.end()) + 1 or len(page) if end else len(page)
        elif name not in EMPTY:  # a closing slash does not close an element that can hold others
            open_.append(node)
            articles += name in ("article", "main")
    return root


def _leave(open_: list[Node], names: set[str]) -> None:
    """Close the nearest element of these names unless a container stands before it."""
    for i in range(len(open_) - 1, 0, -1):
        if open_[i].name in names:
            del open_[i:]
            return
        if open_[i].name in SCOPE:
            return


def _measure(root: Node) -> list[Node]:
    """Letters and linked letters of every kept element, deepest first; no recursion, as pages may be deep."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        order.append(node)
        linked = linked or node.name == "a"
        for child in node.children:
            if isinstance(child, str):
                n = len(" ".join(child.split()))
                node.letters += n
                node.linked += n if linked else 0
            elif not child.drop:
                stack.append((child, linked))
    order.reverse()
    for node in order:
        if node.parent is not None:
            node.parent.letters += node.letters
            node.parent.linked += node.linked
    return order


def _own_text(node: Node) -> str:
    """Text of an element without that of blocks inside it."""
    out, stack = [], list(reversed(node.children))
    while stack:
        child = stack.pop()
        if isinstance(child, str):
            out.append(child)
        elif not child.drop and (child.name == "br" or child.name not in BLOCK):
            stack += reversed(child.children)
    return " ".join("".join(out).split())


def _points(node: Node) -> float:
    """Points of an element's own text, without the discount for links."""
    if node.name not in SCORED or not (text := _own_text(node)):
        return 0.0
    commas = text.count(",") + text.count("，") + text.count("、")
    return 1 + POINTS_PER_COMMA * commas + min(len(text) / LETTERS_PER_POINT, MOST_FOR_LENGTH)


def _restore(root: Node) -> None:
    """Keep forms and elements dropped for their class or id that hold the page's article.

    That is one with the most paragraph points of those that hold an article or main element, if no
    such element is kept otherwise, or one with more than half of the page's points, if it has none.
    """
    while True:
        outer: list[Node] = []
        stack = [root]
        while stack:
            node = stack.pop()
            if node.name in ("article", "main"):
                return
            for child in node.children:
                if not isinstance(child, str):
                    if not child.drop:
                        stack.append(child)
                    elif child.named:
                        outer.append(child)
        if not outer:
            return
        totals, holds = [], []
        for top in [root, *outer]:
            total, article, stack = 0.0, False, [(top, False)]
            while stack:
                node, below = stack.pop()
                article = article or node.name in ("article", "main")
                total += 0.0 if below else _points(node)
                stack += [(c, below or c.drop) for c in node.children if not isinstance(c, str) and (c.named or not c.drop)]
            totals.append(total)
            holds.append(article)
        some = any(holds)
        points, k = max((totals[k], -k) for k in range(1, len(totals)) if holds[k] or not some)
        if not some and 2 * points <= sum(totals):
            return
        outer[-k - 1].drop = False


def _best(root: Node) -> Node | None:
    """The container with the most points from its paragraphs, discounted by its share of linked text."""
    order = _measure(root)
    for node in order:
        if points := _points(node):
            points *= 1 - node.linked / max(node.letters, 1)
            level, above = 0, node.parent if node.name not in ("article", "main") else node
            while above is not None:
                above.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                level, above = level + 1, above.parent
    best, most = None, 0.0
    for node in order:
        node.score *= 1 - node.linked / max(node.letters, 1)
        if node.score > most:
            best, most = node, node.score
    return best


def _inner_text(nodes: list[Node]) -> str:
    out, stack = [], list(reversed(nodes))
    while stack:
        child = stack.pop()
        if isinstance(child, str):
            out.append(child)
        elif not child.drop:
            edge = [" "] if child.name in BLOCK else []
            stack += [*edge, *reversed(child.children), *edge]
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    """The article of a page: the best container and its siblings, without what is not article text.

    Paragraphs give points for length and commas to their ancestors, fewer to farther ones,
    and links take points away. A container within an article or main element stands for the
    whole of it, and only siblings with points of their own stay with it; otherwise all siblings
    that are not mostly links do. A page's only h1 before an article that has none belongs to it. Without any paragraph the page's whole kept text is the answer.
    """
    if not page:
        return ""
    root = parse(page)
    _restore(root)
    best = _best(root)
    if best is None:
        return _inner_text([root])
    above, lifted = best, best
    while above is not None:
        lifted = above if above.name in ("article", "main") else lifted
        above = above.parent
    if lifted.parent is None:
        return _inner_text([lifted])
    whole = lifted.name in ("article", "main")
    kept = []
    for sibling in lifted.parent.children:
        if sibling is lifted:
            kept.append(sibling)
        elif isinstance(sibling, str):
            kept += [] if whole else [sibling]
        elif not sibling.drop:
            links = sibling.linked / max(sibling.letters, 1)
            paragraph = sibling.name == "p" and links < 0.25 and sibling.letters > 80
            enough = not whole or sibling.score >= SIBLING_SHARE * lifted.score
            if enough and links < 0.5 or paragraph:
                kept.append(sibling)
    return _inner_text([*_title_before(kept[0] if not isinstance(kept[0], str) else lifted, kept), *kept])


def _title_before(first: Node, kept: list[Node | str]) -> list[Node]:
    """The page's only h1 that is kept, if it stands before the article in a wrapper of its own and the article has none."""
    titles, node = [], first
    while node.parent is not None:
        for sibling in node.parent.children:
            if sibling is node:
                break
            stack = [] if isinstance(sibling, str) or any(sibling is k for k in kept) else [sibling]
            while stack:
                inner = stack.pop()
                if inner.name == "h1" and not inner.drop and 2 * inner.linked < max(inner.letters, 1):
                    titles.append(inner)
                elif not inner.drop:
                    stack += [c for c in inner.children if not isinstance(c, str)]
        node = node.parent
    stack = [k for k in kept if not isinstance(k, str)]
    while stack:
        inner = stack.pop()
        if inner.name == "h1":
            return []
        stack += [c for c in inner.children if not isinstance(c, str)]
    return titles if len(titles) == 1 else []


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every page.

    Character references are decoded, white space within a block becomes one space, blocks
    are trimmed and joined in page order by one space; nothing is cut short. A NULL or empty
    page and one without article text give an empty text. Rows may repeat and ids and urls
    may be NULL; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column("_html")]
            columns = [batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_url", "text", "n_chars"])

    named = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_url"), F.col(page).cast("string").alias("_html"))
    kinds = [named.schema[c].dataType.simpleString() for c in ("_id", "_url")]
    return named.mapInArrow(run, f"_id {kinds[0]}, _url {kinds[1]}, text string, n_chars long").toDF(page_id, url, "text", "n_chars")
