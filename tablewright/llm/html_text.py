"""Main text of HTML pages by line-block distribution.

1. Markup is stripped: the page becomes *lines*, one per block element, with
   character references decoded and white space runs turned into one space.
   Lines inside menus, page headers, footers, sidebars, forms, adverts,
   notices and reader comments (by element or by class, id and role words)
   stay in place but weigh nothing, and a line's link text weighs nothing.
2. The text lengths of ``window`` consecutive lines are summed at every line.
3. A *surge point* is where the sum rises to ``surge`` code points or more, a
   *dive point* where the weight falls back to nothing; the lines between them
   are a text run.  Without any surge the heaviest run counts (short pages).
4. Surge and dive points are moved to the borders of the element that holds
   the runs, out so that short first and last lines stay and in so that
   neighbouring text outside goes: the page's marked article (``article`` or
   ``main``) with the most run weight, if marked articles hold ``ARTICLE_SHARE`` of all, with every sibling
   article that has a surge of its own; else the innermost container with ``CONTAINER_SHARE`` of it, with every
   element beside it, up to the smallest container of all runs, that has a surge of its own.
5. A page without a main heading in the text kept takes the last ``h1`` before it that stands beside it or beside an
   element around it, with the lines between them.

The operator works row by row on whole pages inside Arrow batches; nothing is
shuffled.

Defined cases: null or empty html gives an empty text; a page with no text
run gives an empty text; unclosed and wrongly nested elements are closed by
the end of their nearest open ancestor, or of the page, but an unclosed menu, page header, aside or form ends at the
first surge in it (an unclosed footer doesn't, it comes last); repeated rows give
repeated results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from html import unescape
from itertools import takewhile
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table

WINDOW = 3
SURGE = 80
#: Elements whose content is never text, whose end closes a block, or that hold no main text.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "canvas", "audio",
       "video", "head", "title"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt",
         "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html",
         "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr",
         "ul", "caption"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
SPACED = {"br", "td", "th", "option", "img", "wbr"}
ASIDE = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "label", "input"}
#: Words of a class, id or role that mark a container without main text.
ASIDE_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb",
               "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies",
               "discussion", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar",
               "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "popup", "promo",
               "promotion", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup",
               "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "alert", "recommended", "header",
               "responses", "overlay", "toc", "note"}
#: Of these, the ones that also tell an article element from the page's main one.
ARTICLE_ASIDE_WORDS = {"ad", "ads", "advert", "advertisement", "comment", "comments", "promo", "related", "reply", "sponsored", "teaser",
                       "teasers"}
#: Words that may stand beside these in a name; with any other word ("with-sidebar") it names something else.
PLAIN_WORDS = {"area", "article", "articles", "bar", "block", "bottom", "box", "button", "buttons", "container", "entry", "global", "group",
               "icons", "inner", "item", "left", "links", "list", "main", "mobile", "outer", "page", "panel", "post", "posts", "primary",
               "right", "secondary", "section", "site", "slot", "top", "unit", "wrap", "wrapper", "author", "content", "form", "reader",
               "readers", "thread", "user", "users", "visitor", "visitors"}
#: readers' comments named in one word.
_COMMENTS = re.compile(r"(?:user|reader|visitor)?comments?(?:area|block|body|box|form|item|list|section|text|thread|wrap|wrapper)?")
#: Elements that end at the first surge in them when their end tag is missing.
OPEN_ENDED = {"nav", "menu", "header", "aside", "form", "dialog"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that may hold a page's main text when it marks no article.
CONTAINERS = {"body", "div", "section", "td", "center", "table"}
#: Least share of the runs' weight with which a marked article is the main one (teasers are articles, too).
ARTICLE_SHARE = 0.25
#: Share of the runs' weight that the smallest container of the main text holds.
CONTAINER_SHARE = 0.8
#: An open p ends where another block begins.
CLOSES_P = BLOCK - {"body", "html"}

_TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.DOTALL)
_MARKS = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def is_aside(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element opens a container without main text."""
    if name in ASIDE or (name == "header" and not in_article):
        return True
    if not attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    if name in ("body", "html") or name in HEADINGS:
        return False
    listed = ARTICLE_ASIDE_WORDS if name in ("article", "main") else ASIDE_WORDS
    for found in _MARKS.finditer(attributes):
        for mark in (found[1] or found[2] or found[3] or "").split():
            words = {"comments" if _COMMENTS.fullmatch(w) else w for w in map(str.lower, _WORD.findall(mark))}
            hit = listed & words
            if hit and words <= listed | ASIDE_WORDS | PLAIN_WORDS and not (in_article and hit <= {"header"}):
                return True
    return False


class Line(NamedTuple):
    text: str
    weight: int
    article: int
    dull: bool
    containers: tuple[int, ...]
    heading: bool
    article_parent: int


def lines_of(html: str, window: int = WINDOW, surge: int = SURGE) -> list[Line]:
    """The page's lines.

    ``weight`` is the code points outside links, ``article`` the number of the
    outermost open article or main element (0: none), ``dull`` whether the line
    stands in a container without main text, ``containers`` the numbers of the
    open container elements from the outermost inwards (0: the page),
    ``heading`` whether it is an ``h1``, ``article_parent`` the innermost
    container around the article.  An element marked by
    its words that holds an article or main element and half the text outside
    links is no such container; the text of inline ones is left out.
    """
    lines: list[tuple[str, int, int, tuple[int, ...], tuple[int, ...], bool]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, int, int, int]] = []  # name, aside number or 0, outer article, container number or 0
    asides, article, articles, containers = 0, 0, 0, 0
    links = hushed = 0
    firm: set[int] = set()  # asides by element or hidden
    holders: set[int] = set()  # other asides that hold an article or main element
    unended: set[int] = set()  # asides without an end tag that end at the first surge in them
    parents: dict[int, int] = {0: 0}  # innermost container around each article

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                lines.append((text, max(len(text) - linked, 0), article, tuple(x[1] for x in stack if x[1]),
                              (0, *(x[3] for x in stack if x[3])), any(x[0] == "h1" for x in stack)))
        linked = 0

    def close(to: int, ended: bool = True) -> None:
        nonlocal article, links, hushed
        while len(stack) > to:
            name, was_aside, outer, _ = stack.pop()
            if name in OPEN_ENDED and not (ended and len(stack) == to):
                unended.add(was_aside)
            hushed -= was_aside > 0 and name not in BLOCK
            article = outer
            links -= name == "a"

    at = 0
    while at < len(html):
        m = _TOKENS.search(html, at)
        text = html[at:m.start()] if m else html[at:]
        if text and not hushed:
            text = unescape(text)
            parts.append(text)
            if links:
                linked += len(" ".join(text.split()))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        if name in RAW and not closing:
            if name == "head":
                end = re.compile(r"</head\s*>|<body[\s>]", re.IGNORECASE).search(html, at)
                at = end.start() if end and end[0].lower().startswith("<body") else end.end() if end else at
            elif not attributes.endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(html, at)
                at = end.end() if end else len(html)
            continue
        if name in SPACED:
            parts.append(" ")
        if name in BLOCK:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
        elif name not in VOID and not attributes.endswith("/"):
            if name in CLOSES_P:
                # an open p (with the inline elements left open in it) ends here
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] in BLOCK:
                        break
            if name in ("li", "tr", "dd", "dt", "option"):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        close(i)
                        break
                    if stack[i][0] in ("ul", "ol", "table", "dl", "menu", "select"):
                        break
            dull = is_aside(name, attributes, bool(article))
            if dull and name not in BLOCK and not re.compile(rf"</{name}\s*>", re.IGNORECASE).search(html, at):
                continue  # an inline element without an end tag silences nothing
            containers += name in CONTAINERS
            asides += dull
            if dull and (name in ASIDE or _HIDDEN.search(attributes)):
                firm.add(asides)
            if name in ("article", "main") and not dull:
                holders.update(x[1] for x in stack if x[1] and x[1] not in firm)
            stack.append((name, asides if dull else 0, article, containers if name in CONTAINERS else 0))
            hushed += dull and name not in BLOCK
            links += name == "a"
            if name in ("article", "main") and not article:
                articles += 1
                article = articles
                parents[article] = next((x[3] for x in reversed(stack[:-1]) if x[3]), 0)
    flush()
    close(0, ended=False)
    ends: dict[int, int] = {}  # line from which an unended aside is none
    for a in unended - {0}:
        own = [line[1] if a in line[3] else 0 for line in lines]
        ends[a] = next((start for start, _ in text_runs(own, window, surge)), len(lines))
    half = sum(line[1] for line in lines) / 2
    freed = {a for a in holders if sum(line[1] for line in lines if a in line[3]) >= half}
    dulled = [any(a not in freed and i < ends.get(a, len(lines)) for a in line[3]) for i, line in enumerate(lines)]
    return [Line(text, 0 if dull else weight, number, dull, held, heading, parents[number])
            for (text, weight, number, _, held, heading), dull in zip(lines, dulled, strict=True)]


def text_runs(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Runs ``[start, end)`` between surge and dive points of the line-block sums."""
    n = len(weights)
    sums = [0] * (n + 1)
    for i, w in enumerate(weights):
        sums[i + 1] = sums[i] + w
    blocks = [sums[min(n, i + window)] - sums[i] for i in range(n)]
    runs, at = [], 0
    while at < n:
        if not weights[at]:
            at += 1
            continue
        end = at
        while end < n and weights[end]:
            end += 1
        if max(blocks[at:end]) >= surge:
            runs.append((at, end))
        at = end
    return runs


def beside(lines: list[Line], path: tuple[int, ...], top: int) -> dict[tuple[int, int], list[int]]:
    """The undulled lines of container ``top`` outside the innermost container of ``path``, by the element that stands
    beside the path; lines that stand there without an element go by stretches."""
    out: dict[tuple[int, int], list[int]] = {}
    stretch, last = 0, None
    for i, line in enumerate(lines):
        held = line.containers
        shared = sum(1 for _ in takewhile(lambda pair: pair[0] == pair[1], zip(held, path)))  # noqa: B905
        place = (shared, held[shared] if len(held) > shared else None)
        stretch += place != last
        last = place
        if shared < len(path) and top in held and not line.dull:
            out.setdefault((shared, -stretch if place[1] is None else place[1]), []).append(i)
    return out


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    if not html:
        return ""
    lines = lines_of(html, window, surge)
    weights = [line.weight for line in lines]
    if not any(weights):
        return ""
    runs = text_runs(weights, window, surge)
    if not runs:
        surge = 1
        runs = text_runs(weights, window, surge)
    rising = lambda own: bool(text_runs([weights[i] for i in own], window, surge))
    in_runs = [i for r in runs for i in range(*r)]
    total = sum(weights[i] for i in in_runs)
    marked: dict[int, int] = {}
    held: dict[int, int] = {}
    for i in in_runs:
        if lines[i].article:
            marked[lines[i].article] = marked.get(lines[i].article, 0) + weights[i]
        for c in lines[i].containers:
            held[c] = held.get(c, 0) + weights[i]
    if sum(marked.values()) >= ARTICLE_SHARE * total and marked:
        chosen = max(marked, key=lambda a: (marked[a], -a))
        members: dict[int, list[int]] = {}
        for i, line in enumerate(lines):
            if line.article and not line.dull:
                members.setdefault(line.article, []).append(i)
        parent = lines[members[chosen][0]].article_parent
        kept = sorted(i for a, own in members.items() for i in own
                      if a == chosen or (lines[own[0]].article_parent == parent and rising(own)))
        path = tuple(takewhile(lambda c: c != parent, lines[kept[0]].containers)) + (parent,)
    else:
        # the last opened is the innermost
        inside = max(c for c, w in held.items() if w >= CONTAINER_SHARE * total)
        every = max(c for c, w in held.items() if w == total)
        whole = next(line.containers for line in lines if inside in line.containers)
        path = whole[:whole.index(inside) + 1]
        kept = [i for i, line in enumerate(lines) if inside in line.containers and not line.dull]
        kept = sorted(kept + [i for own in beside(lines, path, every).values() if rising(own) for i in own])
    if not any(lines[i].heading for i in kept):
        # an h1 beside the text or beside an element around it
        first = next((i for i in range(kept[0] - 1, -1, -1) if lines[i].heading and not lines[i].dull
                      and lines[i].containers == path[:len(lines[i].containers)]), None)
        if first is not None:
            kept = [i for i in range(first, kept[0]) if not lines[i].dull] + kept
    return "\n".join(lines[i].text for i in kept)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """Per row: ``page_id, url, text, n_chars``."""
    @F.pandas_udf("string")
    def text_of(pages_html):
        return pages_html.map(lambda h: main_text(h, window, surge) if h else "")

    out = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                       text_of(F.col(f"`{html_col}`")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op2_html_text(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(table(spark, sf, "pages"))


QUERIES = {"op2_html_text": op2_html_text}
ORACLE: dict[str, str] = {}
