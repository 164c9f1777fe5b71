"""Main text of web pages by consensus on paths per host.

A page's containers are scored by the text of the paragraphs in them, less what is linked: a paragraph
counts for its container and half for the container around it.  From the best container one climbs to
those around it that hold headings, unlinked paragraphs or further parts of the article, as long as little
else comes with them, and that container's path votes for its host.  A path is generalised: the tags and class names from
the body down, without digits, ids and positions.  Spark counts the votes per host and path.  Then every page is read again, and the
container at the host's winning path gives the text; a page that does not have this path takes the
next one of its host, and one that has none of them its own best container.

Left out everywhere: scripts, styles, forms, menus, sidebars, footers, headers outside an article, and
elements whose class, id or role names adverts, notices, comments and the like.  A name of several parts
counts by its last part that is not of layout (cookie-notice, related-posts, but not related-work or
has-sidebar), not for headings, and not where it holds most of the page's unlinked text.  Blocks are what
block-level elements part; a line break is white space.

Defined results: a NULL or empty page has an empty text; a NULL url, or one without a host, belongs to
the host with the empty name; text outside any container counts for the body; repeated pages vote and
are read like others; an empty table gives no rows; very long pages are read whole; a column of the name
given for the text is replaced, columns added on the way take free names.  A host has the three paths
with most votes; a page of a fourth template falls back to its own best container, so none is lost.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import free_name, keep, small_batches

PATHS_PER_HOST = 3
# winning paths of at most so many hosts are sent to all executors; beyond, they are joined by host
BROADCAST_PATHS = 100_000

# fixed values: kinds of elements
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
        "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details",
          "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
          "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav",
          "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot",
          "th", "thead", "tr", "ul"}
CONTAINERS = {"article", "body", "div", "main", "section", "td"}
NO_TEXT = {"aside", "button", "canvas", "dialog", "footer", "form", "head", "nav", "object", "search",
           "select"} | RAW
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "navigation",
         "search", "menu", "menubar", "toolbar"}
# parts of class names and ids that mark what is not the article
ASIDE_NAMES = {"ad", "ads", "adsbygoogle", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb",
               "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "discussion",
               "disqus", "footer", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
               "notice", "notices", "pagination", "pager", "paywall", "popup", "promo", "promotion",
               "promoted", "related", "replies", "respond", "responses", "share", "sharing", "sidebar",
               "signup", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "widget",
               "widgets"}
# parts that say nothing about what is named, and parts that make a name one of a state
LAYOUT_NAMES = {"area", "articles", "bar", "block", "bottom", "box", "button", "buttons", "column",
                "container", "desktop", "fixed", "form", "group", "holder", "icon", "icons", "inner", "item",
                "items", "left", "link", "links", "list", "mobile", "outer", "overlay", "panel", "posts",
                "right", "row", "section", "slot", "small", "stories", "sticky", "text", "this", "title",
                "top", "unit", "wrap", "wrapper"}
STATE_NAMES = {"has", "have", "hide", "is", "no", "non", "not", "show", "with", "without"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# blocks that a further part of an article consists of
PART_BLOCKS = HEADINGS | {"p", "blockquote", "pre", "figcaption"}
# start tags that end an open element of these names, looked for up to the nearest of the others
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>"']+|"[^"]*"|'[^']*')*+)>""", re.S)
_ATTRIBUTE = re.compile(
    r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.S)
_NAME_PART = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Element:
    name: str
    path: str
    off: bool  # nothing below it is text
    container: int  # number of the container it is or stands in
    linked: bool
    article: bool
    hidden: bool = False  # off for another reason than a name of several parts


@dataclass
class Container:
    path: str
    parent: int
    score: float = 0.0


@dataclass
class Page:
    """Containers in page order, and blocks of text with the containers they stand in."""

    containers: list[Container] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)
    # of each block, the block element it is in and its unlinked characters
    kinds: list[tuple[str, float]] = field(default_factory=list)

    def best(self) -> int | None:
        """The container that scores highest, the first of equals, with what belongs to it around it."""
        if not any(c.score > 0 for c in self.containers):
            return None
        best = max(range(len(self.containers)), key=lambda i: (self.containers[i].score, -i))
        around = self.containers[best].parent
        while around >= 0:
            if self.containers[around].path.rsplit(">", 1)[-1].split(".")[0] == "article":
                best = around
            around = self.containers[around].parent
        if self.containers[best].path.rsplit(">", 1)[-1].split(".")[0] == "article":
            return best
        return self._climbed(best)

    def _climbed(self, best: int) -> int:
        """The container around the best one that also holds its headings, unlinked paragraphs and parts.

        Text of other containers that comes with it is at most half as long; the body is taken only for
        a heading ahead of the text.
        """
        chain = [best]
        while self.containers[chain[-1]].parent >= 0:
            chain.append(self.containers[chain[-1]].parent)
        place = {container: i for i, container in enumerate(chain)}
        meets: list[int] = []  # of each container, the place in the chain of the nearest one around it
        branch: list[int] = []  # and the container below that one which it is or stands in
        for i, container in enumerate(self.containers):
            meets.append(place[i] if i in place else meets[container.parent])
            branch.append(i if i in place or container.parent in place else branch[container.parent])
        own = sum(len(text) for owner, text in self.blocks if meets[owner] == 0)
        parts = self._parts(best, branch, own, chain[-1])
        gain, other, start = [0.0] * len(chain), [0.0] * len(chain), 0
        for at, (owner, _) in enumerate(self.blocks):
            if meets[owner] == 0:
                start = at
                break
        for at, ((owner, text), (kind, unlinked)) in enumerate(zip(self.blocks, self.kinds, strict=True)):
            level = meets[owner]
            wanted = kind in HEADINGS or (kind == "p" and chain[level] != 0)
            ahead = at < start or chain[level] != 0
            beside = owner == chain[level] and wanted and ahead and unlinked * 2 > len(text)
            if level == 0 or beside or branch[owner] in parts:
                gain[level] += len(text)
            else:
                other[level] += len(text)
        found, more = best, 0.0
        for container, new, beside in zip(chain[1:], gain[1:], other[1:], strict=True):
            more += beside
            if more * 2 > own:
                break
            if new:
                found = container
                own += new
        return found

    def _parts(self, best: int, branch: list[int], own: float, outermost: int) -> set[int]:
        """Containers beside the best one that hold a further part of its article.

        Such a part has paragraphs with hardly a link and is a quarter as long as the best container (half
        as long, if nothing but the body is around both).  Its text does not stand in three or more
        containers or lists of one path, as readers' comments and teasers do.
        """
        length: dict[int, float] = {}
        plain: dict[int, float] = {}
        paths: dict[int, Counter[str]] = {}
        for (owner, text), (kind, unlinked) in zip(self.blocks, self.kinds, strict=True):
            of = branch[owner]
            length[of] = length.get(of, 0) + len(text)
            if kind in PART_BLOCKS or kind in CONTAINERS:
                plain[of] = plain.get(of, 0) + unlinked
            paths.setdefault(of, Counter())
        for i, container in enumerate(self.containers):
            if branch[i] in paths:
                paths[branch[i]][container.path] += 1
        like = self.containers[best].path
        found = set()
        for of, characters in length.items():
            least = 2 if self.containers[of].parent == outermost else 4
            repeated = max((n for path, n in paths[of].items() if path != like), default=0)
            if (characters * least >= own and plain.get(of, 0) >= 0.8 * characters and repeated < 3):
                found.add(of)
        return found

    def text_of(self, chosen: set[int]) -> str:
        inside = []
        for i, container in enumerate(self.containers):
            inside.append(i in chosen or (container.parent >= 0 and inside[container.parent]))
        return "\n".join(text for at, text in self.blocks if inside[at])

    def extract(self, paths: list[str]) -> str:
        """The text at the first of the paths that has any, else of the best container."""
        for path in paths:
            found = {i for i, c in enumerate(self.containers) if c.path == path}
            text = self.text_of(found) if found else ""
            if text:
                return text
        best = self.best()
        return "" if best is None else self.text_of({best})


def _attributes(rest: str) -> dict[str, str]:
    if not rest or rest.isspace():
        return {}
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), next((v for v in values if v), ""))
    return out


def _is_aside(name: str, attributes: dict[str, str]) -> bool:
    if name in {"html", "body", "main"} or not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if attributes.get("role", "").lower() in ROLES or _HIDDEN.search(attributes.get("style", "")):
        return True
    return not ASIDE_NAMES.isdisjoint(_names(attributes))


def _names(attributes: dict[str, str]) -> list[str]:
    return f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()


def _is_named_aside(name: str, attributes: dict[str, str]) -> bool:
    """Whether a name of several parts marks an aside."""
    if name in {"html", "body", "main", "article"} | HEADINGS:
        return False
    for whole in _names(attributes):
        parts = [p for p in _NAME_PART.findall(whole) if len(p) > 1]
        if not STATE_NAMES.isdisjoint(parts):
            continue
        while parts and parts[-1] in LAYOUT_NAMES:
            parts.pop()
        if parts and parts[-1] in ASIDE_NAMES:
            return True
    return False


def _step(name: str, attributes: dict[str, str]) -> str:
    classes = sorted({"".join(c for c in part if not c.isdigit()) for part in
                      attributes.get("class", "").lower().split()} - {""})
    return ".".join([name, *classes])


def read(source: str | None) -> Page:
    """Read a page; once more if asides, by names of several parts, hold most of its unlinked text."""
    page, total, asides = _read(source, set())
    most = {at for at, n in asides.items() if n * 2 > total}
    return _read(source, most)[0] if most else page


def _read(source: str | None, spared: set[int]) -> tuple[Page, int, dict[int, int]]:
    """The page in one pass over its tags, its unlinked characters, and those of each aside by its place."""
    asides: dict[int, int] = {}
    opened: list[tuple[int, int, Element]] = []  # asides: depth on the stack, place and element
    total = 0
    kind = "body"
    page = Page([Container("body", -1)])
    source = source or ""
    stack = [Element("body", "body", False, 0, False, False)]
    parts: list[str] = []
    linked = [0, 0]  # characters of the block, and those in links
    owner = 0

    def close_block() -> None:
        nonlocal parts
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                page.blocks.append((owner, text))
                share = 1 - linked[1] / max(linked[0], 1)
                page.kinds.append((kind, len(text) * share))
                page.containers[owner].score += len(text) * share
                around = page.containers[owner].parent
                if around >= 0:
                    page.containers[around].score += len(text) * share / 2
        parts = []
        linked[0] = linked[1] = 0

    def close_asides(still: list[Element]) -> None:
        while opened and not (opened[-1][0] < len(still) and still[opened[-1][0]] is opened[-1][2]):
            _, place, _ = opened.pop()
            if opened:
                asides[opened[-1][1]] += asides[place]

    def add(text: str) -> None:
        nonlocal owner, kind, total
        top = stack[-1]
        if not text:
            return
        if not (top.hidden or top.linked or text.isspace()):
            total += len(text)
            if opened:
                close_asides(stack)
            if opened:
                asides[opened[-1][1]] += len(text)
        if top.off:
            return
        if not parts:
            if text.isspace():
                return
            owner = top.container
            kind = next((e.name for e in reversed(stack) if e.name in BLOCKS), "body")
        parts.append(text)
        linked[0] += len(text)
        linked[1] += len(text) * top.linked

    at, end = 0, len(source)
    while at < end:
        tag = _TAG.search(source, at)
        if not tag:
            add(source[at:])
            break
        add(source[at:tag.start()])
        at = tag.end()
        if tag["name"] is None:
            continue
        name = tag["name"].lower()
        if tag["end"]:
            if name in BLOCKS:
                close_block()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
                if name not in BLOCKS and stack[i].name in BLOCKS:
                    break  # an inline end tag does not reach out of its block
            continue
        if name in BLOCKS:
            close_block()
            _end_open(stack, name)
        elif name == "br":
            add(" ")
        if name in VOID or name in {"html", "body"}:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            at = close.end() if close else end
            continue
        if tag["rest"].endswith("/") and name not in BLOCKS:
            continue
        attributes = _attributes(tag["rest"])
        top = stack[-1]
        hidden = (top.hidden or name in NO_TEXT or _is_aside(name, attributes)
                  or (name == "header" and not top.article))
        named = not hidden and at not in spared and _is_named_aside(name, attributes)
        off = top.off or hidden or named
        container, path = top.container, top.path
        if name in BLOCKS:
            path = f"{path}>{_step(name, attributes)}"
        if name in CONTAINERS and not off:
            page.containers.append(Container(path, top.container))
            container = len(page.containers) - 1
        stack.append(Element(name, path, off, container, top.linked or name == "a",
                             top.article or name in {"article", "main"}, hidden))
        if named:
            close_asides(stack)
            asides[at] = 0
            opened.append((len(stack) - 1, at, stack[-1]))
    close_block()
    close_asides([])
    return page, total, asides


def _end_open(stack: list[Element], name: str) -> None:
    """End the open elements that a block's start tag ends without an end tag."""
    ended, limits = ENDS.get(name, (set(), set()))
    for i in range(len(stack) - 1, 0, -1):
        here = stack[i].name
        if here == "p" or here in ended:
            del stack[i:]
            if here == "p" and ended:
                continue
            return
        if here in limits or (not ended and here in BLOCKS):
            return


def host_of(url: str) -> Column:
    """The host of a url in lower case, without user and port; empty if there is none."""
    authority = F.regexp_extract(F.col(url), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\\]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    return F.lower(F.coalesce(host, F.lit("")))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): the paths with most votes of each host, best first."""
    @F.pandas_udf("struct<path: string, score: double>")
    def vote(sources: pd.Series) -> pd.DataFrame:
        votes = []
        for source in sources:
            page = read(source)
            best = page.best()
            chosen = page.containers[best] if best is not None else None
            votes.append((chosen.path, chosen.score) if chosen else (None, 0.0))
        return pd.DataFrame(votes, columns=["path", "score"])

    most = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("score"), "path")
    return (
        pages.select(host_of("url").alias("host"), vote("html").alias("vote"))
        .select("host", "vote.*").filter("path is not null")
        .groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
        # the last digits of a sum depend on its order
        .withColumn("score", F.round("score", 3))
        .withColumn("place", F.row_number().over(most)).filter(F.col("place") <= PATHS_PER_HOST)
        .groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "path"))).alias("ranked"))
        .select("host", F.col("ranked.path").alias("paths"))
    )


def add_main_text(pages: DataFrame, name: str = "text") -> DataFrame:
    """Add the main text of each page (columns url and html), replacing a column of that name."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def extracted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, paths in batches:
            yield pd.Series([read(s).extract([] if p is None else list(p))
                             for s, p in zip(sources, paths, strict=True)], dtype=object)

    paths = keep(winning_paths(pages), "winning-paths")
    if paths.count() <= BROADCAST_PATHS:
        paths = F.broadcast(paths)
    host, ranked = free_name(pages, "_host"), free_name(pages, "_paths")
    return (
        pages.withColumn(host, host_of("url"))
        .join(paths.select(F.col("host").alias(host), F.col("paths").alias(ranked)), host, "left")
        .withColumn(name, extracted(F.col("html"), F.col(ranked)))
        .drop(host, ranked)
    )


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    return add_main_text(pages.select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )
