"""Main text of web pages by consensus on host paths.

Each page is parsed forgivingly and its containers are scored. A container's path is the tags
from the body down, each with its first class name in generalised form (runs of digits become
``#``). The scores of a page's best containers are votes for their paths; votes add up per host
in Spark, and the path with most votes is extracted again from every page of the host. Pages without
such a container, or where it holds little of the page, fall back on their own best one.

A container's score counts the text in long blocks, minus short blocks (where the page has long ones) and twice the text in blocks that
are mostly links, plus half the page's text if it holds the page's h1 and twice that text if its
tag, role or class says that it is the content. What is marked as a menu, header, footer, sidebar,
notice, advert, form, comment section or the like, by tag, role, id or class, counts nothing and is
left out of the result.

Contract: a block ends at the borders of block elements; white space inside it becomes one space,
a ``br`` is white space, character references are decoded, empty blocks give nothing. Null html is empty,
and a page without text has an empty one. Null and odd urls share the host ''. Repeated rows give one
row each, an empty table gives no rows. Only id, url and html are read, so extra columns cannot
clash. Pages are parsed whole in linear time; elements nested deeper than 512 levels count as
children of the 512th, as in browsers.

Votes are combined before the shuffle. The winners (one row per host) are written first, so that they
are broadcast only when their stored size is under Spark's own limit; otherwise the join splits hot
hosts by size.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .arrow import map_arrow, slices

DEPTH = 512
LONG = 60
NAME_CHARS = 64

#: Elements that hold other content; each is a container.
CONTAINERS = frozenset("article aside blockquote center details dialog dir div dl fieldset figure footer "
                       "form header hgroup main menu nav ol search section table tbody td tfoot th thead "
                       "tr ul".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
BLOCKS = CONTAINERS | HEADINGS | frozenset(
    "address caption dd dt figcaption hr legend li optgroup option p pre summary body html".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("noscript template button select datalist svg canvas object audio video map".split())
NOISE_TAGS = UNSEEN | frozenset("nav footer aside form header dialog menu search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog "
                        "menu menubar toolbar".split())
#: Words of class names and ids that mark what is not the article.
NOISE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense adslot adsbygoogle banner promo promos promotion "
    "promoted sponsor sponsors sponsored nav navbar navigation menu menus submenu breadcrumb breadcrumbs "
    "footer foot header masthead sidebar sidebars aside widget widgets comment comments commentlist disqus "
    "respond replies reply cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations trending pagination "
    "pager paging toolbar topbar copyright search tagcloud paywall hidden".split())
#: A class name that starts so says something about the layout around it.
LAYOUT = frozenset(["has", "with", "no", "without", "hide", "show", "is"])
CONTENT_WORDS = frozenset("article articlebody post entry story content maincontent main".split())
TITLE_WORDS = frozenset(["article", "post", "entry", "story"])

TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)(>)?|(!--)|[!?/])")
ENDS = re.compile(r"=\s*([\"'])|>")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop|hidden)(?=[\s=/>]|$)"
                       r"(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")


def _words(name: str) -> list[str]:
    return [w.lower() for w in WORD.findall(name)]


def _is_noise(tag: str, found: dict[str, str], in_article: bool) -> bool:
    if tag in NOISE_TAGS and not (tag == "header" and in_article):
        return True
    if not found:
        return False
    if "hidden" in found or found.get("role", "").lower() in NOISE_ROLES:
        return True
    names = [_words(n) for n in (found.get("class", "") + " " + found.get("id", "")).split()]
    content = any(len(w) == 1 and w[0] in CONTENT_WORDS or set(w) <= CONTENT_WORDS and w for w in names)
    for words in names:
        if not words or words[0] in LAYOUT:
            continue
        marks = NOISE_WORDS.intersection(words)
        if marks <= {"header"} and TITLE_WORDS.intersection(words):
            continue
        if marks and (not content or marks & {"comment", "comments", "commentlist"}):
            return True
    return False


def _is_content(tag: str, found: dict[str, str]) -> bool:
    if tag in ("article", "main") or found.get("role", "").lower() in ("main", "article") \
            or found.get("itemprop", "").lower() == "articlebody":
        return True
    return any(CONTENT_WORDS.intersection(_words(n)) for n in
               (found.get("class", "") + " " + found.get("id", "")).split())


class Page:
    """Containers (parent, path step, marks) and text blocks of one page, in page order."""

    def __init__(self, text: str):
        self.parent, self.step, self.noise, self.content = [-1], [""], [False], [False]
        self.depth = [0]
        self.blocks: list[tuple[int, str, bool, bool]] = []  # container, text, mostly links, h1
        self._stack: list[tuple[str, int, bool]] = []  # tag, container, hides inline text
        self._parts: list[str] = []
        self._links = self._in_link = self._hidden = self._over = 0
        self._h1 = False
        self._parse(text)
        self._score()

    # Parsing

    def _parse(self, text: str) -> None:
        pos, n, unclosed = 0, len(text), set()
        while pos < n:
            m = TAG.search(text, pos)
            if not m:
                self._add(text[pos:])
                break
            if m.start() > pos:
                self._add(text[pos:m.start()])
            closing, tag, plain, comment = m.groups()
            if comment:
                end = text.find("-->", m.end() - 2)
                pos = n if end < 0 else end + 3
                continue
            if tag is None:
                end = text.find(">", m.end())
                pos = n if end < 0 else end + 1
                continue
            end = m.end() - 1 if plain else self._tag_end(text, m.end(), unclosed)
            if end < 0:  # a tag that the page's end cuts off
                break
            tag, attributes, pos = tag.lower(), text[m.end():end], end + 1
            if closing:
                self._close(tag)
            elif tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(text, pos)
                pos = stop.end() if stop else n
            else:
                self._open(tag, attributes)
        self._flush()

    @staticmethod
    def _tag_end(text: str, pos: int, unclosed: set[str]) -> int:
        """Place of the ``>`` that ends a tag; quoted values may hold others."""
        while m := ENDS.search(text, pos):
            quote = m.group(1)
            if not quote:
                return m.start()
            end = -1 if quote in unclosed else text.find(quote, m.end())
            if end < 0:  # no such quote follows anywhere: it quotes nothing
                unclosed.add(quote)
                pos = m.end()
            else:
                pos = end + 1
        return -1

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._parts.append(" ")
            return
        if tag == "a":
            self._in_link = 1
            return
        block = tag in BLOCKS
        if not block and tag not in UNSEEN and (tag != "span" or tag in VOID):
            return
        if block:
            self._flush()
            if tag in ("hr", "body", "html"):
                return
            self._implied(tag)
        found = {m.group(1).lower(): m.group(2) or m.group(3) or m.group(4) or ""
                 for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        at = self._stack[-1][1] if self._stack else 0
        if len(self._stack) >= DEPTH:
            self._over += tag in CONTAINERS
            return
        in_article = any(t in ("article", "main") for t, _, _ in self._stack) if tag == "header" else False
        noise = _is_noise(tag, found, in_article)
        if not block:
            self._stack.append((tag, at, noise))
            self._hidden += noise
            return
        if tag in CONTAINERS or noise:
            name = re.sub(r"\d+", "#", (found.get("class", "").split() or [""])[0])[:NAME_CHARS]
            self.parent.append(at)
            self.depth.append(self.depth[at] + 1)
            self.step.append(f"{tag}.{name}" if name else tag)
            self.noise.append(noise or self.noise[at])
            self.content.append(tag in CONTAINERS and _is_content(tag, found))
            at = len(self.parent) - 1
        self._stack.append((tag, at, False))
        self._h1 = tag == "h1"

    def _implied(self, tag: str) -> None:
        """Ends that a start tag implies: a paragraph before any block, items before the next."""
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
                "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
        while self._stack and (self._stack[-1][0] == "p" or self._stack[-1][0] in ends):
            self._pop()
        # An open span between a paragraph and its implied end goes with it.
        k = len(self._stack)
        while k and self._stack[k - 1][0] == "span":
            k -= 1
        if k and k < len(self._stack) and self._stack[k - 1][0] == "p":
            while len(self._stack) >= k:
                self._pop()

    def _close(self, tag: str) -> None:
        if tag == "a":
            self._in_link = 0
            return
        if tag in BLOCKS:
            self._flush()
            if self._over and tag in CONTAINERS:
                self._over -= 1
                return
        elif tag != "span" and tag not in UNSEEN:
            return
        barrier = () if tag in ("table", "tr", "td", "th", "tbody", "thead", "tfoot") else ("td", "th", "table")
        for k in range(len(self._stack) - 1, -1, -1):
            open_ = self._stack[k][0]
            if open_ == tag:
                while len(self._stack) > k:
                    self._pop()
                return
            if open_ in barrier or (tag == "span" and open_ != "span"):
                return

    def _pop(self) -> None:
        tag, _, hides = self._stack.pop()
        self._hidden -= hides
        if tag in BLOCKS:
            self._flush_as(tag)

    def _add(self, text: str) -> None:
        if self._hidden:
            return
        if "&" in text:
            text = html.unescape(text)
        self._parts.append(text)
        if self._in_link:
            self._links += len(text)

    def _flush(self) -> None:
        self._flush_as("")

    def _flush_as(self, tag: str) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                at = self._stack[-1][1] if self._stack else 0
                self.blocks.append((at, text, 2 * self._links > len(text), self._h1))
        self._parts, self._links, self._h1 = [], 0, False

    # Scores

    def _score(self) -> None:
        n = len(self.parent)
        value, text, h1 = [0] * n, [0] * n, [False] * n
        total = 0
        # Short blocks speak against a container, unless the page has nothing else.
        short = -2 if any(len(t) >= LONG and not links and not self.noise[c]
                          for c, t, links, _ in self.blocks) else 1
        for at, block, links, is_h1 in self.blocks:
            if self.noise[at]:
                continue
            size = len(block)
            if links:
                value[at] -= 8 * size
                continue
            total += size
            text[at] += size
            h1[at] |= is_h1
            value[at] += 4 * size if size >= LONG else 0 if is_h1 else short * size
        for c in range(n - 1, 0, -1):
            if not self.noise[c]:
                p = self.parent[c]
                value[p] += value[c]
                text[p] += text[c]
                h1[p] |= h1[c]
        self.score = {c: value[c] + (total // 2 if h1[c] else 0) + (2 * total if self.content[c] else 0)
                      for c in range(n) if text[c] and not self.noise[c]}

    def path(self, c: int) -> str:
        steps = []
        while c:
            steps.append(self.step[c])
            c = self.parent[c]
        return "/".join(reversed(steps))

    def best(self) -> int | None:
        """The container of highest score; the deepest of equals, then the first."""
        return max(self.score, key=lambda c: (self.score[c], self.depth[c], -c), default=None)

    def votes(self) -> dict[str, int]:
        """Thousandths of the best score for the paths of at least half of it."""
        top = self.best()
        if top is None:
            return {}
        best, found = self.score[top], {self.path(top): 1000}
        same = {self.parent[c] for c in self.score if c and self.score[c] >= self.score.get(self.parent[c], 0)}
        for c, s in self.score.items():
            if best > 0 and 2 * s >= best and c not in same:
                path = self.path(c)
                found[path] = max(found.get(path, 0), 1000 * s // best)
        return found

    def text(self, path: str | None = None) -> str:
        """Blocks of the containers at ``path``, or of the best one."""
        top = self.best()
        if top is None:
            return ""
        chosen = {top}
        if path is not None:
            steps = path.count("/") + 1 if path else 0
            at = [c for c in self.score if self.depth[c] == steps and self.path(c) == path]
            most = max((self.score[c] for c in at), default=0)
            if at and 4 * most >= self.score[top]:
                chosen = {c for c in at if 2 * self.score[c] >= most}
        inside = [False] * len(self.parent)
        for c in range(len(inside)):
            inside[c] = c in chosen or (c > 0 and inside[self.parent[c]])
        return "\n".join(t for at, t, _, _ in self.blocks if inside[at] and not self.noise[at])


def host_of(url: Column) -> Column:
    """Lower-cased host without user and port; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")),
                                    r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("_url"),
                        host_of(F.col(f"`{url_col}`")).alias("host"),
                        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("_text"))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, votes): the path with most votes per host; ties go to the deeper, then the
    later path by text. Hosts of pages without text are left out."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [(host, path, v) for host, text in zip(part["host"].to_pylist(), part["_text"].to_pylist())
                     for path, v in Page(text).votes().items()]
            hosts, paths, votes = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes, pa.int64())],
                ["host", "path", "votes"])

    rows = _pages(pages, url_col, url_col, html_col).select("host", "_text")
    sums = map_arrow(rows, work, "host string, path string, votes long").groupBy("host", "path").agg(
        F.sum("votes").alias("votes"))
    return sums.groupBy("host").agg(F.max(F.struct(
        "votes", F.size(F.split("path", "/")).alias("depth"), "path")).alias("best")).select(
        "host", "best.path", "best.votes")


def extract(pages: DataFrame, paths: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page, by its host's path.

    ``paths`` (host, path) may come from an earlier run; hosts without one use each page's best
    container.
    """
    rows = _pages(pages, id_col, url_col, html_col)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("_id", "_url")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [Page(t).text(p) for t, p in zip(part["_text"].to_pylist(), part["path"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part["_id"], part["_url"], pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["_id", "_url", "text", "n_chars"])

    if paths is None:
        paths = materialise(host_paths(pages, url_col, html_col).select("host", "path"))
    joined = rows.join(paths.select("host", "path"), "host", "left").select("_id", "_url", "_text", "path")
    return map_arrow(joined, work, f"_id {kinds[0]}, _url {kinds[1]}, text string, n_chars long").select(
        F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")
