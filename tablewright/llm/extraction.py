"""Main text of web pages by composite text density.

1. A page is read into a tree of elements, by a tolerant reading of its tags (implied and missing end tags, unclosed
   elements, cut-off pages). Scripts, styles, comments and the like are left out.
2. Elements that are never part of an article are left out with all they hold: menus, headers, footers, sidebars, dialogs,
   controls, by element, ``role`` or being hidden. A header within the article is its title and stays.
   Forms, and elements with a telling ``class`` or ``id`` (notices, adverts, sidebars, reader comments), are left out as well, but
   a name is a hint, not a verdict: only the head of a compound counts (``site-header``, not ``header-image``; never behind ``no`` or
   ``with``), and an element that holds the page's text, by far more of it than all that is left without it, stays.
3. Every element gets its composite density: characters per tag, adjusted by how much of it is links,
   ``C/T * log(C/LC * T/LT) / log(ln(C * LC / (C - LC) + C * LCb / Cb + e))`` (with counts of at least one). The element
   with the largest sum of its children's densities is the heart of the text.
4. The text is the heart's section: the enclosing article or main element, else the nearest container. The least density
   on the path from there up to the body is the threshold; neighbours along the path, and blocks within them, that reach it
   belong to the text as well, whatever their element. A heading goes with the block that follows it.

Character references are decoded, white space in a block becomes one space, blocks are joined in page order by one line
break. NULL or empty pages give an empty text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.session import ship_package

#: Fixed values of HTML, plainly listed.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("html body caption td th tr tbody thead tfoot option optgroup legend".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
             "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "tbody", "thead"}}
FENCES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "tbody": {"table"}, "option": {"select"}}
NOISE_TAGS = frozenset("nav header footer aside button select menu dialog label input".split())
FORMS = frozenset(["form", "fieldset"])
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notification popup modal overlay newsletter subscribe subscription signup login sidebar side rail comment comments "
    "disqus replies reply discussion menu nav navbar navigation breadcrumb breadcrumbs topbar footer header masthead related "
    "recommended share sharing social pagination pager toolbar widget hidden skip banner alert adsbygoogle adbox sitenav".split())
#: Words behind which the head of a name is looked for, and words that turn a name into its opposite.
TAILS = frozenset(
    "area list box container wrapper wrap inner outer block section left right top bottom links link buttons button bar items item "
    "panel group row col column holder unit slot form thread region zone module posts icons".split())
OPPOSITES = frozenset("no not non without with has have hide is by".split())
READERS = frozenset("comment comments disqus replies reply discussion".split())
HARD, SOFT, READER = 1, 2, 3         # left out; left out unless it holds the text; the same for reader comments
OUTWEIGHS = {SOFT: 2, READER: 10}    # how often the text left without an element its own must be, for it to stay
LEAD = 20                            # characters of a paragraph ahead of the text that belongs to it
NOISE_STARTS = ("advert", "sponsor", "cookie", "comment", "newsletter", "breadcrumb", "sidebar")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main".split())
SECTIONS = frozenset("article main section div body table td blockquote center".split())
TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


def noise_name(name: str, in_article: bool) -> int:
    """What a single class or id says: nothing, SOFT or READER."""
    words = [w.lower() for w in WORD.findall(name)]
    if OPPOSITES & set(words):
        return 0
    while len(words) > 1 and words[-1] in TAILS:
        words.pop()
    if not words or (words[-1] == "header" and in_article):
        return 0
    if words[-1] in READERS or words[-1].startswith("comment"):
        return READER
    return SOFT if words[-1] in NOISE or words[-1].startswith(NOISE_STARTS) else 0


def noise_kind(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element, with all it holds, is left out: 0, HARD, SOFT or READER."""
    if tag in NOISE_TAGS and not (tag == "header" and in_article):
        return HARD
    found = SOFT if tag in FORMS else 0
    if not attributes or tag in ("html", "body", "article", "main"):
        return found
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            found = max([found, *(noise_name(part, in_article) for part in value.split())])
        elif name == "role" and value.strip().lower() in NOISE_ROLES:
            return SOFT if value.strip().lower() == "form" else HARD
        elif name == "aria-hidden" and value.strip().lower() == "true":
            return HARD
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return HARD
    return HARD if re.search(r"(?:^|\s)hidden(?=\s|/|$)", attributes) else found


class Page:
    """The elements of a page in order; parents come before their children. Text lies in the stream of ``events``."""

    def __init__(self, source: str):
        self.tags, self.parents, self.kinds = ["body"], [-1], [0]
        self.events: list[tuple[int, str | None]] = []     # (element, text), None where a block begins or ends
        self.stack = [0]
        self.in_article, self.open_tags = [False], Counter()
        self.read(source)
        self.noise = self.weighed()

    def add(self, tag: str, kind: int) -> None:
        above = self.stack[-1]
        self.tags.append(tag)
        self.parents.append(above)
        self.kinds.append(kind)
        self.in_article.append(self.in_article[above] or tag in CONTAINERS)

    def open(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P:
            self.close("p", BLOCKS - {"p"})
        for other in CLOSED_BY.get(tag, ()):
            self.close(other, FENCES[tag])
        above = self.stack[-1]
        self.add(tag, noise_kind(tag, attributes, self.in_article[above]))
        if tag in BLOCKS:
            self.events.append((above, None))
        if tag not in VOID:
            self.stack.append(len(self.tags) - 1)
            self.open_tags[tag] += 1

    def close(self, tag: str, fences=frozenset()) -> None:
        """Close the innermost open ``tag`` and what it holds, unless a fence is open within."""
        if not self.open_tags[tag]:
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            name = self.tags[self.stack[depth]]
            if name == tag:
                if tag in BLOCKS or any(self.tags[n] in BLOCKS for n in self.stack[depth:]):
                    self.events.append((self.stack[-1], None))
                self.open_tags.subtract(self.tags[n] for n in self.stack[depth:])
                del self.stack[depth:]
                return
            if name in fences:
                return

    def read(self, source: str) -> None:
        at = 0
        while True:
            match = TOKEN.search(source, at)
            text = source[at:match.start() if match else len(source)]
            if text:
                self.events.append((self.stack[-1], text))
            if match is None:
                return
            at = match.end()
            tag = (match[2] or "").lower()
            if not tag or tag in ("html", "head", "body"):
                continue
            if match[1]:
                self.close(tag, frozenset() if tag in BLOCKS else frozenset({"td", "th", "article", "main"}))
            elif tag in RAW:
                if not match[3].rstrip().endswith("/"):
                    end = RAW_END[tag].search(source, at)
                    after = source.find(">", end.end()) if end else -1
                    at = after + 1 if after >= 0 else len(source)
                self.events.append((self.stack[-1], " "))
            elif tag == "br":
                self.events.append((self.stack[-1], " "))
                self.add(tag, 0)
            else:
                self.open(tag, match[3])

    def weighed(self) -> list[bool]:
        """For every element, whether it is left out. Hints are weighed by the text outside links, the largest element first."""
        count = len(self.tags)
        own, hard, link, candidate, container = [0] * count, [False] * count, [False] * count, [0] * count, [0] * count
        for n in range(1, count):
            above = self.parents[n]
            hard[n] = hard[above] or self.kinds[n] == HARD
            link[n] = link[above] or self.tags[n] == "a"
            candidate[n] = n if self.kinds[n] in OUTWEIGHS else candidate[above]         # the innermost hint around it
            container[n] = container[above] or (n if self.tags[n] in CONTAINERS else 0)
        for element, text in self.events:
            if text is not None and not hard[element] and not link[element]:
                own[element] += len("".join(text.split()))
        plain, whole, named = [0] * count, own[:], [0] * count          # text with no hint within; all; in articles
        for n in range(count):
            plain[candidate[n]] += own[n]
            if container[n]:
                named[candidate[n]] += own[n]
        for n in range(count - 1, 0, -1):
            whole[self.parents[n]] += whole[n]
        clean, in_articles, left_out = plain[0], named[0], hard[:]
        hints = [n for n in range(1, count) if self.kinds[n] in OUTWEIGHS and not hard[n]]
        for n in sorted(hints, key=lambda n: (-whole[n], n)):
            inner = container[n]
            stays = whole[n] > OUTWEIGHS[self.kinds[n]] * clean and (inner or not in_articles)
            if stays:
                clean += plain[n]
                in_articles += named[n]
            left_out[n] = not stays
        for n in range(1, count):
            left_out[n] = left_out[n] or left_out[self.parents[n]]
        return left_out

    def densities(self) -> tuple[list[float], list[float]]:
        """The composite density of every element, and the sum of its children's."""
        count = len(self.tags)
        chars, tags, link_chars, link_tags = [0] * count, [0] * count, [0] * count, [0] * count
        for element, text in self.events:
            if text is not None and not self.noise[element]:
                chars[element] += len("".join(text.split()))
        for n in range(count - 1, 0, -1):
            if self.noise[n]:
                continue
            if self.tags[n] == "a":
                link_chars[n], link_tags[n] = chars[n], tags[n] + 1
            above = self.parents[n]
            chars[above] += chars[n]
            tags[above] += tags[n] + 1
            link_chars[above] += link_chars[n]
            link_tags[above] += link_tags[n]
        self.size, self.linked = chars, link_chars
        of_links = link_chars[0] / max(chars[0], 1)
        density, sums = [0.0] * count, [0.0] * count
        for n in range(count - 1, -1, -1):
            c, t, lc, lt = chars[n], max(tags[n], 1), max(link_chars[n], 1), max(link_tags[n], 1)
            if not c or self.noise[n]:
                continue
            base = math.log(c * lc / max(c - link_chars[n], 1) + of_links * c + math.e)
            density[n] = c / t * max(math.log(c / lc * t / lt), 0.0) / max(math.log(base), 1e-9) if base > 1 else c / t
            if n:
                sums[self.parents[n]] += density[n]
        return density, sums

    def section(self, element: int) -> int:
        """The article or main element around an element, else its nearest container."""
        found = element
        while found and self.tags[found] not in CONTAINERS:
            found = self.parents[found]
        if found:
            return found
        while element and self.tags[element] not in SECTIONS:
            element = self.parents[element]
        return element

    def chosen(self) -> list[bool]:
        """For every element, whether its text belongs to the main text."""
        density, sums = self.densities()
        inside = [False] * len(self.tags)
        heart = max(range(len(sums)), key=lambda n: (sums[n], -n))
        top = self.section(heart)
        inside[top] = True
        path = [top]
        while path[-1]:
            path.append(self.parents[path[-1]])
        threshold = min(density[n] for n in path)
        on_path = set(path)
        for n in range(1, len(self.tags)):
            if n not in on_path and density[n] >= threshold > 0 and (self.parents[n] in on_path or self.tags[n] in BLOCKS):
                inside[n] = True
        of_links = self.link_share()
        for n in range(1, len(self.tags)):
            if self.tags[n] == "article" and of_links[n] < 0.5:                      # further articles, however short
                inside[n] = True
            if self.tags[n] == "p" and self.parents[n] in on_path and n < top and of_links[n] < 0.5 and self.size[n] >= LEAD:
                inside[n] = True                                                      # short paragraphs that lead to the text
        for n in range(1, len(self.tags)):
            inside[n] = (inside[n] or inside[self.parents[n]]) and not self.noise[n]
        return self.with_headings(inside)

    def link_share(self) -> list[float]:
        """The share of each element's characters that is links; 1 where there is no text."""
        return [1.0 if not c else links / c for c, links in zip(self.size, self.linked)]

    def with_headings(self, inside: list[bool]) -> list[bool]:
        """``inside`` with the headings whose next text in page order, other headings aside, is inside."""
        heading, followed, near = [0] * len(self.tags), set(), False
        for n in range(1, len(self.tags)):
            heading[n] = heading[self.parents[n]] or (n if self.tags[n] in HEADINGS else 0)
        for element, text in reversed(self.events):
            if text is None or self.noise[element] or not text.strip():
                continue
            if inside[element] or not heading[element]:
                near = inside[element]
            elif near:
                followed.add(heading[element])
        return [kept or heading[n] in followed and not self.noise[n] for n, kept in enumerate(inside)]

    def text(self) -> str:
        inside, blocks, parts = self.chosen(), [], []
        for element, text in [*self.events, (0, None)]:
            if text is None:
                block = " ".join(html.unescape("".join(parts)).split())
                if block:
                    blocks.append(block)
                parts = []
            elif inside[element]:
                parts.append(text)
        return "\n".join(blocks)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of ``pages``."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [main_text(source) for source in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
