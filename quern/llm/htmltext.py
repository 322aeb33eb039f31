"""Main text of web pages from parser events and smoothed text-to-tag ratios.

Method
  The standard library's HTML parser streams tags and text. Text between
  block-level tags is one line, with the number of tags inside it. A line's
  text-to-tag ratio is smoothed over its neighbours with a Gaussian kernel,
  and lines above the threshold (the standard deviation of the smoothed
  ratios) form clusters, without lines of next to no text for their tags. The clusters select the content region: all
  articles and main elements if there is a cluster in one, else the
  deepest element that holds all clusters and isn't itself a part of a text, such as a paragraph, section or
  quotation. All lines of the region are kept, short ones too.

  Lines inside menus, headers, footers, sidebars, notices, adverts, forms,
  scripts, styles and reader comments, known by element or role, never count. Those known by class or id
  are weak evidence, which the clusters overrule: in a page without an article or main, no name drops an element that holds more
  than two thirds of the text of all clusters (but reader comments, if there is other text).
  A class or id is such a name if it consists of junk words and words of place
  ("main-nav", not "has-sidebar"). No name drops an article, a main or an element that
  holds one, but reader comments, if an article with text stands outside them.

Character references are decoded; white space inside a line becomes one space
(a <br> too); lines are trimmed and joined by one newline; nothing else is
dropped or cut. Work and memory grow with a page's length, however deep its elements.

Defined results: a null or empty page, or one without text, has an empty text.
Of equal ratios all count alike; of elements that hold the same clusters the deepest is taken. Very long pages are read whole.
Repeated rows give repeated results; an empty table gives no rows; columns besides page_id, url and html are
ignored, whatever their names; null ids and urls stay null. Unclosed elements end with their parent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.store import read_table, trimmed

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("body head html li dd dt tr td th tbody thead tfoot caption legend summary".split())
#: An element of the first kind ends when one of the second kind begins beside it.
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
_JUNK = frozenset("aside audio button canvas dialog footer form head header iframe input math menu nav noscript object script select style svg template textarea title video".split())
_JUNK_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_COMMENT_WORD = r"comments?|commentlist|disqus|repl(?:y|ies)|discussion"
_JUNK_WORD = (
    r"ads?|adverts?|advertis\w*|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlays?|newsletters?|subscri\w*|"
    r"signup|login|menus?|nav|navbar|navigation|breadcrumbs?|sidebars?|aside|footers?|headers?|masthead|related|recommend\w*|share|sharing|social|widgets?|"
    rf"forms?|search|{_COMMENT_WORD}"
)
#: Words that may stand beside a junk word: where or what kind of thing it is.
_PLACE_WORD = r"site|page|main|top|bottom|left|right|primary|secondary|global|sticky|mobile|user|box|bar|area|list|items?|links?|buttons?|icons?|block|section|container|wrap(?:per)?|inner|outer|col|column|unit|slot|\d+"
_JUNK_NAME, _COMMENT_NAME = (re.compile(rf"(?=(?:.*-)?(?:{w})(?:-|$))(?:(?:{_JUNK_WORD}|{_PLACE_WORD})(?:-|$))+") for w in (_JUNK_WORD, _COMMENT_WORD))
_JOINED = {"sign-up": "signup", "log-in": "login", "side-bar": "sidebar"}
_CONTENT = frozenset(("article", "main"))
#: What begins a tag or comment; one that the page's end cuts off is no text.
_BEGUN = re.compile(r"<[a-zA-Z/!?]")
SIGMA, REACH = 1.0, 3
#: Of the mean ratio of the clusters, below which a line doesn't belong to one; and of their text, above which names don't count.
LEAST, MOST = 0.1, 2 / 3
#: Parts of a text, which never are the region.
_PARTS = frozenset(
    "a abbr b bdi bdo big blockquote caption cite code dd del details dfn dl dt em figcaption figure font h1 h2 h3 h4 h5 h6 hgroup i ins kbd label li mark ol p pre q s samp "
    "section small span strong sub summary sup table tbody td tfoot th thead time tr tt u ul var".split()
)
_KERNEL = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
_KERNEL /= _KERNEL.sum()


class _Lines(HTMLParser):
    """Collects lines: text, tags in it, and the open elements above it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []  # name and number of each open element
        self.parent: dict[int, int] = {0: 0}
        self.name: dict[int, str] = {0: ""}
        self.depths: dict[str, list[int]] = {}  # the depths of the open elements of each name
        self.blocks: list[int] = []  # depths at which block-level elements stand
        self.junk: list[int] = []  # depths at which junk elements stand
        self.named: dict[int, bool] = {}  # elements of a junk name, and whether it is one of reader comments
        self.runs: list[tuple[list[tuple[str, int]], int, int]] = []  # parts, tags, number of the element around them
        self.parts: list[tuple[str, int]] = []  # text and the element that holds it
        self.tags = 0

    def inner(self) -> int:
        return self.open[-1][1] if self.open else 0

    def end_line(self) -> None:
        if self.parts:
            self.runs.append((self.parts, self.tags, self.inner()))
            self.parts = []
        self.tags = 0

    def lines(self) -> list[tuple[str, int, int]]:
        """Text, tags and number of the element around it of each line outside junk names."""
        holds: set[int] = set()  # articles, mains and all elements around them
        for number, name in self.name.items():
            while name in _CONTENT and number not in holds:
                holds.add(number)
                number = self.parent[number]
        if not holds and self.named:
            return self.outside(self.overruled(set(self.named)))
        out = self.outside({n for n in self.named if n not in holds})
        comments = {n for n, comment in self.named.items() if comment}
        if comments & holds:
            # comments can be articles too: they go if an article with a line stands outside them
            rest = self.outside({n for n in self.named if n not in holds} | comments)
            article: dict[int, bool] = {}
            for number in self.parent:
                article[number] = self.name[number] == "article" or bool(number) and article[self.parent[number]]
            if any(article[number] for _, _, number in rest):
                return rest
        return out

    def overruled(self, named: set[int]) -> set[int]:
        """The elements that go by their names: those with at most two thirds of the text of all clusters, and comments beside other text."""
        lines = self.outside(set())
        if not lines:
            return named
        weight = dict.fromkeys(self.parent, 0)
        for i in clustered(lines).tolist():
            weight[lines[i][2]] += len(lines[i][0])
        for number in sorted(self.parent, reverse=True)[:-1]:  # children come first
            weight[self.parent[number]] += weight[number]
        gone = {n for n in named if self.named[n] or weight[n] <= MOST * weight[0]}
        return gone if self.outside(gone) else {n for n in gone if not self.named[n]}

    def spread(self, marked: dict[int, bool]) -> dict[int, bool]:
        """Whether an element or one around it is marked."""
        out = {0: marked[0]}
        for number, above in self.parent.items():  # parents come first
            out[number] = marked[number] or out[above]
        return out

    def outside(self, dropped: set[int]) -> list[tuple[str, int, int]]:
        gone = self.spread({n: n in dropped for n in self.parent})
        lines = ((" ".join("".join(text for text, n in parts if not gone[n]).split()), tags, number) for parts, tags, number in self.runs)
        return [line for line in lines if line[0]]

    def cut(self, depth: int) -> None:
        """Close all elements from this depth on."""
        for tag, _ in self.open[depth:]:
            self.depths[tag].pop()
        del self.open[depth:]
        for stack in (self.junk, self.blocks):
            while stack and stack[-1] >= depth:
                stack.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCK:
            self.end_line()
            if self.blocks:
                above = self.open[self.blocks[-1]][0]
                if above == "p" and tag in _CLOSES_P or tag in _ENDED_BY.get(above, ()):
                    self.cut(self.blocks[-1])
        else:
            self.tags += 1
        if tag == "br" and not self.junk:
            self.parts.append((" ", self.inner()))
        if tag in _VOID:
            return
        number = len(self.parent)
        self.parent[number], self.name[number] = self.inner(), "" if self.junk else tag
        depth = len(self.open)
        self.depths.setdefault(tag, []).append(depth)
        if tag in _BLOCK:
            self.blocks.append(depth)
        self.open.append((tag, number))
        if tag in _JUNK or attrs and tag not in ("html", "body") and self.is_junk(attrs):
            self.junk.append(depth)
        elif attrs and not self.junk and tag not in ("html", "body"):
            names = self.junk_names(attrs)
            if names:
                self.named[number] = any(_COMMENT_NAME.fullmatch(n) for n in names)

    @staticmethod
    def is_junk(attrs: list) -> bool:
        for key, value in attrs:
            if key == "hidden":
                return True
            if value and key == "role" and value.lower() in _JUNK_ROLE:
                return True
        return False

    @staticmethod
    def junk_names(attrs: list) -> list[str]:
        out = []
        for key, value in attrs:
            if value and key in ("class", "id"):
                for token in value.lower().split():
                    token = re.sub(r"[^a-z0-9]+", "-", token).strip("-")
                    for apart, joined in _JOINED.items():
                        token = token.replace(apart, joined)
                    if _JUNK_NAME.fullmatch(token):
                        out.append(token)
        return out

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self.end_line()
        else:
            self.tags += 1
        depths = self.depths.get(tag)
        if depths and (tag in _BLOCK or not self.blocks or depths[-1] > self.blocks[-1]):
            self.cut(depths[-1])

    def handle_data(self, data: str) -> None:
        if not self.junk:
            self.parts.append((data, self.inner()))


def smoothed_ratios(lines: list[tuple[str, int, int]]) -> np.ndarray:
    ratio = np.array([len(text) / max(1, tags) for text, tags, _ in lines])
    return np.convolve(ratio, _KERNEL)[REACH : REACH + len(lines)]


def clustered(lines: list[tuple[str, int, int]]) -> np.ndarray:
    """The lines whose smoothed ratio reaches the threshold: one standard deviation, or the largest if all are below it.

    Not those that stand there by smoothing alone: with less than a tenth of the mean ratio of the others, like links beside a text.
    """
    smooth = smoothed_ratios(lines)
    chosen = np.flatnonzero(smooth >= min(smooth.std(), smooth.max()))
    own = np.array([len(lines[i][0]) / max(1, lines[i][1]) for i in chosen.tolist()])
    return chosen[own >= LEAST * own.mean()]


def main_text(html: str | None) -> str:
    page = _Lines()
    html = html or ""
    cut = _BEGUN.search(html, html.rfind(">") + 1)
    page.feed(html[: cut.start()] if cut else html)
    page.close()
    page.end_line()
    lines = page.lines()
    if not lines:
        return ""
    chosen = [lines[i][2] for i in clustered(lines).tolist()]
    region = {n: name in _CONTENT for n, name in page.name.items()}
    inside = page.spread(region)
    if not any(inside[n] for n in chosen):
        count = dict.fromkeys(page.parent, 0)
        for n in chosen:
            count[n] += 1
        for n in sorted(page.parent, reverse=True)[:-1]:  # children come first
            count[page.parent[n]] += count[n]
        deepest = max(n for n, c in count.items() if c == len(chosen) and page.name[n] not in _PARTS)
        inside = page.spread({n: n == deepest for n in page.parent})
    return "\n".join(text for text, _, n in lines if inside[n])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html) for html in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(trimmed(_extracted), "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
