"""Main text of web pages: parser events, text-to-tag ratios, smoothing, clustering.

The standard library's parser streams events of a page. They become lines, one for
each block, with the text's length and the tags met since the line before. The ratio
of text to tags is smoothed along the page by a Gaussian and parted into two clusters
by the threshold of largest between-class variance; the lines of the upper cluster are
content regions. Structure then settles what a ratio alone can't: lines inside menus,
headers, footers, sidebars, notices, adverts, forms and reader comments never count, and
a content region brings in the whole of its article element, however short (without one,
of the innermost container of most content), so that a short heading or paragraph of the
article stays.

Defined cases: a null or empty page has empty text; markup without text too; unclosed
and stray tags are closed as browsers do; repeated rows are extracted each; an empty
table gives an empty result; other columns are ignored. Nothing is cut by length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title iframe object svg canvas audio video math".split())
BOILERPLATE = frozenset("nav header footer aside form button select option textarea menu dialog label input fieldset".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
MAIN = frozenset(("article", "main"))
CONTAINERS = frozenset("article body center div main section table tbody td tr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CLOSED_BY_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# Words of class and id names of parts that aren't the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert modal popup overlay newsletter subscribe subscription "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget widgets related recommended share sharing social footer masthead topbar toolbar pagination pager "
    "comment comments commentlist disqus respond replies reply login signup signin search tags toc skip".split()
)
MAIN_NAMES = frozenset("article content main post entry story body".split())
SPACE = re.compile(r"\s+")
UNCLOSED = re.compile(r"<[!?/A-Za-z]")
LAYOUT = re.compile(r"\b(?:has|no|with|without|show|hide|js)[-_][\w-]+")  # words that say what a page holds, not what a part is
NAME_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")

#: Share of the content that the chosen container holds at least.
MOST = 0.7
#: Standard deviation, in lines, of the smoothing.
SIGMA = 1.0


class Events(HTMLParser):
    """Turns a page into ``lines``: [text, tags, number of the main element, boilerplate, number of the container].

    ``parents`` has the container around each container; 0 is the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.open: list[tuple[str, bool, bool, int, int]] = []  # tag, boilerplate, hidden, numbers of the main element and the container
        self.parents = [0]
        self.parts: list[str] = []
        self.tags = 0
        self.mains = 0
        self.places: dict[str, list[int]] = {}  # where in ``open`` each tag is

    def end_line(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        self.parts.clear()
        if text:
            _, boilerplate, _, main, container = self.open[-1] if self.open else ("", False, False, 0, 0)
            self.lines.append([text, self.tags, main, boilerplate, container])
            self.tags = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
            if tag in CLOSED_BY_P:
                self.close_within("p", ("td", "th", "button", "object", "caption"))
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self.close_within(tag, ("ul", "ol", "dl", "table"))
        self.tags += 1
        if tag in VOID:
            return
        _, boilerplate, hidden, main, container = self.open[-1] if self.open else ("", False, False, 0, 0)
        values = dict(attrs)
        names = {p.lower() for k in ("class", "id") for p in NAME_PARTS.findall(LAYOUT.sub("", values.get(k) or ""))}
        is_main = tag in MAIN or (values.get("role") or "") == "main" or tag in ("div", "section") and bool(names & MAIN_NAMES) and not names & NAMES
        if tag == "header" and main:
            bad = False  # an article's own heading
        else:
            bad = tag in BOILERPLATE or (values.get("role") or "") in ROLES or tag not in ("html", "body", "article", "main", "p", "h1") and bool(names & NAMES)
        bad = bad or tag == "article" and bool(names & {"comment", "comments", "reply", "ad", "promo", "related"})
        hidden = hidden or tag in HIDDEN or "hidden" in values or (values.get("aria-hidden") or "") == "true" or "display:none" in (values.get("style") or "").replace(" ", "").lower()
        if is_main and not bad and not boilerplate and not main:
            self.mains += 1
            main = self.mains
        if tag in CONTAINERS:
            self.parents.append(container)
            container = len(self.parents) - 1
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, boilerplate or bad, hidden, main, container))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def close_within(self, tag: str, fences: tuple[str, ...]) -> None:
        if any(self.last(f) > self.last(tag) for f in (*fences, *MAIN)):
            return
        self.close_from(self.last(tag))

    def last(self, tag: str) -> int:
        """The place of the innermost open element of a tag, or -1."""
        at = self.places.get(tag)
        return at[-1] if at else -1

    def close_from(self, place: int) -> None:
        """Closes the element at ``place`` and all within it; nothing for -1."""
        while 0 <= place < len(self.open):
            self.places[self.open.pop()[0]].pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        self.close_from(self.last(tag))

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][2]):
            self.parts.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![`` begins a comment up to the next ``>``, as in browsers; the parser's own raises at unknown names."""
        return self.parse_bogus_comment(i, report)

    def close(self) -> None:
        if UNCLOSED.match(self.rawdata):  # markup that the page's end cuts off is none of its text
            self.rawdata = ""
        super().close()
        self.end_line()


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing, the weights renewed at the ends."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    middle = slice(reach, reach + len(values))
    return np.convolve(values, kernel)[middle] / np.convolve(np.ones(len(values)), kernel)[middle]


def threshold(values: np.ndarray) -> float:
    """The value that parts ``values`` in two clusters of largest between-class variance."""
    v = np.sort(values)
    n, sums = np.arange(1, len(v)), np.cumsum(v)[:-1]
    between = n * (len(v) - n) * (sums / n - (v.sum() - sums) / (len(v) - n)) ** 2
    return float(v[int(np.argmax(between))]) if len(v) > 1 and v[0] < v[-1] else -1.0


def extract(html: str) -> str:
    """The main text of a page, blocks joined by a newline; empty if there is none."""
    events = Events()
    events.feed(html)
    events.close()
    if all(x[3] for x in events.lines):
        return ""
    ratio = smooth(np.array([len(text) / max(1, tags) for text, tags, *_ in events.lines]))
    plain = np.array([not x[3] for x in events.lines])
    content = plain & (ratio > threshold(ratio))
    lines, content = [x for x in events.lines if not x[3]], (content if content.any() else plain)[plain]
    mains = {main for (_, _, main, *_), take in zip(lines, content, strict=True) if take and main}
    if mains:  # every article that a content region lies in counts whole
        return "\n".join(text for text, _, main, *_ in lines if main in mains)
    # no article element: the innermost container that holds most of the content
    held = [0] * len(events.parents)
    for (text, _, _, _, container), take in zip(lines, content, strict=True):
        held[container] += len(text) * bool(take)
    total = sum(held)
    for number in range(len(held) - 1, 0, -1):  # a container is numbered after the one around it
        held[events.parents[number]] += held[number]
    inner = max(number for number, n in enumerate(held) if n >= MOST * total)
    inside = [False] * len(held)
    for number in range(len(held)):
        inside[number] = number == inner or inside[events.parents[number]]
    return "\n".join(text for text, *_, container in lines if inside[container])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py() or "") for x in batch.column(2)]
            counts = [len(t) for t in texts]
            texts = [t.encode("utf-8", "replace") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.decode() for t in texts], pa.string()), pa.array(counts, pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
