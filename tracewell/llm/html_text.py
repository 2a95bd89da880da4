"""Main text of a page: parser events to lines, text-to-tag ratios, smoothing, threshold clustering.

The standard library's streaming parser turns a page into lines, one for each run of inline content
between block tags. What sits in elements that never hold an article (menus, headers, footers,
sidebars, forms, scripts, or by class, id or role a notice, advert or comment) gives no lines. Each
line has a ratio of text to tags; the ratios are smoothed by a Gaussian, and lines at or above their
standard deviation are dense, but for those that are mostly links. Where an article (or main) element has most of the dense text, it is the
region. Elsewhere runs of dense lines are clusters; the region reaches from the first to the last
cluster that has ``CLUSTER_SHARE`` of the largest one's text, and on over adjoining lines that
stand in a container of its dense lines (a heading, a short paragraph). Every line of the region counts.

Time and memory grow with the page, whatever its depth: a line knows its innermost container and
its article alone, and only open blocks are searched.

Defined cases: a null or empty page, or one without text, has an empty text and n_chars 0; markup
that breaks off or is not closed is read as far as it goes; rows are independent, so repeated ids
and ties change nothing; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map

#: Elements without article text.
SKIPPED = frozenset("head script style noscript template nav header footer aside form button select textarea input label fieldset iframe object svg canvas audio video dialog menu title".split())
#: Elements that can be a content region.
CONTAINERS = frozenset("html body main article section div table tbody tr td center details figure".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption hr br address details summary center".split())
#: Open elements that a new one of these ends.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A paragraph ends at each of these too.
ENDS_P = BLOCK - {"br", "html", "body"}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words of a class or id that mark what is not the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|comments?|commentlist|disqus|replies|respond|sidebar|side-?bar|widget|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|header|toolbar|related|recommend\w*|pagination|pager|tags|skip-?link|copyright|legal|disclaimer)(?:$|[\s_-])"
)
#: An article's own header is part of it.
ARTICLE_ONLY = frozenset({"header"})
SIGMA = 1.0
#: Of the dense text, for an article element; of the largest cluster's text, for others.
ARTICLE_SHARE, CLUSTER_SHARE = 0.5, 0.2
_SPACE = re.compile(r"\s+")


class _Lines(HTMLParser):
    """Lines as (text, tags, number of the innermost container, number of the article, whether it is mostly links)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []  # tag, whether it is skipped
        self.live: Counter = Counter()  # open elements by tag
        self.blocks: list[int] = []  # places in open of those that can be ended by another's start
        self.containers: list[tuple[int, int, int]] = [(-1, 0, 0)]  # place in open, number, number of the article around
        self.skipped = self.count = self.tags = self.linked = 0
        self.parts: list[str] = []
        self.lines: list[tuple[str, int, int, int, bool]] = []

    def flush(self):
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        self.parts = []
        if text:
            self.lines.append((text, self.tags, *self.containers[-1][1:], 2 * self.linked >= len(text)))
            self.tags = 0
        self.linked = 0

    def _pop_to(self, at: int):
        for tag, skipped in self.open[at:]:
            self.skipped -= skipped
            self.live[tag] -= 1
        del self.open[at:]
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()
        while self.containers[-1][0] >= at:
            self.containers.pop()

    def _end_others(self, ended: set[str]):
        for at in reversed(self.blocks):
            name = self.open[at][0]
            if name in ended:
                self._pop_to(at)
                return
            if name not in ("p", "li"):
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK or tag in SKIPPED:
            self.flush()
        self.tags += not self.skipped
        if tag in VOID:
            return
        if ended := ENDS.get(tag, set()) | ({"p"} if tag in ENDS_P else set()):
            self._end_others(ended)
        told = dict(attrs)
        skip = tag in SKIPPED and not (tag in ARTICLE_ONLY and self.live["article"])
        if not skip and tag not in ("html", "body", "article", "main"):
            named = f"{told.get('class') or ''} {told.get('id') or ''}".lower()
            skip = bool(named.strip() and MARKS.search(named)) or (told.get("role") or "").lower() in ROLES or "hidden" in told or (told.get("aria-hidden") or "").lower() == "true" or "display:none" in (told.get("style") or "").replace(" ", "").lower()
        if tag in CONTAINERS:
            self.count += 1
            within = self.containers[-1][2]
            if tag == "article" and not self.live["article"] or tag == "main" and not within:
                within = self.count  # an article counts more than a main element around it
            self.containers.append((len(self.open), self.count, within))
        if tag in BLOCK or tag in SKIPPED or tag in ENDS:
            self.blocks.append(len(self.open))
        self.open.append((tag, skip))
        self.live[tag] += 1
        self.skipped += skip

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK or tag in SKIPPED:
            self.flush()
        self.tags += not self.skipped
        if self.live[tag]:
            self._pop_to(next(at for at in range(len(self.open) - 1, -1, -1) if self.open[at][0] == tag))

    def handle_data(self, data):
        if not self.skipped:
            self.parts.append(data)
            self.linked += len(data.strip()) if self.live["a"] else 0


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing over a window of three sigma each way, weights scaled to what lies inside."""
    radius = max(1, math.ceil(3 * sigma))
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - radius), min(len(values), i + radius + 1)
        w = weights[lo - i + radius : hi - i + radius]
        out.append(sum(a * b for a, b in zip(w, values[lo:hi], strict=True)) / sum(w))
    return out


def dense_lines(lines: list[tuple[str, int, int, int, bool]]) -> list[bool]:
    """Whether each line's smoothed ratio of text to tags reaches the standard deviation of all, and it isn't mostly links."""
    ratios = smoothed([len(text) / max(1, tags) for text, tags, *_ in lines])
    mean = sum(ratios) / len(ratios)
    spread = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    return [r >= spread and not line[4] for r, line in zip(ratios, lines, strict=True)]


def region(lines: list[tuple[str, int, int, int, bool]], dense: list[bool]) -> tuple[int, int]:
    """First and last line of the region about the dense lines: from cluster to cluster, and on within their containers."""
    clusters: list[list[int]] = []  # first, last, characters
    for i, (line, good) in enumerate(zip(lines, dense, strict=True)):
        if good and clusters and clusters[-1][1] == i - 1:
            clusters[-1][1:] = [i, clusters[-1][2] + len(line[0])]
        elif good:
            clusters.append([i, i, len(line[0])])
    large = max((c[2] for c in clusters), default=0)
    kept = [c for c in clusters if c[2] >= CLUSTER_SHARE * large] or [[0, len(lines) - 1, 0]]
    low, high = kept[0][0], kept[-1][1]
    homes = {lines[i][2] for first, last, _ in kept for i in range(first, last + 1)}
    while low and lines[low - 1][2] in homes:
        low -= 1
    while high + 1 < len(lines) and lines[high + 1][2] in homes:
        high += 1
    return low, high


def content_lines(html: str) -> list[str]:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return []
    dense = dense_lines(lines)
    held: Counter = Counter()
    for (text, _, _, article, _), good in zip(lines, dense, strict=True):
        held[article] += good * len(text)
    best = max((n for n in held if n), key=lambda n: (held[n], -n), default=0)
    if best and held[best] >= ARTICLE_SHARE * sum(held.values()):
        return [text for text, _, _, article, _ in lines if article == best]
    low, high = region(lines, dense)
    return [text for text, *_ in lines[low : high + 1]]


def main_text(html: str) -> str:
    return " ".join(content_lines(html))


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page. No shuffle."""
    src = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def compute(batch: pa.RecordBatch) -> dict:
        texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return arrow_map(src, compute, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], keep=("page_id", "url"))
