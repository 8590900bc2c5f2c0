"""Main text of web pages by the density of text between tags.

The events of the standard library's parser are turned into lines, one for each block of a page. A
line's ratio is its characters for each tag in it. The ratios along a page are smoothed with a
Gaussian, and a threshold that splits them into two clusters tells content from the rest. Lines in
the page's content container, an <article> or <main> if one holds content lines, else the element
that holds most of their characters, make the text; menus, notices, comments and the like within it
are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallywise.llm.common import chunks, plain_texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset(
    "head script style noscript template nav footer aside form button select option textarea iframe object svg menu "
    "dialog canvas audio video fieldset math".split()
)
CONTENT = frozenset(("article", "main"))
CONTAINER = CONTENT | frozenset("body section div td th center blockquote".split())
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|menu|nav|navbar|navigation|sidebar|footer|masthead|header|"
    r"comments?|respond|repl(?:y|ies)|disqus|cookies?|notice|alert|consent|popup|modal|overlay|newsletter|subscribe|"
    r"share|sharing|social|related|recommended|breadcrumbs?|login|signup|complementary|contentinfo|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
SIGMA = 1.5


class Lines(HTMLParser):
    """The blocks of a page that are not in dropped elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.holders: list[int] = []  # number of the innermost container of each line
        self.parents = [-1]  # of each container
        self.kinds = ["html"]
        self._open: list[tuple[str, int]] = [("html", 0)]
        self._words: list[str] = []
        self._count = 0
        self._skip, self._depth = "", 0

    def _end_line(self) -> None:
        text = " ".join("".join(self._words).split())
        if text:
            self.texts.append(text)
            self.tags.append(self._count)
            self.holders.append(self._open[-1][1])
        if self._words or self._count:
            self._words, self._count = [], 0

    def _unwanted(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in DROPPED:
            return True
        if tag in CONTENT or tag in ("html", "body"):
            return False
        if tag == "header":
            return not any(kind in CONTENT for kind, _ in self._open)
        for name, value in attrs:
            if name in ("class", "id", "role") and value and NAMED.search(value):
                return True
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self._skip:
            self._depth += tag == self._skip
            return
        if tag not in VOID and self._unwanted(tag, attrs):
            self._end_line()
            self._skip, self._depth = tag, 1
            return
        if tag == "br" or tag == "hr":
            self._words.append(" ")
        elif tag not in INLINE and tag not in VOID:
            self._end_line()
        if tag in CONTAINER:
            self.parents.append(self._open[-1][1])
            self.kinds.append(tag)
            self._open.append((tag, len(self.kinds) - 1))
        self._count += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag in ("svg", "math"):
            if not self._skip and tag in VOID:
                self.handle_starttag(tag, attrs)
        else:  # only a void element ends itself
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self._skip:
            self._depth -= tag == self._skip
            if not self._depth:
                self._skip = ""
            return
        if tag not in INLINE and tag not in VOID:
            self._end_line()
        if tag in CONTAINER and any(kind == tag for kind, _ in self._open):
            while self._open.pop()[0] != tag:
                pass
        self._count += 1

    def handle_data(self, data: str) -> None:
        if not self._skip:
            self._words.append(data)

    def unknown_decl(self, data: str) -> None:
        pass

    def close(self) -> None:
        if self.rawdata.startswith("<!--"):  # a comment without an end reaches to the end of the page
            self.rawdata = ""
        super().close()
        self._end_line()


def smoothed(values: np.ndarray) -> np.ndarray:
    """Weighted means with Gaussian weights; the ends count what is there."""
    reach = int(3 * SIGMA)
    weights = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * SIGMA**2))
    total = np.convolve(np.pad(values, reach), weights, "valid")
    return total / np.convolve(np.pad(np.ones(len(values)), reach), weights, "valid")


def threshold(values: np.ndarray) -> float:
    """The middle between the means of two clusters."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        middle = (low + high) / 2
        upper = values > middle
        if not upper.any() or upper.all():
            return middle
        means = float(values[~upper].mean()), float(values[upper].mean())
        if means == (low, high):
            break
        low, high = means
    return (low + high) / 2


def main_text(html: str) -> str:
    lines = Lines()
    lines.feed(html)
    lines.close()
    if not lines.texts:
        return ""
    sizes = np.array([len(t) for t in lines.texts], np.float64)
    density = smoothed(sizes / np.maximum(np.array(lines.tags), 1))
    content = density >= threshold(density)
    parents, kinds = lines.parents, lines.kinds

    def above(holder: int) -> list[int]:
        out = []
        while holder >= 0:
            out.append(holder)
            holder = parents[holder]
        return out

    chains = [above(h) for h in lines.holders]
    weight: dict[int, float] = {}
    for chain, size, good in zip(chains, sizes, content):
        if good:
            for holder in chain:
                weight[holder] = weight.get(holder, 0.0) + size
    whole = weight.get(0, 0.0)
    named = [h for h in weight if kinds[h] in CONTENT and not any(kinds[a] in CONTENT for a in above(h)[1:])]
    if named:
        chosen = set(named)
    else:  # the innermost element that holds at least nine tenths of the content
        chosen = {max(h for h in weight if weight[h] >= 0.9 * whole)}
    inside = [not chosen.isdisjoint(chain) for chain in chains]
    if all(kinds[h] in ("html", "body") for h in chosen):  # it reaches from the first to the last content line
        good = np.flatnonzero(content & np.array(inside))
        inside = [x and good[0] <= i <= good[-1] for i, x in enumerate(inside)]
    return " ".join([t for t, x in zip(lines.texts, inside) if x])


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: (page_id, url, text, n_chars); n_chars counts code points.

    A null or empty page, and one without text outside dropped elements, has the empty text. Ids and
    urls pass through unchanged, nulls and repetitions too; further columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "html"):
            texts = [main_text(h) for h in plain_texts(part, "html")]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), sizes]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
