"""Main text of HTML pages by line-block distribution (Chen, 2010).

Markup is stripped into lines: one for each block of the page, with inline markup removed, character references decoded and
white space made one blank. Text of elements that never hold the article (navigation, forms, scripts, hidden ones, reader comments)
is left out. A line's weight is its text length without link text. Weights are summed over sliding windows of lines; text surges
where the sums reach a threshold and dives where they return to nothing. The lines of every run that surges are kept, from its first
to its last line with weight, or of all runs if none surges.

Marks of the page weigh in. A class, id or role that names furniture takes the weight from its lines, and an article or main element
from the lines outside it; lines without weight are left out, unless over FOREIGN times the weight of the others surges in them: then
the distribution overrules the mark. Lines of an article have the weight of a surge at least, so that short ones count. An element
that encloses the page's first article is no furniture by its name, nor is a form around it.

Defined results: null and empty html, and pages without text, give an empty text; repeated rows give a row each, a null id too;
unclosed elements, raw ones such as scripts too, end with what encloses them; a raw element ends only at its own end tag, whatever it
holds; an empty table gives no rows; other columns are ignored, whatever their names. Time is linear in a page's length.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

WINDOW = 3
SURGE = 60

FOREIGN = 8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(class|id|role|aria-label|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
#: Elements whose content is raw text, elements that are no text or furniture, and elements that begin a new block.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
FURNITURE = frozenset(
    "nav footer aside form menu dialog button fieldset datalist audio video head noscript template svg math object canvas select".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names that mark furniture: the last part of a class, id or role, besides parts that say where or how it is.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion navigation nav navbar menu"
    " breadcrumb breadcrumbs sidebar side aside footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup"
    " modal overlay newsletter subscribe subscription signup login share sharing social"
    " related recommended recommendations widget pagination pager contentinfo complementary search searchbox copyright disclaimer".split()
)
#: Those of reader comments, which never count.
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
_HEADER_NAMES = frozenset("header head pageheader siteheader".split())
_NEUTRAL = frozenset(
    "left right top bottom primary secondary inner outer wrap wrapper container box block area section list bar item items link links"
    " button buttons form thread posts articles stories panel body".split()
)
#: With one of these a name says what the page has, not what the element is.
_MODIFIERS = frozenset("has no with without is not non hide show".split())
#: Elements that hold text: only their element can make them furniture.
_PROSE = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_NO, _NAMED, _NEVER = range(3)


def _named(name: str) -> int:
    """What one class, id or role says of its element."""
    parts = [w.lower() for w in _WORDS.findall(name)]
    if not parts or _MODIFIERS.intersection(parts):
        return _NO
    while len(parts) > 1 and parts[-1] in _NEUTRAL:
        parts.pop()
    if parts[-1] in COMMENTS:
        return _NEVER
    header = parts[-1] in _HEADER_NAMES and not {"article", "post", "entry"}.intersection(parts)
    return _NAMED if parts[-1] in NAMES or header else _NO


def _marked(attrs: str, name: str) -> int:
    """Whether the attributes mark an element as furniture, or as what never counts."""
    out = _NO
    for key, *values in _ATTR.findall(attrs):
        value = next((v for v in values if v), "")
        key = key.lower()
        if key == "hidden" and not value.strip("'\""):
            return _NEVER
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return _NEVER
        elif key != "aria-label" and name not in ("html", "body", "main") and name not in _PROSE:
            out = max([out, *map(_named, value.split())])
    return out


#: A new element of these ends an open one of those.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}
_END_P = BLOCKS - frozenset("body caption dd dt head html legend li option search summary tbody td tfoot th thead tr".split())
_HOLD = frozenset("ul ol dl table div section article main body blockquote aside nav form header footer".split())
_P_HOLD = _HOLD | {"button", "td", "th", "li"}
_END_TAG = re.compile(r"</([a-zA-Z][a-zA-Z0-9:-]*)")


class Element(NamedTuple):
    name: str
    never: bool = False
    named: bool = False
    article: bool = False
    link: bool = False


class Line:
    __slots__ = ("parts", "links", "article", "named")

    def __init__(self):
        self.parts: list[str] = []
        self.links, self.article, self.named = 0, False, False


class Page:
    """The lines of a page, gathered tag by tag."""

    def __init__(self):
        self.stack = [Element("")]
        self.places: dict[str, list[int]] = {}  # of the open elements of each name in the stack
        self.lines = [Line()]
        self.endless: set[str] = set()  # raw elements of which no end tag lies ahead
        self.met_article = False

    def text(self, text: str) -> None:
        top, line = self.stack[-1], self.lines[-1]
        if not text or top.never:
            return
        if line.parts and line.named != top.named and text.strip():  # furniture within a line is a line of its own
            self.lines.append(line := Line())
        if not line.parts:
            line.article, line.named = top.article, top.named
        line.parts.append(text)
        if top.link:
            line.links += len(text.strip())

    def new_line(self) -> None:
        if self.lines[-1].parts:
            self.lines.append(Line())

    def _last(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def end(self, names: tuple[str, ...], within: frozenset[str] = frozenset()) -> None:
        """Ends the innermost open element of these names, unless one of `within` comes first, and all in it."""
        k = self._last(names)
        if k and k > self._last(within - set(names) if within else within):
            while len(self.stack) > k:
                self.places[self.stack.pop().name].pop()

    def close(self, name: str) -> None:
        self.end((name,))
        if name in BLOCKS:
            self.new_line()

    def open(self, name: str, attrs: str) -> None:
        if name in _ENDS:
            self.end(_ENDS[name], _HOLD)
        if name in _END_P:
            self.end(("p",), _P_HOLD)
        if name == "a":
            self.end(("a",), BLOCKS)
        above = self.stack[-1]
        if name in BLOCKS:
            self.new_line()
        if name in VOID:
            if name == "br":
                self.text(" ")
            return
        if attrs.endswith("/") and name not in BLOCKS:
            return
        mark = _marked(attrs, name)
        never = above.never or mark == _NEVER or (name in FURNITURE and name != "form")
        named = above.named or mark == _NAMED or name == "form" or (name == "header" and not above.article)
        article = above.article or name in ("article", "main")
        if article and not above.article and not never and mark == _NO and not self.met_article:
            named, self.met_article = False, True  # what encloses the article is no furniture
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append(Element(name, never, named, article, above.link or name == "a"))

    def after_raw(self, name: str, page: str, at: int) -> int:
        """Where a raw element ends whose content begins at `at`: behind its own end tag, or with what encloses it."""
        if name not in self.endless:
            found = re.compile(rf"</{name}(?![a-zA-Z0-9:-])[^>]*(?:>|\Z)", re.I).search(page, at)
            if found:
                return found.end()
            self.endless.add(name)
        for found in _END_TAG.finditer(page, at):
            if self.places.get(found[1].lower()):
                return found.start()
        return len(page)


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, length of link text, within the article, named furniture) of each line that has text, in page order."""
    made, at = Page(), 0
    while m := _TOKEN.search(page, at):
        made.text(page[at : m.start()])
        at = m.end()
        if m["name"] is None:
            if m[0].startswith("<![CDATA["):
                made.text(m[0][9:-3])
            continue
        name = m["name"].lower()
        if m["close"]:
            made.close(name)
        elif name in RAW:
            if not m["attrs"].endswith("/"):
                at = made.after_raw(name, page, at)
        else:
            made.open(name, m["attrs"])
    made.text(page[at:])
    found = ((_SPACE.sub(" ", htmllib.unescape("".join(x.parts))).strip(), x.links, x.article, x.named) for x in made.lines)
    return [x for x in found if x[0]]


def runs(weight: np.ndarray, window: int, surge: int) -> list[tuple[int, int]]:
    """[begin, end) of each run of lines between a surge and the dives around it; of all runs with text where none surges."""
    if not weight.sum():
        return []
    # the sum of the windows of lines that end, centre and begin at a line
    pad = np.zeros(window - 1, np.int64)
    sums = np.convolve(np.concatenate([pad, weight, pad]), np.ones(window, np.int64), "valid")  # window k begins at line k - window + 1
    reach = np.max([sums[k : k + len(weight)] for k in range(window)], axis=0)
    least = surge if sums.max() >= surge else 1  # a page of short lines: whatever has text
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (reach > 0).astype(np.int8), [0]])))
    out = []
    for begin, end in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
        if reach[begin:end].max() >= least:
            full = np.flatnonzero(weight[begin:end])
            out.append((begin + int(full[0]), begin + int(full[-1]) + 1))
    return out


def _preferred(lines: list[tuple], good: list[bool], window: int, surge: int) -> list[tuple]:
    """The good lines, unless those of the others that surge outweigh them FOREIGN times: then all."""
    weight = np.array([max(0, len(x[0]) - x[1]) for x in lines], np.int64)
    own = np.array(good, bool)
    foreign = sum(int((weight[a:b] * ~own[a:b]).sum()) for a, b in runs(weight, window, surge))
    if foreign > FOREIGN * max(surge, int(weight[own].sum())):
        return lines
    return [x for x, g in zip(lines, good, strict=True) if g]


def main_lines(lines: list[tuple[str, int, bool, bool]], window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """The lines of every run that surges, where marks take lines' weight unless they are overruled."""
    if any(x[3] for x in lines):
        lines = _preferred(lines, [not x[3] for x in lines], window, surge)
    if any(x[2] for x in lines):
        lines = _preferred(lines, [x[2] for x in lines], window, surge)
    least = surge if all(x[2] for x in lines) else 0
    weight = np.array([max(least, len(x[0]) - x[1], 0) for x in lines], np.int64)
    return [x[0] for a, b in runs(weight, window, surge) for x in lines[a:b]]


def extract(page: str | None) -> str:
    return " ".join(main_lines(lines_of(page or "")))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p) for p in batch.column(2).to_pylist()]
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
