r"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block (a paragraph, heading, list item, cell). A line weighs as much as its
text outside links is long, a tenth of that where it stands outside the page's article or main elements, if there are any; lines
of boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, reader comments; by element, role, and whole
tokens of class and id) are left empty, WINDOW of them for each such element. Weights are summed over sliding windows of
WINDOW lines; a stretch begins at a surge (the sum rises to PEAK of its highest value) and ends at a dive (it falls to
nothing). The stretches choose what is text: article elements in which one surges, or, where the heaviest stretch is outside
any, the stretches outside.

Elements then mend the borders, so that short lines stay: a chosen article is kept from its first to its last line, whatever
adverts cut it; a stretch outside sheds link-only lines at its ends and takes in the paragraphs of the elements whose
paragraphs it holds.

Defined results: a null or empty page has an empty text; unclosed elements end with their parent; an unclosed comment or
script runs to the end; repeated rows each get a result; other columns are left out; an empty table gives an empty result.
Time is linear in a page's length however deep it nests.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_batch

WINDOW, PEAK, INSIDE = 3, 0.15, 10
_TOKEN = re.compile(r"""<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*)((?:[^>"'<]|"[^"<]*"|'[^'<]*')*+)>|</?([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(?=[\s/]|$))""", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object select button canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow ms msqrt mstyle msub msubsup msup mtext munder munderover q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("head nav footer aside form menu dialog".split()) | RAW
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu menubar".split())
#: A class or id token is boilerplate if one of its pieces is among NAMES and all others are or are among BESIDE.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe signup login search widget pagination pager toolbar".split()
)
BESIDE = frozenset("site page main global top bottom left right center primary secondary inner outer sticky fixed floating mobile desktop box container wrapper wrap holder list area section block bar row column col item items link links icon icons button buttons form field input panel slot unit label title heading head text message body group thread post posts article articles entry story content stories news more for the and of us".split())
#: Page headers; inside an article they hold its title.
HEADERS, OF_ARTICLE = frozenset("header masthead topbar".split()), frozenset("article entry post story content".split())
#: What holds a line of text; lists and tables stand between such a line and the element that it belongs to.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre figcaption caption".split())
BETWEEN = PARAGRAPHS | frozenset("ul ol dl table tbody thead tfoot tr blockquote figure".split())
_CLOSES = {"p": frozenset({"p"}), "li": frozenset({"li"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"})}


def _named(value: str, names: frozenset[str]) -> bool:
    for token in value.strip("\"'").split():
        pieces = {p.lower() for p in _PIECES.findall(token) if len(p) > 1}
        if pieces & names and pieces <= names | BESIDE:
            return True
    return False


def _is_boilerplate(name: str, attributes: str, in_article: bool) -> bool:
    if name in BOILERPLATE or name == "header" and not in_article:
        return True
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and _HIDDEN.search(value) or key == "role" and set(value.lower().split()) & ROLES:
            return True
        if key in ("class", "id") and name not in ("body", "html"):
            if name in ("article", "main"):
                if _named(value, frozenset({"comment", "comments", "reply", "related", "ad", "ads"})):
                    return True
            elif _named(value, NAMES) or not in_article and _named(value, HEADERS) and not OF_ARTICLE & {p.lower() for p in _PIECES.findall(value)}:
                return True
    return False


@dataclass(slots=True)
class Line:
    text: str
    #: Its length; with links, its letters and digits outside them; 0 for the empty lines that stand for boilerplate.
    plain: int
    #: The number of the outermost article or main element around it; 0 for none.
    article: int
    #: The number of the element that its paragraph belongs to; -1 if it stands in no paragraph.
    parent: int


class _Open:
    """The open elements: name, whether boilerplate, article, and number; any of them is found without a search."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, int, int]] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.holders: list[int] = []  # those that are neither inline nor between a paragraph and its element

    def push(self, element: tuple[str, bool, int, int]) -> None:
        self.at[element[0]].append(len(self.stack))
        if element[0] not in INLINE:
            self.blocks.append(len(self.stack))
            if element[0] not in BETWEEN:
                self.holders.append(len(self.stack))
        self.stack.append(element)

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            name = self.stack.pop()[0]
            self.at[name].pop()
            for some in (self.blocks, self.holders):
                if some and some[-1] == len(self.stack):
                    some.pop()

    @property
    def state(self) -> tuple[bool, int]:
        return self.stack[-1][1:3] if self.stack else (False, 0)

    def parent(self) -> int:
        block = self.stack[self.blocks[-1]][0] if self.blocks else ""
        return -1 if block not in PARAGRAPHS else self.stack[self.holders[-1]][3] if self.holders else 0


def lines_of(html: str) -> list[Line]:
    """The lines in page order, with WINDOW empty ones where a boilerplate element ends."""
    lines: list[Line] = []
    text: list[str] = []
    is_open = _Open()
    linked: set[int] = set()  # which parts of text
    at, n, numbers = 0, len(html), 0

    def end_line() -> None:
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line:
                plain = sum(map(str.isalnum, unescape("".join(t for i, t in enumerate(text) if i not in linked)))) if linked else len(line)
                lines.append(Line(line, plain, is_open.state[1], is_open.parent()))
            text.clear()
            linked.clear()

    while at < n:
        m = _TOKEN.search(html, at)
        upto = m.start() if m else n
        skipped, article = is_open.state
        if upto > at and not skipped:
            text.append(html[at:upto])
            if (links := is_open.at["a"]) and links[-1] >= len(is_open.stack) - 3:
                linked.add(len(text) - 1)
        if not m:
            break
        at, name = m.end(), (m[1] or m[3] or "").lower()
        if not name:
            continue
        if m[0][1] == "/":
            spots = is_open.at[name]
            if name not in INLINE:
                end_line()
            if spots and not (name in INLINE and is_open.blocks and is_open.blocks[-1] > spots[-1]):
                k = spots[-1]
                if is_open.stack[k][1] and not (k and is_open.stack[k - 1][1]):
                    lines.extend([Line("", 0, 0, -1)] * WINDOW)
                is_open.cut(k)
            continue
        attributes = m[2] or m[4] or ""
        if name in INLINE:
            if name == "br" and not skipped:
                text.append("\n")
        else:
            end_line()
            closes = _CLOSES.get(name)
            while closes and is_open.blocks and is_open.stack[is_open.blocks[-1]][0] in closes:
                is_open.cut(is_open.blocks[-1])
            skipped, article = is_open.state
        if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
            continue
        bad = skipped or _is_boilerplate(name, attributes, bool(article))
        numbers += 1
        if not bad and not article and name in ("article", "main"):
            article = numbers
        if name in RAW:  # nothing inside is markup
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            if not close:
                break
            at = close.start()
        is_open.push((name, bad, article, numbers))
    end_line()
    return lines


def weights_of(lines: list[Line]) -> list[int]:
    inside = any(x.article for x in lines)
    out = [x.plain * (INSIDE if x.article or not inside else 1) for x in lines]
    return out if any(out) else [len(x.text) * (INSIDE if x.article or not inside else 1) for x in lines]


def spans(weights: list[int], threshold: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """From each surge of the window sums to the next dive, as half-open ranges of lines."""
    out, start = [], None
    total = sum(weights[: window - 1])
    for i in range(len(weights)):
        total += weights[i + window - 1] if i + window - 1 < len(weights) else 0
        if start is None and total >= threshold:
            start = i
        elif start is not None and total == 0:
            out.append((start, i))
            start = None
        total -= weights[i]
    return out + ([(start, len(weights))] if start is not None else [])


def threshold_of(weights: list[int], window: int = WINDOW, peak: float = PEAK) -> int:
    return max(1, int(peak * max((sum(weights[i : i + window]) for i in range(len(weights))), default=0)))


def extract(html: str | None, window: int = WINDOW, peak: float = PEAK) -> str:
    lines = lines_of(html or "")
    weights = weights_of(lines)
    articles: dict[int, int] = defaultdict(int)  # the weight of each that surges
    outside: list[tuple[int, list[int]]] = []
    for a, b in spans(weights, threshold_of(weights, window, peak), window):
        free = [i for i in range(a, b) if not lines[i].article and lines[i].text]
        for i in range(a, b):
            if weights[i]:
                articles[lines[i].article] += weights[i]
        outside.append((sum(weights[i] for i in free), free))
    articles.pop(0, None)
    if articles and max(articles.values()) >= max(w for w, _ in outside):
        return "\n\n".join(x.text for x in lines if x.text and x.article in articles)
    kept: set[int] = set()
    for weight, free in outside:
        if weight:
            ends = [i for i in free if weights[i]]
            kept.update(i for i in free if ends[0] <= i <= ends[-1])
    belongs = {lines[i].parent for i in kept} - {-1}
    return "\n\n".join(x.text for i, x in enumerate(lines) if x.text and not x.article and (i in kept or x.parent in belongs))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), 256):
            part = batch.slice(k, 256)
            texts = [extract(x.as_py()) for x in part.column(2)]
            columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text, n_chars for each row of pages."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "url")}
    out = by_batch(rows, _extracted, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
