"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block of text, and every line gets a weight: the length of its text outside
links.  What the markup says only shifts weights.  Elements that are never article text (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments, by tag or by telling class, id or role) leave WINDOW empty lines;
a heading weighs as much as the threshold, a line in a paragraph element three times its length; and where the page marks its article (article, main or
role=main), lines inside weigh the threshold at least and lines outside nothing.

The weights are summed over sliding windows of WINDOW lines.  The surge threshold comes from the page's own
distribution: SURGE of its largest sum, at most HIGH.  A stretch begins where a sum reaches the threshold and the two sums
after it are not zero, unless the page ends there, and it ends where the sum dives to zero.  At both ends, lines that a window took in but whose own weight is
under a window's share of the threshold do not belong to it.  The lines of the stretches are kept, but for those without weight that are
outside the marked article.

Defined cases: null and empty pages give an empty text; a page cut off inside a tag, a comment or
an unclosed element loses what is inside it; a page without markup is one block; equal rows give
equal results; an empty table gives an empty result; other columns pass through, but for columns named text or n_chars, which are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._stage import for_python, passing, schema_of, table

WINDOW, SURGE, HIGH = 3, 0.15, 150
_RAW = frozenset("script style noscript template textarea title svg math iframe object canvas select".split())
_DROPPED = frozenset("head nav footer aside form button dialog menu figure audio video".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split())
_INLINE = frozenset("a abbr b cite code del em font i ins label mark q s small span strong sub sup time u".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that name something other than the article.
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|consent|contentinfo|cookies?|disclaimer|disqus|foot|footer|gdpr|header|masthead|menu|menubar|modal|nav|"
    r"navbar|navigation|newsletter|notice|popup|promo\w*|recommend\w*|related|reply|replies|respond|search|share|sharing|shar\w*bar|side|sidebar|signup|skip|social|sponsor\w*|subscribe|"
    r"toolbar|widget)(?:$|[\s_-])", re.I)
_TAG = re.compile(r"<(?:!--.*?(?:-->|$)|!\[CDATA\[.*?(?:\]\]>|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(>|$))", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_BLANKS = re.compile(r"\s+")


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MAIN = re.compile(r"(?:^|\s)role\s*=\s*[\"']?main\b", re.I)
#: What the parts of an article itself may be called.
_OF_ARTICLE = re.compile(r"(?:^|[\s_-])(?:header|foot)(?=$|[\s_-])", re.I)


def _unwanted(name: str, attributes: str, in_article: bool) -> bool:
    if name in _DROPPED and not (name == "figure" and in_article):
        return True
    if name == "header":
        return not in_article
    if attributes and name not in ("html", "body", "article", "main"):
        for m in _NAMED.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return True
            if key == "id" and name in _HEADINGS and in_article:
                continue  # the name of a section
            if in_article:
                value = _OF_ARTICLE.sub(" ", value)
            if key in ("class", "id", "role") and _NAMES.search(value):
                return True
    elif attributes and name == "article":
        return any(m[1].lower() in ("class", "id") and re.search(r"comment|repl(?:y|ies)|(?:^|[\s_-])ads?(?:$|[\s_-])", m[2] or m[3] or m[4] or "", re.I) for m in _NAMED.finditer(attributes))
    return False


class Lines:
    """The lines of a page: text, characters inside links, kind (h heading, p paragraph, else empty), and whether the marked article holds them."""

    def __init__(self, page: str):
        self.text: list[str] = []
        self.linked: list[int] = []
        self.kind: list[str] = []
        self.inside: list[bool] = []
        self._parts: list[str] = []
        self._in_link, self._links, self._kind = False, 0, ""
        #: open marks of an article: name of the element and how many of the name are open inside
        self._marks: list[list] = []
        self._read(page)

    def _add(self, text: str, linked: int, kind: str, inside: bool) -> None:
        for column, value in ((self.text, text), (self.linked, linked), (self.kind, kind), (self.inside, inside)):
            column.append(value)

    def _end_line(self) -> None:
        if self._parts:
            text = "".join(self._parts)
            if "&" in text:
                text = html.unescape(text)
            text = _BLANKS.sub(" ", text).strip()
            if text:
                self._add(text, self._links, self._kind, bool(self._marks))
            self._parts.clear()
            self._links = 0

    def _gap(self, name: str) -> None:
        """After a removed element: one inside a line leaves the line whole."""
        if name not in _INLINE:
            self._end_line()
            for _ in range(WINDOW):
                self._add("", 0, "", False)

    def _said(self, text: str) -> None:
        self._parts.append(text)
        if self._in_link:
            self._links += len(text)

    def _block(self, name: str, closing: bool, attributes: str) -> None:
        self._end_line()
        self._kind = "" if closing else "h" if name in _HEADINGS else "p" if name == "p" else self._kind if name not in ("li", "td", "div") else ""
        if self._marks and name == self._marks[-1][0]:
            self._marks[-1][1] += -1 if closing else 1
            if self._marks[-1][1] == 0:
                self._marks.pop()
        elif not closing and (name in ("article", "main") or _MAIN.search(attributes)):
            self._marks.append([name, 1])

    def _read(self, page: str) -> None:
        at, dropping, depth = 0, "", 0
        for m in iter(lambda: _TAG.search(page, at), None):
            if not dropping and m.start() > at:
                self._said(page[at : m.start()])
            at = max(m.end(), m.start() + 1)
            if m[2] is None:
                continue
            name, closing = m[2].lower(), bool(m[1])
            if name in _RAW and not closing:
                close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|$)", re.I).search(page, at)
                at = close.end() if close else len(page)
                continue
            if dropping:
                again = False  # whether this tag belongs to what follows
                if dropping == "p":
                    done = name == "p" or name in _BLOCK
                    again = done and not (name == "p" and closing)
                elif dropping == "li":
                    done = depth == 1 and (name == "li" or closing and name in ("ul", "ol"))
                    again = done and not (name == "li" and closing)
                    depth += (-1 if closing else 1) if name in ("ul", "ol") else 0
                else:
                    depth += (-1 if closing else 1) if name == dropping else 0
                    done = depth <= 0
                if done:
                    at = m.start() if again else at
                    self._gap(dropping)
                    dropping = ""
                continue
            if not closing and name not in _VOID and not m[3].rstrip().endswith("/") and _unwanted(name, m[3], bool(self._marks)):
                self._gap(name)
                dropping, depth = name, 1
                continue
            if name in _BLOCK:
                self._block(name, closing, m[3])
            elif name == "br":
                self._parts.append(" ")
            elif name == "a":
                self._in_link = not closing
        if not dropping and at < len(page):
            self._said(page[at:])
        self._end_line()


def stretches(weights: list[float], threshold: float) -> list[tuple[int, int]]:
    """(first, end) of the lines between surges and dives."""
    n = len(weights)
    sums = [sum(weights[i : i + WINDOW]) for i in range(n)]
    out, at = [], 0
    while at < n:
        if sums[at] < threshold or not sums[at] or any(i < n and not sums[i] and any(sums[i:]) for i in (at + 1, at + 2)) and weights[at] < threshold:
            at += 1
            continue
        first = at
        while at < n and sums[at]:
            at += 1
        own = [i for i in range(first, at) if weights[i] >= threshold / WINDOW]
        if own:
            out.append((own[0], own[-1] + 1))
    return out


def main_text(page: str | None) -> str:
    lines = Lines(page or "")
    marked = any(lines.inside)
    weights: list[float] = [max(0, len(t) - n) for t, n in zip(lines.text, lines.linked, strict=True)]
    weights = [3 * w if kind == "p" else w for w, kind in zip(weights, lines.kind, strict=True)]
    if marked:
        weights = [w if inside else 0 for w, inside in zip(weights, lines.inside, strict=True)]
    most = max((sum(weights[i : i + WINDOW]) for i in range(len(weights))), default=0)
    threshold = min(SURGE * most, HIGH) or 1
    lifted = [t and (inside or kind == "h" and not marked and w) for t, w, kind, inside in zip(lines.text, weights, lines.kind, lines.inside, strict=True)]
    weights = [max(w, threshold) if up else w for w, up in zip(weights, lifted, strict=True)]
    return "\n".join(t for a, z in stretches(weights, threshold) for t, inside in zip(lines.text[a:z], lines.inside[a:z], strict=True) if t and (inside or not marked))


def extracted(pages: DataFrame) -> DataFrame:
    """pages with `text` and n_chars instead of html."""
    for_python(pages.sparkSession)
    names = passing(pages, "html", "text", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(len(names)).to_pylist()]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *made], [*names, "text", "n_chars"])

    return pages.select(*names, "html").mapInArrow(run, schema_of(pages, names, "text string, n_chars long"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
