"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element. Lines of menus, adverts, forms and the
like stand in no window, and neither do lines outside <article> and <main> on pages that have them.
Another line weighs its characters outside links, or nothing if it is mostly links. Where the sum
of weights over a sliding window of lines rises from nothing is a surge, where it falls to nothing
a dive; the lines between are text if some window among them is heavy enough, or a short page's
all, or if a paragraph among them ends like a sentence.

Pages are read once from beginning to end, whatever is unclosed or malformed: the time taken is in
proportion to their length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import table

#: Lines of a window, and the characters that make a surge.
WINDOW, SURGE = 3, 60
_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)?(?:\s*=\s*)?""")
_PLAIN_VALUE = re.compile(r"[^\s>]*")
#: Their content is no markup.
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_BOILERPLATE = frozenset("nav footer aside form button dialog menu fieldset label head template svg math select option object canvas audio video".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class or id that always mark what is no text, and those that do unless a line is as long as a surge.
_MARKED = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo sidebar comment comments cookie cookies newsletter subscribe menu nav navbar "
    "navigation breadcrumb breadcrumbs pagination pager popup modal disqus".split()
)
_OUTSIDE = frozenset("header footer masthead".split())
_WEAK = frozenset("banner reply replies respond consent notice alert share sharing social related recommended overlay widget toolbar skip".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
_WORD = re.compile(r"[a-z0-9]+")
_SENTENCE = re.compile(r"[.!?\u2026][\"'\u201d\u2019\u00bb)\]]*$")
_RIGHTS = re.compile(r"\s*(?:\u00a9|\(c\)|copyright\b)", re.IGNORECASE)


@dataclass
class Line:
    """A line of text; linked: its characters in links, weak: whether a class or id makes it doubtful."""

    text: str
    linked: int
    skipped: bool
    article: bool
    weak: bool
    paragraph: bool


class _Page:
    """The tags of a page, in one pass."""

    def __init__(self, page: str):
        self.page = page
        # Where no quote follows any more, an attribute that opens with one ends like a plain one.
        self.last = {q: page.rfind(q) for q in "\"'"}
        self.endless: set[str] = set()  # raw elements that are not closed any more

    def tag(self, at: int) -> tuple[str, list[tuple[str, str]], int]:
        """(name, with a slash before it if closing, attributes, end) of the tag at at; the end is beyond the page if it is not closed."""
        page, size = self.page, len(self.page)
        m = _NAME.match(page, at + 1)
        name, at, found = m[0].lower(), m.end(), []
        while at < size and page[at] != ">":
            m = _ATTRIBUTE.match(page, at)
            key, equals, at = m[1], m[0].rstrip().endswith("="), m.end()
            value = ""
            if equals and at < size:
                quote = page[at]
                if quote in self.last and at < self.last[quote]:
                    end = page.index(quote, at + 1)
                    value, at = page[at + 1 : end], end + 1
                else:
                    m = _PLAIN_VALUE.match(page, at)
                    value, at = m[0], m.end()
            if key:
                found.append((key.lower(), value))
            elif not m[0]:
                at += 1  # a character that belongs nowhere
        return name, found, at + 1

    def after_raw(self, name: str, at: int) -> int:
        """Where the content of a raw element that begins at at, and its end tag, are over; the page's end if it is not closed."""
        if name not in self.endless:
            if m := re.compile(rf"</{name}[\s/]*>", re.IGNORECASE).search(self.page, at):
                return m.end()
            self.endless.add(name)
        return len(self.page)


def _mark(attributes: list[tuple[str, str]], within: bool) -> int:
    """2 for an element that holds no text, 1 for a doubtful one, else 0; within: inside the article."""
    mark = 0
    for key, value in attributes:
        if key == "role" and value.strip().lower() in _ROLES:
            return 2
        if key in ("class", "id"):
            words = set(_WORD.findall(value.lower()))
            if words & _MARKED or (not within and words & _OUTSIDE):
                return 2
            if words & _WEAK:
                mark = 1
    return mark


def lines_of(page: str) -> list[Line]:
    """The page's text, a line for each stretch between block elements."""
    out: list[Line] = []
    parts: list[str] = []
    open_: list[tuple[str, bool, bool, bool]] = []  # name, skipped, article, weak
    named: Counter[str] = Counter()
    inside = [0, 0, 0]  # how many open elements are skipped, article, weak
    tags, linked, links, at, size = _Page(page), 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Line(text, linked, inside[0] > 0, inside[1] > 0, inside[2] > 0, bool(open_) and open_[-1][0] == "p"))
        parts.clear()
        linked = 0

    def close(to: int) -> None:
        while len(open_) > to:
            name, *kinds = open_.pop()
            named[name] -= 1
            for k, yes in enumerate(kinds):
                inside[k] -= yes

    while at < size:
        begin = page.find("<", at)
        while begin >= 0 and not (page[begin + 1 : begin + 2] in ("!", "?") or _NAME.match(page, begin + 1)):
            begin = page.find("<", begin + 1)  # a plain character
        end = begin if begin >= 0 else size
        if end > at:
            parts.append(page[at:end])
            linked += (end - at) * bool(links)
        if begin < 0:
            break
        if page[begin + 1] in "!?":
            stop = "-->" if page.startswith("<!--", begin) else ">"
            at = page.find(stop, begin + len(stop))
            at = size if at < 0 else at + len(stop)
            continue
        name, attributes, at = tags.tag(begin)
        closing, name = name[0] == "/", name.lstrip("/")
        if name in _RAW:
            if not closing:
                at = tags.after_raw(name, at)
            continue
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
        inline = name in _INLINE
        if not inline:
            flush()
            links = 0
        elif name == "br":
            parts.append(" ")
        if name in _VOID:
            continue
        if closing:
            if named[name]:
                where = len(open_) - 1
                while open_[where][0] != name:
                    where -= 1
                if inline:
                    flush()
                close(where)
            continue
        if name in ("p", "li", "option") and open_ and open_[-1][0] == name:
            close(len(open_) - 1)
        if name == "body":  # ends a head that was left open
            close(next((k for k, x in enumerate(open_[:8]) if x[0] == "head"), len(open_)))
        article = name in ("article", "main")
        mark = 0 if article or name in ("html", "body") else _mark(attributes, inside[1] > 0)
        skipped = name in _BOILERPLATE or (name == "header" and not inside[1]) or mark == 2
        if inline and not skipped:
            continue
        if inline:
            flush()
        open_.append((name, skipped, article, mark == 1))
        named[name] += 1
        for k, yes in enumerate((skipped, article, mark == 1)):
            inside[k] += yes
    flush()
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text: its blocks in page order, joined by an empty line; empty for null or empty pages."""
    lines = [x for x in lines_of(page or "") if not x.skipped and not (x.weak and len(x.text) - x.linked < surge)]
    if any(x.article for x in lines):
        lines = [x for x in lines if x.article]
    weight = [0 if x.linked * 2 > len(x.text) and not x.article else max(1, len(x.text) - x.linked) for x in lines]
    blocks = [sum(weight[i : i + window]) for i in range(len(lines))]
    need = min(surge, sum(weight))
    keep: list[str] = []
    at = 0
    while at < len(lines):
        if not weight[at]:
            at += 1
            continue
        dive = at
        while dive < len(lines) and blocks[dive]:
            dive += 1
        run = lines[at:dive]
        if max(blocks[at:dive]) >= need or any(x.paragraph and _SENTENCE.search(x.text) and not _RIGHTS.match(x.text) for x in run):
            keep += [x.text for x in run]
        at = dive
    return "\n\n".join(keep)


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages; other columns are not read, whatever their names.

    Null and empty html gives an empty text; null ids and urls stay; repeated rows each get their own
    result; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: its main text and its length."""
    return extract_text(table(spark, sf_dir, "pages"))
