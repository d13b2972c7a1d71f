"""Operator 1: main text of web pages by line-block distribution.

``strip_markup`` turns a page into lines, one per block element, in one forward scan. What markup names as no text
(script, style, head, menus, page headers, footers, asides, forms; by element, role or hidden) leaves empty
lines. Containers whose class or id words sound like boilerplate (adverts, notices, reader comments) are marked and
judged by their text. A line's weight is its text length without link text. ``main_lines`` sums weights over sliding windows of
lines; text begins where the sum rises to the threshold on a weighted line (surge) and ends
before the first line with no weight (dive); the lines between are kept. In an ``article`` or ``main``
links count, and every line weighs ``SURGE`` more, which is a surge by itself; all other lines of the page are
judged by the same windows. Lines of a marked container have no weight, unless its best window holds ``SUSPECT`` times the text of
the best window of all unmarked lines: then it holds the story, and counts like any other.

Cases: null or empty html gives the empty text; markup cut off at the end of a page is
dropped; after a quote in a tag that never closes, tags end at the first ``>``; a page with no text gives the empty text;
repeated pages are extracted each; null ``page_id`` or ``url`` stay null. Time grows with the length of a page,
malformed ones included.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomescope.llm.common import table
from tomescope.session import ship_package

WINDOW = 3
SURGE = 86
SUSPECT = 4

_OPEN = re.compile(r"<(/?)([a-zA-Z][\w:.-]*)")
_STOP = re.compile(r"""[>"']""")
_NOT_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(?<![\w:-])(?:([\w:-]++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)|(hidden)(?![\w:-]))""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select")}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
_OUT = {"head", "nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices "
    "sidebar aside nav navbar navigation menu breadcrumb breadcrumbs masthead topbar footer comment comments reply replies disqus respond "
    "share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget copyright pagination pager".split()
)


#: class words that say nothing about what a container holds
_NEUTRAL = set("area bar block body box button buttons container content form global group header heading inner item items left link links list main page panel primary right section secondary site text title top bottom wrap wrapper".split())
PLAIN, MARKED, OUT = 0, 1, 2


def _boilerplate(name: str, attrs: str, in_root: bool) -> int:
    """``OUT`` by element, role or hidden; ``MARKED`` by class or id: a word of the list, and beside it only neutral ones."""
    if name in _OUT or name == "header" and not in_root:
        return OUT
    if not attrs or name in ("html", "body", "article", "main") and "comment" not in attrs:
        return PLAIN
    marked = PLAIN
    for key, value, hidden in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if hidden or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return OUT
        if key == "role" and value.lower() in _ROLES:
            return OUT
        if key in ("class", "id"):
            for token in value.split():
                words = {w.lower() for w in _WORD.findall(token)}
                head = "header" in words and not in_root and not name.startswith("h")
                if (words & _WORDS or head) and not words - _WORDS - _NEUTRAL:
                    marked = MARKED
    return marked


class _Tags:
    """Tags of a page from left to right. Each character is passed once: what is not found once is not looked for again."""

    def __init__(self, page: str):
        self.page, self.last, self.quotes, self.unclosed = page, page.rfind(">"), True, set()

    def next(self, at: int):
        """``(start, end, closing, name, attributes)`` of the next tag, or None."""
        while m := _OPEN.search(self.page, at):
            if m.start() > self.last:
                return None
            end = self._end(m.end())
            if end >= 0:
                return m.start(), end + 1, bool(m[1]), m[2].lower(), self.page[m.end() : end]
            at = m.end()
        return None

    def _end(self, at: int) -> int:
        if self.quotes:
            spot = at
            while m := _STOP.search(self.page, spot):
                if m[0] == ">":
                    return m.start()
                close = self.page.find(m[0], m.end())
                if close < 0:
                    break
                spot = close + 1
            self.quotes = False
        return self.page.find(">", at)

    def after_raw(self, name: str, at: int, attrs: str) -> int:
        """Where the content of a script, style or the like ends."""
        if name not in self.unclosed:
            if close := _RAW[name].search(self.page, at):
                return close.end()
            self.unclosed.add(name)
        return at if attrs.endswith("/") else len(self.page)


def strip_markup(page: str) -> list[tuple[str, int, int, int]]:
    """Lines of ``(text, characters of link text, root, marked)``; ``root`` numbers the article or main a line is in, ``marked`` the
    marked container (0: none)."""
    lines: list[tuple[str, int, int, int]] = []
    held: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, bool, int, int]] = []  # element, out, root, marked
    open_now: Counter[str] = Counter()
    roots = marks = 0
    page = _NOT_TAG.sub("", page)
    cut = page.rfind("<")
    if cut > page.rfind(">") and re.match(r"</?[a-zA-Z]|<!?$|</$", page[cut:]):
        page = page[:cut]
    tags = _Tags(page)

    def clean(parts: list[str]) -> str:
        return " ".join(html.unescape("".join(parts)).split())

    def end_line() -> None:
        if held:
            if text := clean(held):
                _, _, root, mark = stack[-1] if stack else ("", False, 0, 0)
                lines.append((text, len(clean(links)), root, mark))
            held.clear()
            links.clear()

    def gap() -> None:
        lines.extend([("", 0, 0, 0)] * WINDOW)

    def leave(k: int) -> None:
        """Closes the elements from place ``k`` on; an end of boilerplate leaves a gap."""
        was_out, was_marked = stack[-1][1], stack[-1][3]
        for name, *_ in stack[k:]:
            open_now[name] -= 1
        del stack[k:]
        _, out, _, mark = stack[-1] if stack else ("", False, 0, 0)
        if was_out and not out or was_marked and was_marked != mark and not out:
            gap()

    at, n = 0, len(page)
    while at < n:
        tag = tags.next(at)
        _, out, root, mark = stack[-1] if stack else ("", False, 0, 0)
        text = page[at : tag[0] if tag else n]
        if text and not out:
            held.append(text)
            if open_now["a"]:
                links.append(text + " ")
        if not tag:
            break
        _, at, closing, name, attrs = tag
        if name in _RAW:
            if not closing:
                at = tags.after_raw(name, at, attrs)
            continue
        if name in _BLOCK and not out:
            end_line()
        elif name == "br" and not out:
            held.append(" ")
        if closing:
            if open_now[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                if stack[-1][3] and stack[-1][3] != (stack[k - 1][3] if k else 0):
                    end_line()
                leave(k)
            continue
        if name in _VOID or attrs.endswith("/"):
            continue
        if name in _BLOCK:
            closes = _CLOSES.get(name, {"p"})
            while stack and stack[-1][0] in closes:
                leave(len(stack) - 1)
            _, out, root, mark = stack[-1] if stack else ("", False, 0, 0)
        kind = OUT if out else _boilerplate(name, attrs, root > 0)
        if kind != OUT and name in ("article", "main") and not root:
            roots += 1
            root = roots
        new = kind == MARKED and not mark
        if kind == OUT and not out or new:
            end_line()
            gap()
        if new:
            marks += 1
            mark = marks
        stack.append((name, kind == OUT, root, mark))
        open_now[name] += 1
    end_line()
    return lines


def window_sums(weight: list[int], window: int = WINDOW) -> list[int]:
    """Sum of each line's weight and those of the next lines of its window."""
    total = [0, *accumulate(weight)]
    return [total[min(i + window, len(weight))] - total[i] for i in range(len(weight))]


def line_weights(lines: list[tuple[str, int, int, int]], window: int = WINDOW) -> list[int]:
    """Text lengths without link text; 0 in marked containers whose windows do not stand out."""
    weight = [len(t) if root else len(t) - k if 2 * k <= len(t) else 0 for t, k, root, _ in lines]
    marked: dict[int, list[int]] = {}
    for w, (*_, mark) in zip(weight, lines, strict=True):
        if mark:
            marked.setdefault(mark, []).append(w)
    if not marked:
        return weight
    plain = max(window_sums([0 if mark else w for w, (*_, mark) in zip(weight, lines, strict=True)], window), default=0)
    peaks = {mark: max(window_sums(w, window)) for mark, w in marked.items()}
    story = {mark for mark, peak in peaks.items() if peak >= SURGE and peak >= SUSPECT * plain}
    return [w if not mark or mark in story else 0 for w, (*_, mark) in zip(weight, lines, strict=True)]


def main_lines(lines: list[tuple[str, int, int, int]], window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """The lines between surge and dive points of the windowed weights."""
    weight = line_weights(lines, window)
    least = max(1, min(surge, max(window_sums(weight, window), default=0) // 4))
    sums = window_sums([w + surge if root and w else w for w, (_, _, root, _) in zip(weight, lines, strict=True)], window)
    kept: list[str] = []
    inside = False
    for (text, *_), w, total in zip(lines, weight, sums, strict=True):
        inside = w > 0 and (inside or total >= least)
        if inside:
            kept.append(text)
    return kept


def main_text(page: str | None) -> str:
    return "\n\n".join(main_lines(strip_markup(page))) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every page; one pass, no shuffle."""

    def run(batches):
        for b in batches:
            text = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    ship_package(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
