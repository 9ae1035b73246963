"""Fields of an article from a page's markup, in one pass.

A page is read from tag to tag.  Open elements are kept on a stack, with how many of
each name are open, so an end tag without a start costs nothing and every element is
pushed and popped once.  A search that finds no end is not made again.  So the time
is in proportion to the page, whatever is left open in it.

Fixed behaviour: text inside `DROPPED` elements is not part of the article, and inside
`RAW` ones tags are text; a paragraph ends at its end tag, at the start of the next
block, or where an element around it ends; a comment or raw element that is never
closed takes the rest of the page; another dropped element that is never closed ends
with what is around it.  Quoted attribute values may hold `>`; a quote that is never
closed is an ordinary character.
"""

from __future__ import annotations

import re
from html import unescape

RAW = frozenset("script style".split())
DROPPED = RAW | frozenset("nav aside footer form noscript".split())
#: Elements without content or end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose start ends a paragraph.
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_NAME = re.compile(r"[A-Za-z][A-Za-z0-9:_-]*")
_ATTR = re.compile(r"([A-Za-z][\w:.\-]*+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)')")


def plain(parts: list[str]) -> str:
    """Pieces of text as one line, without character references."""
    return " ".join(unescape(" ".join(parts)).split())


class _Ends:
    """Searches in a page; one that has failed fails from then on."""

    def __init__(self, page: str):
        self.page, self.lower, self.never = page, None, set()

    def find(self, what: str, start: int) -> int:
        if what in self.never:
            return -1
        at = self.page.find(what, start)
        if at < 0:
            self.never.add(what)
        return at

    def end_tag(self, name: str, start: int) -> int:
        if self.lower is None:
            self.lower = self.page.lower()  # may differ in length from the page only beyond ASCII
            if len(self.lower) != len(self.page):
                self.lower = re.sub("[A-Z]+", lambda m: m[0].lower(), self.page)
        what = f"</{name}"
        if what in self.never:
            return -1
        at = self.lower.find(what, start)
        if at < 0:
            self.never.add(what)
        return at

    def tag_end(self, start: int) -> int:
        """The place of the `>` that ends a tag, quoted values passed over; -1 without one."""
        at = start
        while True:
            close = self.find(">", at)
            if close < 0:
                return -1
            quotes = [q for q in (self.page.find('"', at, close), self.page.find("'", at, close)) if q >= 0]
            if not quotes:
                return close
            quote = min(quotes)
            other = self.find(self.page[quote], quote + 1)
            if other < 0:
                return close if len(quotes) < 2 or self.find(self.page[max(quotes)], max(quotes) + 1) < 0 else self._past(max(quotes), close)
            at = other + 1

    def _past(self, quote: int, close: int) -> int:
        other = self.find(self.page[quote], quote + 1)
        return close if other < 0 or other < close else self.tag_end(other + 1)


class Page:
    """meta values by name, and the texts of headings, titles and paragraphs of a page, in order."""

    def __init__(self, html: str):
        self.meta: dict[str, str] = {}
        self.texts: dict[str, list[str]] = {"h1": [], "title": [], "p": []}
        self._open: list[str] = []
        self._count: dict[str, int] = {}
        self._dropped = 0
        self._now: dict[str, list[str]] = {}
        self._read(html)

    def _push(self, name: str) -> None:
        self._open.append(name)
        self._count[name] = self._count.get(name, 0) + 1
        self._dropped += name in DROPPED
        if name in self.texts and not self._dropped:
            self._now[name] = []

    def _pop_to(self, name: str) -> None:
        if not self._count.get(name):
            return
        while True:
            last = self._open.pop()
            self._count[last] -= 1
            self._dropped -= last in DROPPED
            if last in self._now and not self._count[last]:
                self.texts[last].append(plain(self._now.pop(last)))
            if last == name:
                return

    def _text(self, piece: str) -> None:
        if piece and not self._dropped:
            for parts in self._now.values():
                parts.append(piece)

    def _read(self, page: str) -> None:
        ends, at, n = _Ends(page), 0, len(page)
        while at < n:
            tag = ends.find("<", at)
            if tag < 0:
                break
            self._text(page[at:tag])
            if page.startswith("<!--", tag):
                close = ends.find("-->", tag + 4)
                at = n if close < 0 else close + 3
                continue
            slash = page.startswith("/", tag + 1)
            name = _NAME.match(page, tag + 1 + slash)
            if not name and not page.startswith(("<!", "<?", "</"), tag):
                self._text("<")
                at = tag + 1
                continue
            close = ends.tag_end(name.end() if name else tag + 2)
            if close < 0:
                self._text(page[tag:])
                at = n
                break
            at = close + 1
            if not name:
                continue
            kind = name[0].lower()
            if slash:
                self._pop_to(kind)
                continue
            if kind == "meta":
                self._meta(page[name.end() : close])
            if kind in BLOCKS:
                self._pop_to("p")
            if kind in VOID or page[close - 1] == "/":
                continue
            self._push(kind)
            if kind in RAW:
                close = ends.end_tag(kind, at)
                at = n if close < 0 else close
        else:
            at = n
        self._text(page[at:])
        while self._open:
            self._pop_to(self._open[-1])

    def _meta(self, attributes: str) -> None:
        a = {k.lower(): x or y for k, x, y in _ATTR.findall(attributes)}
        name = (a.get("property") or a.get("name") or "").lower()
        if name and a.get("content") and not self._dropped:
            self.meta.setdefault(name, unescape(a["content"]).strip())


def page_fields(html: str | None) -> tuple[str, str, str, str, str]:
    """title, body, section, published, authors of a page; empty where there is none."""
    page = Page(html or "")
    title = page.meta.get("og:title") or next(filter(None, page.texts["h1"] + page.texts["title"]), "")
    body = "\n".join(filter(None, page.texts["p"]))
    section = (page.meta.get("article:section") or "").split(",")[0].strip()
    return title, body, section, page.meta.get("article:published_time") or page.meta.get("date") or "", page.meta.get("author") or ""
