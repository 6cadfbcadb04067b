"""Main text of HTML pages by the line-block distribution.

The markup is stripped into lines, one a block element, each with the number of its characters outside links. Over these runs a window of
`WINDOW` lines: where its sum rises to `SURGE` characters (or half the page's largest sum, if that is less) stands a surge point, where it
falls below an eighth of that a dive point, and the lines between are a region. A line that is mostly links counts nothing, so menus and
lists of links lie between regions. The region with the most text is kept, with any other that has at least `SHARE` of its text; at a
region's ends, lines without text of their own and loose ones (short, and no paragraph, heading or item) are trimmed.

Markup helps in two ways. What stands in elements that never hold the article (scripts, styles, navigation, footers, asides) is left out
before, and so are elements that a tag, class, id or role hints at (headers, forms, adverts, notices, comments), but not one that holds
most of the page's text. Where the page marks its article, what stands in that mark is kept without regard to the distribution.

Blocks are joined by two line feeds; a line break inside a block is white space. Defined cases: a null or empty html, or one without text,
gives the empty string and 0; if no window rises at all, all text that isn't left out or in links is kept; unclosed and misnested tags
close with the next end tag of an outer element or at the end of the page; repeated rows give repeated results; other columns are not
looked at. The work is linear in the page's length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

WINDOW = 3
SURGE = 80
SHARE = 0.2
#: Lines of fewer characters can be loose.
LOOSE = 30
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Elements whose content is no text of the page: read up to their end tag, or left out with all they hold.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: They end a block.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td template tfoot th thead tr ul".split())
#: They never hold the article.
NEVER = set("nav footer aside button select option input menu template noscript iframe object embed audio video canvas svg map head script style textarea title".split())
#: They hold something else, unless they hold most of the text.
HINT = set("header form fieldset label dialog".split())
HINT_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "status"}
#: Words of a class or id that say the same.
HINT_WORD = set("ad ads advert adverts advertisement advertising advertorial adsense sponsor sponsored sponsors promo promoted promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer header masthead cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus replies reply respond popup modal overlay pagination pager toolbar widget widgets skip copyright legal disclaimer".split())
#: Blocks that an article is made of, however short.
PROSE = set("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd td th figcaption caption".split())
#: A paragraph ends where a block begins; the others end at their like.
P_ENDS = BLOCK


def mark_of(tag: str, attributes: str) -> str:
    """What an element says of its content: never, hint, article, main, or nothing."""
    if tag in NEVER:
        return "never"
    kind = "hint" if tag in HINT else tag if tag in ("article", "main") else ""
    if kind == "hint" or not attributes or "=" not in attributes and "hidden" not in attributes:
        return kind
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        # an article is a comment or an advert by a whole name only, not as one "with-sidebar"
        if name in ("class", "id") and tag not in ("html", "body", "main") and not HINT_WORD.isdisjoint(value.split() if tag == "article" else re.split(r"[^a-z0-9]+", value)):
            return "hint"
        if name == "role" and value in HINT_ROLE or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return "hint"
        if name == "role" and value in ("main", "article"):
            kind = value
    return kind


class Page:
    """lines: the blocks in order, as pieces (text, mark, whether in a link) and the block's tag; marks: (kind, tag, mark around) of elements."""

    def __init__(self, html: str) -> None:
        self.lines: list[tuple[list[tuple[str, int, bool]], str]] = []
        self.marks: list[tuple[str, str, int]] = [("", "", -1)]
        parts: list[tuple[str, int, bool]] = []
        stack: list[tuple[str, int]] = []  # tag, the mark around it
        open_: Counter = Counter()
        at = here = 0
        block = ""

        def end_block() -> None:
            if parts and any(not x.isspace() for x, _, _ in parts):
                self.lines.append((parts.copy(), block))
            parts.clear()

        def pop() -> None:
            nonlocal here
            tag, here = stack.pop()
            open_[tag] -= 1

        for m in TOKEN.finditer(html):
            if m.start() < at:
                continue
            if m.start() > at:
                parts.append((html[at : m.start()], here, open_["a"] > 0))
            at = m.end()
            tag = m[2]
            if tag is None:
                if m[0].startswith("<![CDATA["):
                    parts.append((m[0][9:-3].replace("&", "&amp;"), here, open_["a"] > 0))
                continue
            tag = tag.lower()
            if m[1]:
                if tag in BLOCK:
                    end_block()
                if open_[tag]:
                    # an inline end tag doesn't close the blocks that were opened inside it
                    while stack[-1][0] != tag and (tag in BLOCK or stack[-1][0] not in BLOCK):
                        pop()
                    if stack[-1][0] == tag:
                        pop()
                continue
            if tag in RAW:
                if tag in ("textarea", "title"):
                    end_block()
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = close.end() if close else len(html)
                continue
            if tag == "br":
                parts.append((" ", here, False))
                continue
            if tag in BLOCK:
                end_block()
                block = tag
                if stack and (stack[-1][0] == "p" and tag in P_ENDS or stack[-1][0] == tag and tag in ("li", "dd", "dt", "td", "th", "tr", "option")):
                    pop()
            if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
                continue
            stack.append((tag, here))
            open_[tag] += 1
            if kind := mark_of(tag, m[3]):
                self.marks.append((kind, tag, here))
                here = len(self.marks) - 1
        if at < len(html):
            parts.append((html[at:], here, False))
        end_block()

    def weigh(self) -> list[int]:
        """Characters outside links in each mark, with all that it holds."""
        out = [0] * len(self.marks)
        for parts, _ in self.lines:
            for text, mark, link in parts:
                if not link:
                    out[mark] += len(" ".join(text.split()))
        for k in range(len(out) - 1, 0, -1):
            out[self.marks[k][2]] += out[k]
        return out


def left_out(marks: list[tuple[str, str, int]], weight: list[int]) -> list[bool]:
    """By mark whether its content is left out: under what never holds the article, or under a hint that doesn't hold most of the text."""
    n = len(marks)
    never, hinted, in_article = [False] * n, [False] * n, [0] * n
    for k in range(1, n):
        kind, tag, up = marks[k]
        never[k] = never[up] or kind == "never"
        in_article[k] = k if kind in ("article", "main") else in_article[up]
        # an article's own header holds its title
        hinted[k] = hinted[up] or kind == "hint" and not (tag == "header" and in_article[up])
    total = weight[0] - sum(weight[k] for k in range(1, n) if never[k] and not never[marks[k][2]])
    # with an article outside all hints they are believed, however much they hold, but for those inside one that hold most of it
    plain = any(marks[k][0] in ("article", "main") and weight[k] and not never[k] and not hinted[k] for k in range(1, n))
    out = never
    for k in range(1, n):
        kind, tag, up = marks[k]
        most = weight[in_article[up]] if in_article[up] and not hinted[up] else total
        believed = plain and not in_article[up] or 2 * weight[k] <= most
        out[k] = out[k] or out[up] or kind == "hint" and not (tag == "header" and in_article[up]) and believed
    return out


def chosen(marks: list[tuple[str, str, int]], weight: list[int], out: list[bool], share: float) -> set[int] | None:
    """The marks whose content is the marked article, None if there is none."""
    inside = [False] * len(marks)
    articles, mains = [], []
    for k in range(1, len(marks)):
        kind, _, up = marks[k]
        if kind == "article" and not inside[up] and not out[k] and weight[k]:
            articles.append(k)
        if kind == "main" and not out[k] and weight[k]:
            mains.append(k)
        inside[k] = inside[up] or kind == "article"
    best = max((weight[k] for k in articles), default=0)
    whole = max((weight[k] for k in mains), default=0)
    if best and best >= share * whole:
        picked = {k for k in articles if weight[k] >= share * best}
    else:
        picked = set(mains)
    if not picked:
        return None
    for k in range(1, len(marks)):
        if marks[k][2] in picked:
            picked.add(k)
    return picked


def sums(lengths: list[int], window: int = WINDOW) -> list[int]:
    """Around each line, the sum over the window that it stands in the middle of."""
    before, total = window // 2, [0]
    for x in lengths:
        total.append(total[-1] + x)
    return [total[min(len(lengths), i - before + window)] - total[max(0, i - before)] for i in range(len(lengths))]


def regions(lengths: list[int], window: int = WINDOW, surge: float = SURGE) -> list[tuple[int, int]]:
    """From the surge points to the dive points: [first, end) of every run of lines that reaches the surge and doesn't dive in between."""
    around = sums(lengths, window)
    rise = min(surge, max(around, default=0) / 2)
    out, first, risen = [], None, False
    for i, x in enumerate([*around, 0]):
        if x and x >= rise / 8:
            first, risen = i if first is None else first, risen or x >= rise
        elif first is not None:
            if risen:
                out.append((first, i))
            first, risen = None, False
    return out


def main_text(html: str | None, window: int = WINDOW, surge: float = SURGE, share: float = SHARE) -> str:
    if not html:
        return ""
    page = Page(html)
    weight = page.weigh()
    out = left_out(page.marks, weight)
    inside = chosen(page.marks, weight, out, share)
    lines: list[tuple[str, int, bool]] = []  # text, characters outside links, whether loose
    for parts, tag in page.lines:
        own = [(x, link) for x, mark, link in parts if not out[mark] and (inside is None or mark in inside)]
        if text := " ".join(unescape("".join(x for x, _ in own)).split()):
            linked = sum(len(" ".join(x.split())) for x, link in own if link)
            lines.append((text, 0 if 2 * linked >= len(text) else len(text) - linked, tag not in PROSE and len(text) < LOOSE))
    if inside is None:
        lengths = [n for _, n, _ in lines]
        found = []
        for a, b in regions(lengths, window, surge):
            while a < b and (not lengths[a] or lines[a][2]):
                a += 1
            while a < b and (not lengths[b - 1] or lines[b - 1][2]):
                b -= 1
            found.append((a, b))
        most = max((sum(lengths[a:b]) for a, b in found), default=0)
        if most:
            lines = [lines[i] for a, b in found if sum(lengths[a:b]) >= share * most for i in range(a, b)]
        else:
            lines = [x for x in lines if x[1]]
    return "\n\n".join(text for text, _, _ in lines)


def extract(pages: DataFrame, window: int = WINDOW, surge: float = SURGE, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, window, surge, share) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


op1 = extract
