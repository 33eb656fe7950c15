"""Main text of web pages by their line-block distribution.

Markup is stripped into lines, one per block element. Each line weighs as many
characters as it has outside links. Sums over a sliding window of lines show
where text is dense: a region lies between two dives, where the sum falls to
zero, and is kept if the sum surges somewhere in it.

Tags are evidence for the distribution and no way around it. Elements that by
tag, role or class are no article (menus, footers, forms, adverts, comments)
become empty lines. If the page has an article or main element of some mass, its
lines weigh all their characters and lines elsewhere a quarter of theirs; a
region elsewhere is kept only if it is as dense as the densest inside. Marks of
role and class count for articles, too, and for what holds them: a comment or a
card in an article element goes. Where every article is marked or inside
something marked, the one that holds most of the text, and what is around it,
lose their marks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines per window; the sum at which text surges, or half the page's largest sum if that is less.
WINDOW, SURGE = 3, 86
#: What lines outside an article or main element weigh, if there is one.
OUTSIDE = 0.25

_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
_RAW = "script|style|textarea|title|noscript|template|iframe|svg|xmp|noembed|noframes|object|canvas|select"
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    rf"""|<(?P<raw>{_RAW})\b{_ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)"""
    rf"""|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attributes>{_ATTRIBUTES})>"""
    r"""|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)[^>]*(?:>|\Z)""",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead "
    "tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset(["article", "main"])
NEVER = frozenset("head nav footer aside form button menu dialog datalist optgroup option label audio video map".split())
#: Words in a class, id or role that mark what is no article; the second group counts outside an article only.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert menu nav navbar navigation breadcrumb breadcrumbs sidebar aside complementary footer contentinfo toolbar "
    "comment comments disqus respond replies share sharing social newsletter subscribe signup login popup modal overlay related "
    "recommended recommendations pagination pager search widget paywall".split())
OUTER_MARKS = frozenset("header masthead topbar".split())
#: A class with one of these says what the element has or lacks, not what it is.
NEUTRAL = frozenset("open closed no has with without".split())
_ENDS_ITSELF = {"p": BLOCKS, "li": frozenset(["li", "ul", "ol"]), "dt": frozenset(["dt", "dd", "dl"]), "dd": frozenset(["dt", "dd", "dl"])}


def _named(token: re.Match) -> tuple[str, bool]:
    """The tag of a token, empty for comments and raw elements, and whether it ends an element."""
    return (token["tag"] or token["tag2"] or "").lower(), bool(token["end"] or token["end2"])


def _ends(tokens: list[re.Match]) -> list[int]:
    """For each start tag the number of the token that ends its element, by the rules that skipping follows."""
    ends = [len(tokens)] * len(tokens)
    opened: dict[str, list[int]] = {}
    for j, token in enumerate(tokens):
        tag, ending = _named(token)
        if not tag or tag in VOID and tag != "hr":
            continue
        over = [t for t, by in _ENDS_ITSELF.items() if opened.get(t) and tag in by and not (tag == t and ending)]
        if tag == "body" or ending and tag == "html":
            over = list(opened)
        for t in over:
            for i in opened.pop(t, ()):
                ends[i] = j
        if not ending:
            opened.setdefault(tag, []).append(j)
        elif opened.get(tag):
            ends[opened[tag].pop()] = j
    return ends


def _attribute_marks(attributes: str) -> tuple[bool, bool, bool]:
    """Whether attributes hide an element, mark it as no article, and mark it so only outside an article."""
    marked = outer = False
    if not attributes or attributes.isspace():
        return False, False, False
    for name, *values in _NAMES.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, marked, outer
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, marked, outer
        elif name != "aria-hidden":
            for one in value.split():
                words = {w.lower() for w in _SPLIT.split(one)}
                if not words & NEUTRAL:
                    marked |= bool(words & MARKS)
                    outer |= bool(words & OUTER_MARKS)
    return False, marked, outer


def _unmarked(page: str, tokens: list[re.Match]) -> set[int]:
    """Numbers of start tags whose marks do not count: of the article that holds most text, if all are marked, and around it."""
    content = [i for i, t in enumerate(tokens) if _named(t) in (("article", False), ("main", False))]
    if not content:
        return set()
    ends = _ends(tokens)
    starts = [i for i, t in enumerate(tokens) if _named(t)[0] and not _named(t)[1] and _named(t)[0] not in VOID]
    gone, marked, at = [], [], 0
    for i in starts:
        tag = _named(tokens[i])[0]
        hidden, by_mark, _ = _attribute_marks(tokens[i]["attributes"] or "")
        while at < len(content) and content[at] < i:
            at += 1
        holds = tag in CONTENT or at < len(content) and content[at] < ends[i]
        if tag in ("html", "body"):
            continue
        if tag in NEVER or hidden or by_mark and not holds:
            gone.append(i)
        elif by_mark:
            marked.append(i)

    def covered(starts_of: list[int]) -> list[int]:
        """At k: how many of these elements the text before token k is in."""
        change = [0] * (len(tokens) + 2)
        for i in starts_of:
            change[i + 1] += 1
            change[ends[i] + 1] -= 1
        return np.cumsum(change).tolist()

    never, under = covered(gone), covered(marked)
    last, lengths = 0, []
    for token in [*tokens, None]:
        lengths.append(len(page[last:token.start() if token else len(page)].strip()))
        last = token.end() if token else last
    all_text = np.cumsum([0, *[n if not c else 0 for n, c in zip(lengths, never)]])
    clear_text = np.cumsum([0, *[n if not c and not u else 0 for n, c, u in zip(lengths, never, under)]])
    mass = lambda total, i: int(total[min(ends[i], len(tokens)) + 1] - total[i + 1])  # noqa: E731  text between the tags
    free = [i for i in content if not never[i + 1] or i in gone]
    most = max((mass(all_text, i) for i in free), default=0)
    if not most or max(mass(clear_text, i) for i in free) >= min(SURGE, most / 3):
        return set()
    best = [i for i in free if mass(all_text, i) >= most / 2][-1]
    return {i for i in marked if i <= best < ends[i]}


def _is_boilerplate(tag: str, attributes: str, in_content: bool, unmarked: bool) -> bool:
    if tag in ("html", "body"):
        return False
    if tag in NEVER or tag == "header" and not in_content:
        return True
    hidden, marked, outer = _attribute_marks(attributes)
    return hidden or not unmarked and (marked or outer and not in_content and tag not in CONTENT)


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters outside links, inside an article) of each line; boilerplate outside articles is ``WINDOW`` empty lines."""
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    outside_links = content = links = 0
    skipped, depth = "", 0

    def gap() -> None:
        lines.extend([("", 0, False)] * WINDOW)

    def close() -> None:
        nonlocal outside_links
        text = " ".join("".join(parts).split())
        if text:
            lines.append((text, min(outside_links, len(text)), content > 0))
        parts.clear()
        outside_links = 0

    def add(text: str) -> None:
        nonlocal outside_links
        if "&" in text:
            text = html.unescape(text)
        parts.append(text)
        if not links:
            outside_links += len(text) - sum(map(text.count, " \n\t\r"))

    tokens = list(_TOKEN.finditer(page))
    unmarked = _unmarked(page, tokens)
    at = 0
    for number, token in enumerate(tokens):
        if not skipped and token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        tag, ending = _named(token)
        if not tag:
            continue
        if skipped:
            ended = tag in _ENDS_ITSELF.get(skipped, ()) and not (tag == skipped and ending)
            if tag == skipped and not ended:
                depth += -1 if ending else 1
            elif tag == "body" or ending and tag == "html":
                depth = 0
            if depth > 0 and not ended:
                continue
            skipped = ""
            if not ended:
                continue
        if ending:
            if tag in CONTENT and content:
                close()
                content -= 1
                if not content:
                    gap()
            elif tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                close()
            continue
        if tag == "br" or tag in ("td", "th"):
            parts.append(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        if _is_boilerplate(tag, token["attributes"] or "", content > 0, number in unmarked):
            if tag in BLOCKS:
                close()
            if not content:
                close()
                gap()
            skipped, depth = tag, 1
        elif tag in CONTENT:
            close()
            if not content:
                gap()
            content += 1
        elif tag == "a":
            links += 1
        elif tag in BLOCKS:
            close()
            links = 0
    if not skipped:
        add(page[at:])
    close()
    return lines


def window_sums(lines: list[tuple[str, int, bool]]) -> np.ndarray:
    """Weighted characters in each window of lines; at i: the window that ends with line i."""
    has_content = any(inside and text for text, _, inside in lines)
    weights = [len(text) if inside else w * OUTSIDE if has_content else w for text, w, inside in lines]
    return np.convolve(np.array(weights, float), np.ones(WINDOW)) if lines else np.zeros(0)


def main_text(page: str | None) -> str:
    """The text between surge and dive, one line per block."""
    lines = page_lines(page or "")
    sums = window_sums(lines)
    if not sums.any():
        return ""
    top = sums.max()
    surge = min(SURGE, top / 2)
    has_content = any(inside and text for text, _, inside in lines)
    kept, start = [], None
    for i, total in enumerate([*sums.tolist(), 0]):
        if total and start is None:
            start = i
        elif not total and start is not None:
            inside = any(line[2] for line in lines[start:i])
            if sums[start:i].max() >= (surge if inside or not has_content else max(surge, top * OUTSIDE)):
                kept += [text for text, _, _ in lines[start:i] if text]
            start = None
    return "\n".join(kept)


def extract(page: Column) -> Column:
    """The main text of each page of a column; null and empty pages give the empty text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(main_text)

    return run(page)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` in place of the markup; every other column but a former ``text`` and repeated rows stay as they are."""
    others = [c for c in pages.columns if c not in (html_col, "text")]
    return pages.select(*others, extract(F.col(html_col)).alias("text"))
