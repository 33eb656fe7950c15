"""Extraction against a tree walk over whole tables, and pages made to mislead it."""

import html
from html.parser import HTMLParser

import pytest

from gridsurvey.llm import html_extract, queries
from gridsurvey.llm.html_extract import extract_pages, main_text


class ArticleText(HTMLParser):
    """Blocks of the article element of the given pages, by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.inside, self.blocks, self.now = False, [], ""

    def flush(self):
        if self.inside and self.now.split():
            self.blocks.append(" ".join(html.unescape(self.now).split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "article"):
            self.flush()
        if tag == "article":
            self.inside = True

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.flush()
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        self.now += data

    def handle_entityref(self, name):
        self.now += "&" + name + ";" if self.rawdata.startswith("&" + name + ";", self.offset_of(name)) else "&" + name

    def offset_of(self, name):
        line, column = self.getpos()
        starts = [0]
        for part in self.rawdata.split("\n")[: line - 1]:
            starts.append(starts[-1] + len(part) + 1)
        return starts[line - 1] + column

    def handle_charref(self, name):
        self.now += f"&#{name};"


def expected(page):
    parser = ArticleText()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return "\n".join(parser.blocks)


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_whole_table(spark, table):
    path = f"/root/testdata/{table}"
    pages = {r.page_id: r for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    rows = queries.QUERIES["op8_html_extract"](spark, path).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == expected(pages[r.page_id].html), r.page_id
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))


LONG = "This sentence belongs to the story and is long enough for the text to surge here, as stories do. "


@pytest.mark.parametrize("page,text", [
    ("", ""), (None, ""), ("   ", ""), ("just text", "just text"), ("a &lt;b&gt; &amp;amp; &copy;&nbsp; c", "a <b> &amp; © c"),
    ("<p>One<p>Two<br>Three <b>bo</b>ld", "One\nTwo Three bold"),
    ("<script>if (a<b) x='<p>no</p>'</script><p>Yes", "Yes"), ("<p>Cut off <a href='x", "Cut off"),
    ("<!-- <p>no</p> --><p>Yes</p><!-- open <p>no", "Yes"),
    (f"<nav><ul><li><a>Menu</a></ul></nav><div class='cookie-notice'>{LONG}</div><article><header><h1>T</h1></header><p>Of.<p>Is."
     f"<div class=ad>{LONG}</div><p>{LONG}<section id=comments><p>{LONG}</section><p>End.</article><aside>{LONG}</aside>",
     f"T\nOf.\nIs.\n{LONG.strip()}\nEnd."),
    # no article element: dense text is kept, links and thin lines around it are not
    ("<div>" + "".join(f"<div><a href='/{i}'>Some section with a name {i}</a></div>" for i in range(9)) + f"</div><h1>Title</h1><p>{LONG}"
     f"<p>Short.<p>{LONG}" + "".join(f"<p><a>Another link to somewhere {i}</a>" for i in range(9)) + "<p>Imprint",
     # a window reaches up to two linked lines at either edge
     f"Title\n{LONG.strip()}\nShort.\n{LONG.strip()}\nAnother link to somewhere 0\nAnother link to somewhere 1"),
    (f"<form><p>{LONG}</p></form><main><h2>H</h2><table><tr><td>a<td>b</table></main><footer>{LONG}", "H\na b"),
    (f"<p class=advert>{LONG}<p>Real text", "Real text"),
])
def test_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page,text", [
    (f"<div class='content-sidebar-wrap'><main><p>{LONG}</main></div><div class=sidebar><p>{LONG}</div>", LONG.strip()),
    (f"<div id=page class='no-sidebar'><div class=widget>{LONG}</div><article><p>{LONG}</article></div>", LONG.strip()),
    (f"<main class='search-results'><p>{LONG}</main>", LONG.strip()),
    (f"<article class='post comments-open'><p>{LONG}<div class=comments><p>{LONG}</div></article>", LONG.strip()),
    (f"<ul class=menu><li class=widget><article><p>{LONG}</article></ul><p class=ad>{LONG}", LONG.strip()),
    (f"<div class=ad><div>{LONG}</div></div><div class=sidebar>{LONG}</div><main><p>Text</main>", "Text"),
    # link-only lines inside an article are part of it, and so is a short tail
    (f"<article><p>{LONG}" + "".join(f"<p><a href='/{i}'>Source {i}</a>" for i in range(5)) + "<p>End.</article>",
     "\n".join([LONG.strip(), *[f"Source {i}" for i in range(5)], "End."])),
])
def test_articles_stay_whole(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page,text", [
    # the story is not in the article
    (f"<div class=story><p>{LONG}<p>{LONG}</div><article class=teaser>Other story</article>", f"{LONG.strip()}\n{LONG.strip()}"),
    # comments and cards are articles, too
    (f"<main><article><h1>T</h1><p>{LONG}</article><div id=comments><ol><li class=comment><article class=comment-body><p>{LONG * 3}"
     "</article></ol></div></main>", f"T\n{LONG.strip()}"),
    (f"<article><p>{LONG}</article><div class=related-posts><article class=card><p>{LONG}</article></div>", LONG.strip()),
    (f"<main class=search-results><h1>Found</h1><article class='post comments-open'><p>{LONG}</article></main>", f"Found\n{LONG.strip()}"),
    (f"<div class=sidebar><article class=comment><p>{LONG}</article></div><div class=widget><article><p>{LONG * 2}</article></div>", (LONG * 2).strip()),
    # an unmarked line beside an article of some length is left out, a denser story is not
    (f"<p>Buy this one thing now, it is the best that was ever made for you.<article><p>{LONG}<p>{LONG}</article>", f"{LONG.strip()}\n{LONG.strip()}"),
    (f"<section><p>{LONG * 4}</section><article><p>{LONG}</article>", f"{(LONG * 4).strip()}\n{LONG.strip()}"),
])
def test_articles_are_evidence_only(page, text):
    assert main_text(page) == text


def slow_text(lines):
    """Regions by looking at every window that touches each line."""
    weight = {True: lambda t, w: len(t), False: lambda t, w: w * (html_extract.OUTSIDE if any(x[2] and x[0] for x in lines) else 1)}
    weights = [weight[inside](t, w) for t, w, inside in lines]
    size = html_extract.WINDOW
    window = [sum(weights[max(0, i - size + 1):i + 1]) for i in range(len(lines) + size - 1)]
    top, kept, i = max(window, default=0), [], 0
    while i < len(window):
        j = i
        while j < len(window) and window[j] > 0:
            j += 1
        inside = any(x[2] for x in lines[i:j]) or not any(x[2] and x[0] for x in lines)
        if j > i and max(window[i:j]) >= max(min(html_extract.SURGE, top / 2), 0 if inside else top * html_extract.OUTSIDE):
            kept += [t for t, _, _ in lines[i:j] if t]
        i = max(j, i + 1)
    return "\n".join(kept)


def test_windows_against_plain_ones_on_every_page(monkeypatch):
    """The distribution is computed for each page and decides what is kept."""
    import random

    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column("html").to_pylist()
    r = random.Random(7)
    tags = ["<p>", "<div>", "<article>", "</article>", "<main>", "</main>", "<a href=x>", "</a>", "<li class=menu>", "</li>", "<div class=ad>", "</div>",
            "<aside>", "</aside>", "<h1>", "<br>", "words of some length here ", LONG, "x"]
    pages += ["".join(r.choice(tags) for _ in range(r.randrange(60))) for _ in range(1500)]
    calls, sums = [], html_extract.window_sums
    monkeypatch.setattr(html_extract, "window_sums", lambda lines: calls.append(1) or sums(lines))
    for page in pages:
        assert main_text(page) == slow_text(html_extract.page_lines(page or ""))
    assert len(calls) == len(pages)


def test_marked_wrappers_in_linear_time():
    assert main_text("<div class=sidebar>" * 20_000 + f"<main><p>{LONG}</main>") == LONG.strip()
    assert main_text("<li class=widget>" * 20_000) == ""


def test_long_and_hostile_pages():
    assert main_text("<p>" + "word " * 200_000) == ("word " * 200_000).strip()
    for page in ("<" * 20_000, "<a href=\"" * 5_000, "&" * 20_000, "<div>" * 20_000 + "x", "<!--" * 20_000):
        main_text(page)


def test_other_columns_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "<p>a", "old", None), (1, "<p>a", "old", None), (None, None, None, 2)], "page_id int, html string, text string, n int")
    assert sorted(map(tuple, extract_pages(pages).collect()), key=str) == [(1, None, "a"), (1, None, "a"), (None, 2, "")]
    assert extract_pages(pages.limit(0)).count() == 0
