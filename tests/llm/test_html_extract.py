"""Main text: pages written by hand, exact marginals against enumeration, held-out layouts."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import SparkSession

from tidemark.llm import html_extract as hx
from tidemark.llm.registry import op8_main_text

ARTICLE = "<p>The first paragraph of the story holds enough words to look like prose, with a comma.</p><p>A second paragraph goes on, and it has <b>bold</b>\n and <a href='x'>linked</a> words too.</p>"
WANT = "The first paragraph of the story holds enough words to look like prose, with a comma.\nA second paragraph goes on, and it has bold and linked words too."
PAGES = {
    "article": (f"<html><head><title>T</title><style>p{{}}</style></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav><article>{ARTICLE}</article><footer>&copy; 2024 Site</footer></body></html>", WANT),
    "divs": (f'<body><div id="menu"><a href=a>Home</a> | <a href=b>About</a></div><div class="post-content">{ARTICLE}</div><div class="sidebar"><h3>Related</h3><ul><li><a href=c>More</a></li></ul></div><div id=comments><div class=comment><p>Nice post, I liked it a lot.</p></div></div></body>', WANT),
    "scripts": (f"<body><script>var a = '<p>no</p>';</script><!-- <p>no</p> --><main>{ARTICLE}</main><form><label>Name</label><input><button>Send</button></form></body>", WANT),
    "references": ("<body><article><p>Fish &amp; chips cost &pound;5 &#8212; a fair price, people said to us yesterday.</p></article></body>", "Fish & chips cost £5 — a fair price, people said to us yesterday."),
    "open tags": ("<article><p>One paragraph without an end tag stands here as the text.<p>Another one follows it and also has no end tag at all.</article>", "One paragraph without an end tag stands here as the text.\nAnother one follows it and also has no end tag at all."),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name: str) -> None:
    page, want = PAGES[name]
    assert hx.main_texts([page], hx.trained()) == [want]


FIRST, LAST = ARTICLE.split("</p>")[0] + "</p>", "<p>A second paragraph goes on, and it has more than enough words to stand as text of the story.</p>"
BOTH = WANT.split("\n")[0] + "\nA second paragraph goes on, and it has more than enough words to stand as text of the story."


@pytest.mark.parametrize("between", ['<svg class="i"/>', "<math/>", "<svg><path d='M0 0'/></svg>", "<svg><path d='M0 0'>", "<object>", "<video>", "<canvas>", "<noscript>", "<audio src='x'>"])
def test_text_behind_embedded_elements_stays(between: str) -> None:
    assert hx.main_texts([f"<body><article>{FIRST}{between}{LAST}</article></body>"], hx.trained()) == [BOTH]


def test_formulas_and_icons_stay_in_their_paragraph() -> None:
    page = "<body><article><p>The area is <math><mi>A</mi><mo>=</mo><msup><mi>r</mi><mn>2</mn></msup></math> for <svg><g><path d='M0 0'/></g></svg>the circle, as people said to us<svg/> yesterday.</p></article></body>"
    assert hx.main_texts([page], hx.trained()) == ["The area is A=r2 for the circle, as people said to us yesterday."]


INSERTS = {
    "advert": '<div class="ad">Buy our new shoes today, half price for all readers.</div>',
    "advert paragraph": '<div class="advert"><p>Buy our new shoes today, half price for all readers of this page.</p></div>',
    "advert link": '<aside class="ad-slot"><a href=x>Buy now</a></aside>',
    "sponsored": '<section class="sponsored"><p>Our partners offer you a loan with low rates and no questions.</p></section>',
    "noscript": "<noscript>Please enable javascript</noscript>",
    "noscript paragraph": "<NOSCRIPT><p>Please enable javascript to see this page in full.</p></NOSCRIPT>",
    "cookie notice": '<div class="notice">This site uses cookies to work well for you.</div>',
    "newsletter": '<div class="newsletter"><p>Subscribe to our letter.</p><form><input><button>Go</button></form></div>',
    "form": "<form><label>Your name</label><input><button>Send</button></form>",
    "comments": '<div class="comments"><div class="comment"><p>Nice post, I liked it a lot and will come back.</p></div></div>',
    "comment section": '<section class="comments"><h3>Comments</h3><article class="comment"><p>I do not agree with the author at all, in my view.</p></article></section>',
    "menu": '<nav class="breadcrumb"><a href=a>Home</a> | <a href=b>News</a></nav>',
    "share links": '<ul class="share"><li><a href=x>Share</a></li><li><a href=y>Post</a></li></ul>',
}
KEPT = {"code": ("<pre>x = 1\ny = 2</pre>", "x = 1 y = 2"), "plain block": ("<div>A plain block in the story, which has words enough to look like prose.</div>", "A plain block in the story, which has words enough to look like prose."), "formula": ("<p>So <math><mi>A</mi><mo>=</mo><mi>B</mi></math> holds for all of them, as was said before.</p>", "So A=B holds for all of them, as was said before."), "quote": ("<blockquote><p>They said that nothing of the kind was known to them at that time.</p></blockquote>", "They said that nothing of the kind was known to them at that time.")}
FRAMES = ("<body><article>{}</article></body>", '<body><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav><main><h1>The title of the page</h1>{}</main><footer>&copy; 2024 Site</footer></body>', '<body><div class="post-content">{}</div><div class="sidebar"><ul><li><a href=c>More</a></li></ul></div></body>')


def test_inserts_in_articles_go_and_the_rest_stays() -> None:
    pages, wanted = [], []
    for frame in FRAMES:
        title = ["The title of the page"] if "title" in frame else []
        for inside, text in [*[(x, []) for x in INSERTS.values()], *[(x, [t]) for x, t in KEPT.values()]]:
            pages.append(frame.format(FIRST + inside + LAST))
            wanted.append([*title, *BOTH.split("\n")[:1], *text, *BOTH.split("\n")[1:]])
    got = [x.split("\n") for x in hx.main_texts(pages, hx.trained())]
    words = lambda blocks: sum(len(b.split()) for b in blocks)
    common = sum(words([b for b in g if b in w]) for g, w in zip(got, wanted, strict=True))
    assert 2 * common / (sum(map(words, got)) + sum(map(words, wanted))) >= 0.98
    assert sum(g != w for g, w in zip(got, wanted, strict=True)) <= len(pages) // 20


@pytest.mark.parametrize("part", ["<a ", "<div a='", '<b c="', "<!", "<script x='", "<a '\"", "</script ", "<noscript>", "<p>'", "<div>", "</p>", "<li><ul>", "<svg><a>"])
def test_malformed_pages_take_linear_time(part: str) -> None:
    import time

    took = []
    for size in (50_000, 400_000):
        page = part * (size // len(part))
        start = time.process_time()
        hx.parse(page)
        hx.parse(page + ">")
        took.append(time.process_time() - start)
    assert took[1] < 24 * took[0] + 0.5, took  # eight times the page; its square would be 64


def test_tags_without_an_end_are_text() -> None:
    assert [t[3] for t in hx.tokens("<p>a <b c='d<i>e<!-- f --><script>x</SCRIPT >g</p><u <!-- open")] == ["p", "i", None, None, "p", None]


def test_held_out_layouts() -> None:
    pages, answers = hx.labelled_pages(200, seed=99)
    f = hx.forest(map(hx.parse, pages))
    content = hx.trained().marginals(f) > 0.5
    truth = np.array([t is not None and t in answers[p] for p, t in zip(f.page, f.texts, strict=True)])
    leaf = f.leaf
    assert (content[leaf] == truth[leaf]).mean() >= 0.95


def test_marginals_equal_enumeration() -> None:
    f = hx.forest([hx.parse("<div class=post><p>Some words here.</p><div><a href=x>Link</a><p>Other words.</p></div></div>")])
    model = hx.trained()
    seen, n = model.observed(f), len(f.leaf)
    total = np.zeros((n, 3))
    for states in itertools.product(range(3), repeat=n):
        log = model.root[states[0]] + sum(seen[i, s] for i, s in enumerate(states))
        log += sum(model.edges[int(f.leaf[i]), states[f.parent[i]], states[i]] for i in range(1, n))
        for i, s in enumerate(states):
            total[i, s] += np.exp(log)
    assert model.marginals(f) == pytest.approx(total[:, hx.CONTENT] / total.sum(1))


def test_edge_cases(spark: SparkSession) -> None:
    deep = "<div>" * 3000 + "<p>Words at the bottom.</p>"
    long = "<article>" + "<p>A sentence of the long article, number one.</p>" * 3000 + "</article>"
    rows = [(1, None), (2, ""), (3, "no tags at all"), (4, "<<<>>> & &bogus; <p"), (5, deep), (6, long), (None, "<p>x</p>"), (6, long), (7, "<script>only script"), (8, "<a href='unclosed><p>text")]
    pages = spark.createDataFrame([(i, f"u{i}", h, "old", "old") for i, h in rows], "page_id long, url string, html string, text string, n_chars string")
    got = hx.extract(pages).collect()
    assert len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == by[7] == ""
    assert by[6].count("\n") == 2999
    assert hx.extract(pages.limit(0)).collect() == []


def test_whole_table(spark: SparkSession, small: str) -> None:
    rows = op8_main_text(spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/pages.parquet").count()
    assert sum(bool(r.text) for r in rows) >= 0.9 * len(rows)
    assert not any("<p" in r.text or "\n\n" in r.text or "  " in r.text for r in rows)
