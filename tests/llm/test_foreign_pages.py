"""Pages in layouts that the labeller was not trained on, written by hand, with the text that should be found."""

import time
from collections import Counter

import numpy as np
import pytest
from tidemark.llm import html_blocks, html_extract

P = ["The harbour was quiet that morning, and the boats lay in two rows along the wall.", "Nobody had seen the keeper since the storm; his lamp, however, still burned.",
     "A letter was found on the table. It named three ships and a date in May.", "By noon the whole town had read it, or claimed to have done so."]
GOLD = "\n".join(P)
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in P)

#: name: (page, text)
PAGES = {
    "blog": (f'<html><head><title>x</title></head><body><div id="masthead"><a href="/">My blog</a></div><ul id="topnav"><li><a href="/a">Home</a><li><a href="/b">Archive</a></ul><div class="hentry"><div class="entry-body">{PARAGRAPHS}</div></div><div id="comments"><h3>2 comments</h3><p>Great story, I loved the ending very much.</p></div><div id="bottom">Copyright 2020</div></body></html>', GOLD),
    "news": (f'<body><header><nav><a href="/">News</a><a href="/s">Sport</a></nav></header><main><h1>The lamp</h1><div class="story-text">{PARAGRAPHS}</div><aside class="most-read"><h3>Most read</h3><a href="/1">Cat found</a><a href="/2">Rain again</a></aside></main><footer>Terms Privacy</footer></body>', "The lamp\n" + GOLD),
    "table": (f'<body><table><tr><td><a href="/">Home</a> <a href="/about">About</a></td></tr><tr><td>{PARAGRAPHS}</td></tr><tr><td><font size=1>Webmaster</font></td></tr></table></body>', GOLD),
    "wiki": (f'<body><div id="sidebar"><ul><li><a href="/m">Main page</a></li><li><a href="/r">Random</a></li></ul></div><div id="content"><h1>Harbour</h1><div class="toc"><ul><li><a href="#1">One</a></li></ul></div>{PARAGRAPHS}</div><div id="footer">Text under a licence</div></body>', "Harbour\n" + GOLD),
    "shop": (f'<body><div class="cookie-bar"><p>We use cookies on this site.</p><button>OK</button></div><nav><a href="/c">Cart</a></nav><section class="description">{PARAGRAPHS}</section><form><label>Your email</label><input><button>Subscribe</button></form></body>', GOLD),
    "forum": (f'<body><div class="breadcrumbs"><a href="/f">Forum</a> <a href="/g">Boats</a></div><div class="post-content">{PARAGRAPHS}</div><div class="replies"><div class="reply">I do not think so at all, sorry.</div></div><div class="pagination"><a href="2">2</a></div></body>', GOLD),
    "bare": (f"<body>{PARAGRAPHS}</body>", GOLD),
    "section": (f'<body><div class="wrap"><div class="ad-box">Buy a boat now, cheap!</div><section role="main"><h1>The lamp</h1>{PARAGRAPHS}</section><div class="share"><a href="/t">Share</a></div></div></body>', "The lamp\n" + GOLD),
    "amp": (f'<body><amp-sidebar><ul><li><a href="/">Home</a></li></ul></amp-sidebar><article><h1>The lamp</h1>{PARAGRAPHS}<div class="related"><a href="/z">More like this</a></div></article><amp-ad>Advert</amp-ad></body>', "The lamp\n" + GOLD),
    "divs": ('<body><div class="nav"><a href="/">Start</a> <a href="/k">Contact</a></div><div class="text">' + "".join(f"<div>{x}</div>" for x in P) + '</div><div class="legal">All rights reserved.</div></body>', GOLD),
    "unclosed": (f'<body><div class=nav><a href=/>Start</a></div><article><canvas><p id="x"">{P[0]}<p title=it\'s>{P[1]}<select><p>{P[2]}<p>{P[3]}</article><div class=footer>About us</div>', GOLD),
    "docs": (f'<body><div class="topbar">Docs v2</div><div class="sidenav"><a href="/i">Install</a><a href="/u">Use</a></div><div class="markdown-body"><h1>Harbour</h1>{PARAGRAPHS}</div><div class="feedback">Was this page useful?</div></body>', "Harbour\n" + GOLD),
}


def f1(got, gold):
    a, b = Counter(got.split()), Counter(gold.split())
    both = sum((a & b).values())
    return 2 * both / max(1, sum(a.values()) + sum(b.values()))


def train_pages(prose):
    layouts = html_extract.Layouts([t.capitalize() + "." for t in prose(21, 200, 8, 60)], [t for t in prose(22, 100, 1, 4)], 5)
    clean = lambda t: t.replace(html_extract.ARTICLE, "").replace(html_extract.OTHER, "")
    return [clean(layouts.page()) for _ in range(80)]


def test_foreign_layouts(spark, prose):
    pages = spark.createDataFrame([(i, "u", p) for i, p in enumerate(train_pages(prose))], "page_id long, url string, html string")
    model = html_extract.train(pages)
    names = list(PAGES)
    found = spark.createDataFrame([(i, n, PAGES[n][0]) for i, n in enumerate(names)], "page_id long, url string, html string")
    scores = {r.url: f1(r.text, PAGES[r.url][1]) for r in html_extract.extract(found.selectExpr("*", "1 AS text"), model).collect()}
    print({k: round(v, 2) for k, v in scores.items()}, round(float(np.mean(list(scores.values()))), 3))
    assert np.mean(list(scores.values())) > 0.85


def test_tokenizer_is_linear():
    for page in ("<a " * 350_000, '<a x="' * 170_000, "<canvas>" * 130_000, "<!--" * 250_000, "<p>x" * 250_000, "<div>" * 200_000 + "</p>" * 10_000, "</b>" * 200_000, "<" * 1_000_000, "<b x='" * 100_000 + ">"):
        began = time.process_time()
        html_blocks.blocks(page)
        assert time.process_time() - began < 6


def test_odd_markup():
    text = lambda p: [b.text for b in html_blocks.blocks(p)]
    assert text("<article><p>one two.</p><canvas><p>three four.</p></article>") == ["one two.", "three four."]
    assert text('<p>a</p><script src="x.js"/>var q=1;</script><p>b</p>') == ["a", "b"]
    assert text("<p title=it's>a</p><p id=\"x\"\">b</p><svg/><p>c") == ["a", "b", "c"]
    assert text("<p>2 < 3 and <3</p><script>x</script foo><p>d") == ["2 < 3 and <3", "d"]


def test_long_page_in_slices(monkeypatch, prose):
    model = html_extract.Labeller(html_extract.WIDTH, 4, 1)
    page = html_blocks.blocks("".join(f"<p>{t}</p>" for t in prose(3, 300, 2, 12)))
    whole = html_extract.label(model, [page, page[:7]])
    monkeypatch.setattr(html_extract, "CELLS", 32)
    assert all((a == b).all() for a, b in zip(whole, html_extract.label(model, [page, page[:7]])))


def test_tokenizer_does_not_walk_what_is_open():
    """Implied ends and end tags go to where the element is, however much is open in between."""
    began = time.process_time()
    found = html_blocks.blocks("<ul>" + "<b>" * 130_000 + "<li>x" * 130_000 + "</b>" * 1_000)
    assert len(found) == 130_000 and time.process_time() - began < 30
    nested = html_blocks.blocks("<ul><li>a<table><tr><td>b<li>c</table>d<li>e</ul><p>f<div>g<p>h")
    assert [b.text for b in nested] == list("abcdefgh")


@pytest.mark.parametrize("comment", ["<!-->", "<!--->", "<!-- x --!>", "<!-- x -->", "<!-- -- > -->", "<!----!>"])
def test_comments_end(comment):
    assert [b.text for b in html_blocks.blocks(f"<p>a</p>{comment}<p>b</p>")] == ["a", "b"]


def test_open_comment_reaches_the_end():
    assert [b.text for b in html_blocks.blocks("<p>a</p><!-- <p>b</p> -- <p>c")] == ["a"]
