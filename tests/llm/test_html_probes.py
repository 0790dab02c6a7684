"""Main text: reader comments, notices, teasers and link lists, in an article and in a plain container."""

import re

import duckdb
import pytest

from gridloom.llm import html

P1 = "The first paragraph has a good many words, some marks, and more than one clause to read; it goes on."
P2 = "The second paragraph is like it, with commas, a full stop. And it has another sentence, which ends here."
NAV = '<nav><a href="/">Home</a> <a href="/a">Away</a></nav>'


def page(body, kind):
    a, b = {"article": ("<article>", "</article>"), "div": ('<div id="content">', "</div>")}[kind]
    return f"<html><head><title>t</title></head><body>{NAV}{a}<h1>Head</h1><p>{P1}</p>{body}<p>{P2}</p>{b}<footer>Foot line</footer></body></html>"


KINDS = pytest.mark.parametrize("kind", ["article", "div"])
TALK = "<p>I do not agree with this, says a reader, and I say so at some length.</p>"


@KINDS
@pytest.mark.parametrize("body", [
    f'<div class="comment-body">{TALK}</div>', f'<ol class="commentlist"><li>{TALK}</li><li>{TALK}</li></ol>', f'<div class="user-comment-text">{TALK}</div>', f'<section id="readercomments">{TALK}</section>',
    '<div class="gdpr-notice">We use cookies, as all do, to make this site better for you.</div>', '<p class="notice">This site changes its terms, see below, from next week on.</p>',
    '<div class="paywall-teaser">Subscribe now, read all, and cancel at any time you like.</div>', '<div class="related-stories"><h3>Related stories</h3><ul><li><a href="/1">One thing</a></li><li><a href="/2">Another thing</a></li></ul></div>',
    '<h3>Related stories</h3><ul><li><a href="/1">One thing</a></li><li><a href="/2">Another thing</a></li></ul>',
])
def test_what_is_no_part_of_the_article(kind, body):
    assert html.extract(page(body, kind)) == f"Head\n{P1}\n{P2}"


@KINDS
@pytest.mark.parametrize("body, text", [
    ('<h2>Sources</h2><ul><li><a href="/1">A report</a></li><li><a href="/2">A second report</a></li></ul>', "Sources\nA report\nA second report"),
    ('<div class="market-share"><p>Its share of the market, in all, is a third.</p></div>', "Its share of the market, in all, is a third."),
    ('<p class="commentary">The commentary, as such, is part of it.</p>', "The commentary, as such, is part of it."),
    ('<div class="noticeboard"><p>The board, it says, has met on Monday.</p></div>', "The board, it says, has met on Monday."),
    ('<p title="it\'s>A quote without its partner, here, stays a tag.</p><p class="x">And the next, too, is a paragraph.</p>', "A quote without its partner, here, stays a tag.\nAnd the next, too, is a paragraph."),
    ('<p data-a="1"data-b=\'2\'>No blank between its attributes, yet a tag.</p>', "No blank between its attributes, yet a tag."),
    ('<p title="a > b">A mark in a quote, as it may be.</p>', "A mark in a quote, as it may be."),
])
def test_what_is_part_of_the_article(kind, body, text):
    assert html.extract(page(body, kind)) == f"Head\n{P1}\n{text}\n{P2}"


def test_many_unpaired_quotes_take_linear_time():
    import time

    began = time.time()
    html.extract(page("".join(f'<p title="it\'s>{k}</p>' for k in range(20_000)), "div"))
    assert time.time() - began < 10


def test_articles_of_the_fixture_as_plain_containers():
    """All pages of the fixture give the same with their article tags turned into div."""
    pages = duckdb.sql("SELECT html FROM '/root/testdata/sf0.1/pages.parquet' WHERE html IS NOT NULL").fetchall()
    differ = sum(html.extract(h) != html.extract(re.sub(r"<(/?)article\b", r"<\1div", h)) for (h,) in pages)
    assert len(pages) > 2000 and differ == 0
