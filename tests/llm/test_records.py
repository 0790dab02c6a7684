"""Operators on conversations, vectors, pages and archives."""

import gzip
import hashlib
import io
import math
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import chat, html, queries, vectors, warc
from gridloom.llm.common import filesystem


DATA = "/root/testdata/sf0.01"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- op4

@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "a:b"]), st.text(alphabet="\\#:</turn> a\n", max_size=12)), st.text(alphabet="\\#:<>/turn \n###é", max_size=40))))
def test_chat_round_trip(messages):
    text, spans = chat.render(messages)
    assert chat.parse(text) == messages
    assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in messages if r == "assistant")


def test_chat_parse_refuses_other_text():
    with pytest.raises(ValueError):
        chat.parse("### user:\nhello")


def test_fold_events():
    events = [
        ("message", 0, "user", "hi"), ("delta", 1, "assistant", "he"), ("delta", 1, "assistant", "llo"), ("message", 2, "user", "more"), ("delta", 3, "assistant", "x"),
        ("edit", 0, "", "hey"), ("regenerate", 1, "assistant", ""), ("delta", 1, "assistant", "again"), ("message", 2, "user", "bye"), ("message", 4, "user", "gone"), ("delete", 4, "", ""),
    ]
    assert chat.fold(events) == [("user", "hey"), ("assistant", "again"), ("user", "bye")]


def test_event_log(spark):
    rows = [(1, 3, "delta", 1, "assistant", "lo"), (1, 1, "message", 0, "user", "q"), (1, 2, "delta", 1, "assistant", "hel"), (2, 1, None, None, None, None), (None, 5, "message", 0, "user", "n")]
    log = spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: r["formatted"] for r in chat.format_log(log).collect()}
    assert got == {1: "### user:\nq</turn>\n### assistant:\nhello</turn>\n", 2: "### :\n</turn>\n", None: "### user:\nn</turn>\n"}
    assert chat.format_log(log.limit(0)).count() == 0


def test_chat_query_cases(spark, tmp_path):
    long = "x\\###</turn>" * 30_000
    rows = [(1, 1, "assistant", "two", 0), (1, 0, "user", None, 0), (1, 1, "assistant", "two", 0), (3, 0, "assistant", long, 0), (4, 0, "system", "", 0)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted long").repartition(2).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries.op4_chat(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 3, 4, chat.EXTRA_ID}
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == sha("user\n\nassistant\ntwo\nassistant\ntwo\n") and got[1]["loss_sha256"] == sha("twotwo")
    assert got[3]["loss_chars"] == len(long) and got[3]["loss_sha256"] == sha(long)
    assert got[4]["loss_chars"] == 0 and got[4]["loss_sha256"] == sha("")
    assert got[-7]["loss_sha256"] == sha(chat.EXTRA_TEXT) and got[-7]["loss_chars"] == len(chat.EXTRA_TEXT)


# --- op5

@pytest.mark.parametrize("part", [vectors.PART, 40])
def test_vectors_against_brute_force(spark, part):
    rng = np.random.default_rng(3)
    rows = {}
    for size in (64, 20, 3):
        for _ in range(12):
            center = rng.standard_normal(size)
            for _ in range(rng.integers(1, 8)):
                rows[len(rows)] = (center + rng.standard_normal(size) * rng.choice([0, 0.1, 0.3, 0.5])).astype(np.float32).tolist()
    for bad in (None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [1.0, None, 2.0]):
        rows[len(rows)] = bad
    hot = rng.standard_normal(64).astype(np.float32).tolist()
    for _ in range(120):
        rows[len(rows)] = hot
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows.items()], "vec_id long, embedding array<float>, n_links int, label int").repartition(4)
    got = vectors.near_duplicates(df, part=part).collect()
    want = vectors.brute_force(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got) and len(got) == len(rows)


def test_vectors_cases(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<double>")
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect())
    assert got == [("1", 2, 1), ("1", 2, 1), ("2", 2, 1), ("None", 0, None)]
    assert vectors.near_duplicates(df.limit(0)).count() == 0


# --- op8

ARTICLE = "First paragraph of the article, with enough words to count.", "Second one &amp; its “marks”; it goes on, and on.", "Short."
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><h2>Site</h2></header><nav><ul><li>Home<li>About us, and so on, and on</ul></nav>
<div class="cookie-notice"><p>We use cookies, as all do, and you agree to them.</p></div><div class=ad>Buy now!</div>
<{tag}><header><h1>Head   line</h1></header><p>{0}<br></p><p>{1}<script>var x = "</p>";</script><ul><li>item <b>one</b></ul><p>{2}<form><input value=x>Sign up</form></{tag}>
<aside><p>Related: other things, many of them, to read.</p></aside><section id="comments"><p>First! I like this, really, a lot, yes.</p></section><footer><p>&copy; all rights, always.</p></footer>"""
WANT = "Head line\n" + ARTICLE[0] + "\nSecond one & its “marks”; it goes on, and on.\nitem one\nShort."


@pytest.mark.parametrize("tag", ["article", "main"])
def test_main_text(tag):
    assert html.extract(PAGE.format(*ARTICLE, tag=tag)) == WANT


def test_content_without_named_container():
    page = PAGE.format(*ARTICLE, tag="div").replace("<header><h1>", "<h1>").replace("</h1></header>", "</h1>")
    assert html.extract(page) == WANT


@pytest.mark.parametrize("block", ["section", "div", "blockquote", "table"])
@pytest.mark.parametrize("lead", ["<h1>Head line</h1><p>An intro of some words, that says what is to come.</p>", "<h1>Head line</h1>", "<h1>Head line</h1><p>By <b>them</b></p>"])
def test_long_nested_block_keeps_headline_and_intro(block, lead):
    body = [f"Paragraph {i} goes on, " + "with words and more words, " * 10 + "to its end." for i in range(10)]
    start, stop = ("<table><tr><td>", "</td></tr></table>") if block == "table" else (f"<{block}>", f"</{block}>")
    page = f"<html><body><div><ul><li><a href=/>Home</a><li>Shop</ul></div><div id=content>{lead}{start}{''.join(f'<p>{p}</p>' for p in body)}{stop}</div><div><span>Top</span></div></body></html>"
    head = [re.sub("<[^>]*>", "", part) for part in re.findall("<(?:h1|p)>.*?</(?:h1|p)>", lead)]
    assert html.extract(page).split("\n") == head + body


def test_html_cases(spark):
    deep = "<article>" + "<div>" * 3000 + "<p>Deep text, here.</p>" + "</div>" * 3000 + "</article>"
    long = "<article><h1>x</h1>" + "".join(f"<p>Paragraph {i}, with words.</p>" for i in range(20000)) + "</article>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<nav>only a menu</nav>"), (4, "u", "plain text, no markup"), (5, "u", "<p>cut off in the mid"), (6, "u", deep), (7, "u", long), (7, "u", long), (8, "u", "<article><p>a < b &lt; c &am d</p></art"), (None, "u", "<p>no id</p>")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, text int")
    got = [tuple(r) for r in html.main_texts(df).collect()]
    want = {1: "", 2: "", 3: "", 4: "plain text, no markup", 5: "cut off in the mid", 6: "Deep text, here.", 8: "a < b < c &am d", None: "no id"}
    for page_id, _, text, n in got:
        assert n == len(text)
        assert text == (want[page_id] if page_id in want else "x\n" + "\n".join(f"Paragraph {i}, with words." for i in range(20000)))
    assert len(got) == len(rows)
    assert html.main_texts(df.limit(0)).count() == 0


# --- op10

def test_warc_round_trip(spark):
    same, big = "é" * 60, "".join(chr(33 + i % 90) for i in range(3 * warc.CHUNK + 5))
    rows = [(5, "http://x/a b", same), (2, "u", same), (9, None, same), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (6, "u", big), (7, "u\r\nX: y", big), (2, "u", same), (None, "u", same), (8, "u", "x" * 99), (10, "u", "x" * 99)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str)
    want = []
    for i, _, text in rows:
        data = (text or "").encode()
        first = min((j for j, _, t in rows if j is not None and (t or "") == (text or "")), default=None)
        revisit = len(data) >= 100 and i != first
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_chunks(spark):
    data = bytes(range(256)) * 4096
    df = spark.createDataFrame([(1, "u", bytearray(data)), (2, "u", bytearray(b""))], "page_id long, url string, payload binary")
    manifest = warc.write_archives(df)
    rows = sorted(warc.read_archives(manifest).collect(), key=lambda r: (r["page_id"], r["chunk_no"]))
    one = [r for r in rows if r["page_id"] == 1]
    assert b"".join(r["data"] for r in one) == data and [r["chunk_no"] for r in one] == list(range(len(one))) and len(one) > 1
    assert [r["is_last"] for r in one] == [False] * (len(one) - 1) + [True] and one[-1]["payload_digest"] == hashlib.sha256(data).hexdigest()
    assert all(len(r["data"]) <= warc.CHUNK for r in one)
    assert [(r["chunk_no"], bytes(r["data"]), r["payload_bytes"]) for r in rows if r["page_id"] == 2] == [(0, b"", 0)]
    for r in manifest.collect():
        fs, path = filesystem(r["path"])
        with fs.open_input_stream(path, compression=None) as f:
            text = gzip.GzipFile(fileobj=io.BytesIO(f.read())).read()
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


# --- op8: what pages look like elsewhere, and the ratios again in plain code

LONG = "This paragraph says something, and it says it at some length; so it is content, as anyone can see. "
BODY = f"<p>{LONG * 3}</p><p>{LONG * 2}</p>"
BODY_TEXT = f"{(LONG * 3).strip()}\n{(LONG * 2).strip()}"


@pytest.mark.parametrize("more,text", [
    ('<h1 class="article-header">Head</h1>', "Head"), ('<p class="market-share">Shares of the market.</p>', "Shares of the market."), ('<p class="notice-period">A month.</p>', "A month."),
    ('<div class="search-results-study">We searched.</div>', "We searched."), ("<p>a<svg/>b</p>", "ab"), ("<p>a<svg><path/></svg>b</p>", "ab"), ("<p>x &lt<b>; y</b></p>", "x <; y"), ("<p>&am<i>p;</i></p>", "&amp;"),
    ("<p hidden>no</p><p>yes</p>", "yes"), ('<div style="color: red; display: none">no</div><p>yes</p>', "yes"), ("<p aria-hidden=true>no</p><p>yes</p>", "yes"),
    ("<blockquote><p>Said so.</p><footer>Someone</footer></blockquote>", "Said so.\nSomeone"), ('<div class="ad-slot-2">Buy.</div><div class="share links"><a href=x>s</a></div><p>yes</p>', "yes"),
    ('<ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul><p>yes</p>', "yes"), ("<ul><li>One</li><li>Two</li></ul>", "One\nTwo"), ("<table><tr><td>1</td><td>2</td></tr></table>", "1\n2"),
    ("<!-- c --><p>1 &amp; 2&nbsp;&#8211;  3</p><script>var t = '</p>';</script>", "1 & 2 \u2013 3"), ('<section class="comments"><p>' + LONG * 9 + "</p></section><p>yes</p>", "yes"), ("<p>a < b and 1<2</p>", "a < b and 1<2"),
])
def test_blocks_of_an_article(more, text):
    page = f"<html><body><nav><a href=x>Menu</a></nav><article>{BODY}{more}</article><footer>Foot</footer></body></html>"
    assert html.extract(page) == f"{BODY_TEXT}\n{text}"
    assert html.extract(page.replace("article>", "div>")) == f"{BODY_TEXT}\n{text}"


def test_other_pages():
    teaser = "<article><h2><a href=x>Other news</a></h2><p>Short.</p></article>"
    assert html.extract(f"<main><article>{BODY}</article>{teaser}</main>") == BODY_TEXT
    assert html.extract(f"<main><div>{BODY}</div>{teaser}</main>") == BODY_TEXT
    assert html.extract(f"<main><article>{BODY}</article><article>{BODY}</article></main>") == f"{BODY_TEXT}\n{BODY_TEXT}"
    assert html.extract(f"<body><div id=nav><a href=x>Menu</a></div><div><h1>Head</h1><p>Intro</p><section>{BODY * 5}</section></div><div class=sidebar>Side</div></body>") == "Head\nIntro\n" + "\n".join([BODY_TEXT] * 5)
    assert html.extract(f'<body><div class="widget">{BODY}</div></body>') == BODY_TEXT
    assert html.extract(f"<p>{LONG}<svg/></p><p>After.</p>") == f"{LONG.strip()}\nAfter."
    assert html.extract("<nav>only</nav>") == html.extract("") == html.extract("<div>") == html.extract("<script>x") == ""


def test_deep_pages():
    import time
    import tracemalloc

    tracemalloc.start()
    assert html.extract("<div>" * 40_000 + LONG) == LONG.strip()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000 * 1000
    for page in ("<div>" * 200_000 + LONG, "<b>" * 100_000 + LONG + "</i>" * 100_000, "<footer>" * 100_000 + LONG, "<p>x" * 50_000, "<div><b>x" * 15_000):
        began = time.time()
        html.extract(page)
        assert time.time() - began < 30


def test_ratios_again_in_plain_code():
    """Sums by whole path strings and the formula written out, on random pages without markup that closes itself."""
    rng = random.Random(4)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return " ".join(rng.choice(["word", "a,", "longer", "end."]) for _ in range(rng.randrange(1, 30)))
        tag = rng.choice(["div", "section", "blockquote", "b", "a"])
        return f'<{tag}{rng.choice(["", " class=x", " id=y"]) if tag != "b" else ""}>' + "".join(make(depth - 1) for _ in range(rng.randrange(1, 4))) + f"</{tag}>"

    def plain(text):
        stack, rows, names = [], {}, []
        for piece in re.split(r"(<[^>]*>)", text):
            if piece.startswith("</"):
                stack.pop()
            elif piece.startswith("<"):
                stack.append(piece[1:-1])
            elif piece.strip():
                blocks = [t for t in stack if t[0] not in "ab" or t.startswith("blockquote")]
                last = max((k for k, t in enumerate(stack) if t in blocks), default=-1)
                link = any(t.startswith("a") for t in stack[last + 1 :])
                row = rows.setdefault("/".join(blocks), [0, 0, 0])
                row[0] += 0 if link else len(piece)
                row[1] += 0 if link else sum(c in ".,;:!?\u3001\u3002\uff0c\u2026" for c in piece)
                row[2] += 1
        names, values = list(rows), list(rows.values())
        near = lambda i, f: sum(math.exp(-((i - j) ** 2) / 2) * f(values[j]) for j in range(max(0, i - 1), min(len(values), i + 2))) / sum(math.exp(-((i - j) ** 2) / 2) for j in range(max(0, i - 1), min(len(values), i + 2)))
        fused = [near(i, lambda r: r[0] / r[2]) * (1 + near(i, lambda r: r[1] / r[2])) for i in range(len(values))]
        mean = sum(fused) / len(fused)
        least = mean - 0.5 * math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
        return [v[:3] for v in values], [x >= least - 1e-12 for x in fused]

    for _ in range(200):
        text = "<div>" + make(5) + make(5) + "</div>"
        page = html.Page(text)
        sums = html.path_sums(page, page.out)
        values, passed = plain(text)
        assert [v[:3] for v in sums.values()] == values
        paths = html.content_paths(sums)
        assert [p in paths for p in sums] == passed or len(paths) == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no fixture tables")
def test_query_against_articles(spark):
    """Every page of the fixture has one article: its blocks by regular expressions alone, for the query's whole result."""
    from html import unescape

    def blocks(page):
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
        inside = re.sub(r"<!--.*?-->", "", inside, flags=re.S)
        parts = re.split(r"</?(?:p|h\d|ul|ol|li|div|table|tr|td|blockquote|pre|section)\b[^>]*>", inside)
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", part)))).strip() for part in parts]
        return "\n".join(part for part in parts if part)

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = queries.op8_html(spark, DATA).collect()
    assert len(got) == len(pages) > 200
    for r in got:
        assert r["text"] == blocks(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


# --- large payloads, and the application's folder

def test_large_payload_travels_in_chunks(spark):
    big = "".join(chr(97 + i * i % 26) for i in range(1 << 16)) * 400
    df = spark.createDataFrame([(1, "u", big), (2, "u", "x"), (3, "v", big)], "page_id long, url string, html string")
    records = df.selectExpr("page_id", "url", "encode(html, 'utf-8') AS payload")
    rows = warc.chunked(warc.decided(records)).selectExpr("page_id", "chunk_no", "is_last", "length(data) AS n").collect()
    assert max(r["n"] or 0 for r in rows) == warc.CHUNK and sum(r["n"] for r in rows if r["page_id"] == 1) == len(big)
    assert [(r["chunk_no"], r["is_last"], r["n"]) for r in rows if r["page_id"] == 3] == [(0, True, None)]
    got = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    assert (got[1]["payload_digest"], got[1]["payload_bytes"], got[3]["refers_to"], got[2]["record_type"]) == (sha(big), len(big), 1, "response")


def test_clean_removes_what_was_written(spark, tmp_path):
    from gridloom.llm import common

    common.written(spark.range(3), "some")
    folder = common.run_folder(spark).removeprefix("file:")
    assert os.path.isdir(folder) and common.clean(spark) and not os.path.exists(folder)
    assert common.written(spark.range(3), "again").count() == 3
