"""Operators on pages against brute force, on odd rows and on the smallest given table."""

import hashlib
import html
import os
import re
import uuid

import duckdb
import pytest

import __spark_entry__ as entry
from docmetrics.llm import main_text, warc
from docmetrics.llm.common import shared_dir

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")

LONG = "Long enough to be revisited, since the payload has at least one hundred bytes in it, as the rule demands."
PAGES = [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (2, "http://a/2", LONG), (3, None, LONG), (None, "http://a/n", LONG), (4, "u\r\nv", "short"),
         (5, "http://a/5", "short"), (6, "http://a/6", None), (7, "http://a/7", ""), (1, "http://a/1", LONG), (8, "http://a/8", "é" * 60), (9, "x", "é" * 60),
         (None, None, "only here: " + LONG), (10, "http://a/10", "<p>" + "long " * 60_000)]


def pages(spark):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in PAGES], "page_id long, url string, html string, digest string")


def roles():
    first = {}
    for i, _, h in PAGES:
        raw = (h or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(i, first.get(raw, i))
    out = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        to = first.get(raw) if len(raw) >= 100 and first.get(raw) != i else None
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(map(str, out))


def test_round_trip(spark):
    folders = [f"{shared_dir(spark)}/test-{uuid.uuid4().hex}" for _ in range(2)]
    files = [sorted(map(str, warc.write_warc(pages(spark), f, roll=2000, shard_bytes=3000).collect())) for f in folders]
    assert files[0] == files[1] and len(files[0]) > 2  # the same bytes on every run
    got = warc.read_warc(spark, folders[0]).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == roles()
    payloads = {r.payload_digest: bytes(r.payload) for r in got if r.record_type == "response"}
    assert all(hashlib.sha256(payloads[r.payload_digest]).hexdigest() == r.payload_digest for r in got)
    assert not [x for x in os.listdir(folders[0]) if x.startswith("_temporary")]


def test_damage_is_seen():
    raw = warc.record(1, "u", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), None, "2024-01-01T00:00:00Z")
    assert warc.parsed(raw)["payload"] == b"x" * 200
    with pytest.raises(ValueError):
        warc.parsed(raw.replace(b"xxx", b"xyx", 1))


def test_no_pages(spark):
    folder = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    none = pages(spark).where("false")
    assert warc.write_warc(none, folder).count() == 0 and warc.read_warc(spark, folder).count() == 0
    assert main_text.extract_main_text(none).count() == 0


@given
def test_given_pages_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    cur = con.execute(entry.oracle_sql()["op7_warc"])
    names = [d[0] for d in cur.description]
    got = entry.queries()["op7_warc"](spark, SF).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, cur.fetchall()))


PARTS = [
    ('<html><head><title>T</title></head><body><nav><a href="/">Home</a></nav><article><h1>Head &amp; more</h1><p>Some  text,\n with <b>bold</b>words.'
     "<p>Second &lt;one&gt;.<br>Line.</article><footer>(c)</footer></body></html>", "Head & more Some text, with boldwords. Second <one>. Line."),
    ('<div class="sidebar"><p>Side text, long enough to look good. Really.</p></div><div class="post"><h2>Title</h2><p>Some long text, with commas. And more.</p>'
     '<ul><li>one item</li><li>two</li></ul><section class="comments"><p>Nice, really. Yes.</p></section></div><p id="cookie-notice">We use cookies.</p>',
     "Title Some long text, with commas. And more. one item two"),
    ("<article><p>Kept.</p><form>Name <input> here</form><aside>not this</aside><script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --></article>", "Kept."),
    ("<article><div class='ad-box adbox'>Buy now, please.</div><p>Real text here, yes.</p><div hidden>secret text, long.</div></article>", "Real text here, yes."),
    ("just text without markup", "just text without markup"), ("", ""), (None, ""), ("<p>unclosed <b>bold <p>next", "unclosed bold next"), ("<<<>>> &#x41;&nbsp;x", None),
    ("<article><p>" + "word, " * 30_000 + "</p></article>", ("word, " * 30_000).strip()), ("<article><p title='a>b'>Quoted.</p></article>", "Quoted."),
]


BODY = "<article><h1>Title</h1><p>" + "Some long text, with commas. And more of it. " * 12 + "</p></article>"
BODY_TEXT = "Title " + ("Some long text, with commas. And more of it. " * 12).strip()


@pytest.mark.parametrize("page", [
    f'<div class="content-sidebar-wrap">{BODY}<div class="sidebar"><p>Side text, really. Yes.</p></div></div>',
    f'<div class="has-sidebar">{BODY}</div><p class="footer">Foot, note.</p>', f'<div class="post social">{BODY}</div>',
    f'<main class="comments-open">{BODY}</main>', f'<form id="page">{BODY}<p class="search-form">Find, here.</p></form>',
    f'<html><head><title>T</title><meta charset="utf-8"><body>{BODY}</body></html>', f"<head><title>T</title>{BODY}",
    f'<body class="no-sidebar modal-open">{BODY}</body>', f'<main class="banner-top"><nav><p>Menu, long.</p></nav>{BODY}</main>',
    f'{BODY}<section class="comments"><article><p>{"A reader, says this. " * 90}</p></article></section>',
    f'{BODY}<div class="related"><article><p>{"Another story, here. " * 90}</p></article></div>',
    f'{BODY}<div class="comment-content"><p>{"A reader, says this. " * 90}</p></div>',
])
def test_names_are_overruled_only_around_the_article(page):
    assert main_text.main_text(page) == BODY_TEXT


def test_deep_pages_are_linear():
    """Steps, not seconds: twice the depth is about twice the work of the path nodes and of the reader."""
    import sys

    def steps(page):
        n = 0

        def count(*_):
            nonlocal n
            n += 1
            return None

        sys.setprofile(count)
        try:
            main_text.main_text(page)
        finally:
            sys.setprofile(None)
        return n

    for make in (lambda n: "<div>text, here. " * n, lambda n: "<x><table>" + "<div>" * n + "t</x>" * n,
                 lambda n: "<b><a href=x>t" * n, lambda n: "<p class=sidebar><div class='widget'>t" * n):
        assert steps(make(2000)) < 2.3 * steps(make(1000))
    assert main_text.main_text("<div>" * 50_000 + BODY) == BODY_TEXT


def test_main_text(spark):
    rows = [(i, None if i % 3 else f"http://x/{i}", h, "x", 7) for i, (h, _) in enumerate(PARTS)] + [(None, None, PARTS[0][0], None, None), (0, "http://x/0", PARTS[0][0], "x", 7)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = main_text.extract_main_text(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        want = PARTS[r.page_id or 0][1]
        assert want is None or r.text == want
        assert r.n_chars == len(r.text)


@given
def test_given_articles(spark):
    """The given pages hold their text in one article element: cut it out with patterns instead."""
    def plain(page):
        inner = page[page.index("<article>"):].partition("</article>")[0]
        return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br|article)\b[^>]*>", " ", inner))).split())

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = entry.queries()["op2_main_text"](spark, SF).collect()
    assert {r.page_id: r.text for r in got} == {i: plain(h) for i, h in pages.items()}
