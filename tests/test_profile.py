import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagewatch import schemas
from pagewatch.functions import html as H
from pagewatch.operators.profile import profile_captures
from pagewatch.sources.captures import normalize_captures

HTML = "text/html; charset=utf-8"


def profile_of(spark, html, status=200, content_type=HTML, error=None, url="https://site.example/p"):
    headers = {"Content-Type": content_type} if content_type is not None else {}
    row = (url, dt.datetime(2024, 1, 1), status, headers, url, html, None, None, error, "c", 1)
    captures = normalize_captures(spark.createDataFrame([row], schemas.CAPTURES))
    return profile_captures(captures).first().profile


@pytest.fixture(scope="module")
def rich(spark):
    return profile_of(
        spark,
        """<!DOCTYPE html><html lang=" en "><head><title> A <b>bold</b> &amp; title </title>
        <!-- <title>hidden</title> <script> --><meta name=description content='first "one"'>
        <META CONTENT="a > b" PROPERTY="OG:Title"><meta property="og:title" content="name=x last">
        <meta property="og:og:site" content="s"><meta name="Twitter:Card" content="c">
        <meta name="keywords" content=""><meta name="keywords" content="k">
        <meta http-equiv="X-A" content="1"><meta charset=" latin1 ">
        <link href="/no" rel="icon"><link href=" /yes " rel="nofollow canonical">
        <style>p { color: red }</style><script>var t = "<p>privacy</p><!--";</script>
        <script type='application/ld+json'>{"b": 2, "a": 1}</script>
        <script type="application/ld+json">nope</script></head>
        <body><header>header words</header><nav>nav <form></form></nav><main class="x">
        <h1>One</h1><h2>Two</h2><h2>Three</h2><p>Privacy<b>policy</b> text</p><ul></ul><ol></ol><img>
        <p itemscope itemtype="T2"></p><p itemtype="T1"></p><p itemtype="T2"></p>
        <a href="/in">in <i> x </i></a><a href="//cdn">cdn</a><a href="https://SITE.example/q">own</a>
        <a href="https://www.youtube.com/v" title="v">tube</a><a href="#f">f</a><a href="p.html">rel</a>
        <a href="JavaScript:x()">js</a><a href="mailto:a@b">m</a><a href=" ">none</a><a>no href</a>
        </main><footer>footer</footer></body></html>""",
    )


def test_head_fields(rich):
    assert rich.error is None
    assert rich.title == "A bold & title"
    assert rich.meta_description == 'first "one"'
    assert rich.og_metadata == {"title": "name=x last", "site": "s"}
    assert rich.twitter_metadata == {"card": "c"}
    assert rich.other_metadata == {"http_equiv_x-a": "1"}  # the first keywords tag is empty
    assert rich.canonical_url == "/yes"
    assert (rich.language, rich.charset) == ("en", "latin1")


def test_structured_data(rich):
    assert rich.json_ld == ['{"a":1,"b":2}']
    assert rich.microdata.item_count == 3 and rich.microdata.sample_types == ["T1", "T2"]
    assert rich.structured_canonical == (
        '{"json_ld":[{"a":1,"b":2}],"microdata":{"item_count":3,"sample_types":["T1","T2"]}}'
    )


def test_links(rich):
    got = [(x.category, x.url, x.text) for x in rich.important_links]
    assert got == [
        ("internal", "/in", "inx"), ("internal", "//cdn", "cdn"),
        ("internal", "https://SITE.example/q", "own"), ("social", "https://www.youtube.com/v", "tube"),
        ("external", "#f", "f"), ("external", "p.html", "rel"),
    ]


def test_content(rich):
    content = rich.content_analysis
    assert content.headings.h1 == 1 and content.headings.h2 == 2 and content.headings.h6 == 0
    assert (content.image_count, content.paragraph_count, content.list_count) == (1, 4, 2)
    assert content.has_main_content and content.has_legal_language
    # Tags leave no space behind, and scripts, header, nav and footer are not text.
    assert "Privacypolicy text" in content.text_preview
    assert (content.privacy_keyword_count, content.governance_keyword_count) == (1, 1)
    assert not rich.has_forms and not rich.has_comments


def test_comment_text(spark):
    assert profile_of(spark, "<p>&lt;!-- shown --&gt;</p>").has_comments
    assert not profile_of(spark, "<p>&lt;!--</p><p>--&gt;</p><!-- real -->").has_comments


def test_parse_gate(spark):
    assert profile_of(spark, "<title>x</title>", status=404).error == "HTTP 404 - Cannot parse HTML"
    assert profile_of(spark, "x", content_type="Application/PDF").error == "Non-HTML content type: application/pdf"
    assert profile_of(spark, "x", content_type=None).error == "Non-HTML content type: "
    assert profile_of(spark, None, status=None, error="timeout") is None
    blocked = profile_of(spark, "<title>x</title>", status=503)
    assert blocked.title is None and blocked.content_analysis is None and blocked.og_metadata is None or blocked.og_metadata == {}


def test_empty_page(spark):
    page = profile_of(spark, "")
    assert page.title is None and page.content_analysis.word_count == 0 and page.charset == "utf-8"
    assert page.structured_canonical == '{"json_ld":[],"microdata":{}}'


@pytest.mark.parametrize(
    "head, charset",
    [
        ('<meta charset=" "><meta http-equiv="content-type" content="a; charset=b">', None),
        ('<meta http-equiv="Content-Type" content="text/html; charset=b; x">', "b"),
        ('<meta http-equiv="Content-Type" content="text/html; CHARSET=b">', None),
        ("", "utf-8"),
    ],
)
def test_charset_order(spark, head, charset):
    assert profile_of(spark, head).charset == charset


def test_failed_capture_is_normalised(spark):
    row = ("https://a.b/", dt.datetime(2024, 1, 1), None, None, None, None, None, None, "down", "c", 1)
    got = normalize_captures(spark.createDataFrame([row], schemas.CAPTURES)).first()
    assert (got.headers, got.final_url, got.content_length, got.response_time) == ({}, "https://a.b/", 0, 0.0)
    sized = normalize_captures(
        spark.createDataFrame([("u", None, 200, {}, "u", "é", None, None, None, "c", 1)], schemas.CAPTURES)
    )
    assert sized.first().content_length == 2


def test_title_and_language_are_searched_once(spark):
    cases = [
        ("<html lang=' de '><title> A &amp; <b>b</b> </title><link rel='x canonical' href='/c'></html>", "A & b", "de", "/c", 0),
        ("<HTML><title></title><link rel='CANONICAL' href='/c'>", "", None, None, 0),
        ("", None, None, None, 0), ("<p>canonical", None, None, None, 0),
        ("<script type=application/ld+json>{}</script><!-- <script type='application/ld+json'>1</script> -->", None, None, None, 1),
        ("application/ld+json<script>1</script>", None, None, None, 0),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)] + [(len(cases), None)], "i int, h string")
    h = F.col("h")
    found = rows.select("i", H.title(h), H.page_language(h), H.canonical_link(h), F.array_size(H.json_ld_bodies(h)))
    assert [tuple(r)[1:] for r in found.orderBy("i").collect()] == [c[1:] for c in cases] + [(None,) * 4]
    # A search whose result is mentioned twice would run twice.
    for field, tag in ((H.title, "<title"), (H.page_language, "<html")):
        assert rows.select(field(h).alias("x"))._jdf.queryExecution().optimizedPlan().toString().count(tag) == 1


def test_parts_of_the_content_analysis_are_built_alone(spark):
    pages = [
        "<p>Last updated: May 1, 2024. date: 1/2/2024</p>", "<h1>x</h1><p>no marks</p>", None, "<p>updated on 3 June</p><p>privacy</p>",
    ]
    rows = [
        (f"https://site.example/{i}", dt.datetime(2024, 1, 1), status, {"Content-Type": kind}, None, html, None, None, None, "c", i)
        for i, (html, status, kind) in enumerate([(p, 200, HTML) for p in pages] + [(pages[0], 404, HTML), (pages[0], 200, "text/plain")])
    ]
    captures = normalize_captures(spark.createDataFrame(rows, schemas.CAPTURES))
    whole = {r.ordinal: r.profile for r in profile_captures(captures).collect()}
    parts = ["date_indicators", "word_count"]
    alone = profile_captures(captures, ["title", *[f"content_analysis.{p}" for p in parts]]).collect()
    assert len(alone) == len(rows)
    for r in alone:
        content = whole[r.ordinal].content_analysis
        assert r.profile.asDict(True) == {
            "title": whole[r.ordinal].title, "content_analysis": content and {p: content[p] for p in parts},
        }


def test_date_marks_are_looked_for_once(spark, sf_dir):
    from pagewatch.catalog.queries import QUERIES
    from pagewatch.functions.text import DATE_PATTERNS

    plan = QUERIES["h21_date_indicators"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # No marks of versions, no policy phrases, and no second search in a filter.
    assert plan.count("regexp_extract_all") == len(DATE_PATTERNS)
