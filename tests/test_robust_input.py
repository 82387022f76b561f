"""Inputs that web pages bring and that the fixtures do not hold."""

import time

import pytest
from pyspark.sql import functions as F

from pagewatch.functions import html as H
from pagewatch.functions.jsonld import canonical_or_null, model_card
from pagewatch.functions.text import decode_entities


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("&#0000000065;", "A"), ("&#x0000000041;", "A"), ("it&#146;s &#x80;", "it’s €"),
        ("&#99999999999;", "�"), ("&#0;", "�"), ("&check; &nbsp;&apos;", "✓ \xa0'"), ("&#;", "&#;"),
    ],
)
def test_character_references(spark, text, want):
    assert one(spark, text, decode_entities) == want


def test_tag_with_very_many_attributes(spark):
    tag = "<meta " + " ".join(f'a{i}="x > {i}"' for i in range(100_000)) + ' name="last" content=yes>'
    assert one(spark, tag, lambda c: H.raw_attribute(c, "content")) == "yes"
    assert one(spark, tag, lambda c: H.raw_attribute(c, "name")) == "last"
    assert one(spark, tag, lambda c: H.raw_attribute(c, "absent")) is None
    body = tag.replace("<meta", "<div").replace('name="last"', 'class="the main part"')
    assert one(spark, body, lambda c: H.has_main_content(c, H.tag_names(c))) is True


def test_attribute_forms(spark):
    tag = "<a data-x='href=\"no\"' HREF = \"first\" title href='a b' hidden>"
    assert one(spark, tag, lambda c: H.raw_attribute(c, "href")) == "a b"
    assert one(spark, tag, lambda c: H.raw_attribute(c, "title")) == ""


def test_json_null_is_no_model_card_value(spark):
    card = '{"@type": "SoftwareApplication", "name": "m", "version": null, "metrics": [null]}'
    got = one(spark, card, lambda c: model_card(canonical_or_null(c)))
    assert "version" not in got and "metrics" in got


def test_repeated_json_key_keeps_the_last_value(spark):
    assert one(spark, '{"a": 1, "a": 2}', canonical_or_null) == '{"a":2}'


BLOCKS = {
    "<nav>": H.reduced_document, "<header>": H.reduced_document, "<footer>": H.reduced_document, "<!--": H.visible_document,
    "<script>": H.visible_document, "<style>": H.visible_document, "<a href=x>": H.anchors, "<title>": H.title,
    "<script >": H.json_ld_bodies,
}


@pytest.mark.parametrize("start", BLOCKS)
def test_unclosed_starts_take_linear_time(spark, start):
    text = start * (1_000_000 // len(start))
    begin = time.perf_counter()
    got = one(spark, text, BLOCKS[start])
    assert time.perf_counter() - begin < 8
    # The first start takes all that follows.
    assert got in ("", [text], [], None)


def test_blocks_end_at_their_first_end_or_with_the_page(spark):
    document = "a<nav>1<nav>2</nav>3</nav>b<!-- c -->d<header>f</header>nav<nav>h</NAV >i<footer>j<p>k"
    assert one(spark, document, H.visible_document) == document.replace("<!-- c -->", "")
    assert one(spark, "x<script>y</script>z<!-- w <style>", H.visible_document) == "xz"
    assert one(spark, document, H.reduced_document) == "a3</nav>b<!-- c -->dnavi"
    links = "<a name=x><a href=1>one</a><A href=2>two</a ><a href=3>three"
    assert one(spark, links, H.anchors) == ["<a name=x><a href=1>one</a>", "<A href=2>two</a >", "<a href=3>three"]
    page = "<!--x--><script type='application/ld+json'>{\"a\":\"<!-- b\"}</script><script type=application/ld+json>{}"
    assert one(spark, page, H.json_ld_bodies) == ['{"a":"<!-- b"}', "{}"]
    assert one(spark, "<title>t &amp; u", H.title) == "t & u"
    assert one(spark, None, H.reduced_document) is None and one(spark, "", H.visible_document) == ""
