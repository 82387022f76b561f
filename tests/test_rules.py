"""Rules at their thresholds, and rows that must stay silent."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagewatch.operators import alerts, rules
from tests.test_history import SCHEMA, capture

URL = "http://a.example/p"


def pair(spark, prev, cur):
    """Rows with the snapshots of two captures as ``prev`` and ``cur``."""
    both = spark.createDataFrame([prev, cur], SCHEMA).withColumn("s", rules.snapshot())
    return both.groupBy().agg(
        F.min_by("s", "ordinal").alias("prev"), F.max_by("s", "ordinal").alias("cur")
    ).withColumns({"url": F.lit(URL), "captured_at": F.lit(dt.datetime(2024, 1, 1)), "ordinal": F.lit(1)})


def changed(spark, prev, cur, **kw):
    return rules.with_changes(pair(spark, prev, cur), **kw).first().changes


def edit(row, **fields):
    names = [part.strip().split(" ")[0] for part in SCHEMA.split("profile ")[0].split(",") if " " in part.strip()]
    row = list(row)
    for name, value in fields.items():
        row[names.index(name) if name != "profile" else 10] = value
    return tuple(row)


def page(n, title="same", canonical=None, words=10, headings=(1,), counts=(0,) * 6, versions=(), legal=False,
         og=None, other=None, structured="{}", error=None, description=None):
    analysis = None if error else (words, headings, *counts, list(versions), legal)
    profile = (error, title, description, canonical, og or {}, other or {}, structured, analysis)
    return edit(capture(URL, n, title="x"), profile=profile)


def test_equal_pages_are_silent(spark):
    for build in (page, lambda n: page(n, error="HTTP 404 - Cannot parse HTML", title=None)):
        assert changed(spark, build(1), build(2)) == []


@pytest.mark.parametrize("old, new, severity", [(200, 399, "medium"), (200, 400, "high"), (404, None, "medium"), (None, 200, "medium")])
def test_status(spark, old, new, severity):
    got = changed(spark, edit(page(1), status_code=old), edit(page(2), status_code=new))
    assert [(c.change_type, c.severity) for c in got] == [("status_change", severity)]


@pytest.mark.parametrize("delta, fires", [(1000, False), (1001, True), (-1001, True)])
def test_content_size(spark, delta, fires):
    got = changed(spark, edit(page(1), content_length=2000), edit(page(2), content_length=2000 + delta))
    assert [c.change_type for c in got] == (["content_size_change"] if fires else [])
    if fires:
        assert got[0].delta == delta and got[0].change_percent == pytest.approx(abs(delta) / 2000 * 100)


@pytest.mark.parametrize("words, severity", [(60, None), (61, "low"), (110, "low"), (111, "medium")])
def test_words(spark, words, severity):
    got = changed(spark, page(1, words=10), page(2, words=words))
    assert [c.severity for c in got] == ([severity] if severity else [])


def test_percent_of_nothing(spark):
    assert changed(spark, page(1, words=0), page(2, words=51))[0].change_percent == 5100.0


@pytest.mark.parametrize("count, fires", [(2, False), (3, True)])
def test_policy_keywords(spark, count, fires):
    got = changed(spark, page(1), page(2, counts=(0, 0, count, 0, 0, 0)))
    assert [(c.change_type, c.field, c.policy_alert) for c in got] == (
        [("policy_keyword_change", "liability", True)] if fires else []
    )


def test_version_marks_compare_as_sets(spark):
    assert changed(spark, page(1, versions=["1", "2"]), page(2, versions=["2", "1", "1"])) == []
    got = changed(spark, page(1, versions=["1"]), page(2, versions=[]))
    assert (got[0].rule_ordinal, got[0].old_value, got[0].new_value) == (29, '["1"]', "[]")


def test_page_fields(spark):
    got = changed(
        spark,
        page(1, title=None, og={"title": "a", "site": "x"}, other={"version": "1"}, legal=False),
        page(2, title="t", description="", canonical="/c", og={"image": "i"}, other={"version": "2"}, legal=True),
    )
    assert [(c.change_type, c.field) for c in got] == [
        ("title_change", None), ("meta_description_change", None), ("canonical_url_change", None),
        ("opengraph_change", "title"), ("opengraph_change", "image"), ("version_change", None),
        ("legal_language_change", None),
    ]
    assert [c.rule_ordinal for c in got] == sorted(c.rule_ordinal for c in got)


def test_lost_profile_skips_page_rules(spark):
    lost = edit(page(2), profile=None, status_code=None, headers={})
    assert [c.change_type for c in changed(spark, page(1), lost)] == ["status_change"]
    assert [c.change_type for c in changed(spark, edit(lost, ordinal=1), page(3, title="new"))] == ["status_change"]


def test_blocked_page_fires_page_rules_but_no_structured_change(spark):
    ok = page(1, words=100, structured='{"json_ld":[],"microdata":{}}')
    blocked = page(2, title=None, error="HTTP 500 - Cannot parse HTML")
    there = [c.change_type for c in changed(spark, ok, blocked)]
    assert there == ["title_change", "word_count_change", "heading_structure_change"]
    back = [c.change_type for c in changed(spark, edit(blocked, ordinal=1), edit(ok, ordinal=2))]
    assert back == ["title_change", "structured_data_change", "word_count_change", "heading_structure_change"]


def test_headers(spark):
    old = edit(page(1), headers={"etag": "1", "date": "a", "last-modified": "m", "age": "1"})
    new = edit(page(2), headers={"etag": "2", "date": "b", "cache-control": "no", "age": "2"})
    got = [(c.rule_ordinal, c.field, c.severity) for c in changed(spark, old, new)]
    assert got == [(5, "last-modified", "low"), (6, "etag", "medium"), (9, "cache-control", "medium")]


def test_model_card(spark):
    old = page(1, structured='{"json_ld":[{"@type":"Model","license":"a","name":"m"}],"microdata":{}}')
    new = page(2, structured='{"json_ld":[{"@type":"Model","license":{"b":1},"name":"m","other":2}],"microdata":{}}')
    got = changed(spark, old, new)
    assert [c.change_type for c in got] == ["structured_data_change", "model_card_change"]
    assert (got[1].field, got[1].old_value, got[1].new_value) == ("license", '"a"', '{"b":1}')


def test_own_rule_and_thresholds(spark):
    def headings(cur, prev, limits):
        return [rules.Rule(31, "h1_change", "own", "low", cur["headings"]["h1"] > prev["headings"]["h1"])]

    sets = [*rules.DEFAULT_RULES, headings]
    got = changed(spark, page(1, words=10), page(2, words=15, headings=(2,)), rule_sets=sets, limits=rules.Thresholds(word_count=4))
    assert [c.change_type for c in got] == ["word_count_change", "heading_structure_change", "h1_change"]


@pytest.mark.parametrize(
    "words, versions, modified, expected",
    [
        (110, ["1"], "a", []),
        (111, ["1"], "a", ["STEALTH_CONTENT_CHANGE"]),
        (111, ["2"], "a", []),
        (59, ["1"], "b", ["STEALTH_LAST_MODIFIED_UPDATE"]),
        (60, ["1"], "b", []),
        (10, ["1"], None, ["STEALTH_LAST_MODIFIED_UPDATE"]),
    ],
)
def test_alerts(spark, words, versions, modified, expected):
    old = edit(page(1, versions=["1"]), headers={"last-modified": "a"})
    new = edit(page(2, words=words, versions=versions), headers={"last-modified": modified} if modified else {})
    got = alerts.policy_alerts(pair(spark, old, new)).collect()
    assert [a.alert_type for a in got] == expected
    if modified is None:
        assert got[0].last_modified_change == "a -> None"
