import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from pagewatch import schemas
from pagewatch.operators import documents, reports, rules, watchlist
from pagewatch.operators.skew import SkewPolicy
from pagewatch.sources.lists import read_linked_documents, read_watchlist

NOW = dt.datetime(2024, 1, 1, 12)


def entries(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schemas.WATCHLIST)


def test_watchlist_defaults_and_legacy_interval(spark):
    text = '{"monitored_urls":[{"url":"http://a/","check_interval":5},{"url":"http://b/","type":"t","priority":"high"}]}'
    document = spark.createDataFrame([(text, 10)], "j string, document bigint").select(
        "document", F.inline(F.array(F.from_json("j", schemas.WATCHLIST_DOCUMENT)))
    )
    got = watchlist.watchlist_of_documents(document).orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [
        ("http://a/", "policy", "medium", (10, 0), 3600), ("http://b/", "t", "high", (10, 1), 3600)
    ]


def test_watchlist_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{\n "central_check_interval": 900,\n "monitored_urls": [\n  {"url": "http://a/"},\n  {"url": "http://b/", "priority": "low"},\n'
        '  {"url": "http://a/", "type": "x"}]}'
    )
    (tmp_path / "b.json").write_text('{"monitored_urls": [{"url": "http://b/", "priority": "high"}, {"url": "http://c/"}]}')
    (tmp_path / "c.json").write_text("\n")
    (tmp_path / "d.json").write_text('{"scheduling": {"polling_interval": 5}}')
    rows = read_watchlist(spark, str(tmp_path))
    got = [(r.ordinal.document[-6:], r.ordinal.position, r.url, r.priority, r.check_interval)
           for r in rows.orderBy("ordinal").collect()]
    assert got == [
        ("a.json", 0, "http://a/", "medium", 900), ("a.json", 1, "http://b/", "low", 900), ("a.json", 2, "http://a/", "medium", 900),
        ("b.json", 0, "http://b/", "high", 3600), ("b.json", 1, "http://c/", "medium", 3600),
    ]
    # Entries at one place of two documents do not tie.
    assert rows.groupBy("ordinal").count().where("count > 1").isEmpty()
    for policy in (SkewPolicy(), SkewPolicy(min_rows=1, share=0.0)):
        again = watchlist.repeated_entries(rows, policy)
        assert {(r.url, r.ordinal.document[-6:], r.occurrence) for r in again.collect()} == {
            ("http://a/", "a.json", 2), ("http://b/", "b.json", 2)}
    merged = {r.url: (r.type, r.priority, r.ordinal.document[-6:], r.ordinal.position) for r in watchlist.schedule_entries(rows).collect()}
    assert merged == {"http://a/": ("x", "medium", "a.json", 0), "http://b/": ("policy", "high", "a.json", 1),
                      "http://c/": ("policy", "medium", "b.json", 1)}
    faults = {r.message for r in watchlist.validate(rows, 10).collect()}
    assert "Duplicate URL: http://b/" in faults and any("too short" in m for m in faults)
    (tmp_path / "e.json").write_text("monitored_urls: nothing")
    with pytest.raises(Exception):
        read_watchlist(spark, str(tmp_path)).collect()


def test_linked_document_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a b%20.pdf").write_bytes(b"one")
    (tmp_path / "deep" / "empty.pdf").write_bytes(b"")
    (tmp_path / "long.pdf").write_bytes(b"x" * 100)
    (tmp_path / "unlisted.pdf").write_bytes(b"z")
    files = {"1": ("a b%20.pdf", 3), "2": ("deep/empty.pdf", 0), "3": ("long.pdf", 100), "4": ("gone.pdf", 5), "5": (None, None),
             "6": ("a b%20.pdf", None), "7": ("a b%20.pdf", 3), "8": ("a b%20.pdf", 9), "9": ("gone.pdf", None)}
    listing = spark.createDataFrame(
        [("c", f"https://d/{k}.pdf", "application/pdf", 200, 9, f, n, "timeout" if k == "7" else None) for k, (f, n) in files.items()],
        "cycle_id string, link string, content_type string, status_code int, declared_length bigint, file string, "
        "stored_length bigint, error string")
    rows = read_linked_documents(listing, str(tmp_path), max_bytes=99)
    one, nothing = hashlib.sha256(b"one").hexdigest(), hashlib.sha256(b"").hexdigest()
    want = {"1": (one, 3, None), "2": (nothing, 0, None), "3": (None, None, "longer than 99 bytes"), "4": (None, None, "missing"),
            "5": (None, None, "no body"), "6": (one, 3, None), "7": (None, None, "timeout"), "8": (None, None, "3 of 9 bytes"),
            "9": (None, None, "missing or empty")}
    assert {r.link[10:-4]: (r.hash, r.length, r.error) for r in rows.collect()} == want
    entries = documents.fetched_fingerprints(rows).collect()
    assert {r.link[10:-4]: (r.entry.hash, r.entry.length, r.entry.error) for r in entries} == want
    no_errors = read_linked_documents(listing.drop("error"), str(tmp_path))
    assert no_errors.where("error is null").count() == 5
    # The bodies are hashed at the scan: no content is shuffled.
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any("content" in line.replace("content_type", "") for line in plan.splitlines() if "Exchange" in line)


def test_validation(spark):
    rows = entries(
        spark, ("http://a/", "p", "low"), ("http://a/", "p", "low"), ("HTTP://b/", "p", "high"),
        ("ftp://c/", "p", "Low"), ("http://a/", "p", "critical"),
    )
    got = {(r.ordinal, r.message) for r in watchlist.validate(rows).collect()}
    assert got == {
        (1, "Duplicate URL: http://a/"), (4, "Duplicate URL: http://a/"),
        (2, "Invalid URL format: HTTP://b/"), (3, "Invalid URL format: ftp://c/"),
        (3, "Invalid priority for ftp://c/: Low"),
    }


@pytest.mark.parametrize("interval, word", [(299, "short"), (300, None), (86400, None), (86401, "long")])
def test_interval_bounds(spark, interval, word):
    got = watchlist.validate(entries(spark, ("http://a/", "p", "low")), interval).collect()
    assert [word in r.message for r in got] == ([True] if word else [])


def test_repeats_of_a_hot_url(spark):
    rows = entries(spark, *[("http://hot/", "p", "low")] * 40, ("http://b/", "p", "low"))
    got = watchlist.repeated_entries(rows, SkewPolicy(min_rows=5, share=0.0)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.occurrence) for r in got] == [(i, i + 1) for i in range(1, 40)]


def test_schedule_takes_later_values_at_first_place(spark):
    rows = entries(spark, ("http://a/", "p", "low"), ("", "p", "low"), ("http://a/", "q", "high"))
    assert [tuple(r) for r in watchlist.schedule_entries(rows).collect()] == [("http://a/", "q", "high", 0)]


def test_recheck(spark):
    checks = spark.createDataFrame(
        [(1, NOW, 1, True), (2, NOW, 2, True), (2, NOW, 3, False), (3, NOW - dt.timedelta(hours=2), 4, True)],
        "url_key bigint, checked_at timestamp_ntz, ordinal bigint, success boolean",
    )
    schedule = spark.createDataFrame([(f"u{i}", "high" if i < 3 else "low", i) for i in range(1, 5)], "url string, priority string, url_key bigint")
    state = watchlist.recheck_state(schedule, checks, interval=3601)
    times = {r.url: r.next_check for r in state.collect()}
    assert times == {
        "u1": NOW + dt.timedelta(seconds=3601), "u2": NOW + dt.timedelta(seconds=1800),
        "u3": NOW - dt.timedelta(seconds=3599), "u4": None,
    }
    assert {r.url for r in watchlist.due_urls(state, NOW + dt.timedelta(seconds=1800)).collect()} == {"u2", "u3", "u4"}
    status = {r.priority: tuple(r)[1:] for r in watchlist.recheck_status(state, NOW).collect()}
    assert status == {"*": (4, 2, 0.0), "high": (2, 0, 1800.0), "low": (2, 2, 0.0)}
    upcoming = watchlist.upcoming_checks(state, NOW, limit=2).collect()
    assert [(r.url, r.seconds_until) for r in upcoming] == [("u3", -3599.0), ("u2", 1800.0)]


@pytest.mark.parametrize(
    "kind, link, followed",
    [
        ("application/PDF ; x", "https://d/x", True), ("text/html", "https://d/x.PDF?q", True),
        ("text/html", "https://d/x.html", False), (None, "https://d/a.docx", True),
        (None, "https://d/a", False), ("", "https://d/a.doc#f", True), ("text/html", "https://d/x?f=.pdf", False),
    ],
)
def test_followed_documents(spark, kind, link, followed):
    df = spark.createDataFrame([(kind, link)], "t string, l string")
    assert df.select(documents.is_followed(F.col("t"), F.col("l"))).first()[0] is followed


def test_manifest_changes(spark):
    schema = "page_key string, link string, hash string, status_code int"
    old = spark.createDataFrame([("p", "same", "1", 200), ("p", "new", "1", 200), ("p", "gone", "9", 200), ("p", "none", None, 200)], schema)
    new = spark.createDataFrame([("p", "same", "1", 200), ("p", "new", "2", 200), ("q", "gone", "9", 201), ("p", "none", None, 404)], schema)
    found = documents.manifest_changes(new, old)
    got = {(r.page_key, r.link, r.change_type, r.severity) for r in found.collect()}
    assert got == {
        ("p", "new", "linked_document_changed", "high"), ("p", "gone", "linked_document_removed", "medium"),
        ("q", "gone", "linked_document_added", "medium"),
    }
    assert documents.manifest_changes(new, old, follow=False).count() == 0
    text = reports.document_text(*[F.col(c) for c in ("change_type", "link", "old_hash", "new_hash", "status_code")])
    assert {r[0] for r in found.select(text).collect()} == {
        "Linked doc changed: new (old:1 new:2)", "Linked doc removed: gone (old_hash:9)",
        "Linked doc added: gone (status:201 type:)",
    }


def test_change_texts(spark):
    def one(kind, old, new):
        change = rules.change_struct(1, kind, "s", "low", False, F.lit(None), F.lit(old), F.lit(new))
        return spark.range(1).select(reports.change_text(change)).first()[0]

    assert one("status_change", "200", None) == "Status: 200→None"
    assert one("redirect_change", None, "u") == "Redirect: None→u"
    assert one("structured_data_change", "a", "b") == "Structured data change: a→b"
    assert one("content_change", None, None) == "Content modified"
    assert one("content_type_change", "a", "b") == "Content-Type: a→b"
    assert one("title_change", "a", "b") is None


def test_iso_time(spark):
    times = [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 60)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    assert [r[0] for r in df.select(reports.iso_time(F.col("t"))).collect()] == [t.isoformat() for t in times]


def test_batches_of_a_large_cycle(spark):
    log = spark.range(1030).select(
        F.when(F.col("id") < 1000, "big").otherwise("small").alias("cycle_id"),
        F.format_string("u%04d", "id").alias("url"), F.lit(NOW).alias("captured_at"), F.col("id").alias("ordinal"),
    )
    got = reports.append_batches(log, policy=SkewPolicy(min_rows=50, share=0.0)).groupBy("cycle_id", "batch_no").count()
    sizes = {(r.cycle_id, r.batch_no): r["count"] for r in got.collect()}
    assert sizes == {**{("big", i): 50 for i in range(20)}, ("small", 0): 30}
