"""State folders, linked documents in detection, and whole feed runs with all outputs, failures included."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagewatch import schemas
from pagewatch.operators import reports
from pagewatch.operators.documents import MANIFEST, NOT_CAPTURED, fetched_fingerprints, with_manifests
from pagewatch.operators.rules import long_changes
from pagewatch.plans import detection
from pagewatch.sources.captures import normalize_captures, stream_captures
from pagewatch.sources.tables import KEPT_VERSIONS, PageState
from pagewatch.streaming import feeds

CYCLES = ["c1", "c2", "c3"]
PAGE = "http://a.example/p"
DOCUMENTS = "cycle_id string, link string, content string, content_type string, status_code int, declared_length long, error string"
RECORDS = "history_key string, url string, final_url string, captured_at timestamp_ntz, ordinal bigint, note string"


def captures(spark, cycles=CYCLES):
    html = '<html><title>same</title><p>one two</p><a href="/terms.pdf">t</a><a href="/x.html">x</a></html>'
    rows = [
        (url, dt.datetime(2024, 1, 1 + CYCLES.index(c)), 200, {"Content-Type": "text/html"}, url, html, None, 0.0, None, c, n)
        for c in cycles for n, url in enumerate([PAGE, "http://b.example/q"], 10 * CYCLES.index(c))
    ]
    return spark.createDataFrame(rows, schemas.CAPTURES)


def documents(spark):
    body = {"c1": "first", "c2": "second"}
    rows = [(c, "/terms.pdf", body[c], "application/pdf", 200, None, None) for c in body]
    rows += [("c3", "/terms.pdf", None, None, None, None, "timed out"), ("c1", "/unlinked.pdf", "z", None, 200, None, None)]
    return spark.createDataFrame(rows, DOCUMENTS)


def schedule(spark):
    return spark.createDataFrame([(PAGE, "high")], "url string, priority string")


def kinds(rows):
    return sorted((r.url, r.cycle_id, r.change_type, r.field) for r in rows)


WANT = sorted(
    [(u, "c1", "first_detection", None) for u in (PAGE, "http://b.example/q")]
    + [(u, c, "linked_document_changed", "/terms.pdf") for u in (PAGE, "http://b.example/q") for c in ("c2", "c3")]
)


def test_only_change_is_a_document(spark):
    records = detection.profile_records(normalize_captures(captures(spark)), documents(spark))
    detected = detection.replay_changes(records)
    assert kinds(long_changes(detected, "url", "cycle_id").collect()) == WANT
    log = {(r.url, r.cycle_id): (r.change_type, r.change_details, r.priority) for r in reports.change_log_rows(detected, schedule(spark)).collect()}
    kind, text, priority = log[PAGE, "c2"]
    assert kind == "linked_document_changed" and priority == "high" and text.startswith("Linked doc changed: /terms.pdf (old:")
    assert log["http://b.example/q", "c2"][2] is None  # not in the watchlist: still logged
    stats = {r.cycle_id: r.changes_detected for r in reports.cycle_stats(detected).collect()}
    assert stats == {"c1": 2, "c2": 2, "c3": 2}
    without = detection.replay_changes(detection.profile_records(normalize_captures(captures(spark))))
    assert [k for k in kinds(long_changes(without, "url", "cycle_id").collect()) if k[2] != "first_detection"] == []


def test_manifest_tells_failed_missing_skipped_and_empty(spark):
    given = [("c", "/a.pdf", "", "application/pdf", 200, None, None), ("c", "/b.pdf", None, None, 500, None, "no answer"),
             ("c", "/d.html", "page", "text/html", 200, 7, None), ("c", "/a.pdf", "", "application/pdf", 200, None, None)]
    records = spark.createDataFrame(
        [("u", 1, 1, "c", (["/a.pdf", "/b.pdf", "/c.pdf", "/d.html", "/e.html"],)), ("v", 1, 2, "c", ([],)), ("w", 1, 3, "c", None)],
        "url string, captured_at int, ordinal int, cycle_id string, profile struct<links: array<string>>",
    ).withColumn("profile", F.when(F.col("profile").isNotNull(), F.struct(
        F.transform("profile.links", lambda x: F.struct(x.alias("url"))).alias("important_links"))))
    found = {r.url: r.documents for r in with_manifests(records, spark.createDataFrame(given, DOCUMENTS)).collect()}
    seen = {k: (d.hash is not None, d.length, d.skipped, d.error) for k, d in found["u"].items()}
    assert seen == {
        "/a.pdf": (True, 0, False, None), "/b.pdf": (False, None, False, "no answer"), "/c.pdf": (False, 0, False, NOT_CAPTURED),
        "/d.html": (False, 7, True, None), "/e.html": (False, 0, True, None),
    }
    assert found["v"] == {} and found["w"] is None
    assert fetched_fingerprints(spark.createDataFrame(given, DOCUMENTS)).count() == 3
    assert "MAP" in MANIFEST


# ------------------------------------------------------------------ state


def records(spark, keys, version):
    at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=version)
    return spark.createDataFrame([(k, k, k, at, version, f"v{version}") for k in keys], RECORDS)


def test_state_reads_only_the_buckets_of_a_batch(spark, tmp_path):
    store = PageState(spark, str(tmp_path / "state"), buckets=16)
    store.write(records(spark, [f"k{n}" for n in range(200)], 0), 0)
    store.write(records(spark, ["k1", "k7"], 1), 1)
    keys = spark.createDataFrame([("k1",), ("k7",), ("new",)], "history_key string")
    rows = store.read(keys=keys)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    got = {r.history_key: r.note for r in rows.collect()}
    assert got["k1"] == got["k7"] == "v1" and len(got) < 100
    whole = {r.history_key: r.note for r in store.read().collect()}
    assert len(whole) == 200 and all(whole[k] == n for k, n in got.items())


def test_superseded_folders_are_removed(spark, tmp_path):
    store = PageState(spark, str(tmp_path / "state"), buckets=2)
    for version in range(24):
        store.write(records(spark, [f"k{version % 5}", "hot"], version), version)
        if version % 6 == 5:
            store.compact(version)
        assert len(list((tmp_path / "state" / "data").iterdir())) <= 6 + KEPT_VERSIONS
        assert len(list((tmp_path / "state" / "commits").glob("*.json"))) <= KEPT_VERSIONS
    assert {r.history_key: r.note for r in store.read().collect()} == {
        "k0": "v20", "k1": "v21", "k2": "v22", "k3": "v23", "k4": "v19", "hot": "v23"}
    assert {r.note for r in store.read(before=23).where("history_key = 'hot'").collect()} == {"v22"}


def test_folder_without_commit_does_not_count(spark, tmp_path, monkeypatch):
    store = PageState(spark, str(tmp_path / "state"))
    store.write(records(spark, ["a"], 0), 0)
    monkeypatch.setattr(PageState, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.write(records(spark, ["a", "b"], 1), 1)
    monkeypatch.undo()
    assert [r.note for r in store.read().collect()] == ["v0"]
    store.write(records(spark, ["a", "b"], 1), 1)
    assert {r.note for r in store.read().collect()} == {"v1"}
    assert len(list((tmp_path / "state" / "data").iterdir())) == 2  # what was left behind is gone
    store.write(records(spark, [], 2), 2)
    assert len(store.folders()) == 2 and store.read().count() == 2


# ------------------------------------------------------------------ the feed


def run_feed(spark, root):
    feeds.start_change_feed(
        stream_captures(spark, f"{root}/in"), f"{root}/state", f"{root}/out", f"{root}/checkpoint", compact_every=2,
        documents=lambda batch: documents(batch.sparkSession), schedule=schedule, report_path=f"{root}/reports",
        availableNow=True,
    ).awaitTermination()


def outputs(spark, root):
    read = lambda name: spark.read.parquet(f"{root}/reports/{name}")
    found = long_changes(spark.read.parquet(f"{root}/out"), "url", "cycle_id").collect()
    log = sorted((r.URL, r["Change Type"], r["Change Details"]) for r in read("log").collect())
    stats = {r.cycle_id: (r.urls_checked, r.changes_detected, r.successful, r.failed, r.first_run)
             for r in detection.merged_stats(read("stats")).collect()}
    return kinds(found), log, stats, read("report").count(), read("alerts").count()


@pytest.mark.parametrize("broken", [None, "write", "write_outputs"])
def test_feed_writes_all_outputs_and_survives_failures(spark, tmp_path, monkeypatch, broken):
    """A failure before the state is committed, or before the outputs are written, changes nothing in the end."""
    for cycle in CYCLES:
        captures(spark, [cycle]).write.mode("append").parquet(str(tmp_path / "in"))
        if broken and cycle == "c2":
            home = PageState if broken == "write" else feeds
            with monkeypatch.context() as patch:
                patch.setattr(home, broken, lambda *a, **k: (_ for _ in ()).throw(OSError("lost executor")))
                with pytest.raises(Exception):
                    run_feed(spark, tmp_path)
        run_feed(spark, tmp_path)
    found, log, stats, reported, alerts = outputs(spark, tmp_path)
    assert found == WANT
    assert len(log) == 6 and sum("Linked doc changed" in text for _, _, text in log) == 4
    assert stats == {"c1": (2, 2, 2, 0, True), "c2": (2, 2, 2, 0, False), "c3": (2, 2, 2, 0, False)}
    assert reported == 6 and alerts == 0
