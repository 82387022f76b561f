"""Lookup of previous captures, against a plain loop over the captures in order."""

import datetime as dt
import random
import time
from collections import defaultdict
from urllib.parse import urlsplit

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewatch.operators.history import latest_records, pair_with_previous
from pagewatch.operators.skew import SkewPolicy, number_in_order, plan_chunks, previous_in_order
from pagewatch.operators.sweep import POSITION, _sweep, holders
from pagewatch.plans.detection import replay_changes
from pagewatch.sources.tables import PageState

START = dt.datetime(2024, 1, 1)
SCHEMA = (
    "url STRING, captured_at TIMESTAMP_NTZ, ordinal BIGINT, cycle_id STRING, status_code INT, "
    "headers MAP<STRING,STRING>, final_url STRING, content_length BIGINT, response_time DOUBLE, "
    "error STRING, profile STRUCT<error STRING, title STRING, meta_description STRING, "
    "canonical_url STRING, og_metadata MAP<STRING,STRING>, other_metadata MAP<STRING,STRING>, "
    "structured_canonical STRING, content_analysis STRUCT<word_count INT, headings STRUCT<h1 INT>, "
    + ", ".join(
        f"{c}_keyword_count INT"
        for c in ("privacy", "terms", "liability", "termination", "rights", "governance")
    )
    + ", version_indicators ARRAY<STRING>, has_legal_language BOOLEAN>>, history_key STRING"
)


def key_of(url):
    """Key of the simple URLs of this test."""
    parts = urlsplit(url)
    path = parts.path[:-1] if parts.path.endswith("/") and parts.path != "/" else parts.path
    return f"{parts.scheme}://{parts.netloc}{path}"


def variants(url):
    parts = urlsplit(url)
    host = parts.netloc[4:] if parts.netloc.startswith("www.") else "www." + parts.netloc
    other = "https" if parts.scheme == "http" else "http"
    return [key_of(f"{other}://{parts.netloc}{parts.path}"), key_of(f"{parts.scheme}://{host}{parts.path}")]


def capture(url, n, final=None, canonical=None, minute=None, **content):
    final = final or url
    words = content.pop("words", 10)
    analysis = (words, (1,), 0, 0, 0, 0, 0, 0, [], False)
    profile = (None, content.pop("title", f"t{n}"), None, canonical, {}, {}, "{}", analysis)
    moment = START + dt.timedelta(minutes=n if minute is None else minute)
    return (url, moment, n, "c", 200, {}, final, 5, 0.0, None, profile, key_of(final))


def loop(captures):
    """What a loop sees that stores every capture at once: ordinal -> ordinal of the previous."""
    stored, seen = {}, {}
    for row in sorted(captures, key=lambda r: (r[1], r[2])):
        url = row[0]
        hit = next((k for k in [url, key_of(url), *variants(url)] if k in stored), None)
        if hit is None:
            wanted = key_of(url)
            hit = next(
                (k for k, r in stored.items()
                 if key_of(r[6]) == wanted or (r[10][3] and key_of(r[10][3]) == wanted)),
                None,
            )
        seen[row[2]] = None if hit is None else stored[hit][2]
        stored[row[11]] = row
    return seen


def random_captures(seed, n):
    rng = random.Random(seed)
    urls = [f"{s}://{w}h{i}.example{p}" for s in ("http", "https") for w in ("", "www.")
            for i in range(3) for p in ("/a", "/a/", "/b?x=1")]
    rows = []
    for i in range(n):
        # One URL makes up a third of all captures, and many share a minute.
        url = urls[0] if rng.random() < 0.34 else rng.choice(urls)
        final = rng.choice(urls) if rng.random() < 0.3 else url
        canonical = rng.choice(urls) if rng.random() < 0.4 else None
        rows.append(capture(url, i, final, canonical, minute=rng.randrange(n // 3)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("policy", [SkewPolicy(), SkewPolicy(min_rows=7, share=0.0)])
def test_pairs_equal_loop(spark, seed, policy):
    rows = random_captures(seed, 240)
    records = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = pair_with_previous(records, policy=policy).select("ordinal", "prev.ordinal").collect()
    assert len(got) == len(rows)
    assert {r[0]: r[1] for r in got} == loop(rows)


def test_declared_canonical_is_last_tier(spark):
    rows = [
        capture("http://a.example/x", 1, canonical="http://c.example/y"),
        capture("http://b.example/x", 2, canonical="http://c.example/y"),
        capture("http://c.example/y", 3, final="http://d.example/"),
        capture("http://a.example/x", 4),
        capture("http://c.example/y", 5, final="http://d.example/"),
    ]
    records = spark.createDataFrame(rows, SCHEMA)
    got = {r[0]: r[1] for r in pair_with_previous(records).select("ordinal", "prev.ordinal").collect()}
    # The first stored page that declares the URL wins while it declares it.
    assert got == loop(rows) == {1: None, 2: None, 3: 1, 4: 1, 5: 2}


@pytest.mark.parametrize("cuts", [[80, 160], [1, 2, 239]])
def test_batches_with_state_equal_replay(spark, tmp_path, cuts):
    rows = sorted(random_captures(3, 240), key=lambda r: (r[1], r[2]))
    whole = spark.createDataFrame(rows, SCHEMA)
    want = {r[0]: r[1] for r in pair_with_previous(whole).select("ordinal", "prev.ordinal").collect()}
    store, got = PageState(spark, str(tmp_path / "state")), {}
    bounds = [0, *cuts, len(rows)]
    for version, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        batch = spark.createDataFrame(rows[lo:hi], SCHEMA)
        paired = pair_with_previous(batch, store.read(before=version))
        got |= {r[0]: r[1] for r in paired.select("ordinal", "prev.ordinal").collect()}
        store.write(batch, version)
        if version == 1:
            store.compact(version)
    assert got == want == loop(rows)
    assert store.read().count() == len({r[11] for r in rows})


def test_state_keeps_newest_and_ignores_late(spark, tmp_path):
    store = PageState(spark, str(tmp_path / "state"))
    url = "http://a.example/x"
    store.write(spark.createDataFrame([capture(url, 5)], SCHEMA), 0)
    late = spark.createDataFrame([capture(url, 2, title="old")], SCHEMA)
    (row,) = replay_changes(late, store.read(before=1)).collect()
    assert row.is_late and row.changes == [] and row.prev is None
    store.write(late, 1)
    assert [r.ordinal for r in store.read().collect()] == [5]
    store.write(late, 1)  # the same version again changes nothing
    assert [r.ordinal for r in store.read().collect()] == [5]


def test_missing_state_is_empty(spark, tmp_path):
    assert PageState(spark, str(tmp_path / "none")).read() is None


def test_latest_records_breaks_ties_by_ordinal(spark):
    rows = [capture("http://a.example/", 1, minute=0), capture("http://a.example/", 2, minute=0)]
    got = latest_records(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.ordinal, r.first_ordinal) for r in got] == [(2, 1)]


def test_replay_of_unchanged_page_has_no_changes(spark):
    rows = [capture("http://a.example/", n, title="same") for n in range(4)]
    got = replay_changes(spark.createDataFrame(rows, SCHEMA)).orderBy("ordinal").collect()
    assert [[c.change_type for c in r.changes] for r in got] == [["first_detection"], [], [], []]


# ------------------------------------------------------------------ hot groups


def hot_rows(spark, n=3000):
    group = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50)
    return spark.range(n).select(
        group.alias("g"), (F.col("id") % 7).alias("t"), "id", (F.col("id") % 5 == 0).alias("w")
    )


def test_hot_group_is_cut_and_result_is_unchanged(spark):
    rows = hot_rows(spark)
    policy = SkewPolicy(min_rows=100, share=0.01)
    chunks = plan_chunks(rows, "g", ["t", "id"], policy=policy)
    assert [r.g for r in chunks.collect()] == [0]  # only the hot group is planned
    assert chunks.selectExpr("size(cuts)").first()[0] > 3

    def previous(plan):
        return {r.id: r.p for r in previous_in_order(rows, "g", ["t", "id"], F.col("id"), "p", plan).collect()}

    got = previous(chunks)
    assert len(got) == 3000 and got == previous(None)


def test_hot_group_with_rare_writes(spark):
    rows = hot_rows(spark)
    for writes in (F.col("w"), F.col("id") == 0):
        chunks = plan_chunks(rows, "g", ["t", "id"], writes, SkewPolicy(min_rows=100, share=0.01))

        def previous(plan):
            out = previous_in_order(rows, "g", ["t", "id"], F.struct("id"), "p", plan, writes)
            return {r.id: r.p and r.p.id for r in out.collect()}

        assert previous(chunks) == previous(None)


def test_numbering_of_hot_group(spark):
    rows = hot_rows(spark)
    order = ["t", "id"]
    cut = number_in_order(rows, "g", order, "n", SkewPolicy(min_rows=100, share=0.01))
    plain = number_in_order(rows, "g", order, "n")
    assert {r.id: r.n for r in cut.collect()} == {r.id: r.n for r in plain.collect()}


def test_even_groups_are_not_cut(spark):
    rows = spark.range(1000).select((F.col("id") % 100).alias("g"), "id")
    assert plan_chunks(rows, "g", ["id"], policy=SkewPolicy(min_rows=20)) is None


def test_declared_tier_does_not_depend_on_other_rows(spark):
    rows = [capture("http://a.example/x", 1, canonical="/p/1"), capture("/p/1", 2)]
    unrelated = [capture("http://b.example/y", 3, canonical="http://c.example/z")]

    def pairs(given):
        records = spark.createDataFrame(given, SCHEMA)
        return {r[0]: r[1] for r in pair_with_previous(records).select("ordinal", "prev.ordinal").collect()}

    assert pairs(rows)[2] == pairs(rows + unrelated)[2] == loop(rows)[2]


# ------------------------------------------------------------------ overlapping claims


def claims_frame(spark, rows):
    spot = "struct<_seq: int, captured_at: timestamp_ntz, ordinal: bigint>"
    at = lambda n: None if n is None else (1, START, n)
    made = [(g, v, at(a), at(b), at(r)) for g, v, a, b, r in rows]
    return spark.createDataFrame(made, f"_group string, value string, start {spot}, end {spot}, rank {spot}")


def holder_at(rows, group, n):
    living = [(r, v) for g, v, a, b, r in rows if g == group and a < n and (b is None or n <= b)]
    return min(living)[1] if living else None


@pytest.mark.parametrize("policy", [SkewPolicy(), SkewPolicy(min_rows=5, share=0.0), SkewPolicy(min_rows=40, share=0.0)])
def test_holders_equal_all_claims(spark, policy):
    rng = random.Random(9)
    rows = []
    for n in range(300):
        start = rng.randrange(400)
        end = rng.choice([None, start + 1, start + rng.randrange(1, 30), start + rng.randrange(1, 300)])
        # One value claims one group many times, with the rank that it always has.
        rows.append((rng.choice("aaab"), f"v{n}", start, None if end is None else end, n * 7 % 300))
    changes = defaultdict(list)
    for r in holders(claims_frame(spark, rows).repartition(3), policy).collect():
        changes[r._group].append((r.ordinal, r.value))
    for group in "ab":
        told = {}
        for at, value in sorted(changes[group], key=lambda c: c[0]):
            assert told.get(at, value) == value  # chunks agree on their border
            told[at] = value
        for n in range(-1, 720):
            last = max((at for at in told if at < n), default=None)
            assert told.get(last) == holder_at(rows, group, n), (group, n)


def test_redirected_url_against_alternating_canonical(spark):
    """Many captures of a URL that others declare on and off: one look back each, not one per interval."""
    wanted = "http://wanted.example/p"
    rows = []
    for n in range(1200):
        if n % 3 == 0:
            rows.append(capture(f"http://a{n // 3 % 4}.example/x", n, canonical=wanted if n // 12 % 2 else None))
        else:
            rows.append(capture(wanted, n, final=f"http://r{n % 2}.example/"))
    records = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for policy in (SkewPolicy(), SkewPolicy(min_rows=60, share=0.0)):
        got = pair_with_previous(records, policy=policy).select("ordinal", "prev.ordinal").collect()
        assert {r[0]: r[1] for r in got} == loop(rows)


def test_sweep_of_many_claims_is_linear():
    """10^5 claims that alternate on one group are swept in seconds, and the heap stays as small as what lives."""
    n = 100_000
    at = [pa.array(c) for c in zip(*[(1, i, i) for i in range(n)])]
    end = [pa.array([None if i % 2 else 1 for i in range(n)], pa.int64()), pa.array([i + 1 for i in range(n)]), pa.array([i + 1 for i in range(n)])]
    names = [f"{p}_{f}" for p in ("start", "end", "rank") for f in POSITION]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["g"] * n), pa.array([0] * n), pa.array([f"k{i % 2}" for i in range(n)]), *at, *end, *at],
        ["_group", "_chunk", "value", *names])
    for name in ("start_captured_at", "end_captured_at", "rank_captured_at"):
        k = batch.schema.get_field_index(name)
        batch = batch.set_column(k, name, batch.column(k).cast(pa.timestamp("us")))
    begin = time.time()
    rows = sum(b.num_rows for b in _sweep(iter([batch])))
    assert time.time() - begin < 10 and rows <= 2 * n
