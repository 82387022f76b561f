"""One query per operator, each over whole provided tables or tables derived from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewatch import schemas
from pagewatch.functions import html as H
from pagewatch.functions import jsonld as J
from pagewatch.functions import text as X
from pagewatch.functions.headers import drop_volatile, normalize_headers
from pagewatch.functions.urls import normalize_url, url_variants
from pagewatch.operators import alerts, documents, history, reports, rules, skew, watchlist
from pagewatch.operators.profile import profile_captures, with_page_fields
from pagewatch.plans.detection import profile_records, replay_changes, run_batch
from pagewatch.session import shared_dir
from pagewatch.sources import derived as D
from pagewatch.sources.captures import spread, stream_captures
from pagewatch.sources.lists import read_watchlist
from pagewatch.sources.tables import PageState, materialize
from pagewatch.streaming.feeds import start_change_feed, start_numeric_feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CAPTURE = ["url", "captured_at", "ordinal", "cycle_id"]
PAGE = ["page_id", "cycle_no"]


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return register


# ------------------------------------------------------------------ shared inputs


def tagged(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    profiled = profile_captures(D.tagged_captures(spark, sf_dir), list(fields) or None)
    return profiled.where("profile IS NOT NULL")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.pair_with_previous(profile_records(D.page_captures(spark, sf_dir)))


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_changes(profile_records(D.page_captures(spark, sf_dir)))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.long_changes(detected(spark, sf_dir), *CAPTURE)


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watchlist.schedule_entries(D.watchlist(spark, sf_dir))


def recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = schedule(spark, sf_dir).withColumn("url_key", F.col("ordinal"))
    return watchlist.recheck_state(entries, D.check_log(spark, sf_dir), D.CHECK_INTERVAL)


# ------------------------------------------------------------------ sources and sinks


@query("a1_watchlist_source")
def a1(spark, sf_dir):
    # Documents of up to a hundred entries, a file each. Entries leave out values that equal the defaults; the source fills them in.
    entry = F.struct(
        "ordinal",
        "url",
        F.nullif("type", F.lit("policy")).alias("type"),
        F.nullif("priority", F.lit("medium")).alias("priority"),
        F.lit(60).alias("check_interval"),
    )
    texts = (
        D.watchlist(spark, sf_dir)
        .groupBy(F.expr("ordinal div 100").alias("document"))
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        .select("document", F.to_json(F.struct(F.transform("entries", lambda e: e.dropFields("ordinal")).alias("monitored_urls"))))
    )
    folder = shared_dir(spark, "watchlist")
    texts.write.partitionBy("document").text(folder)
    number = F.regexp_extract(F.col("ordinal.document"), r"/document=(\d+)/", 1).cast("bigint")
    return read_watchlist(spark, folder).select(
        "url", "type", "priority", number.alias("document"), F.col("ordinal.position").alias("position"), "check_interval"
    )


@query("a2_captures_source")
def a2(spark, sf_dir):
    return D.page_captures(spark, sf_dir).select(
        *PAGE, "url", "captured_at", "status_code", "final_url", "content_length", "error",
        F.col("headers")["ETag"].alias("etag"), F.size("headers").cast("bigint").alias("n_headers"),
    )


@query("a3_linked_docs_source")
def a3(spark, sf_dir):
    return D.linked_docs(spark, sf_dir).select(
        "cycle_no", "page_key", "link", "content_type", "status_code",
        F.octet_length("content").cast("bigint").alias("bytes"),
    )


@query("a4_state_read")
def a4(spark, sf_dir):
    store = PageState(spark, shared_dir(spark, "page-state"))
    state = D.page_state(spark, sf_dir)
    stored_at = F.lit("2024-01-01").cast("timestamp_ntz")
    store.write(state.withColumns({"captured_at": stored_at, "ordinal": F.col("insertion_seq")}), 0)
    return store.read().select(*state.columns)


@query("a5_state_write")
def a5(spark, sf_dir):
    records = profile_records(D.page_captures(spark, sf_dir))
    store = PageState(spark, shared_dir(spark, "page-state"))
    cycles = [f"cycle_2024010{n}_000000" for n in (2, 3, 4)]
    for version, cycle in enumerate(cycles):
        store.write(records.where(F.col("cycle_id") == cycle), version)
    store.compact(1)
    return store.read().select(
        "history_key", "url", "captured_at", "ordinal", "status_code", "final_url", "content_length",
        F.col("headers")["etag"].alias("etag"), F.col("profile.title").alias("title"),
        F.col("profile.structured_hash").alias("structured_hash"), "first_captured_at",
    )


@query("a6_cycle_report_sink")
def a6(spark, sf_dir):
    path = shared_dir(spark, "cycle-report")
    found = materialize(detected(spark, sf_dir), "detected")
    reports.write_cycle_report(found, schedule(spark, sf_dir), path)
    change = "rule_ordinal INT, change_type STRING, severity STRING, policy_alert BOOLEAN"
    nested = spark.read.schema(
        f"report_id STRING, url STRING, timestamp STRING, change_source STRING, priority STRING, changes ARRAY<STRUCT<{change}>>"
    ).json(f"{path}/changes")
    summary = spark.read.schema(
        "report_id STRING, summary STRUCT<total_changes BIGINT, first_run BOOLEAN>, cycle_stats STRUCT<urls_checked BIGINT>"
    ).json(f"{path}/summary")
    return nested.join(summary, "report_id").select(
        "report_id", "url", "timestamp", "change_source", "priority",
        reports.change_types(F.col("changes")).alias("change_types"),
        F.col("summary.total_changes").alias("total_changes"),
        F.col("summary.first_run").alias("first_run"),
        F.col("cycle_stats.urls_checked").alias("urls_checked"),
    )


@query("a7_change_log_sink")
def a7(spark, sf_dir):
    path = shared_dir(spark, "change-log")
    rows = reports.change_log_rows(detected(spark, sf_dir), schedule(spark, sf_dir))
    reports.append_change_log(rows, path)
    return spark.read.parquet(path)


@query("a8_cycle_summary")
def a8(spark, sf_dir):
    return reports.cycle_summary(materialize(detected(spark, sf_dir), "detected"))


# ------------------------------------------------------------------ projections and filters


@query("b1_validate_watchlist")
def b1(spark, sf_dir):
    return watchlist.validate(D.watchlist(spark, sf_dir), interval=120)


@query("b2_list_watchlist")
def b2(spark, sf_dir):
    return watchlist.listing(D.watchlist(spark, sf_dir))


@query("b3_due_urls")
def b3(spark, sf_dir):
    return watchlist.due_urls(recheck(spark, sf_dir), D.AS_OF).select(
        "url", "type", "priority", "last_checked", "next_check"
    )


@query("b4_parse_gate")
def b4(spark, sf_dir):
    profiled = profile_captures(D.tagged_captures(spark, sf_dir), ["error", "title"])
    return profiled.select(
        "page_id", F.col("profile").isNotNull().alias("has_profile"), "profile.error",
        F.col("profile.title").isNotNull().alias("has_title"),
    )


@query("b5_linked_doc_filter")
def b5(spark, sf_dir):
    docs = D.linked_docs(spark, sf_dir)
    return docs.select(
        "cycle_no", "link", "content_type",
        documents.is_followed(F.col("content_type"), F.col("link")).alias("followed"),
    )


def _header_rows(spark, sf_dir):
    """Header maps with volatile entries and with keys that collide once lowered."""
    volatile = F.map_from_arrays(
        F.array(F.lit("Date"), F.lit("x-cache"), F.lit("etag")),
        F.array(F.col("captured_at").cast("string"), F.lit("HIT"), F.concat(F.lit("late-"), F.col("url"))),
    )
    merged = F.map_concat(F.col("headers"), volatile)
    return D.page_captures(spark, sf_dir).where("error IS NULL").select(*PAGE, merged.alias("headers"))


@query("b6_volatile_header_drop")
def b6(spark, sf_dir):
    rows = _header_rows(spark, sf_dir).select(*PAGE, normalize_headers(F.col("headers")).alias("h"))
    return rows.select(*PAGE, F.explode(drop_volatile(F.col("h"))).alias("name", "value"))


@query("b7_header_normalise")
def b7(spark, sf_dir):
    rows = _header_rows(spark, sf_dir)
    return rows.select(*PAGE, F.explode(normalize_headers(F.col("headers"))).alias("name", "value"))


@query("b8_link_skip_filter")
def b8(spark, sf_dir):
    fields = with_page_fields(D.tagged_captures(spark, sf_dir)).select("page_id", F.inline("_anchors"))
    return fields.select("page_id", "href", H.is_followed(F.col("href")).alias("kept"))


@query("b9_change_log_rows")
def b9(spark, sf_dir):
    return reports.change_log_rows(detected(spark, sf_dir), schedule(spark, sf_dir))


@query("b10_policy_changes_only")
def b10(spark, sf_dir):
    return rules.policy_changes(changes(spark, sf_dir))


# ------------------------------------------------------------------ joins


@query("c1_previous_state_lookup")
def c1(spark, sf_dir):
    return history.lookup_in_state(D.table(spark, sf_dir, "pages"), D.page_state(spark, sf_dir))


@query("c2_first_detection")
def c2(spark, sf_dir):
    pages = D.table(spark, sf_dir, "pages").select("page_id", "url")
    return history.first_detections(pages, D.page_state(spark, sf_dir))


def _manifest(spark, sf_dir, cycle):
    docs = D.linked_docs(spark, sf_dir).where(F.col("cycle_no") == cycle)
    return documents.fingerprints(docs)


@query("c3_linked_doc_diff")
def c3(spark, sf_dir):
    return documents.manifest_changes(_manifest(spark, sf_dir, 2), _manifest(spark, sf_dir, 1)).select(
        "page_key", "link", "change_type", "old_hash", "new_hash"
    )


def _cards(spark, sf_dir):
    """Model-card fields of every capture that carries structured data."""
    profiled = profile_captures(
        D.page_captures(spark, sf_dir), ["json_ld", "structured_canonical"]
    ).where(F.size("profile.json_ld") > 0)
    card = F.from_json(J.model_card(F.col("profile.structured_canonical")), "map<string,string>")
    return profiled.select(*PAGE, F.explode(card).alias("field", "value"))


@query("c4_model_card_diff")
def c4(spark, sf_dir):
    cards = _cards(spark, sf_dir)
    before = cards.withColumn("cycle_no", F.col("cycle_no") + 1)
    return documents.field_changes(cards, before, PAGE)


@query("c5_enrich_with_priority")
def c5(spark, sf_dir):
    return reports.with_priority(changes(spark, sf_dir), schedule(spark, sf_dir)).select(
        "url", "captured_at", "rule_ordinal", "field", "priority"
    )


@query("c6_as_of_previous_capture")
def c6(spark, sf_dir):
    paired = pairs(spark, sf_dir)
    return paired.select(
        *CAPTURE, F.col("prev.captured_at").alias("prev_at"), F.col("prev.ordinal").alias("prev_ordinal"),
        F.col("prev.url").alias("prev_url"),
    )


# ------------------------------------------------------------------ aggregates


@query("d1_watchlist_summary")
def d1(spark, sf_dir):
    return watchlist.summary(D.watchlist(spark, sf_dir))


@query("d2_priority_pivot")
def d2(spark, sf_dir):
    return watchlist.priority_pivot(D.watchlist(spark, sf_dir))


@query("d3_recheck_status")
def d3(spark, sf_dir):
    return watchlist.recheck_status(recheck(spark, sf_dir), D.AS_OF)


@query("d4_cycle_stats")
def d4(spark, sf_dir):
    return reports.cycle_stats(materialize(detected(spark, sf_dir), "detected"))


@query("d5_first_run_flag")
def d5(spark, sf_dir):
    return reports.first_run_flags(D.page_captures(spark, sf_dir))


@query("d6_changes_per_url")
def d6(spark, sf_dir):
    grouped = rules.changes_per_capture(changes(spark, sf_dir), "url", "captured_at", "ordinal")
    return grouped.select(
        "url", "captured_at", "ordinal", F.size("changes").cast("bigint").alias("n_changes"),
        reports.change_types(F.col("changes")).alias("change_types"),
    )


@query("d7_tracked_urls")
def d7(spark, sf_dir):
    captures = D.page_captures(spark, sf_dir)
    state = captures.select(history.history_key(F.col("final_url"), F.col("url")).alias("history_key"))
    return history.tracked_keys(state)


@query("d8_append_counts")
def d8(spark, sf_dir):
    return reports.append_counts(detected(spark, sf_dir))


@query("d9_og_last_wins")
def d9(spark, sf_dir):
    rows = tagged(spark, sf_dir, "og_metadata")
    return rows.select("page_id", F.col("profile.og_metadata")["title"].alias("og_title"))


@query("d10_first_tag_wins")
def d10(spark, sf_dir):
    rows = tagged(spark, sf_dir, "meta_description", "other_metadata")
    return rows.select(
        "page_id", F.col("profile.meta_description").alias("description"),
        F.col("profile.other_metadata")["author"].alias("author"),
        F.col("profile.other_metadata")["robots"].alias("robots"),
    )


# ------------------------------------------------------------------ windows, sorts, sets

LOG_ORDER = ["captured_at", "ordinal"]


def _log_with_previous(spark, sf_dir):
    log = D.capture_log(spark, sf_dir)
    chunks = skew.plan_chunks(log.select("key", *LOG_ORDER), "key", LOG_ORDER)
    value = F.struct("status_code", "content_length", "etag")
    return skew.previous_in_order(log, "key", LOG_ORDER, value, "prev", chunks)


@query("e1_previous_values")
def e1(spark, sf_dir):
    return _log_with_previous(spark, sf_dir).select(
        "key", "ordinal", "status_code", F.col("prev.status_code").alias("prev_status"),
        F.col("prev.content_length").alias("prev_length"), F.col("prev.etag").alias("prev_etag"),
    )


@query("e2_latest_state")
def e2(spark, sf_dir):
    return skew.latest_in_order(D.capture_log(spark, sf_dir), "key", LOG_ORDER)


@query("e3_duplicate_occurrence")
def e3(spark, sf_dir):
    return watchlist.repeated_entries(D.watchlist(spark, sf_dir))


@query("e4_append_batches")
def e4(spark, sf_dir):
    log = materialize(reports.change_log_rows(detected(spark, sf_dir), schedule(spark, sf_dir)), "log")
    return reports.append_batches(log).select("cycle_id", "url", "captured_at", "ordinal", "batch_no")


@query("e5_next_check_times")
def e5(spark, sf_dir):
    return watchlist.next_checks(D.check_log(spark, sf_dir), D.CHECK_INTERVAL)


@query("f1_upcoming_checks")
def f1(spark, sf_dir):
    return watchlist.upcoming_checks(recheck(spark, sf_dir), D.AS_OF)


@query("f2_first_k_items")
def f2(spark, sf_dir):
    rows = tagged(spark, sf_dir, "microdata").where("profile.microdata IS NOT NULL")
    return rows.select("page_id", F.explode("profile.microdata.sample_types").alias("item_type"))


@query("f3_change_order")
def f3(spark, sf_dir):
    rows = detected(spark, sf_dir)
    return rows.select(
        "url", "captured_at", "ordinal", F.posexplode("changes").alias("position", "change")
    ).select("url", "captured_at", "ordinal", "position", "change.change_type", "change.field")


@query("g1_union_changes")
def g1(spark, sf_dir):
    page = changes(spark, sf_dir).select("url", "rule_ordinal", "change_type", "source", "severity", "field")
    linked = documents.manifest_changes(_manifest(spark, sf_dir, 2), _manifest(spark, sf_dir, 1))
    return page.unionByName(
        linked.select(
            F.col("page_key").alias("url"), "rule_ordinal", "change_type", "source", "severity",
            F.col("link").alias("field"),
        )
    )


@query("g2_set_difference_flag")
def g2(spark, sf_dir):
    return pairs(spark, sf_dir).where("prev IS NOT NULL").select(
        "url", "captured_at", "ordinal",
        rules.set_differs(F.col("cur.version_indicators"), F.col("prev.version_indicators")).alias("differs"),
    )


@query("g3_key_union")
def g3(spark, sf_dir):
    keys = _manifest(spark, sf_dir, 1).select("page_key", "link").union(
        _manifest(spark, sf_dir, 2).select("page_key", "link")
    )
    return keys.distinct()


@query("g4_watchlist_dedupe")
def g4(spark, sf_dir):
    return schedule(spark, sf_dir)


# ------------------------------------------------------------------ URL and page functions


@query("h1_normalize_url")
def h1(spark, sf_dir):
    url = F.col("url")
    forms = F.array(
        url, F.upper(url), F.regexp_replace(url, "^(https?://[^/?#]+)", "$1:443"),
        F.concat(url, F.lit(";v=1")),
    )
    rows = D.table(spark, sf_dir, "pages").select("page_id", F.posexplode(forms).alias("form", "url"))
    return rows.select("page_id", "form", normalize_url(F.col("url")).alias("key"))


@query("h2_url_variants")
def h2(spark, sf_dir):
    pages = D.table(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(url_variants(F.col("url"))).alias("variant"))


def _profile_query(name: str, **columns: str) -> None:
    """Query that shows profile fields of the tagged pages; values are profile paths."""
    fields = sorted({path.split(".")[0].split("[")[0] for path in columns.values()})

    @query(name)
    def build(spark, sf_dir):
        shown = [F.expr(f"profile.{path}").alias(out) for out, path in columns.items()]
        return tagged(spark, sf_dir, *fields).select("page_id", *shown)


def _map_query(name: str, field: str) -> None:
    @query(name)
    def build(spark, sf_dir):
        return tagged(spark, sf_dir, field).select(
            "page_id", F.explode(f"profile.{field}").alias("key", "value")
        )


_profile_query("h3_page_title", title="title")
_profile_query("h4_meta_description", description="meta_description")
_profile_query("h5_canonical_url", canonical="canonical_url")
_map_query("h6_og_metadata", "og_metadata")


@query("h7_meta_tags")
def h7(spark, sf_dir):
    return with_page_fields(D.tagged_captures(spark, sf_dir)).select("page_id", F.inline("_metas"))


_map_query("h8_twitter_metadata", "twitter_metadata")
_map_query("h9_other_metadata", "other_metadata")


@query("h10_json_ld")
def h10(spark, sf_dir):
    rows = tagged(spark, sf_dir, "json_ld")
    return rows.select("page_id", F.posexplode("profile.json_ld").alias("pos", "body"))


@query("h11_microdata")
def h11(spark, sf_dir):
    rows = tagged(spark, sf_dir, "microdata")
    return rows.select(
        "page_id", F.col("profile.microdata.item_count").cast("bigint").alias("item_count"),
        F.array_join("profile.microdata.sample_types", " ").alias("sample_types"),
    )


@query("h12_page_links")
def h12(spark, sf_dir):
    return tagged(spark, sf_dir, "important_links").select("page_id", F.inline("profile.important_links"))


@query("h13_clean_text")
def h13(spark, sf_dir):
    rows = with_page_fields(D.tagged_captures(spark, sf_dir)).where("_html IS NOT NULL")
    return rows.select("page_id", F.col("_text").alias("clean_text"))


_profile_query("h15_text_preview", preview="content_analysis.text_preview")


def _content_query(name: str, **columns: str) -> None:
    @query(name)
    def build(spark, sf_dir):
        content = "profile.content_analysis"
        shown = [F.expr(e.replace("@", content)).alias(out) for out, e in columns.items()]
        rows = tagged(spark, sf_dir, "content_analysis").where(f"{content} IS NOT NULL")
        return rows.select("page_id", *shown)


_content_query("h14_word_count", word_count="CAST(@.word_count AS BIGINT)")
_content_query("h16_heading_structure", headings="to_json(@.headings)")
_content_query(
    "h17_element_counts",
    images="CAST(@.image_count AS BIGINT)",
    paragraphs="CAST(@.paragraph_count AS BIGINT)",
    lists="CAST(@.list_count AS BIGINT)",
)
_content_query("h18_has_main_content", main_content="@.has_main_content")


@query("h19_policy_keyword_counts")
def h19(spark, sf_dir):
    docs = spread(D.table(spark, sf_dir, "documents")).withColumn("low", F.lower("text"))
    counts = {f"n_{c}": n for c, n in X.hit_counts(F.col("hits"), F.col("low")).items()}
    rows = docs.withColumn("hits", X.phrase_hits(F.col("low"))).withColumns(counts)
    return rows.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in counts])


def _document_marks(spark, sf_dir, marks):
    docs = spread(D.table(spark, sf_dir, "documents")).withColumn("folded", X.fold_case(F.col("text")))
    found = docs.withColumn("marks", marks(F.col("text"), F.col("folded")))
    # The outer form keeps the optimizer from evaluating the marks once more in a filter.
    rows = found.select("doc_id", F.posexplode_outer("marks").alias("pos", "mark"))
    return rows.where("pos IS NOT NULL")


@query("h20_version_indicators")
def h20(spark, sf_dir):
    return _document_marks(spark, sf_dir, X.version_marks)


@query("h21_date_indicators")
def h21(spark, sf_dir):
    found = tagged(spark, sf_dir, "content_analysis.date_indicators")
    marks = F.col("profile.content_analysis.date_indicators")
    # The outer form keeps the optimizer from evaluating the marks once more in a filter.
    return found.select("page_id", F.posexplode_outer(marks).alias("pos", "mark")).where("pos IS NOT NULL")


_content_query("h22_has_legal_language", has_legal_language="@.has_legal_language")
_profile_query("h23_page_language", language="language")
_profile_query("h24_page_charset", charset="charset")
_profile_query("h25_forms_and_comments", has_forms="has_forms", has_comments="has_comments")


@query("h26_canonical_json")
def h26(spark, sf_dir):
    events = D.table(spark, sf_dir, "events")
    # Every tenth text is cut open, so that it is no JSON any more.
    text = F.when(F.col("event_id") % 10 == 9, F.rtrim("props", F.lit("}"))).otherwise(F.col("props"))
    return events.select("event_id", J.canonical_json(text).alias("canonical"))


@query("h27_json_hash")
def h27(spark, sf_dir):
    events = D.table(spark, sf_dir, "events")
    return events.select("event_id", J.json_hash(J.canonical_json(F.col("props"))).alias("hash"))


@query("h28_document_fingerprint")
def h28(spark, sf_dir):
    return documents.fingerprints(D.linked_docs(spark, sf_dir))


@query("h29_model_card_fields")
def h29(spark, sf_dir):
    rows = tagged(spark, sf_dir, "json_ld", "structured_canonical").where(F.size("profile.json_ld") > 0)
    card = F.from_json(J.model_card(F.col("profile.structured_canonical")), "map<string,string>")
    return rows.select("page_id", F.explode(card).alias("field", "value"))


# ------------------------------------------------------------------ change rules

RULE_TYPES = {
    "i1_first_detection": "first_detection",
    "i2_status_change": "status_change",
    "i3_redirect_change": "redirect_change",
    "i4_content_size_change": "content_size_change",
    "i5_header_change": "header_change",
    "i6_title_change": "title_change",
    "i7_meta_description_change": "meta_description_change",
    "i8_canonical_url_change": "canonical_url_change",
    "i9_opengraph_change": "opengraph_change",
    "i10_structured_data_change": "structured_data_change",
    "i11_model_card_change": "model_card_change",
    "i13_word_count_change": "word_count_change",
    "i14_heading_structure_change": "heading_structure_change",
    "i16_policy_keyword_change": "policy_keyword_change",
    "i17_version_indicator_change": "version_indicator_change",
    "i18_legal_language_change": "legal_language_change",
}


def _rule_query(name: str, change_type: str) -> None:
    @query(name)
    def build(spark, sf_dir):
        return changes(spark, sf_dir).where(F.col("change_type") == change_type)


for _name, _type in RULE_TYPES.items():
    _rule_query(_name, _type)


@query("i15_version_change")
def i15(spark, sf_dir):
    """No page puts a version among its listed metas; here each capture's etag stands for one."""
    records = profile_records(D.page_captures(spark, sf_dir))
    versions = F.map_concat(
        F.col("profile.other_metadata"), F.create_map(F.lit("version"), F.col("headers")["etag"])
    )
    marked = materialize(
        records.withColumn(
            "profile",
            F.when(F.col("profile").isNotNull(), F.col("profile").withField("other_metadata", versions)),
        ),
        "records",
    )
    found = rules.long_changes(replay_changes(marked), *CAPTURE)
    return found.where("change_type = 'version_change'")


@query("i12_linked_document_changes")
def i12(spark, sf_dir):
    found = documents.manifest_changes(_manifest(spark, sf_dir, 2), _manifest(spark, sf_dir, 1))
    text = reports.document_text(*[F.col(c) for c in ("change_type", "link", "old_hash", "new_hash", "status_code")])
    return found.withColumn("log_text", text)


@query("i12_documents_in_detection")
def i12_detected(spark, sf_dir):
    """Document changes of captured pages, found with all other changes, and their log texts."""
    records = profile_records(D.document_captures(spark, sf_dir), D.fetched_documents(spark, sf_dir))
    found = replay_changes(records).select(
        *CAPTURE, F.col("cur.documents").alias("documents"), F.inline_outer("changes")
    ).where("change_type LIKE 'linked_document%'")
    change = F.struct("change_type", "source", "field", "old_value", "new_value")
    return found.select(
        *CAPTURE, "rule_ordinal", "change_type", "source", "severity", "policy_alert", F.col("field").alias("link"),
        F.col("old_value").alias("old_hash"), F.col("new_value").alias("new_hash"),
        reports.change_text(change, F.col("documents")).alias("log_text"),
    )


@query("i_all_changes")
def all_changes(spark, sf_dir):
    return changes(spark, sf_dir)


def _alerts(spark, sf_dir, kind):
    return alerts.policy_alerts(pairs(spark, sf_dir)).where(F.col("alert_type") == kind)


@query("i19_stealth_content_change")
def i19(spark, sf_dir):
    return _alerts(spark, sf_dir, "STEALTH_CONTENT_CHANGE")


@query("i20_stealth_last_modified_update")
def i20(spark, sf_dir):
    return _alerts(spark, sf_dir, "STEALTH_LAST_MODIFIED_UPDATE")


# ------------------------------------------------------------------ streaming


CYCLES = ["cycle_20240102_000000", "cycle_20240103_000000", "cycle_20240104_000000"]


def _feed(spark, sf_dir, idle_runs: int = 0):
    """Let the cycles arrive one after the other in a folder, with a feed run after each."""
    source, root = shared_dir(spark, "captures"), shared_dir(spark, "feed")
    names = [part.split()[0] for part in schemas.CAPTURES.replace("MAP<STRING,STRING>", "MAP").split(", ")]
    rows = D.page_captures(spark, sf_dir).select(*names)

    def run() -> None:
        stream = stream_captures(spark, source)
        paths = (f"{root}/state", f"{root}/out", f"{root}/checkpoint")
        start_change_feed(stream, *paths, compact_every=2, availableNow=True).awaitTermination()

    for cycle in CYCLES:
        rows.where(F.col("cycle_id") == cycle).write.mode("append").parquet(source)
        run()
    for _ in range(idle_runs):
        run()
    return rules.long_changes(spark.read.parquet(f"{root}/out"), *CAPTURE)


@query("j1_stream_change_feed")
def j1(spark, sf_dir):
    return _feed(spark, sf_dir)


def _numeric_source(spark, sf_dir):
    schema = D.table(spark, sf_dir, "events").schema
    # The glob matches a table that is one file as well as one that is a folder.
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return D.log_of_events(events)


@query("j2_stateful_numeric_diff")
def j2(spark, sf_dir):
    root = shared_dir(spark, "numeric-feed")
    feed = start_numeric_feed(
        _numeric_source(spark, sf_dir), f"{root}/state", f"{root}/out", f"{root}/checkpoint",
        availableNow=True,
    )
    feed.awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch_id", "is_late")


@query("j3_checkpointed_resume")
def j3(spark, sf_dir):
    """The feed starts again on a used checkpoint without new input; nothing is emitted twice."""
    return _feed(spark, sf_dir, idle_runs=1)


@query("j4_micro_batch_trigger")
def j4(spark, sf_dir):
    """The numeric feed on a processing-time trigger, until all input is taken."""
    root = shared_dir(spark, "numeric-feed")
    feed = start_numeric_feed(
        _numeric_source(spark, sf_dir), f"{root}/state", f"{root}/out", f"{root}/checkpoint",
        processingTime="1 second",
    )
    try:
        feed.processAllAvailable()
    finally:
        feed.stop()
    return spark.read.parquet(f"{root}/out").drop("batch_id", "is_late").where("size_changed")


@query("j5_late_capture_rule")
def j5(spark, sf_dir):
    """Cycle 3 is stored first; cycle 2 comes late: its rows stay, but are compared with nothing and not kept."""
    store = PageState(spark, shared_dir(spark, "page-state"))
    captures = D.page_captures(spark, sf_dir)
    run_batch(captures.where("cycle_no = 3"), store, 0)
    late = run_batch(captures.where("cycle_no = 2"), store, 1)
    kept = store.read().select("url", "captured_at", F.lit("state").alias("kind"))
    compared = late.select(
        "url", "captured_at", F.when(F.col("is_late"), "late").otherwise("compared").alias("kind")
    )
    return kept.unionByName(compared)
