"""Registered queries against their SQL. Set PAGEWATCH_ALL=1 to run every one of them."""

import os

import pytest

import __spark_entry__ as entry
from pagewatch.catalog.oracle import ORACLES
from pagewatch.catalog.queries import QUERIES
from tools.compare import compare, connect

QUICK = [
    "a1_watchlist_source", "b1_validate_watchlist", "b5_linked_doc_filter", "b7_header_normalise",
    "c1_previous_state_lookup", "c2_first_detection", "c3_linked_doc_diff", "d1_watchlist_summary",
    "d3_recheck_status", "e1_previous_values", "e2_latest_state", "f1_upcoming_checks",
    "g4_watchlist_dedupe", "h1_normalize_url", "h2_url_variants", "h7_meta_tags", "h12_page_links",
    "h19_policy_keyword_counts", "h20_version_indicators", "h26_canonical_json",
    "h28_document_fingerprint", "h29_model_card_fields", "i12_linked_document_changes",
    "i_all_changes", "i12_documents_in_detection", "j2_stateful_numeric_diff",
]
NAMES = list(QUERIES) if os.environ.get("PAGEWATCH_ALL") else QUICK


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, sf_dir, name):
    text, _ = compare(spark, con, name, sf_dir)
    assert text.startswith("ok") and "types" not in text, text


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns[:4] == ["url", "captured_at", "ordinal", "cycle_id"]
