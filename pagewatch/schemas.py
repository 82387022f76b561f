"""Explicit schemas of the input tables."""

WATCHLIST = "url STRING, type STRING, priority STRING, ordinal BIGINT"

WATCHLIST_DOCUMENT = (
    "central_check_interval INT, "
    "monitored_urls ARRAY<STRUCT<url STRING, type STRING, priority STRING, check_interval INT>>, "
    "scheduling STRUCT<polling_interval INT>"
)

CAPTURES = (
    "url STRING, captured_at TIMESTAMP_NTZ, status_code INT, headers MAP<STRING,STRING>, "
    "final_url STRING, html STRING, content_length BIGINT, response_time DOUBLE, error STRING, "
    "cycle_id STRING, ordinal BIGINT"
)

LINKED_DOCUMENTS = (
    "page_key STRING, link STRING, content STRING, content_type STRING, status_code INT, "
    "declared_length BIGINT"
)
