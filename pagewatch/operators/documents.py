"""Linked documents: which bodies count, fingerprints, manifests of pages, and comparison of two manifests.

A manifest is a map from the links of a page to what is known of each document: its hash, status, media type, length,
whether it was skipped, and the error if it could not be read. Every link of the page has an entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagewatch.functions.urls import path as url_path
from pagewatch.operators.rules import differs

ENTRY = "STRUCT<hash: STRING, status_code: INT, content_type: STRING, length: BIGINT, skipped: BOOLEAN, error: STRING>"
MANIFEST = f"MAP<STRING, {ENTRY}>"
NOT_CAPTURED = "not captured"

# Media types and file endings of documents that are followed.
FOLLOWED_TYPES = [
    "application/pdf",
    "application/msword",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
]
FOLLOWED_ENDINGS = [".pdf", ".doc", ".docx"]


def is_followed(
    content_type: Column,
    link: Column,
    types: list[str] = FOLLOWED_TYPES,
    endings: list[str] = FOLLOWED_ENDINGS,
) -> Column:
    """A listed media type or file ending; without a media type the ending decides."""
    known = F.coalesce(content_type, F.lit("")) != ""
    media = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    listed = F.coalesce(media.isin([t.lower() for t in types]), F.lit(False)) if types else known
    lowered = F.lower(url_path(link))
    ended = F.lit(False)
    for ending in endings:
        ended = ended | F.endswith(lowered, F.lit(ending))
    if not endings:
        ended = ~known
    return F.when(known, listed | ended).otherwise(ended)


def fingerprints(documents: DataFrame, **whitelists: list[str]) -> DataFrame:
    """Replace ``content`` by its SHA-256 and byte length.

    Documents that are not followed are listed as skipped, with their declared length.
    Hashing in place needs no shuffle of the bodies, even where pages share a link.
    """
    kept = [c for c in documents.columns if c not in ("content", "declared_length")]
    followed = is_followed(F.col("content_type"), F.col("link"), **whitelists)
    return documents.withColumn("_followed", followed).select(
        *kept,
        F.when(F.col("_followed"), F.sha2("content", 256)).alias("hash"),
        F.when(F.col("_followed"), F.octet_length("content"))
        .otherwise(F.coalesce("declared_length", F.lit(0)))
        .cast("bigint")
        .alias("length"),
        (~F.col("_followed")).alias("skipped"),
    )


def fetched_fingerprints(documents: DataFrame) -> DataFrame:
    """One fingerprint per link and cycle: ``cycle_id, link, entry``, however many pages share the link.

    ``documents`` has ``cycle_id, link, content_type, status_code, declared_length`` and either the ``content`` or its ``hash``
    and ``length``, as the reader gives them. A row with an ``error`` has no fingerprint. Of several rows of a link the least
    entry counts.
    """
    given = documents.columns
    followed = is_followed(F.col("content_type"), F.col("link"))
    failed = F.col("error").isNotNull() if "error" in given else F.lit(False)
    body = F.col("hash") if "hash" in given else F.sha2("content", 256)
    length = F.col("length") if "length" in given else F.octet_length("content")
    read = followed & ~failed
    entry = F.struct(
        F.when(read, body).alias("hash"),
        F.col("status_code").cast("int").alias("status_code"),
        F.col("content_type").alias("content_type"),
        F.when(read, length).when(~failed, F.coalesce("declared_length", F.lit(0))).cast("bigint").alias("length"),
        (~followed).alias("skipped"),
        (F.col("error") if "error" in given else F.lit(None)).cast("string").alias("error"),
    ).cast(ENTRY)
    return documents.select("cycle_id", "link", entry.alias("entry")).groupBy("cycle_id", "link").agg(
        F.min("entry").alias("entry")
    )


def with_manifests(records: DataFrame, documents: DataFrame) -> DataFrame:
    """Add the manifest of each record's own links as ``documents``.

    A link that was not captured in the record's cycle has an error, or is skipped if nothing of its kind is followed. A record
    without a profile has no manifest. Only keys and links are shuffled to meet the documents.
    """
    key = ["url", "captured_at", "ordinal"]
    links = records.select(
        *key, "cycle_id", F.explode(F.array_distinct(F.col("profile.important_links")["url"])).alias("link")
    )
    unknown = ~is_followed(F.lit(None).cast("string"), F.col("link"))
    missing = F.struct(
        F.lit(None), F.lit(None), F.lit(None), F.lit(0), unknown, F.when(~unknown, F.lit(NOT_CAPTURED))
    ).cast(ENTRY)
    manifests = (
        links.join(fetched_fingerprints(documents), ["cycle_id", "link"], "left")
        .groupBy(*key)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("link", F.coalesce("entry", missing))))).alias("documents"))
    )
    empty = F.create_map().cast(MANIFEST)
    return records.join(manifests, key, "left").withColumn(
        "documents", F.when(F.col("profile").isNotNull(), F.coalesce("documents", empty))
    )


def manifest_changes(current: DataFrame, previous: DataFrame, follow: bool = True) -> DataFrame:
    """Documents added, removed or changed between two manifests.

    Rows meet on page and link together, so a page with very many links spreads over tasks.
    """
    if not follow:
        current, previous = current.where(F.lit(False)), previous.where(F.lit(False))

    def side(df: DataFrame, prefix: str) -> DataFrame:
        fields = ["hash", "status_code"]
        return df.select(
            "page_key", "link", F.lit(True).alias(f"{prefix}_here"),
            *[F.col(f).alias(f"{prefix}_{f}") for f in fields],
        )

    both = side(current, "new").join(side(previous, "old"), ["page_key", "link"], "full_outer")
    kind = (
        F.when(F.col("old_here").isNull(), "linked_document_added")
        .when(F.col("new_here").isNull(), "linked_document_removed")
        .when(differs(F.col("old_hash"), F.col("new_hash")), "linked_document_changed")
    )
    return both.withColumn("change_type", kind).where(F.col("change_type").isNotNull()).select(
        "page_key",
        F.lit(19).alias("rule_ordinal"),
        "change_type",
        F.lit("linked_documents").alias("source"),
        F.when(F.col("change_type") == "linked_document_changed", "high").otherwise("medium").alias("severity"),
        F.lit(False).alias("policy_alert"),
        "link",
        "old_hash",
        "new_hash",
        F.when(F.col("change_type") == "linked_document_added", F.col("new_status_code")).alias("status_code"),
    )


def field_changes(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Named values that differ between two tables ``(*keys, field, value)``."""
    old = previous.withColumnRenamed("value", "old_value")
    new = current.withColumnRenamed("value", "new_value")
    return new.join(old, [*keys, "field"], "full_outer").where(
        differs(F.col("old_value"), F.col("new_value"))
    )
