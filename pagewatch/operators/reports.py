"""Change log, cycle statistics and cycle reports.

Inputs are detection results: one row per capture with ``cur``, ``prev`` and ``changes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagewatch.operators.skew import DEFAULT_POLICY, SkewPolicy, number_in_order

CHANGE_SOURCE = "direct_metadata"
BATCH_SIZE = 50

# Columns of the change log.
LOG_COLUMNS = [
    "Timestamp", "URL", "Change Type", "Change Details", "Status Code", "Content Type",
    "Final URL", "Source", "Priority", "Resolved", "Notes",
]


def detected_only(detected: DataFrame) -> DataFrame:
    return detected.where(F.size("changes") > 0)


def with_priority(changes: DataFrame, schedule: DataFrame) -> DataFrame:
    """Attach the watchlist priority. ``schedule`` has one row per URL, so no row multiplies.

    A URL that is not in the watchlist keeps its changes and has no priority. No broadcast hint: a watchlist grows with
    the data, and the join adapts to its size.
    """
    return changes.join(schedule.select("url", "priority"), "url", "left")


def iso_time(moment: Column) -> Column:
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(
        F.date_format(moment, "SSSSSS") == "000000", whole
    ).otherwise(F.concat(whole, F.date_format(moment, ".SSSSSS")))


def _arrow(label: str, change: Column) -> Column:
    def shown(value: Column) -> Column:
        return F.coalesce(value, F.lit("None"))

    return F.concat(F.lit(label), shown(change["old_value"]), F.lit("→"), shown(change["new_value"]))


# How the change log words each kind of change.
ARROW_LABELS = {
    "status_change": "Status: ",
    "content_type_change": "Content-Type: ",
    "redirect_change": "Redirect: ",
    "structured_data_change": "Structured data change: ",
}


def change_text(change: Column, documents: Column | None = None) -> Column:
    """Log text of one change struct; null where the log has no wording for its type.

    ``documents`` is the page's manifest, which knows the status of a document that was added.
    """
    kind = change["change_type"]
    text = F.when(kind == "content_change", F.lit("Content modified"))
    for name, label in ARROW_LABELS.items():
        text = text.when(kind == name, _arrow(label, change))
    if documents is not None:
        status = F.try_element_at(documents, change["field"])["status_code"]
        text = text.when(
            change["source"] == "linked_documents",
            document_text(kind, change["field"], change["old_value"], change["new_value"], status),
        )
    return text


# How the change log words changes of linked documents.
def document_text(change_type: Column, link: Column, old: Column, new: Column, status: Column) -> Column:
    """Log text of a linked-document change; missing values print as nothing."""

    def shown(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit(""))

    return (
        F.when(
            change_type == "linked_document_added",
            F.concat(F.lit("Linked doc added: "), link, F.lit(" (status:"), shown(status), F.lit(" type:)")),
        )
        .when(
            change_type == "linked_document_removed",
            F.concat(F.lit("Linked doc removed: "), link, F.lit(" (old_hash:"), shown(old), F.lit(")")),
        )
        .when(
            change_type == "linked_document_changed",
            F.concat(
                F.lit("Linked doc changed: "), link, F.lit(" (old:"), shown(old), F.lit(" new:"),
                shown(new), F.lit(")"),
            ),
        )
    )


def change_types(changes: Column) -> Column:
    return F.array_join(changes["change_type"], ", ")


def change_log_rows(detected: DataFrame, schedule: DataFrame) -> DataFrame:
    """One log row per capture that changed something. Rows are made in place, without grouping."""
    texts = F.array_compact(F.transform("changes", lambda c: change_text(c, F.col("cur.documents"))))
    rows = with_priority(detected_only(detected), schedule).withColumn("_texts", texts)
    return rows.select(
        "cycle_id",
        "captured_at",
        "ordinal",
        iso_time(F.col("captured_at")).alias("timestamp"),
        "url",
        change_types(F.col("changes")).alias("change_type"),
        F.when(F.size("_texts") > 0, F.array_join("_texts", "; "))
        .otherwise(F.lit("No changes detected"))
        .alias("change_details"),
        F.col("cur.status_code").cast("bigint").alias("status_code"),
        F.coalesce("cur.header_content_type", F.lit("")).alias("content_type"),
        F.coalesce("cur.final_url", "url").alias("final_url"),
        F.lit(CHANGE_SOURCE).alias("source"),
        "priority",
        F.lit("FALSE").alias("resolved"),
        F.lit("").alias("notes"),
    )


def named_log(rows: DataFrame) -> DataFrame:
    """The eleven log columns under their log names."""
    fields = [name.lower().replace(" ", "_") for name in LOG_COLUMNS]
    return rows.select(*[F.col(f).alias(name) for f, name in zip(fields, LOG_COLUMNS)])


def append_change_log(rows: DataFrame, path: str) -> None:
    """Append the eleven log columns to a table."""
    named_log(rows).write.mode("append").parquet(path)


def append_batches(
    log: DataFrame, size: int = BATCH_SIZE, policy: SkewPolicy = DEFAULT_POLICY
) -> DataFrame:
    """Number the log rows of a cycle in batches; one cycle may hold any number of rows."""
    numbered = number_in_order(log, "cycle_id", ["url", "captured_at", "ordinal"], "_n", policy)
    return numbered.withColumn("batch_no", F.floor((F.col("_n") - 1) / size)).drop("_n")


def append_counts(detected: DataFrame) -> DataFrame:
    """Log rows written, and captures skipped because nothing changed, per cycle."""
    changed = F.size("changes") > 0
    return detected.groupBy("cycle_id").agg(
        F.count_if(changed).alias("successful"), F.count_if(~changed).alias("failed")
    )


def first_run_flags(cycles: DataFrame, has_history: bool = False) -> DataFrame:
    """Per cycle whether nothing ran before it."""
    ids = cycles.groupBy("cycle_id").agg(F.count("*").alias("captures"))
    first = ids.agg(F.min("cycle_id").alias("first")).scalar()
    flag = F.lit(False) if has_history else F.col("cycle_id") == first
    return ids.select("cycle_id", flag.alias("first_run"))


def cycle_stats(detected: DataFrame, has_history: bool = False) -> DataFrame:
    """One row per cycle. Changes are counted as captures that changed, not as change rows."""
    alerts = F.size(F.filter("changes", lambda c: c["policy_alert"]))
    changed = F.size("changes") > 0
    stats = detected.groupBy("cycle_id").agg(
        F.min("captured_at").alias("start_time"),
        F.max("captured_at").alias("end_time"),
        F.count("*").alias("urls_checked"),
        F.count_if(changed).alias("changes_detected"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.count_if(F.col("cur.has_profile") & ~F.col("cur.is_parsed")).alias("html_parsing_errors"),
        F.sum(alerts).alias("policy_alerts_detected"),
    )
    seconds = F.timestamp_diff("MICROSECOND", F.col("start_time"), F.col("end_time")) / 1e6
    return stats.join(first_run_flags(detected, has_history), "cycle_id").withColumn(
        "duration_seconds", seconds
    )


def report_changes(detected: DataFrame, schedule: DataFrame) -> DataFrame:
    """One report record per capture that changed something, with its changes nested."""
    return with_priority(detected_only(detected), schedule).select(
        F.col("cycle_id").alias("report_id"),
        "url",
        iso_time(F.col("captured_at")).alias("timestamp"),
        F.lit(CHANGE_SOURCE).alias("change_source"),
        "priority",
        "changes",
    )


def write_cycle_report(detected: DataFrame, schedule: DataFrame, path: str) -> None:
    """Write a JSON report per cycle: change records by cycle, and one summary per cycle.

    A cycle may hold any number of changes, so its records are lines of several files and
    never one document in one task.
    """
    report_changes(detected, schedule).write.partitionBy("report_id").json(f"{path}/changes")
    stats = cycle_stats(detected)
    stats.select(
        F.col("cycle_id").alias("report_id"),
        F.struct(*stats.columns).alias("cycle_stats"),
        F.struct(
            F.col("changes_detected").alias("total_changes"), F.col("first_run").alias("first_run")
        ).alias("summary"),
    ).write.json(f"{path}/summary")


def cycle_summary(detected: DataFrame) -> DataFrame:
    """Text of a cycle: a headline per cycle and a line per capture that changed something."""
    stats = cycle_stats(detected)
    headline = F.format_string(
        "Cycle ID: %s | Duration: %.2fs | URLs checked: %d | Changes detected: %d | Errors: %d",
        "cycle_id", "duration_seconds", "urls_checked", "changes_detected", "errors",
    )
    lines = detected_only(detected).select(
        "cycle_id",
        F.lit("change").alias("part"),
        "url",
        F.concat(
            F.lit("Types: "), change_types(F.col("changes")), F.lit(" | Source: "), F.lit(CHANGE_SOURCE),
            F.lit(" | Time: "), iso_time(F.col("captured_at")),
        ).alias("text"),
    )
    heads = stats.select(
        "cycle_id", F.lit("headline").alias("part"), F.lit("").alias("url"), headline.alias("text")
    )
    return heads.unionByName(lines)
