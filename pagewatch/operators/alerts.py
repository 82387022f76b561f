"""Alerts on quiet policy updates, over pairs of current and previous snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagewatch.operators.rules import differs, set_differs

# Word counts that make a change large, or small.
LARGE_CHANGE, SMALL_CHANGE = 100, 50


def policy_alerts(pairs: DataFrame) -> DataFrame:
    """Much text changed under the same version marks; or a new date on nearly the same text."""
    cur, prev = F.col("cur"), F.col("prev")
    words = (cur["word_count"] - prev["word_count"]).cast("bigint")
    both = cur["has_profile"] & prev["has_profile"]
    new_date, old_date = cur["header_last_modified"], prev["header_last_modified"]
    shown = F.concat(
        F.coalesce(old_date, F.lit("None")), F.lit(" -> "), F.coalesce(new_date, F.lit("None"))
    )

    def alert(kind: str, severity: str, message: str, dates) -> F.Column:
        versions = [
            F.to_json(side["version_indicators"]).alias(name)
            for side, name in ((cur, "current_versions"), (prev, "previous_versions"))
        ]
        return F.struct(
            F.lit(kind).alias("alert_type"), F.lit(severity).alias("severity"),
            F.lit(message).alias("message"), words.alias("word_count_change"), *versions,
            dates.cast("string").alias("last_modified_change"),
        )

    content = both & (F.abs(words) > LARGE_CHANGE) & ~set_differs(
        cur["version_indicators"], prev["version_indicators"]
    )
    dated = both & differs(new_date, old_date) & (F.abs(words) < SMALL_CHANGE)
    alerts = F.array(
        F.when(
            content,
            alert(
                "STEALTH_CONTENT_CHANGE", "HIGH",
                "Significant content changes detected without version update", F.lit(None),
            ),
        ),
        F.when(
            dated,
            alert(
                "STEALTH_LAST_MODIFIED_UPDATE", "MEDIUM",
                "Last-Modified header changed with minimal content changes", shown,
            ),
        ),
    )
    return pairs.where(prev.isNotNull()).select(
        "url", "captured_at", "ordinal", F.inline(F.array_compact(alerts))
    )
