"""Change detection over a whole capture log, or over one batch with a stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagewatch.functions.urls import candidate_keys, normalize_url
from pagewatch.operators.alerts import policy_alerts
from pagewatch.operators.documents import with_manifests
from pagewatch.operators.history import pair_with_previous, to_records
from pagewatch.operators.profile import profile_captures
from pagewatch.operators.reports import append_counts, change_log_rows, cycle_stats, named_log, report_changes
from pagewatch.operators.rules import RuleSet, Thresholds, with_changes
from pagewatch.operators.skew import DEFAULT_POLICY, SkewPolicy
from pagewatch.session import shared_dir
from pagewatch.sources.tables import PageState, materialize


def profile_records(
    captures: DataFrame, documents: DataFrame | None = None, fields: list[str] | None = None
) -> DataFrame:
    """Profile captures once and keep the records as a table, which is far smaller than the HTML.

    With ``documents``, the linked documents captured in the same cycles, records get the manifest of their links.
    """
    records = materialize(to_records(profile_captures(captures, fields)), "records")
    return records if documents is None else with_manifests(records, documents)


def replay_changes(
    records: DataFrame,
    state: DataFrame | None = None,
    limits: Thresholds = Thresholds(),
    rule_sets: list[RuleSet] | None = None,
    policy: SkewPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """All captures of a log with their changes; captures that changed nothing have none.

    A capture older than the state of its key is kept, without changes and with ``is_late``.
    """
    return with_changes(pair_with_previous(records, state, policy), limits, rule_sets)


def touched_keys(records: DataFrame) -> DataFrame:
    """Keys that the captures of a batch are stored under or may be found under; not those that declare them."""
    looked_up = F.array_union(F.array("history_key"), candidate_keys(F.col("url"))["key"])
    return records.select(F.explode(looked_up).alias("history_key"))


def run_batch(
    captures: DataFrame,
    state: PageState,
    version: int,
    limits: Thresholds = Thresholds(),
    policy: SkewPolicy = DEFAULT_POLICY,
    documents: DataFrame | None = None,
    path: str | None = None,
) -> DataFrame:
    """Compare a batch with the stored state, then store its records as ``version``.

    Running a version again reads the same earlier state, so it gives the same result. The result is a
    table at ``path``, which is replaced, or in the shared folder.
    """
    detected = detect_batch(captures, state, version, limits, policy, documents, path)
    state.write(detected.records, version)
    return detected.rows


class DetectedBatch:
    """Detection rows of a batch, as a table, and the records that its state will hold."""

    def __init__(self, rows: DataFrame, records: DataFrame):
        self.rows, self.records = rows, records


def detect_batch(
    captures: DataFrame, state: PageState, version: int, limits: Thresholds = Thresholds(),
    policy: SkewPolicy = DEFAULT_POLICY, documents: DataFrame | None = None, path: str | None = None,
) -> DetectedBatch:
    """The comparison of ``run_batch`` alone; nothing is stored as state."""
    records = profile_records(captures, documents)
    rows = replay_changes(records, stored_for(records, state, version), limits, policy=policy)
    path = path or shared_dir(rows.sparkSession, "detected")
    rows.write.mode("overwrite").parquet(path)
    return DetectedBatch(rows.sparkSession.read.schema(rows.schema).parquet(path), records)


def stored_for(records: DataFrame, state: PageState, version: int) -> DataFrame | None:
    """The stored records that a batch can touch.

    Keys of the batch name the buckets to read. Records that declare a URL of the batch lie in any bucket; they
    are found by their declared URLs alone, and are few.
    """
    near = state.read(before=version, keys=touched_keys(records))
    if near is None:
        return None
    asked = records.select(normalize_url(F.col("url")).alias("declared")).distinct()
    keys = touched_keys(records).distinct()
    mine = near.join(keys, "history_key", "left_semi")
    spelled = F.explode(F.array_compact(F.array(
        normalize_url(F.nullif(F.col("final_url"), F.lit(""))), normalize_url(F.col("profile.canonical_url"))
    )))
    whole = state.read(before=version)
    declaring = whole.withColumn("declared", spelled).where(F.col("declared") != F.col("history_key")).join(
        asked, "declared", "left_semi"
    ).select("history_key").distinct()
    others = whole.join(declaring, "history_key", "left_semi").join(keys, "history_key", "left_anti")
    return materialize(mine.unionByName(others), "stored")


def write_outputs(detected: DataFrame, schedule: DataFrame, path: str, batch_id: int, has_history: bool) -> None:
    """Change log, policy alerts, statistics and report records of one batch, each replaced if it is there.

    All come from the detection table; each reads the columns it needs. Statistics are by cycle and batch:
    ``merged_stats`` adds up the batches of a cycle.
    """
    stats = cycle_stats(detected, has_history).join(append_counts(detected), "cycle_id")
    tables = {
        "log": named_log(change_log_rows(detected, schedule)),
        "alerts": policy_alerts(detected),
        "stats": stats,
        "report": report_changes(detected, schedule),
    }
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")


def merged_stats(stats: DataFrame) -> DataFrame:
    """Statistics of whole cycles from those of their batches."""
    counts = [
        "urls_checked", "changes_detected", "errors", "html_parsing_errors", "policy_alerts_detected", "successful", "failed",
    ]
    return stats.groupBy("cycle_id").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        *[F.sum(c).alias(c) for c in counts], F.bool_or("first_run").alias("first_run"),
    ).withColumn("duration_seconds", F.timestamp_diff("MICROSECOND", F.col("start_time"), F.col("end_time")) / 1e6)
