"""Change feeds on Structured Streaming.

Each micro-batch is compared with the stored state by the same functions as a batch run.
State and output folders are named by the batch id, so a batch that runs again after a
failure replaces its own output. The trigger is the caller's choice: ``availableNow`` for
one run over what has arrived, or a processing time for repeated runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewatch.operators.rules import Thresholds, change_percent, differs
from pagewatch.operators.skew import DEFAULT_POLICY, SkewPolicy, plan_chunks, previous_in_order
from pagewatch.plans.detection import detect_batch, write_outputs
from pagewatch.sources.tables import PageState

NUMERIC_ORDER = ["_seq", "captured_at", "ordinal"]


def start_change_feed(
    captures: DataFrame,
    state_path: str,
    output_path: str,
    checkpoint_path: str,
    limits: Thresholds = Thresholds(),
    policy: SkewPolicy = DEFAULT_POLICY,
    compact_every: int = 20,
    documents: Callable[[DataFrame], DataFrame] | None = None,
    schedule: Callable[[SparkSession], DataFrame] | None = None,
    report_path: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Detect changes in a stream of captures and write them by batch.

    ``documents`` gives the linked documents of a batch of captures. With ``schedule``, the watchlist at that time, and
    ``report_path``, each batch also writes its change log, alerts, statistics and report. The state is
    committed last: a batch that fails before that runs again from the same state and replaces all it had written.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = PageState(spark, state_path)
        found = detect_batch(
            batch, state, batch_id, limits, policy, documents and documents(batch), f"{output_path}/batch_id={batch_id}"
        )
        if schedule is not None and report_path is not None:
            write_outputs(found.rows, schedule(spark), report_path, batch_id, bool(state.folders(batch_id)))
        state.write(found.records, batch_id)
        if batch_id % compact_every == compact_every - 1:
            state.compact(batch_id)

    return (
        captures.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint_path)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def numeric_changes(
    log: DataFrame,
    last: DataFrame | None = None,
    limits: Thresholds = Thresholds(),
    policy: SkewPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Status and size changes of a numeric capture log, after the last row per key.

    A row older than the stored one is kept with ``is_late``, is compared with nothing and nothing is compared with it.
    """
    fields = ["key", "captured_at", "ordinal", "status_code", "content_length", "etag"]
    rows = log.select(*fields).withColumns({"_seq": F.lit(1), "is_late": F.lit(False)})
    if last is not None:
        touched = last.join(rows.select("key").distinct(), "key", "left_semi").select(*fields)
        newest = touched.select("key", F.struct("captured_at", "ordinal").alias("_newest"))
        rows = rows.join(newest, "key", "left").withColumn(
            "is_late", F.coalesce(F.struct("captured_at", "ordinal") <= F.col("_newest"), F.lit(False))
        ).drop("_newest")
        rows = rows.unionByName(touched.withColumns({"_seq": F.lit(0), "is_late": F.lit(False)}))
    values = F.struct("status_code", "content_length", "etag")
    writes = ~F.col("is_late")
    chunks = plan_chunks(rows.select("key", *NUMERIC_ORDER, "is_late"), "key", NUMERIC_ORDER, writes, policy)
    paired = previous_in_order(rows, "key", NUMERIC_ORDER, values, "prev", chunks, writes).withColumn(
        "prev", F.when(writes, F.col("prev"))
    )
    size = F.col("content_length") - F.col("prev.content_length")
    status = F.col("status_code")
    return paired.where("_seq = 1").select(
        "key", "captured_at", "ordinal", "status_code", "content_length",
        F.col("prev.status_code").alias("old_status"),
        F.col("prev.content_length").alias("old_length"),
        (F.col("prev").isNull() & writes).alias("is_first"),
        F.coalesce(F.col("prev").isNotNull() & differs(status, F.col("prev.status_code")), F.lit(False))
        .alias("status_changed"),
        F.when(status >= 400, "high").otherwise("medium").alias("status_severity"),
        F.coalesce(F.abs(size) > limits.content_size, F.lit(False)).alias("size_changed"),
        F.coalesce(F.col("prev").isNotNull() & differs(F.col("etag"), F.col("prev.etag")), F.lit(False))
        .alias("etag_changed"),
        change_percent(F.col("prev.content_length"), F.col("content_length")).alias("change_percent"),
        "is_late",
    )


def start_numeric_feed(
    log: DataFrame,
    state_path: str,
    output_path: str,
    checkpoint_path: str,
    limits: Thresholds = Thresholds(),
    policy: SkewPolicy = DEFAULT_POLICY,
    compact_every: int = 20,
    **trigger,
) -> StreamingQuery:
    """Numeric change feed that keeps one small row per key.

    State is the last row of each key, read and written as tables. A keyed state function
    would sort all rows of a hot key in one task; here such a key is cut into chunks.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = PageState(spark, state_path)
        keys = batch.select(F.col("key").alias("history_key"))
        changes = numeric_changes(batch, _as_log(state.read(before=batch_id, keys=keys)), limits, policy)
        changes.write.mode("overwrite").parquet(f"{output_path}/batch_id={batch_id}")
        state.write(batch.withColumnRenamed("key", "history_key"), batch_id)
        if batch_id % compact_every == compact_every - 1:
            state.compact(batch_id)

    return (
        log.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint_path)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _as_log(state: DataFrame | None) -> DataFrame | None:
    return None if state is None else state.withColumnRenamed("history_key", "key")
