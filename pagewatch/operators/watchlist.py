"""Watchlist checks and summaries, and when each URL is due again."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from pagewatch.operators.skew import DEFAULT_POLICY, SkewPolicy, number_in_order

# Accepted priorities and bounds of the check interval in seconds.
PRIORITIES = ["low", "medium", "high", "critical"]
MIN_INTERVAL, MAX_INTERVAL = 300, 86400
DEFAULT_INTERVAL = 3600
DEFAULT_TYPE, DEFAULT_PRIORITY = "policy", "medium"


def watchlist_of_documents(documents: DataFrame, document: str = "document") -> DataFrame:
    """Entries of watchlist documents, with defaults. A legacy per-URL interval is dropped.

    The ``ordinal`` of an entry is the pair of its document and its place in it: no two entries share one.
    """
    entries = documents.select(
        F.coalesce("central_check_interval", F.lit(DEFAULT_INTERVAL)).alias("check_interval"),
        F.col(document).alias("document"),
        F.posexplode("monitored_urls").alias("position", "entry"),
    )
    return entries.select(
        F.col("entry.url").alias("url"),
        F.coalesce("entry.type", F.lit(DEFAULT_TYPE)).alias("type"),
        F.coalesce("entry.priority", F.lit(DEFAULT_PRIORITY)).alias("priority"),
        F.struct("document", F.col("position").cast("bigint").alias("position")).alias("ordinal"),
        "check_interval",
    )


def validate(watchlist: DataFrame, interval: int = DEFAULT_INTERVAL) -> DataFrame:
    """One row per fault: ``(ordinal, url, message)``; faults of the interval have no URL.

    An entry is a duplicate if its URL has an earlier entry. The earliest one per URL is an
    aggregate, so a URL repeated very often is no single task.
    """
    first = watchlist.groupBy("url").agg(F.min("ordinal").alias("_first"))
    url, priority = F.col("url"), F.col("priority")
    web = F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))
    faults = F.array(
        F.when(F.col("ordinal") > F.col("_first"), F.concat(F.lit("Duplicate URL: "), url)),
        F.when(~web, F.concat(F.lit("Invalid URL format: "), url)),
        F.when(
            ~priority.isin(PRIORITIES),
            F.concat(F.lit("Invalid priority for "), url, F.lit(": "), priority),
        ),
    )
    rows = watchlist.join(first, "url").select(
        "ordinal", "url", F.explode(F.array_compact(faults)).alias("message")
    )
    text = None
    if interval < MIN_INTERVAL:
        text = f"Central check interval too short: {interval}s (minimum: {MIN_INTERVAL}s)"
    elif interval > MAX_INTERVAL:
        text = f"Central check interval too long: {interval}s (maximum: {MAX_INTERVAL}s)"
    if text is not None:
        fault = watchlist.sparkSession.range(1).select(
            F.lit(None).cast(watchlist.schema["ordinal"].dataType).alias("ordinal"), F.lit(None).cast("string").alias("url"),
            F.lit(text).alias("message"),
        )
        rows = rows.unionByName(fault)
    return rows


def repeated_entries(watchlist: DataFrame, policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """Second and later entries of a URL, numbered."""
    return number_in_order(watchlist, "url", ["ordinal"], "occurrence", policy).where("occurrence > 1")


def listing(watchlist: DataFrame) -> DataFrame:
    total = watchlist.agg(F.count("*").alias("n")).scalar()
    return watchlist.select("url", "type", "priority", "ordinal", total.alias("total"))


def summary(watchlist: DataFrame) -> DataFrame:
    """Counts by priority, by type and in all, from one scan."""
    priority, kind = F.col("priority"), F.col("type")
    sets = watchlist.groupingSets([[priority], [kind], []], priority, kind).agg(
        F.count("*").alias("urls"), F.grouping("priority").alias("_p"), F.grouping("type").alias("_t")
    )
    dimension = F.when(F.col("_p") == 0, "priority").when(F.col("_t") == 0, "type").otherwise("total")
    return sets.select(
        dimension.alias("dimension"),
        F.when(F.col("_p") == 0, priority).when(F.col("_t") == 0, kind).otherwise("all").alias("value"),
        "urls",
    )


def priority_pivot(watchlist: DataFrame, interval: int = DEFAULT_INTERVAL) -> DataFrame:
    def of(level: str) -> Column:
        return F.count_if(F.col("priority") == level).alias(level)

    return watchlist.agg(
        F.lit(interval).cast("bigint").alias("central_check_interval"), F.count("*").alias("total_urls"),
        of("high"), of("medium"), of("low"),
    )


def schedule_entries(watchlist: DataFrame) -> DataFrame:
    """One entry per URL: the later entry's values at the first entry's place."""
    later = F.max_by(F.struct("type", "priority"), "ordinal").alias("later")
    return (
        watchlist.where(F.coalesce("url", F.lit("")) != "")
        .groupBy("url")
        .agg(later, F.min("ordinal").alias("ordinal"))
        .select("url", "later.*", "ordinal")
    )


def next_checks(checks: DataFrame, interval: int = DEFAULT_INTERVAL) -> DataFrame:
    """Last check per key and the next one: after the interval, or half of it on failure."""
    last = F.max_by(F.struct("checked_at", "success"), F.struct("checked_at", "ordinal"))
    wait = F.when(F.col("last.success"), interval).otherwise(interval // 2)
    return checks.groupBy("url_key").agg(last.alias("last")).select(
        "url_key",
        F.col("last.checked_at").alias("last_checked"),
        F.col("last.success").alias("success"),
        (
            F.col("last.checked_at")
            + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), wait.cast("decimal(18,6)"))
        ).alias("next_check"),
    )


def recheck_state(schedule: DataFrame, checks: DataFrame, interval: int = DEFAULT_INTERVAL) -> DataFrame:
    """Schedule rows with their check times; a URL never checked has none and is due."""
    times = next_checks(checks, interval).drop("success")
    return schedule.join(times, "url_key", "left")


def wall_time(moment: dt.datetime) -> Column:
    """Literal without a time zone; a plain literal would shift with the session's zone."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def is_due(as_of: dt.datetime) -> Column:
    return F.col("next_check").isNull() | (wall_time(as_of) >= F.col("next_check"))


def due_urls(state: DataFrame, as_of: dt.datetime) -> DataFrame:
    return state.where(is_due(as_of))


def seconds_until(moment: Column, as_of: dt.datetime) -> Column:
    return F.timestamp_diff("MICROSECOND", wall_time(as_of), moment) / 1e6


def recheck_status(state: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Totals, due URLs and seconds to the next check, per priority and for all (``*``)."""
    priority = F.col("priority")
    sets = state.groupingSets([[priority], []], priority).agg(
        F.count("*").alias("total_urls"),
        F.count_if(is_due(as_of)).alias("due_urls"),
        F.min("next_check").alias("nearest"),
        F.grouping("priority").alias("_all"),
    )
    return sets.select(
        F.when(F.col("_all") == 1, "*").otherwise(priority).alias("priority"),
        "total_urls",
        "due_urls",
        F.greatest(F.lit(0.0), seconds_until(F.col("nearest"), as_of)).alias("next_check_in"),
    )


def upcoming_checks(state: DataFrame, as_of: dt.datetime, limit: int = 10) -> DataFrame:
    """The next checks, soonest first: a top-k report."""
    return (
        state.where(F.col("next_check").isNotNull())
        .orderBy("next_check", "url")
        .limit(limit)
        .select(
            "url", "priority", "next_check",
            seconds_until(F.col("next_check"), as_of).alias("seconds_until"),
        )
    )
