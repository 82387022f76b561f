"""Lookup of the previous capture of a URL, in a stored state or in the capture log itself.

A capture is stored under the key of its final URL and looked up by the URL it was made
for. The lookup has four tiers: the raw URL, its normalised form, its variants, and last a
stored capture that declares the URL as its final or canonical URL, the first stored first.
Every tier is an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagewatch.functions.headers import normalize_headers
from pagewatch.functions.urls import TIER_DECLARED, candidate_keys, history_key, normalize_url
from pagewatch.operators.rules import snapshot
from pagewatch.operators.skew import (
    DEFAULT_POLICY, SkewPolicy, plan_chunks, previous_in_order,
)
from pagewatch.operators.sweep import holders
from pagewatch.session import materialize

# State rows come before every row of a batch.
ORDER = ["_seq", "captured_at", "ordinal"]
RECORD_COLUMNS = [
    "url", "captured_at", "ordinal", "cycle_id", "status_code", "headers", "final_url",
    "content_length", "response_time", "error", "profile",
]


def to_records(profiled: DataFrame) -> DataFrame:
    """History records: normalised headers and the key a capture is stored under."""
    return profiled.select(*RECORD_COLUMNS).withColumns(
        {
            "headers": normalize_headers(F.col("headers")),
            "history_key": history_key(F.col("final_url"), F.col("url")),
        }
    )


def lookup_in_state(
    urls: DataFrame, state: DataFrame, insertion: str = "insertion_seq", by_url: bool = False
) -> DataFrame:
    """Resolve distinct URLs to history keys: ``(url, tier, rank, history_key)``.

    ``state`` has ``history_key, url, final_url, canonical_url`` and an insertion order.
    With ``by_url`` a stored capture made for the same URL is a fifth tier.
    URLs without a stored capture are absent.
    """
    wanted = urls.select("url").distinct()
    keyed = (
        wanted.select("url", F.inline(candidate_keys(F.col("url"))))
        .join(state.select(F.col("history_key").alias("key")), "key")
        .select("url", "tier", "rank", F.col("key").alias("history_key"))
    )
    # A declared URL that many captures share shrinks to its first entry before the join.
    spellings = F.array_distinct(
        F.array_compact(F.array(normalize_url(F.col("final_url")), normalize_url(F.col("canonical_url"))))
    )
    declared = _first_by(state.withColumn("declared", F.explode(spellings)), "declared", insertion)
    found = keyed.unionByName(
        wanted.withColumn("declared", normalize_url(F.col("url")))
        .join(declared, "declared")
        .select("url", F.lit(TIER_DECLARED).alias("tier"), F.lit(0).alias("rank"), "history_key")
    )
    if by_url:
        stored = _first_by(state, "url", insertion)
        found = found.unionByName(
            wanted.join(stored, "url")
            .select("url", F.lit(TIER_DECLARED + 1).alias("tier"), F.lit(0).alias("rank"), "history_key")
        )
    best = F.min(F.struct("tier", "rank", "history_key")).alias("best")
    return found.groupBy("url").agg(best).select("url", "best.*")


def _first_by(state: DataFrame, column: str, insertion: str) -> DataFrame:
    return state.groupBy(column).agg(F.min_by("history_key", insertion).alias("history_key"))


def first_detections(urls: DataFrame, state: DataFrame, insertion: str = "insertion_seq") -> DataFrame:
    """URLs for which no stored capture is found."""
    return urls.join(lookup_in_state(urls, state, insertion), "url", "left_anti")


def _position() -> Column:
    return F.struct(*ORDER)


def _candidates(slim: DataFrame) -> DataFrame:
    """Per URL the stored keys it may be found under, best first, with their first write."""
    first = slim.groupBy("history_key").agg(F.min(_position()).alias("first"))
    entries = (
        slim.where("_seq = 1")
        .select("url")
        .distinct()
        .select("url", F.inline(candidate_keys(F.col("url"))))
        .join(first.withColumnRenamed("history_key", "key"), "key")
    )
    # At most one entry per spelling of the URL.
    return entries.groupBy("url").agg(
        F.array_sort(F.collect_list(F.struct("tier", "rank", "key", "first"))).alias("candidates")
    )


def _claims(slim: DataFrame, chunks: DataFrame | None, policy: SkewPolicy) -> DataFrame:
    """Intervals in which a stored capture declares a URL, ranked by when its key was first stored.

    Runs of writes with the same declaration become one interval, from its first write to the write that ends it.
    """
    position = _position()
    declared = slim.select(
        "history_key", *ORDER, "declared_final", "declared_canonical"
    ).withColumn("declares", F.array_sort(F.array_distinct(F.array_compact(
        F.array("declared_final", "declared_canonical")
    ))))
    turns = previous_in_order(
        declared, "history_key", ORDER, F.struct("declares"), "before", chunks
    ).where(F.col("before").isNull() | (F.col("before.declares") != F.col("declares"))).select(
        "history_key", *ORDER, "declares"
    )
    plan = None
    if chunks is not None:
        turns = materialize(turns, "turns")
        plan = plan_chunks(turns.select("history_key", *ORDER), "history_key", ORDER, policy=policy)
    # The write that ends an interval tells it; the last one of a key has no end.
    claim = F.struct(position.alias("start"), F.col("declares"))
    ended = previous_in_order(turns, "history_key", ORDER, claim, "claim", plan).where(
        F.col("claim").isNotNull()
    ).select("history_key", "claim", position.alias("end"))
    lasting = turns.groupBy("history_key").agg(F.max(claim).alias("claim")).withColumn(
        "end", F.lit(None).cast(ended.schema["end"].dataType)
    )
    inserted = slim.groupBy("history_key").agg(F.min(position).alias("rank"))
    return (
        ended.unionByName(lasting)
        .select("history_key", "claim.start", "end", F.explode("claim.declares").alias("_group"))
        # Declaring its own key adds nothing to the second tier.
        .where(F.col("_group") != F.col("history_key"))
        .join(inserted, "history_key")
        .withColumnRenamed("history_key", "value")
    )


def _declared_keys(
    slim: DataFrame, open_captures: DataFrame, chunks: DataFrame | None, policy: SkewPolicy
) -> DataFrame | None:
    """Last tier: captures whose URL some stored capture declared at that time; None if none declares one.

    A sweep over the claims of a declared URL tells from when on which key is the first to declare it. A capture then
    looks back at the last such change, as it does at captures of its own key.
    """
    changes = materialize(holders(_claims(slim, chunks, policy), policy), "declared")
    if changes.isEmpty():
        return None
    order = [*ORDER, "_kind"]

    def asking(captures: DataFrame) -> DataFrame:
        return captures.select(
            normalize_url(F.col("url")).alias("_group"), "url", *ORDER, F.lit(None).cast("string").alias("value"),
            F.lit(0).alias("_kind"),
        )

    # A change takes effect after the captures of its own position.
    told = changes.select("_group", F.lit(None).cast("string").alias("url"), *ORDER, "value", F.lit(1).alias("_kind"))
    writes = F.col("_kind") == 1
    # All captures in place of those still open: counting them needs no lookup.
    plan = plan_chunks(
        asking(slim.where("_seq = 1")).unionByName(told).select("_group", *order), "_group", order, writes, policy
    )
    looked = previous_in_order(
        asking(open_captures).unionByName(told), "_group", order, F.struct("value"), "last", plan, writes
    )
    return looked.where((F.col("_kind") == 0) & F.col("last.value").isNotNull()).select(
        "url", *ORDER, F.col("last.value").alias("declared_key")
    )


def _snapshot_of(records: DataFrame) -> Column:
    return snapshot(documents="documents" in records.columns).alias("cur")


def pair_with_previous(
    records: DataFrame, state: DataFrame | None = None, policy: SkewPolicy = DEFAULT_POLICY
) -> DataFrame:
    """One row per capture with ``cur`` and ``prev`` snapshots; ``prev`` is null if none is found.

    The result is what a loop over the captures in order would see, where every capture
    replaces the state of its key at once. ``state`` holds the records before the batch.
    A capture older than the state of its key (``is_late``) pairs with nothing and is not
    looked back at. ``records`` are read several times, by few columns each; pass a table,
    not an unfinished profile job.
    """
    keep = [c for c in records.columns if c not in ("headers", "profile", "documents")]
    # Snapshots are taken next to the scan, so only their fields of a profile are read.
    rows = records.select(*keep, _snapshot_of(records)).withColumn("_seq", F.lit(1))
    stored = None
    if state is not None:
        state = state.select(
            "history_key", "url", "final_url", "captured_at", "ordinal", "first_captured_at",
            "first_ordinal", _snapshot_of(state),
        )
        # Only the state of keys that this batch can touch takes part.
        needed = rows.select(
            F.explode(F.array_union(F.array("history_key"), candidate_keys(F.col("url"))["key"])).alias("key")
        ).distinct()
        asked = rows.select(normalize_url(F.col("url")).alias("declared")).distinct()
        spelled = state.withColumn("declared", F.explode(F.array_compact(F.array(
            normalize_url(F.col("final_url")), normalize_url(F.col("cur.canonical_url"))
        )))).join(asked, "declared", "left_semi").select("history_key")
        touched = needed.select(F.col("key").alias("history_key")).union(spelled).distinct()
        stored = state.join(touched, "history_key", "left_semi").withColumn("_seq", F.lit(0))
        newest = stored.select(
            "history_key", F.struct("captured_at", "ordinal").alias("_newest")
        )
        rows = rows.join(newest, "history_key", "left").withColumn(
            "is_late", F.coalesce(F.struct("captured_at", "ordinal") <= F.col("_newest"), F.lit(False))
        ).drop("_newest")
    else:
        rows = rows.withColumn("is_late", F.lit(False))

    def slim_of(df: DataFrame) -> DataFrame:
        return df.select(
            "url", "history_key", *ORDER,
            normalize_url(F.nullif(F.col("final_url"), F.lit(""))).alias("declared_final"),
            normalize_url(F.col("cur.canonical_url")).alias("declared_canonical"),
        )

    on_time = rows.where(~F.col("is_late"))
    slim = slim_of(on_time)
    if stored is not None:
        slim = slim.unionByName(slim_of(_in_insertion_order(stored)))
    # Keys and positions are read five times below: normalise URLs and meet the state once.
    slim = materialize(slim, "slim")

    chunks = plan_chunks(slim.select("history_key", *ORDER), "history_key", ORDER, policy=policy)
    asked = rows.where(~F.col("is_late")).select("url", *ORDER)
    position = _position()
    resolved = asked.join(_candidates(slim), "url", "left").withColumn(
        "key", F.get(F.filter("candidates", lambda c: c["first"] < position), F.lit(0))["key"]
    )
    declared = _declared_keys(slim, resolved.where(F.col("key").isNull()), chunks, policy)
    if declared is None:
        found = resolved.select("url", *ORDER, F.col("key").alias("_found"))
    else:
        found = resolved.join(declared, ["url", *ORDER], "left").select(
            "url", *ORDER, F.coalesce("key", "declared_key").alias("_found")
        )

    def role(group: Column, writes: bool, reads: bool) -> Column:
        return F.struct(
            group.alias("_group"), F.lit(writes).alias("_writes"), F.lit(reads).alias("_reads")
        )

    # Most captures look back in the group they are stored in. Others enter two groups.
    own, key = F.col("history_key"), F.col("_found")
    roles = F.when(
        F.col("is_late"), F.array(role(own, False, True))
    ).when(
        key.isNull() | (key == own), F.array(role(own, True, True))
    ).otherwise(F.array(role(own, True, False), role(key, False, True)))
    events = (
        rows.join(found, ["url", *ORDER], "left")
        .select(*keep, "_seq", "is_late", "cur", "_found", F.inline(roles))
    )
    if stored is not None:
        absent = {c: F.lit(None).cast(records.schema[c].dataType) for c in keep if c not in stored.columns}
        events = events.unionByName(
            stored.withColumns({**absent, "is_late": F.lit(False)}).select(
                *keep, "_seq", "is_late", "cur", F.lit(None).cast("string").alias("_found"),
                F.col("history_key").alias("_group"), F.lit(True).alias("_writes"),
                F.lit(False).alias("_reads"),
            )
        )
    plan = None if chunks is None else chunks.withColumnRenamed("history_key", "_group")
    paired = previous_in_order(
        events, "_group", ORDER, F.col("cur"), "prev", plan, writes=F.col("_writes")
    )
    return (
        paired.where("_reads")
        .withColumn("prev", F.when(F.col("_found").isNotNull() & ~F.col("is_late"), F.col("prev")))
        .drop("_seq", "_found", "_group", "_writes", "_reads")
    )


def _in_insertion_order(stored: DataFrame) -> DataFrame:
    """State rows placed at the time their key was first stored, as the last tier needs it."""
    return stored.withColumns({"captured_at": F.col("first_captured_at"), "ordinal": F.col("first_ordinal")})


def latest_records(records: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """New state: the newest record per key, and when the key was first stored.

    Aggregates combine before the shuffle, so a hot key sends one record per task. A record
    older than the stored one loses.
    """
    fresh = records.withColumns(
        {"first_captured_at": F.col("captured_at"), "first_ordinal": F.col("ordinal")}
    )
    rows = fresh if state is None else fresh.unionByName(state)
    payload = [c for c in rows.columns if c not in ("history_key", "first_captured_at", "first_ordinal")]
    return (
        rows.groupBy("history_key")
        .agg(
            F.max_by(F.struct(*payload), F.struct("captured_at", "ordinal")).alias("last"),
            F.min(F.struct("first_captured_at", "first_ordinal")).alias("first"),
        )
        .select("history_key", "last.*", "first.*")
    )


def tracked_keys(state: DataFrame) -> DataFrame:
    return state.select("history_key").distinct()
