"""Ordered per-group work that stays balanced when one group holds much of the data.

A window over a group runs in one task. Here a hot group is cut into chunks along its own
order, chunks are spread over tasks, and the one row that a chunk needs from before its
start is copied into it. Results equal those of the plain window, row for row.

Planning reads only the group and order columns. The plan table holds at most ``1/share``
hot groups, because each has more than that share of all rows, and about ``1/share`` cut
rows, because one row in ``limit`` is a cut. So its size does not grow with the data, and
it may be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewatch.session import shared_dir


@dataclass(frozen=True)
class SkewPolicy:
    """A group is hot above ``min_rows`` rows and above ``share`` of all rows."""

    min_rows: int = 1_000_000
    share: float = 0.001


DEFAULT_POLICY = SkewPolicy()


def _position(order: list[str]) -> Column:
    return F.struct(*order)


def plan_chunks(
    slim: DataFrame,
    group: str,
    order: list[str],
    writes: Column | None = None,
    policy: SkewPolicy = DEFAULT_POLICY,
) -> DataFrame | None:
    """Chunk table ``(group, cuts, openers)`` of the hot groups; None if no group is hot.

    ``slim`` holds the group and order columns of all rows. ``writes`` tells which rows
    later rows look back at; by default all of them. The order has to be total.
    """
    writes = F.lit(True) if writes is None else writes
    counts = slim.groupBy(group).agg(F.count("*").alias("n"))
    total, largest = counts.agg(F.sum("n"), F.max("n")).first()
    limit = max(policy.min_rows, int((total or 0) * policy.share))
    if not largest or largest <= limit:
        return None

    hot = counts.where(F.col("n") > limit).select(group)
    rows = slim.join(F.broadcast(hot), group).select(group, *order, writes.alias("_write"))
    # Cuts are picked by a hash of the row itself: a retried task picks the same ones.
    picked = rows.where(F.pmod(F.xxhash64(group, *order), F.lit(limit)) == 0)
    cuts = picked.groupBy(group).agg(F.array_sort(F.collect_set(_position(order))).alias("cuts"))

    chunked = rows.join(F.broadcast(cuts), group).withColumn("_chunk", _home_chunk(order))
    lasts = chunked.groupBy(group, "_chunk").agg(
        F.max(F.when(F.col("_write"), _position(order))).alias("last")
    )
    # Every chunk gets its opener, also one that only rows of another source fall into. One
    # row per chunk of a hot group, so this window is small.
    every = cuts.select(group, F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("_chunk"))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    openers = (
        every.join(lasts, [group, "_chunk"], "left")
        .withColumn("opener", F.max("last").over(before))
        .where(F.col("opener").isNotNull())
        .groupBy(group)
        .agg(F.collect_list(F.struct("opener", "_chunk")).alias("openers"))
    )
    path = shared_dir(slim.sparkSession, "chunks")
    cuts.join(openers, group, "left").write.parquet(path)
    return slim.sparkSession.read.parquet(path)


def _home_chunk(order: list[str]) -> Column:
    """Number of cuts before the row; a row without cuts is in chunk 0."""
    position = _position(order)
    return F.coalesce(F.size(F.filter("cuts", lambda c: c < position)), F.lit(0))


def assign_chunks(
    rows: DataFrame,
    group: str,
    order: list[str],
    chunks: DataFrame | None,
    writes: Column | None = None,
) -> DataFrame:
    """Add ``_chunk`` and ``_carry``; carried copies open a chunk and belong to another."""
    if chunks is None:
        return rows.withColumns({"_chunk": F.lit(0), "_carry": F.lit(False)})
    writes = F.lit(True) if writes is None else writes
    position = _position(order)
    opened = F.transform(
        F.filter("openers", lambda o: o["opener"] == position), lambda o: o["_chunk"]
    )
    none = F.array().cast("array<int>")
    return (
        rows.join(F.broadcast(chunks), group, "left")
        .withColumn("_home", _home_chunk(order))
        .withColumn(
            "_chunk",
            F.explode(
                F.array_union(F.array("_home"), F.when(writes, F.coalesce(opened, none)).otherwise(none))
            ),
        )
        .withColumn("_carry", F.col("_chunk") != F.col("_home"))
        .drop("cuts", "openers", "_home")
    )


def previous_in_order(
    rows: DataFrame,
    group: str,
    order: list[str],
    value: Column,
    name: str,
    chunks: DataFrame | None = None,
    writes: Column | None = None,
) -> DataFrame:
    """Add the value of the last earlier row of the group, or of its last earlier write.

    ``value`` must not be null for a row that is looked back at; wrap it in a struct.
    """
    window = Window.partitionBy(group, "_chunk").orderBy(*order)
    if writes is None:
        looked_up = F.lag(value).over(window)
    else:
        earlier = window.rowsBetween(Window.unboundedPreceding, -1)
        looked_up = F.last(F.when(writes, value), ignorenulls=True).over(earlier)
    return (
        assign_chunks(rows, group, order, chunks, writes)
        .withColumn(name, looked_up)
        .where(~F.col("_carry"))
        .drop("_chunk", "_carry")
    )


def number_in_order(
    rows: DataFrame, group: str, order: list[str], name: str, policy: SkewPolicy = DEFAULT_POLICY
) -> DataFrame:
    """Add the 1-based position of each row in its group."""
    chunks = plan_chunks(rows.select(group, *order), group, order, policy=policy)
    window = Window.partitionBy(group, "_chunk").orderBy(*order)
    if chunks is None:
        numbered = rows.withColumn("_chunk", F.lit(0))
        return numbered.withColumn(name, F.row_number().over(window).cast("bigint")).drop("_chunk")

    def placed(df: DataFrame) -> DataFrame:
        joined = df.join(F.broadcast(chunks.drop("openers")), group, "left")
        return joined.withColumn("_chunk", _home_chunk(order))

    # Rows in earlier chunks, per chunk of a hot group: as small as the chunk table.
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed(rows.select(group, *order))
        .where(F.col("cuts").isNotNull())
        .groupBy(group, "_chunk")
        .agg(F.count("*").alias("n"))
        .select(group, "_chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed(rows)
        .drop("cuts")
        .join(F.broadcast(offsets), [group, "_chunk"], "left")
        .withColumn(name, F.row_number().over(window) + F.coalesce("_offset", F.lit(0)))
        .drop("_chunk", "_offset")
    )


def latest_in_order(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The last row of each group. The limit of one applies before the shuffle as well."""
    window = Window.partitionBy(group).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")
