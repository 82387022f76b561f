"""The first of several overlapping claims, over time.

Every interval is a claim of a value on a group from ``start`` until ``end``, with a rank. At any time the living claim of the
least rank holds. A sweep over the starts with a heap of living claims finds the times at which the holder changes, so
a lookup at some time is one look back instead of a join with every interval.

A sweep holds the living claims of one group, and reads its starts as a sorted stream. A group with very many claims is cut into
chunks along its starts. A claim goes to the chunk it starts in and to the one it ends in. Of the claims that
last through whole chunks only the least of each chunk matters: a claim names the few blocks of chunks (of 1, 2, 4, ... chunks)
that make up its range, and the least claim of a block is found before and after the shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagewatch.operators.skew import DEFAULT_POLICY, SkewPolicy, plan_chunks

#: Fields of a position, in order: state before batch, time, place in the log.
POSITION = ("_seq", "captured_at", "ordinal")
HOLDERS = "_group string, _seq int, captured_at timestamp_ntz, ordinal bigint, value string"


def holders(claims: DataFrame, policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """Times from which another value holds a group: ``_group, _seq, captured_at, ordinal, value``.

    ``claims`` has ``_group, value`` and the positions ``start, end, rank``, where ``end`` may be null. The value is null
    from a time on at which no claim lives. A claim lives after its start and up to its end.
    """
    claims = claims.select("_group", "value", "start", "end", "rank")
    chunks = plan_chunks(claims.select("_group", "start"), "_group", ["start"], policy=policy)
    if chunks is None:
        placed = claims.withColumn("_chunk", F.lit(0))
    else:
        placed = _in_chunks(claims, chunks.select("_group", F.transform("cuts", lambda c: c["start"]).alias("cuts")))
    fields = [F.col(f"{p}.{f}").alias(f"{p}_{f}") for p in ("start", "end", "rank") for f in POSITION]
    return (
        placed.select("_group", "_chunk", "value", *fields).repartition("_group", "_chunk")
        .sortWithinPartitions("_group", "_chunk", *[f"start_{f}" for f in POSITION])
        .mapInArrow(_sweep, HOLDERS)
    )


def _before(position: Column) -> Column:
    """Number of cuts before a position: its chunk."""
    return F.size(F.filter("cuts", lambda c: c < position))


def _blocks(first: Column, beyond: Column) -> Column:
    """Aligned blocks ``(level, block)`` of 2**level chunks that make up a range of chunks."""

    def at_level(level: Column) -> Column:
        size = F.pow(F.lit(2), level)
        low, high = F.ceil(first / size).cast("int"), F.floor(beyond / size).cast("int")

        def block(number: Column, taken: Column) -> Column:
            return F.when((low < high) & taken, F.struct(level.alias("level"), number.alias("block")))

        return F.array_compact(F.array(block(low, low % 2 == 1), block(high - 1, high % 2 == 1)))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(30)), at_level)))


def _in_chunks(claims: DataFrame, cuts: DataFrame) -> DataFrame:
    told = claims.join(F.broadcast(cuts), "_group", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast(cuts.schema["cuts"].dataType)))
    ranged = told.withColumns({
        "_first": _before(F.col("start")),
        "_last": F.when(F.col("end").isNull(), F.size("cuts") + 1).otherwise(_before(F.col("end"))),
    })
    # Claims that end in a later chunk live on to the end of this one, and from the beginning of that one.
    later = F.col("_last") > F.col("_first")
    none = F.lit(None).cast(claims.schema["end"].dataType)
    own = F.struct(
        F.col("_first").alias("_chunk"), F.col("start").alias("from"), F.when(~later, F.col("end")).alias("to"))
    carried = F.struct(
        F.col("_last").alias("_chunk"), F.get("cuts", F.col("_last") - 1).alias("from"), F.col("end").alias("to"))
    parts = F.array_compact(F.array(own, F.when(later & F.col("end").isNotNull(), carried)))
    ends = ranged.select("_group", "value", "rank", F.explode(parts).alias("part")).select(
        "_group", "value", F.col("part.from").alias("start"), F.col("part.to").alias("end"), "rank",
        F.col("part._chunk").alias("_chunk"),
    )
    least = (
        ranged.where(F.col("_last") > F.col("_first") + 1)
        .select("_group", "rank", "value", F.explode(_blocks(F.col("_first") + 1, F.col("_last"))).alias("at"))
        .groupBy("_group", "at.level", "at.block").agg(F.min(F.struct("rank", "value")).alias("least"))
    )
    # A chunk lies in one block of every level. Chunks of hot groups are few.
    every = cuts.select("_group", "cuts", F.explode(F.sequence(F.lit(1), F.size("cuts"))).alias("_chunk"))
    lasting = (
        every.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(30))))
        .withColumn("block", F.expr("shiftright(_chunk, level)"))
        .join(least, ["_group", "level", "block"])
        .groupBy("_group", "_chunk").agg(F.min("least").alias("least"), F.first("cuts").alias("cuts"))
        .select(
            "_group", "least.value", F.get("cuts", F.col("_chunk") - 1).alias("start"), none.alias("end"), "least.rank",
            "_chunk",
        )
    )
    return ends.unionByName(lasting)


def _positions(batch: pa.RecordBatch, name: str) -> Iterator[tuple | None]:
    """Positions as tuples of numbers that compare like them; None where there is none."""
    seq, time, ordinal = (batch.column(batch.schema.get_field_index(f"{name}_{f}")) for f in POSITION)
    for s, t, o in zip(seq.to_pylist(), time.cast(pa.int64()).to_pylist(), ordinal.to_pylist()):
        yield None if s is None else (s, -(1 << 63) if t is None else t, -(1 << 63) if o is None else o)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made: list[tuple] = []
    heap: list[tuple] = []
    chunk, told, waiting, serial = None, None, None, 0

    def hold(at: tuple) -> None:
        """Note who holds after a position. Only the last one of a position counts."""
        nonlocal waiting
        if waiting and waiting[0] != at:
            give()
        waiting = (at, heap[0][1] if heap else None)

    def give() -> None:
        nonlocal waiting, told
        if waiting and waiting[1] != told:
            told = waiting[1]
            made.append((chunk[0], *waiting[0], told))
        waiting = None

    def expire(until: tuple | None) -> None:
        while heap and heap[0][3] is not None and (until is None or heap[0][3] <= until):
            at = heap[0][3]
            while heap and heap[0][3] is not None and heap[0][3] <= at:
                heapq.heappop(heap)
            hold(at)

    def given() -> pa.RecordBatch:
        group, seq, time, ordinal, value = zip(*made)
        least = -(1 << 63)
        batch = pa.RecordBatch.from_arrays([
            pa.array(group, pa.string()), pa.array(seq, pa.int32()),
            pa.array([None if t == least else t for t in time], pa.int64()).cast(pa.timestamp("us")),
            pa.array([None if o == least else o for o in ordinal], pa.int64()), pa.array(value, pa.string()),
        ], ["_group", "_seq", "captured_at", "ordinal", "value"])
        made.clear()
        return batch

    for batch in batches:
        rows = zip(
            batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(),
            _positions(batch, "start"), _positions(batch, "end"), _positions(batch, "rank"),
        )
        for group, number, value, start, end, rank in rows:
            if (group, number) != chunk:
                if chunk is not None:
                    expire(None)
                    give()
                    heap.clear()
                # The holder at the beginning of a chunk is told again: chunks do not see each other.
                told = None if chunk is None or chunk[0] != group else object()
                chunk = (group, number)
            expire(start)
            serial += 1
            heapq.heappush(heap, (rank, value, serial, end))
            hold(start)
        if len(made) >= 10_000:
            yield given()
    if chunk is not None:
        expire(None)
        give()
    if made:
        yield given()
