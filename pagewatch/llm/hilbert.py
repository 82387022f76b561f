"""Sharding along a Hilbert curve over several metadata dimensions.

Every dimension is quantised to ``2**bits`` levels of about equal numbers of rows, the levels
of a row are the coordinates of a cell, and rows are sorted by their cell's place on the Hilbert curve. Shards are
runs of this order, so each spans a compact box of metadata, and a reader that knows the boxes skips
most shards.

Law ``rows``: counts of shards differ by one at most. The order is made by a range exchange
on (curve index, text hash, id), so a cell with very many rows is split like any other; a row's place is
its place in its partition plus the rows of earlier partitions, of which the driver gets one
number each.

A dimension is a number or a text. Texts are quantised whole, in the order of their UTF-8 bytes: rows are counted per distinct
value, the values are ranked over a range exchange, and at most ``2**bits - 1`` values where the running count passes a
share become cut points. Only these reach the driver, and no row is joined to its value, so a hot value is no hot key.

Defined cases: a null value takes the lowest level, a null text has no bytes and the checksum of the
empty text. Repeated rows take different slots. With fewer rows than shards the last shards are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewatch.sources.tables import materialize

ACCURACY = 1000


def hilbert_index(levels: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each column of an integer array ``(dimensions, n)``.

    Skilling's transform: undo the excess work of the higher bits, then read the Gray code.
    """
    x = levels.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def text_cuts(df: DataFrame, name: str, bits: int) -> list[str]:
    """The values at which the running count of rows, by value, passes ``k / 2**bits`` of all rows, for each ``k``."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = materialize(
        df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n"))
        .repartitionByRange(n, "v").withColumn("_part", F.spark_partition_id()),
        "values",
    )
    rows = {r["_part"]: r["n"] for r in counted.groupBy("_part").agg(F.sum("n").alias("n")).collect()}
    total = sum(rows.values())
    if not total:
        return []
    before = np.cumsum([0] + [rows[part] for part in sorted(rows)]).tolist()
    starts = spark.createDataFrame(list(zip(sorted(rows), before)), "_part int, _before long")
    upto = F.col("_before") + F.sum("n").over(Window.partitionBy("_part").orderBy("v"))
    levels = 1 << bits
    passed = lambda rows_so_far: F.expr(f"({rows_so_far} * {levels}L) div {total}L")
    found = (
        counted.join(F.broadcast(starts), "_part")  # one row per partition of the exchange
        .withColumn("_upto", upto)
        .select("v", passed("(_upto - n)").alias("a"), F.least(passed("_upto"), F.lit(levels - 1)).alias("b"))
        .where("b > a")
        .collect()
    )
    return [r["v"] for r in sorted(found, key=lambda r: r["a"]) for _ in range(r["b"] - r["a"])]


def quantised(df: DataFrame, dimensions: list[str], bits: int) -> DataFrame:
    """``df`` with a column ``_level_i`` per dimension: how many of its cut points lie below a value."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    kinds = dict(df.dtypes)
    numbers = [d for d in dimensions if kinds[d] != "string"]
    found = df.select(
        F.count("*"), *[F.percentile_approx(F.col(d).cast("double"), shares, ACCURACY).alias(d) for d in numbers]
    ).first()

    def below(d: str) -> Column:
        # 2**bits - 1 values; repeats spread few values over all levels.
        points = list(found[d] or []) if d in numbers else text_cuts(df, d, bits)
        kind, value = ("double", F.col(d).cast("double")) if d in numbers else ("string", F.col(d))
        cut = F.array(*map(F.lit, points)).cast(f"array<{kind}>")
        return F.when(value.isNull(), 0).otherwise(F.size(F.filter(cut, lambda c: c < value)))

    return df.withColumns({f"_level_{i}": below(d) for i, d in enumerate(dimensions)})


def _curve(dimensions: int, bits: int):
    @F.pandas_udf("long")
    def index(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for levels in parts:
            yield pd.Series(hilbert_index(np.stack([s.to_numpy() for s in levels]), bits))

    return index(*[F.col(f"_level_{i}") for i in range(dimensions)])


def hilbert_shards(docs: DataFrame, dimensions: list[str], shards: int, id_col: str = "doc_id",
                   text_col: str = "text", bits: int = 5, partitions: int | None = None) -> DataFrame:
    """``(id, size, text_crc32, curve, <dimensions>, shard, slot)`` of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    narrow = materialize(
        docs.select(
            F.col(id_col).alias("_id"), *[F.col(d).alias(f"_d{i}") for i, d in enumerate(dimensions)],
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("_hash"),
        ),
        "sizes",
    )
    names = [f"_d{i}" for i in range(len(dimensions))]
    placed = quantised(narrow, names, bits).withColumn("curve", _curve(len(names), bits))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["curve", "_hash", "_id"]
    ranged = materialize(
        placed.drop(*[f"_level_{i}" for i in range(len(names))])
        .repartitionByRange(n, *order).sortWithinPartitions(*order)
        # The number of the partition in the upper bits, the place inside it in the lower 33.
        .withColumn("_place", F.monotonically_increasing_id()),
        "curve",
    ).withColumns({"_part": F.shiftright("_place", 33), "_at": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(counts):
        before[part] = total
        total += counts[part]
    starts = spark.createDataFrame(sorted(before.items()) or [(0, 0)], "_part long, _before long")
    small, larger = divmod(total, shards)
    edge = larger * (small + 1)
    g = F.col("_at") + F.col("_before")
    shard = F.when(g < edge, F.floor(g / (small + 1))).otherwise(
        larger + F.floor((g - edge) / F.lit(max(small, 1)))
    ).cast("int")
    first = F.col("shard") * small + F.least("shard", F.lit(larger))
    return (
        ranged.join(F.broadcast(starts), "_part")  # one row per partition of the exchange
        .withColumn("shard", shard)
        .withColumn("slot", (g - first).cast("long"))
        .select(F.col("_id").alias(id_col), "size", "text_crc32", "curve",
                *[F.col(f"_d{i}").alias(d) for i, d in enumerate(dimensions)], "shard", "slot")
    )


def shard_boxes(sharded: DataFrame, dimensions: list[str]) -> DataFrame:
    """Per shard the smallest and largest value of each dimension: what a reader prunes by."""
    return sharded.groupBy("shard").agg(
        F.count("*").alias("rows"), F.sum("size").alias("bytes"),
        *[f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))],
    )


def write_shards(docs: DataFrame, sharded: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the documents as one folder per shard, in curve order inside each."""
    keys = sharded.select(id_col, "shard", "slot")
    joined = docs.join(keys, id_col)
    joined.repartition("shard").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
