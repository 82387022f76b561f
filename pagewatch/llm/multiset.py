"""Homomorphic multiset hash of a text's paragraphs.

A paragraph (a line of the text) is hashed to a wide vector, and a text's fingerprint is the sum of its
paragraphs' vectors, lane by lane, modulo 2**16 or 2**32. So the order of paragraphs does not matter, repeated ones
count, and inserting or deleting a paragraph adds or subtracts its vector.

The vector has two parts. ``DENSE`` lanes of 16 bits take part in every paragraph: they decide
equality. The others are sparse, ``GROUPS`` lanes in each of ``LEVELS`` levels, of 32 bits in the first and 16 in
the others. A paragraph is in level k if the last 2k bits of its hash are zero, so each level samples a quarter of the one before;
there it touches ``TOUCHED`` lanes, chosen by its hash, so a lane on which two texts agree speaks for common paragraphs.

Likeness estimates the share of distinct paragraphs that both texts hold equally often among those that either holds; it
is 1 for equal fingerprints. It reads the first level of which the two texts together touch at most ``FULL`` of the lanes,
and corrects touched and differing lanes for collisions. Up to about 200 different paragraphs of either text that is the
first level, and the error comes from collisions only (standard error up to about 0.06); above, about 50 to 200
paragraphs of the sample stand for all of them (up to about 0.08, whatever the length) up to
``200 * 4 ** (LEVELS - 1)``, some 800,000, from where on the last level fills and the error grows. A single changed paragraph of a
long text is seen by the dense lanes, but need not lower the likeness.

Defined cases: null and empty texts are the empty multiset: all lanes zero, equal to each other
with likeness 1. A text ``"a\\n"`` has the paragraphs ``a`` and the empty one. Of rows with equal ids the order
is by text. With one row the next text is its own; without rows there is no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewatch.llm.common import slices

DENSE = 64
GROUPS = 256
TOUCHED = 2
LEVELS = 7
FULL = 0.8
_DENSE_BYTES = 2 * DENSE
_FIRST_BYTES = 4 * GROUPS
BYTES = _DENSE_BYTES + _FIRST_BYTES + 2 * GROUPS * (LEVELS - 1)
#: Results go out in batches of so many rows, as fingerprints are wide.
ROWS = 1000


class Fingerprint:
    """Sum of paragraph vectors; mutable, so paragraphs can be added and removed."""

    __slots__ = ("dense", "sparse", "sampled")

    def __init__(self):
        self.dense = np.zeros(DENSE, np.uint16)
        self.sparse = np.zeros(GROUPS, np.uint32)
        self.sampled = np.zeros((LEVELS - 1, GROUPS), np.uint16)

    @classmethod
    def of(cls, text: str, known: dict[str, tuple] | None = None) -> Fingerprint:
        made = cls()
        if text:
            made._change(text.split("\n"), {} if known is None else known, 1)
        return made

    @classmethod
    def from_hex(cls, text: str) -> Fingerprint:
        made, raw = cls(), bytes.fromhex(text)
        made.dense = np.frombuffer(raw[:_DENSE_BYTES], "<u2").astype(np.uint16)
        made.sparse = np.frombuffer(raw[_DENSE_BYTES : _DENSE_BYTES + _FIRST_BYTES], "<u4").astype(np.uint32)
        made.sampled = np.frombuffer(raw[_DENSE_BYTES + _FIRST_BYTES :], "<u2").astype(np.uint16).reshape(-1, GROUPS)
        return made

    def _change(self, paragraphs: list[str], known: dict, sign: int) -> None:
        parts = []
        for p in paragraphs:
            vector = known.get(p)
            if vector is None:
                vector = known[p] = paragraph_vector(p)
            parts.append(vector)
        dense = np.stack([v[0] for v in parts]).sum(axis=0, dtype=np.uint16)
        lanes = np.concatenate([v[1] for v in parts])
        values = np.concatenate([v[2] for v in parts])
        sparse = np.zeros(GROUPS, np.uint32)
        np.add.at(sparse, lanes, values)
        sampled = np.zeros((LEVELS - 1, GROUPS), np.uint16)
        deep = np.array([v[3] for v in parts])
        for at in np.flatnonzero(deep).tolist():
            np.add.at(sampled, (slice(0, deep[at]), parts[at][1]), parts[at][2].astype(np.uint16))
        if sign > 0:
            self.dense, self.sparse, self.sampled = self.dense + dense, self.sparse + sparse, self.sampled + sampled
        else:
            self.dense, self.sparse, self.sampled = self.dense - dense, self.sparse - sparse, self.sampled - sampled

    def insert(self, paragraphs: list[str]) -> Fingerprint:
        self._change(paragraphs, {}, 1)
        return self

    def delete(self, paragraphs: list[str]) -> Fingerprint:
        self._change(paragraphs, {}, -1)
        return self

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool(
            (self.dense == other.dense).all() and (self.sparse == other.sparse).all()
            and (self.sampled == other.sampled).all()
        )

    __hash__ = None

    def likeness(self, other: Fingerprint) -> float:
        if self == other:
            return 1.0
        for level in range(LEVELS):
            one, two = (f.sampled[level - 1] if level else f.sparse for f in (self, other))
            used, differ = int(((one != 0) | (two != 0)).sum()), int((one != two).sum())
            if used <= FULL * GROUPS:
                break
        if used == differ:
            return 0.0
        # Of n paragraphs that touch lanes at random about GROUPS * exp(-TOUCHED * n / GROUPS) lanes stay untouched.
        last = GROUPS - 0.5
        return float(1 - np.log1p(-differ / GROUPS) / np.log1p(-min(used, last) / GROUPS))

    def hex(self) -> str:
        parts = self.dense.astype("<u2"), self.sparse.astype("<u4"), self.sampled.astype("<u2")
        return b"".join(p.tobytes() for p in parts).hex()


def paragraph_vector(paragraph: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Dense lanes, the touched sparse lanes with their values, and the last level that the paragraph is in."""
    raw = hashlib.shake_128(paragraph.encode("utf-8", "surrogatepass")).digest(_DENSE_BYTES + 8 * TOUCHED + 4)
    tail = np.frombuffer(raw[_DENSE_BYTES:], "<u4")
    depth = int(tail[-1]) | 1 << 2 * (LEVELS - 1)
    # An odd value is zero in no lane, also in its lower 16 bits.
    return (np.frombuffer(raw[:_DENSE_BYTES], "<u2"), tail[:TOUCHED] % GROUPS, tail[TOUCHED:-1] | np.uint32(1),
            ((depth & -depth).bit_length() - 1) // 2)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)`` of every row, as lower-case hex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                for at in range(0, len(texts), ROWS):
                    made = [Fingerprint.of(t).hex() for t in texts[at : at + ROWS]]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(at, ROWS), pa.array(made, pa.string())], ["id", "fingerprint"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"id {kind}, fingerprint string"
    ).withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """The last half of a text (rounded down) replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(part, own, id, text)`` sorted inside each partition by ``part`` and descending id, where each part
    ends with a copy of the row that follows its last (``own`` is false there).

    Parts are ranges of ids between cut points; only ids are read to find the cuts and the first row of each part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.select(
        F.percentile_approx("id", [k / n for k in range(1, n)], min(100 * n, 1_000_000)).alias("c")
    ).first()["c"] if n > 1 else []
    points = sorted(set(cuts or []), reverse=True)  # fewer than partitions
    # Part 0 holds the largest ids; null ids come last of all.
    ascending = np.array(sorted(points), np.int64)
    last = len(points)

    @F.pandas_udf("int")
    def part_of(column: pd.Series) -> pd.Series:
        known = column.fillna(0).to_numpy(np.int64)
        return pd.Series(last - np.searchsorted(ascending, known, "right")).where(column.notna().to_numpy(), last)

    part = part_of("id")
    firsts = {
        r["part"]: r["top"] for r in
        ids.select(part.alias("part"), "id").groupBy("part").agg(F.max("id").alias("top")).collect()
    }
    order = sorted(firsts)
    follows = {p: order[(k + 1) % len(order)] for k, p in enumerate(order)}
    lookahead = [(firsts[q], p) for p, q in follows.items()]
    needed = spark.createDataFrame(lookahead or [(None, 0)], "id long, part int")
    # One copy of the first row of each part goes to the part before it: as many rows as parts.
    copies = (
        rows.join(F.broadcast(needed), rows["id"].eqNullSafe(needed["id"]))
        .select("part", rows["id"], "text")
        .groupBy("part").agg(F.min(F.struct("id", "text")).alias("r"))
        .select("part", F.lit(False).alias("own"), "r.id", "r.text")
    )
    own = rows.select(part.alias("part"), F.lit(True).alias("own"), "id", "text")
    return own.unionByName(copies).repartition(max(n, 1), "part").sortWithinPartitions(
        "part", F.desc("own"), F.desc_nulls_last("id"), "text"
    )


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next)`` of every row.

    The next row is the one with the next smaller id; after the smallest comes the largest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next one: part, id, text, fingerprint
        known: dict[str, tuple] = {}
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for part_rows, texts in (piece for batch in batches for piece in slices(batch, 3)):
            out = []
            for at, (part, own, key) in enumerate(zip(*(part_rows.column(i).to_pylist() for i in range(3)))):
                text = texts[at]
                mark = Fingerprint.of(text, known)
                if held and held[0] == part:
                    changed = edited(held[2], text)
                    after = Fingerprint.of(changed, known)
                    out.append((held[1], len(held[2]), changed, held[3].hex(), after.hex(),
                                held[3].likeness(after), held[3].likeness(mark)))
                held = (part, key, text, mark) if own else None
                if len(known) > 20_000:
                    known.clear()
                if len(out) >= ROWS:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)

    return with_next(docs, id_col, text_col).mapInArrow(
        run,
        "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    ).withColumnRenamed("id", id_col)
