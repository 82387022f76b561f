"""Benchmark decontamination with spaced seeds.

Texts are words (``\\w+``, lower-cased). A mask is a row of ones and zeros; the words under its
ones are hashed, the others are ignored, so a seed survives substitutions between. Seeds of
the benchmark and of the documents are joined, and each pair of document and item that shares one
is verified: of all gap-free runs along a diagonal with a shared seed that have a share of matches of at least
``MIN_IDENTITY``, the one with the most matches is held against ``MIN_MATCHES``.

A document's seeds would be several times its words. A bit table of a fixed size with the
benchmark's seeds (``FILTER_BITS``, whatever the benchmark's size) goes to all tasks and drops nearly all
seeds that cannot match; the exact join decides about the rest.

Defined cases: null and empty texts have no seeds. Items of fewer than ``MIN_WORDS`` words prove
nothing and are left out; items shorter than the shortest mask are one seed of their own
length. Rows with a null id are left out. Repeated rows give one result. An item that is repeated
under another id gives a row for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewatch.llm.common import WordHashes, arrays, lists, mix, slices
from pagewatch.sources.tables import materialize

MASKS = ("111111", "11011011", "1100101011", "10110001101")
MIN_WORDS = 4
FILTER_BITS = 24
#: A run counts if it has so many matching words (or all the item's, if it has fewer) ...
MIN_MATCHES = 10
#: ... and so large a share of matches.
MIN_IDENTITY = 0.75

_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def seeds(hashes: np.ndarray, masks: list[str]) -> np.ndarray:
    """``(2, n)`` array of seed and position, over all masks."""
    out = [np.zeros((2, 0), np.uint64)]
    for mask in masks:
        n = len(hashes) - len(mask) + 1
        if n <= 0:
            continue
        total = np.full(n, int(mask, 2) + (len(mask) << 32), np.uint64)
        for i, bit in enumerate(mask):
            if bit == "1":
                total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
        out.append(np.stack([mix(total), np.arange(n, dtype=np.uint64)]))
    return np.concatenate(out, axis=1)


def _slot(seed: np.ndarray) -> np.ndarray:
    return (seed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def best_run(match: np.ndarray) -> tuple[int, int, int]:
    """``(matches, start, end)`` of the run of a diagonal that has the most matches of all runs with a share of
    at least ``MIN_IDENTITY``; it begins and ends with a match. All zero if nothing matches."""
    # Non-negative over a run exactly if its share is large enough; whole numbers, as the share is a number of quarters.
    total = np.concatenate([[0], np.cumsum(np.where(match, 4 - int(4 * MIN_IDENTITY), -int(4 * MIN_IDENTITY)))])
    matches = np.concatenate([[0], np.cumsum(match)])
    # For each end the first start from which the run is good enough, as matches only grow with length.
    start = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
    end = int(np.argmax(matches - matches[start]))
    first = int(start[end])
    if not match[first:end].any():
        return 0, 0, 0
    first += int(np.argmax(match[first:end]))
    return int(matches[end] - matches[first]), first, end


def verify(doc: np.ndarray, item: np.ndarray, masks: list[str]) -> tuple[int, int, int, int] | None:
    """Best accepted ``(matches, length, start in document, start in item)`` over all diagonals with a hit."""
    d, i = seeds(doc, masks), seeds(item, masks)
    d = d[:, np.isin(d[0], i[0])]
    order = np.argsort(i[0], kind="stable")
    keys = i[0][order]
    lo, hi = np.searchsorted(keys, d[0], "left"), np.searchsorted(keys, d[0], "right")
    count = hi - lo
    at = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    shift = np.repeat(d[1].astype(np.int64), count) - i[1][order][at].astype(np.int64)
    best = None
    for s in np.unique(shift).tolist():
        a, b = max(0, s), min(len(doc), s + len(item))
        matches, start, end = best_run(doc[a:b] == item[a - s : b - s])
        if matches >= min(MIN_MATCHES, len(item)):
            found = (matches, end - start, a + start, a - s + start)
            if best is None or found[0] > best[0]:
                best = found
    return best


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with their word hashes and the seeds of their masks."""
    hashes = WordHashes()
    for batch in batches:
        for part, texts in slices(batch):
            found = [hashes.of(words(t)) for t in texts]
            seen = [
                np.unique(seeds(h, list(MASKS) if len(h) >= len(MASKS[0]) else ["1" * len(h)])[0])
                if len(h) >= MIN_WORDS else np.zeros(0, np.uint64)
                for h in found
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), lists([h.view(np.int64) for h in found], np.int64),
                 lists([s.view(np.int64) for s in seen], np.int64)], ["item_id", "item", "seeds"])


def _probe(bits: np.ndarray, masks: list[str]):
    """Documents with at least one seed that may be the benchmark's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(bits).astype(bool)
        hashes = WordHashes()
        for batch in batches:
            for part, texts in slices(batch):
                keep, found, hits = [], [], []
                for i, text in enumerate(texts):
                    h = hashes.of(words(text))
                    s = seeds(h, masks)[0]
                    s = np.unique(s[table[_slot(s)]])
                    if len(s):
                        keep.append(i)
                        found.append(h.view(np.int64))
                        hits.append(s.view(np.int64))
                if keep:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(keep)), lists(found, np.int64), lists(hits, np.int64)],
                        ["doc", "words", "seeds"])

    return run


def _filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bit table of the seeds that a task has read, in pieces of 64 bits."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    for batch in batches:
        bits[_slot(batch.column(0).to_numpy().view(np.uint64))] = True
    pieces = np.packbits(bits).view(np.int64)
    at = np.flatnonzero(pieces)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(pieces[at])], ["at", "piece"])


def _verify(masks: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, item_id, w, i in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                arrays(batch.column(2)), arrays(batch.column(3)),
            ):
                h = i.view(np.uint64)
                found = verify(w.view(np.uint64), h, masks)
                if found:
                    rows.append((doc, item_id, len(h), *found))
            names = ["doc", "item", "item_words", "matches", "length", "doc_start", "item_start"]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(id, item, item_words, matches, length, doc_start, item_start)``: the best accepted overlap
    of each pair of document and benchmark item; positions count words."""
    plain = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("t"))
    items = materialize(
        plain.where("item_id IS NOT NULL").dropDuplicates()
        .mapInArrow(_index, "item_id long, item array<long>, seeds array<long>"),
        "items",
    )
    bounds = items.select(F.size("item").alias("n")).where(
        F.col("n").between(MIN_WORDS, len(MASKS[0]) - 1)
    ).distinct()  # at most a handful of lengths
    masks = list(MASKS) + ["1" * r["n"] for r in bounds.orderBy("n").collect()]
    pieces = (
        items.select(F.explode("seeds").alias("seed")).mapInArrow(_filter, "at long, piece long")
        .groupBy("at").agg(F.bit_or("piece").alias("piece")).toArrow()
    )
    bits = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    bits[pieces.column("at").to_numpy()] = pieces.column("piece").to_numpy()
    probed = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("t"))
        .where("doc IS NOT NULL")
        .mapInArrow(_probe(bits.view(np.uint8), masks), "doc long, words array<long>, seeds array<long>"),
        "probed",
    )
    pairs = (
        probed.select("doc", F.explode("seeds").alias("seed"))
        .join(items.select("item_id", F.explode("seeds").alias("seed")), "seed")
        .select("doc", "item_id").distinct()
    )
    found = (
        pairs.join(probed.select("doc", "words"), "doc")
        .join(items.select("item_id", "item"), "item_id")
        .select("doc", "item_id", "words", "item")
        .mapInArrow(
            _verify(masks),
            "doc long, item long, item_words long, matches long, length long, doc_start long, item_start long",
        )
    )
    best = found.groupBy("doc", "item").agg(
        F.max(F.struct("matches", "length", "doc_start", "item_start", "item_words")).alias("best")
    )
    return best.select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), "best.item_words", "best.matches",
        "best.length", "best.doc_start", "best.item_start",
    )
