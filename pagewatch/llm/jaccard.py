"""N-gram Jaccard join with Bayesian pruning of candidate pairs.

A text is its set of word five-grams (lower-cased, split at white space; a shorter text is one
shorter n-gram). Equal sets form one node. Nodes meet as candidates if they share a band of
MinHash values. A candidate pair compares its MinHash values step by step; it is dropped as soon
as the posterior probability that its similarity reaches the threshold falls below
``tolerance`` (uniform prior, so the posterior is a beta distribution). All pairs left are verified
on the sets themselves.

Nothing emits the pairs of a group. Candidates are first joined to components by star links per
band; a component is cut into blocks of about ``BLOCK`` nodes by hash, and each pair of blocks is
one group, compared in arrays inside its task. A task returns one row per node: its number of links and
the smallest node it reaches there. Components of these rows are the classes.

Defined cases: a null text is an empty one; texts without any word are equal to each other.
Repeated rows are separate documents of one node (each counts as a link of the other). One id may come with
different texts: nodes have numbers of their own. Rows
with a null id link nothing and form no class: their class is null, their links 0. Ties: a class is named by its smallest id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewatch.llm.common import WordHashes, arrays, lists, mix, slices
from pagewatch.llm.components import connected_components
from pagewatch.sources.tables import materialize

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
BLOCK = 256

_MULTIPLIERS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text, given the hashes of its words."""
    n = min(WORDS, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total = mix(total + words[i : len(words) - n + 1 + i] + np.uint64(n))
    return np.unique(total)


def set_key(found: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed numbers."""
    high = mix(found).sum(dtype=np.uint64) + np.uint64(len(found))
    low = mix(found ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)
    return int(high.astype(np.int64)), int(low.astype(np.int64))


def minhash(found: np.ndarray) -> np.ndarray:
    """The smallest of each of ``HASHES`` hash functions over a set."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(found), 256):
        values = (_MULTIPLIERS[:, None] * found[None, at : at + 256]) >> np.uint64(32)
        least = np.minimum(least, values.min(axis=1).astype(np.uint32))
    return least


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """Per number of compared values (a multiple of ``STEP``): the fewest matches that keep a pair.

    With a uniform prior the posterior after m of n matches is Beta(m+1, n-m+1), whose upper
    tail at the threshold is the chance of at most m successes in n+1 trials.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for part, texts in slices(batch):
            high, low, signs = [], [], []
            for text in texts:
                found = shingles(hashes.of(text.lower().split()))
                key = set_key(found)
                high.append(key[0])
                low.append(key[1])
                signs.append(minhash(found).view(np.int32))
            flat = pa.array(np.concatenate(signs))
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * HASHES)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(high, pa.int64()), pa.array(low, pa.int64()),
                 pa.ListArray.from_arrays(offsets, flat)], ["id", "hi", "lo", "sign"])


def _resketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of the nodes' texts. Input: node, text, hi, lo, then what is passed on."""
    hashes = WordHashes()
    for batch in batches:
        for part, texts in slices(batch):
            keep, sets = [], []
            want = list(zip(part.column(2).to_pylist(), part.column(3).to_pylist()))
            for i, text in enumerate(texts):
                found = shingles(hashes.of(text.lower().split()))
                if set_key(found) == want[i]:
                    keep.append(i)
                    sets.append(found.view(np.int64))
            if not keep:
                continue
            kept = part.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), *(kept.column(i) for i in range(4, kept.num_columns)), lists(sets, np.int64)],
                ["node", *kept.schema.names[4:], "set"])


def _compare(signs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray,
             threshold: float, needed: list[int]) -> list[tuple[int, int]]:
    """Linked pairs between two blocks of nodes, or within one if both are the same."""
    a, b = signs[left], signs[right]
    shared = np.zeros((len(left), len(right)), bool)
    for band in range(BANDS):
        hit = np.ones(shared.shape, bool)
        for at in range(band * ROWS, (band + 1) * ROWS):
            hit &= a[:, at, None] == b[None, :, at]
        shared |= hit
    if left is right:
        shared &= np.tri(len(left), k=-1, dtype=bool)
    i, j = np.nonzero(shared)
    matches = np.zeros(len(i), np.int32)
    for step, least in enumerate(needed):
        span = slice(step * STEP, (step + 1) * STEP)
        matches += (a[i, span] == b[j, span]).sum(axis=1, dtype=np.int32)
        stay = matches >= least
        i, j, matches = i[stay], j[stay], matches[stay]
    links = []
    for x, y in zip(left[i].tolist(), right[j].tolist()):
        p, q = sets[x], sets[y]
        common = np.intersect1d(p, q, assume_unique=True).size
        union = len(p) + len(q) - common
        if not union or common >= threshold * union - 1e-9:
            links.append((x, y))
    return links


def _links_in_blocks(threshold: float, tolerance: float):
    needed = least_matches(threshold, tolerance)

    def group(table: pa.Table) -> pa.Table:
        ids, first_at = np.unique(table.column("node").to_numpy(), return_index=True)
        table = table.take(pa.array(first_at))
        block, copies = table.column("block").to_numpy(), table.column("copies").to_numpy()
        signs = np.stack(arrays(table.column("sign")))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        links = _compare(signs, arrays(table.column("set")), left, right, threshold, needed)
        root = list(range(len(ids)))
        degree = np.zeros(len(ids), np.int64)

        def find(n: int) -> int:
            while root[n] != n:
                root[n] = root[root[n]]
                n = root[n]
            return n

        for x, y in links:
            degree[x] += copies[y]
            degree[y] += copies[x]
            u, v = find(x), find(y)
            root[max(u, v)] = min(u, v)
        linked = np.flatnonzero(degree)
        return pa.table({
            "node": pa.array(ids[linked]),
            "links": pa.array(degree[linked]),
            "root": pa.array(ids[[find(n) for n in linked]] if len(linked) else ids[:0]),
        })

    return group


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``(id, class_id, n_links)`` of every row: the smallest id of its class, and with how many
    other documents it has at least ``threshold`` of all distinct five-grams in common.

    ``threshold`` has to be at least 0.7: the bands are laid out for it. At 0.8 a pair is missed
    with a probability of 3e-6, less for more similar ones.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    sketches = materialize(
        plain.mapInArrow(_sketch, "id long, hi long, lo long, sign array<int>"), "sketches"
    )
    # Numbers are given once: the table is written before anything reads them.
    nodes = materialize(
        sketches.where("id IS NOT NULL").groupBy("hi", "lo").agg(
            F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("sign").alias("sign")
        ).withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    banded = nodes.select(
        "node",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(BANDS - 1)),
                lambda b: F.xxhash64(b, F.slice("sign", b * ROWS + 1, ROWS)),
            )
        ).alias("band"),
    )
    shared = banded.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    stars = banded.join(shared.drop("last"), "band").where("node != first").select("node", "first").distinct()
    weak = connected_components(stars, "node", "first")
    sizes = weak.groupBy("root").agg(F.count("*").alias("size"))
    placed = (
        weak.join(sizes, "root")
        .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .select("node", "root", "blocks", "block")
        .join(nodes, "node")
    )
    # An id may have other texts too; the next step keeps the node's own.
    read = placed.join(plain.withColumnRenamed("id", "first_id"), "first_id").select(
        "node", "t", "hi", "lo", "root", "blocks", "block", "copies", "sign"
    )
    members = read.mapInArrow(
        _resketch,
        "node long, root long, blocks int, block int, copies long, sign array<int>, set array<long>",
    )
    dealt = members.select(
        "node", "root", "block", "copies", "sign", "set",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mate"),
    ).select(
        "node", "root", "block", "copies", "sign", "set",
        F.least("block", "mate").alias("i"), F.greatest("block", "mate").alias("j"),
    )
    found = materialize(
        dealt.groupBy("root", "i", "j").applyInArrow(
            _links_in_blocks(threshold, tolerance), "node long, links long, root long"
        ),
        "found",
    )
    degrees = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(found, "node", "root").withColumnRenamed("root", "class")
    named = nodes.select("node", "first_id").join(classes, "node").groupBy("class").agg(F.min("first_id").alias("class_id"))
    known = (
        nodes.select("hi", "lo", "node", "first_id", "copies")
        .join(degrees, "node", "left").join(classes.join(named, "class").select("node", "class_id"), "node", "left")
        .select("hi", "lo", F.coalesce("class_id", "first_id").alias("class_id"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    return sketches.select("id", "hi", "lo").join(known, ["hi", "lo"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("id").isNotNull(), F.col("class_id")).alias("class_id"),
        F.when(F.col("id").isNotNull(), F.col("n_links")).otherwise(0).alias("n_links"),
    )
