"""Phrase collocations from counting quotient filters.

A word's id is a 64-bit hash of language and word. The table of all words is checked: if two of them ever share an
id, another seed is taken, so ids stand for words without loss. An n-gram is
packed as its word ids. Its first id is changed by a hash of the others, which can be undone: the packed n-gram is
permuted, not hashed. The leading bits of the permuted n-gram are the quotient; the remainder is all the rest.

A counting quotient filter (``CountingFilter``) keeps n-grams in the order of their permuted value: one bit per n-gram and
one per quotient say how many remainders a quotient has, remainders are stored in full, and counters take one byte unless they
are large. Nothing is lost: the filter gives back every n-gram and its exact count. A task counts its texts
into filters, cut by blocks of quotients. All filters of a block then merge in order into one, whatever their number.
Blocks follow the number of words, so a block stays small; the permutation spreads n-grams evenly over them, and a very common
n-gram is one entry of every filter.

Phrases grow word by word: an n-gram can occur ``MIN_COUNT`` times only if both of its parts without an end word do. A bit
table of fixed size (``FILTER_BITS``) of the frequent n-grams of one length goes to all tasks, and n-grams that cannot be
frequent are not counted. False hits of that table cost work and change no result.

A null text is empty, a null language is ``und``. Repeated rows count as often as they occur; ids and other columns are not read.
Ties in score and count are ordered by phrase, so equal inputs give equal ranks. Empty tables give an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewatch.llm.common import mix, slices
from pagewatch.sources.tables import materialize

MIN_COUNT = 30
MAX_WORDS = 4
#: Phrases with a longer one in which at least so many of a hundred of their occurrences lie are dropped.
CONTAINED_PERCENT = 80
TOP = 2000
FILTER_BITS = 26
#: Words that a block of quotients stands for, and quotients of a block.
BLOCK_WORDS = 1 << 19
BLOCK_QUOTIENT_BITS = 14
#: Occurrences that a task gathers before it sorts them, and different n-grams that it holds before it gives them away.
FRESH = 1 << 18
HELD = 1 << 20
#: Words that a task counts before it gives them away, and ids that it remembers; a task with more forgets them all.
COUNTED = 1 << 18
REMEMBERED = 1 << 17
SALTS = 16

_BREAK = b"."
#: Separators of pieces become a break, which is no word; white space that is left separates words.
_PIECES = bytes(ord(_BREAK) if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words in lower case (A to Z only), with a break between pieces."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_PIECES).replace(_BREAK, b" . ").split()


class WordIds(dict):
    """Word to id in one language; a break is 0. Ids are computed anew once ``REMEMBERED`` are remembered."""

    def __init__(self, lang: str, seed: int):
        super().__init__({_BREAK: 0})
        self.seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), seed)

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, self.seed) or 1
        if len(self) < REMEMBERED:
            self[word] = value
        return value


# -- packed n-grams: a list of columns of word ids


def permuted(gram: list[np.ndarray]) -> list[np.ndarray]:
    """The first id changed by the others. Doing it twice undoes it."""
    key = np.zeros(len(gram[0]), np.uint64)
    for column in gram[1:]:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return [gram[0] ^ key, *gram[1:]] if len(gram) > 1 else gram


def slot(gram: list[np.ndarray]) -> np.ndarray:
    return (permuted(gram)[0] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Permuted n-grams in order, each once, with their summed counts. Runs already in order are merged."""
    if not len(counts):
        return keys, counts
    order = np.argsort(keys[0], kind="stable")
    placed = [k[order] for k in keys]
    same = placed[0][1:] == placed[0][:-1]
    equal = same.copy()
    for k in placed[1:]:
        equal &= k[1:] == k[:-1]
    if (same & ~equal).any():
        # Different n-grams with equal first columns: order by all columns.
        order = np.lexsort(keys[::-1])
        placed = [k[order] for k in keys]
        equal = np.logical_and.reduce([k[1:] == k[:-1] for k in placed])
    firsts = np.flatnonzero(np.concatenate([[True], ~equal]))
    return [k[firsts] for k in placed], np.add.reduceat(counts[order], firsts)


@dataclass(frozen=True)
class CountingFilter:
    """Sorted n-grams of one block of quotients: ``marks`` has a 1 per n-gram and a 0 after each quotient's last."""

    size: int
    marks: bytes
    remainders: bytes
    counters: bytes

    @staticmethod
    def of(keys: list[np.ndarray], counts: np.ndarray, block: int, block_bits: int) -> CountingFilter:
        bits = block_bits + BLOCK_QUOTIENT_BITS
        quotient = (keys[0] >> np.uint64(64 - bits)).astype(np.int64) - (block << BLOCK_QUOTIENT_BITS)
        marks = np.zeros(len(counts) + (1 << BLOCK_QUOTIENT_BITS), np.uint8)
        marks[np.arange(len(counts)) + quotient] = 1
        low = (keys[0] & np.uint64((1 << (64 - bits)) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)
        rest = [k.astype("<u8").tobytes() for k in keys[1:]]
        large = counts[counts >= 255]
        counters = np.minimum(counts, 255).astype(np.uint8).tobytes() + large.astype("<u8").tobytes()
        width = -(-(64 - bits) // 8)
        return CountingFilter(len(counts), np.packbits(marks).tobytes(), low[:, :width].tobytes() + b"".join(rest), counters)

    def entries(self, words: int, block: int, block_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The permuted n-grams, in order, and their counts."""
        bits = block_bits + BLOCK_QUOTIENT_BITS
        marks = np.unpackbits(np.frombuffer(self.marks, np.uint8), count=self.size + (1 << BLOCK_QUOTIENT_BITS))
        quotient = np.flatnonzero(marks) - np.arange(self.size) + (block << BLOCK_QUOTIENT_BITS)
        width = -(-(64 - bits) // 8)
        low = np.zeros((self.size, 8), np.uint8)
        low[:, :width] = np.frombuffer(self.remainders, np.uint8, self.size * width).reshape(-1, width)
        first = quotient.astype(np.uint64) << np.uint64(64 - bits) | low.view("<u8").ravel()
        rest = np.frombuffer(self.remainders, "<u8", self.size * (words - 1), self.size * width).reshape(words - 1, -1)
        counts = np.frombuffer(self.counters, np.uint8, self.size).astype(np.int64)
        large = counts == 255
        counts[large] = np.frombuffer(self.counters, "<u8", int(large.sum()), self.size).astype(np.int64)
        return [first, *rest], counts


def block_bits_for(words: int) -> int:
    return min(max(4, math.ceil(math.log2(max(words, 1) / BLOCK_WORDS))), 64 - BLOCK_QUOTIENT_BITS - 8)


# -- words


def _count_words(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                counts.pop(_BREAK, None)
                ids = WordIds(lang, seed)
                every = list(counts)
                for at in range(0, len(every), 50_000):
                    found = every[at:at + 50_000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.array([ids[w] for w in found], np.uint64).view(np.int64)),
                        pa.array([lang] * len(found), pa.string()),
                        pa.array([w.decode("utf-8", "surrogatepass") for w in found], pa.string()),
                        pa.array([counts[w] for w in found], pa.int64()),
                    ], ["id", "lang", "word", "n"])
            held.clear()

        for batch in batches:
            for part, texts in slices(batch):
                for lang, text in zip(part.column(0).to_pylist(), texts):
                    held.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, held.values())) > COUNTED:
                    yield from given()
        yield from given()

    return run


def word_table(texts: DataFrame, seeds: Iterable[int] = range(8)) -> tuple[DataFrame, int]:
    """All words with exact counts, ``id, lang, word, n``, and the seed under which every id stands for one word."""
    for seed in seeds:
        counted = materialize(
            texts.mapInArrow(_count_words(seed), "id long, lang string, word string, n long")
            .groupBy("id", "lang", "word").agg(F.sum("n").alias("n")), "words")
        if counted.groupBy("id").count().where("count > 1").limit(1).count() == 0:
            return counted, seed
    raise ValueError("no seed gives every word an id of its own")


# -- n-grams


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bit table of the n-grams that a task has read, in pieces of 64 bits."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    for batch in batches:
        column = batch.column(0)
        if len(column):
            grams = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(column), -1)
            bits[slot(list(grams.T))] = True
    pieces = np.packbits(bits).view(np.int64)
    used = np.flatnonzero(pieces)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(pieces[used])], ["at", "piece"])


def bit_table(grams: DataFrame) -> np.ndarray | None:
    """One bit per slot of a frequent n-gram; its size does not depend on the data. None if there is none."""
    pieces = (
        grams.select("gram").mapInArrow(_bits, "at long, piece long")
        .groupBy("at").agg(F.bit_or("piece").alias("piece")).toArrow()
    )
    if not pieces.num_rows:
        return None
    bits = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    bits[pieces.column("at").to_numpy()] = pieces.column("piece").to_numpy()
    return bits.view(np.uint8)


def grams_in(ids: np.ndarray, words: int, frequent: np.ndarray) -> list[np.ndarray]:
    """N-grams whose parts without an end word may all be frequent, by the table of those parts."""
    n = len(ids) - words + 2
    if n < 2:
        return [np.zeros(0, np.uint64)] * words
    part = [ids[i:i + n] for i in range(words - 1)]
    place = slot(part)
    able = (frequent[place >> 3] >> (7 - (place & 7)) & 1).astype(bool)
    for column in part:
        able &= column != 0
    at = np.flatnonzero(able[:-1] & able[1:])
    return [ids[at + i] for i in range(words)]


FILTER_TYPE = "block int, size int, marks binary, remainders binary, counters binary"


def _count(words: int, seed: int, packed: bytes, block_bits: int):
    """Filters of the n-grams of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.frombuffer(zlib.decompress(packed), np.uint8)
        lookups: dict[str, WordIds] = {}
        keys, counts = [np.zeros(0, np.uint64)] * words, np.zeros(0, np.int64)
        fresh: list[list[np.ndarray]] = []

        def fold() -> None:
            nonlocal keys, counts
            if fresh:
                new, ones = summed(
                    permuted([np.concatenate(c) for c in zip(*fresh)]), np.ones(sum(len(g[0]) for g in fresh), np.int64))
                keys, counts = summed([np.concatenate(c) for c in zip(keys, new)], np.concatenate([counts, ones]))
                fresh.clear()

        def given() -> Iterator[pa.RecordBatch]:
            nonlocal keys, counts
            block = (keys[0] >> np.uint64(64 - block_bits)).astype(np.int64)
            edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(block) else [0]
            rows = []
            for a, b in zip(edges[:-1], edges[1:]):
                made = CountingFilter.of([k[a:b] for k in keys], counts[a:b], int(block[a]), block_bits)
                rows.append((int(block[a]), made.size, made.marks, made.remainders, made.counters))
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([
                    pa.array(c, t) for c, t in zip(zip(*rows[at:at + 64]), [pa.int32(), pa.int32(), *[pa.binary()] * 3])
                ], ["block", "size", "marks", "remainders", "counters"])
            keys, counts = [np.zeros(0, np.uint64)] * words, np.zeros(0, np.int64)

        for batch in batches:
            for part, texts in slices(batch):
                if sum(map(len, lookups.values())) > 2 * REMEMBERED:
                    lookups.clear()
                ids = []
                for lang, text in zip(part.column(0).to_pylist(), texts):
                    if lang not in lookups:
                        lookups[lang] = WordIds(lang, seed)
                    found = words_of(text)
                    ids.append(np.fromiter(map(lookups[lang].__getitem__, found), np.uint64, len(found)))
                    ids.append(np.zeros(1, np.uint64))
                fresh.append(grams_in(np.concatenate(ids), words, frequent))
                if sum(len(g[0]) for g in fresh) > FRESH:
                    fold()
                if len(counts) > HELD:
                    yield from given()
        fold()
        yield from given()

    return run


def _merge(words: int, block_bits: int, least: int):
    """One filter from all of a block, and its n-grams that occur often enough."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        parts = [
            CountingFilter(*row).entries(words, block, block_bits)
            for row in zip(*(table.column(c).to_pylist() for c in ("size", "marks", "remainders", "counters")))
        ]
        keys, counts = summed(
            [np.concatenate(c) for c in zip(*(k for k, _ in parts))], np.concatenate([c for _, c in parts]))
        often = counts >= least
        grams = np.column_stack(permuted([k[often] for k in keys])).view(np.int64)
        offsets = pa.array(np.arange(0, grams.size + 1, words, dtype=np.int32))
        return pa.table({
            "gram": pa.ListArray.from_arrays(offsets, pa.array(grams.ravel())), "n": pa.array(counts[often]),
        })

    return run


def frequent_grams(texts: DataFrame, words: int, frequent: np.ndarray, seed: int, block_bits: int, least: int) -> DataFrame:
    """N-grams of so many words that occur at least ``least`` times: ``gram array<long>, n``."""
    filters = texts.mapInArrow(_count(words, seed, zlib.compress(frequent.tobytes(), 1), block_bits), FILTER_TYPE)
    merged = filters.groupBy("block").applyInArrow(_merge(words, block_bits, least), "gram array<long>, n long")
    return materialize(merged, f"grams-{words}")


# -- scores


def _salt(gram: str) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SALTS))


def _looked_up(rows: DataFrame, key: str, counts: DataFrame, name: str) -> DataFrame:
    """Add the count of the n-gram in ``key``; a common one is spread over ``SALTS`` keys."""
    spread = counts.select(
        F.col("gram").alias(key), F.col("n").alias(name), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    ).withColumn("_salt", F.col("_salt").cast("long"))
    return rows.withColumn("_salt", _salt("gram")).join(spread, [key, "_salt"]).drop("_salt")


def _weakest_cut(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("gram") - 1))).select(
        "gram", "n", "k", F.slice("gram", F.lit(1), F.col("k")).alias("head"),
        F.slice("gram", F.col("k") + 1, F.size("gram") - F.col("k")).alias("tail"),
    )
    both = _looked_up(_looked_up(cuts, "head", counts, "l"), "tail", counts, "r")
    # Decimals: a product of counts may pass 64 bits.
    score = F.expr("CAST(2000000 * CAST(n AS DECIMAL(20, 0)) AS DECIMAL(28, 0)) div (CAST(l AS DECIMAL(20, 0)) + r)")
    worst = F.min(F.struct(score.cast("long").alias("score"), F.col("k"), F.col("l"), F.col("r"))).alias("worst")
    return both.groupBy("gram", "n").agg(worst).select("gram", "n", "worst.score", "worst.l", "worst.r")


def _on_their_own(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates that no longer one holds most occurrences of."""
    inside = candidates.where(F.size("gram") > 2).select(
        "n", F.explode(F.flatten(F.transform(
            F.sequence(F.lit(2), F.size("gram") - 1),
            lambda size: F.transform(F.sequence(F.lit(1), F.size("gram") - size + 1), lambda at: F.slice("gram", at, size)),
        ))).alias("gram"),
    ).groupBy("gram").agg(F.max("n").alias("longer"))
    held = F.expr(f"100 * CAST(longer AS DECIMAL(20, 0)) >= {int(percent)} * CAST(n AS DECIMAL(20, 0))")
    return candidates.join(inside, "gram", "left").where(F.col("longer").isNull() | ~held).select("gram", "n")


def _spelled(scored: DataFrame, words: DataFrame) -> DataFrame:
    parts = scored.select("gram", F.posexplode("gram").alias("at", "id"))
    counts = words.select(F.array("id").alias("gram"), F.struct("lang", "word").alias("n"))
    named = _looked_up(parts.withColumn("one", F.array("id")), "one", counts, "word")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word.word"))), lambda w: w["word"]), " ")
    spelled = named.groupBy("gram").agg(F.first("word.lang").alias("lang"), phrase.alias("phrase"))
    return scored.join(spelled, "gram")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = MIN_COUNT,
                 longest: int = MAX_WORDS, percent: int = CONTAINED_PERCENT, top: int = TOP) -> DataFrame:
    """The first phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` is the phrase's count, ``l`` and ``r`` those of its parts at the cut that scores lowest, ``n`` all words of the
    language, and ``score`` the whole part of ``2000000 * a / (l + r)``.
    """
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    words, seed = word_table(texts)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    block_bits = block_bits_for(words.agg(F.sum("n")).first()[0] or 0)
    common = words.where(F.col("n") >= least)
    levels = [common.select(F.array("id").alias("gram"), "n")]
    for size in range(2, longest + 1):
        frequent = bit_table(levels[-1])
        if frequent is None:
            break
        levels.append(frequent_grams(texts, size, frequent, seed, block_bits, least))
    empty = levels[0].limit(0)
    candidates = empty
    for level in levels[1:]:
        candidates = candidates.unionByName(level)
    scored = _weakest_cut(_on_their_own(candidates, percent), candidates.unionByName(levels[0]))
    spelled = _spelled(scored, common)
    order = [F.col("score").desc(), F.col("n").desc(), F.col("phrase")]
    # The first ones of parts of a language hold the first ones of all of it.
    part = Window.partitionBy("lang", "_part").orderBy(*order)
    few = (
        spelled.withColumn("_part", F.pmod(F.xxhash64("gram"), F.lit(64))).withColumn("rank", F.row_number().over(part))
        .where(F.col("rank") <= top)
    )
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", "rank", "phrase", F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "score")
