"""Language-model scores from a probabilistic suffix tree over words, beside add-one unigram scores.

Tokens are the words of a text (A-Z in lower case) and one end. A context is the last one to ``DEPTH`` tokens.
The root predicts a token by its add-one unigram probability; every retained context has its own next-token
distribution. Counts are taken over the whole training corpus, level by level: a context of length
d + 1 and its successor can only be frequent if the shorter runs inside them are.

Kept are the runs of tokens that were seen ``MIN_COUNT`` times or more, whatever their share, so the tree grows with
the corpus; words and levels are tables. A context is retained if its next-token distribution diverges from its
suffix's: the log-likelihood that it gains on its occurrences (their number times the Kullback-Leibler divergence) has
to exceed ``log(n) / 2`` nats for each successor it stores. Smoothing: a stored successor's count is discounted by
``DISCOUNT``, and what this and the successors not stored leave is spread as the suffix's distribution. Scoring uses
the longest retained suffix of what precedes a token.

The probability of a token is its unigram probability times a factor that the tree alone decides. The factor's logarithm
is a sum: each context of a token adds ``rest``, what it leaves to its suffix, and each stored run that ends with
the token adds ``gain``, what the run has above that. So a text's score is its base plus one value for each run that it holds.

Texts are made into tokens once, in blocks of about ``BLOCK_TOKENS`` tokens, which are kept as numbers. All later steps are
numpy on whole arrays: a row that Spark deals out holds the arrays of one bucket of hashes, or of one block. Blocks send their
different runs to the buckets, which count them; runs meet their suffixes and their contexts in the buckets of these. In
scoring, blocks ask the buckets for the values of their runs, and the answers are sums by document. Tables of fixed size
spare most rows the way: the runs and words above ``SHARE`` (at most ``KNOWN_RUNS``) are known to all tasks, and a bit
table drops runs that have no value. Neither changes a score.

Words and runs are named by 64-bit hashes; a run is counted under those of its two shorter runs, 128 bits together.

Defined cases: null and empty texts are one end token. Without training rows all counts are zero and
both scores are those of the root. Repeated rows are scored each. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from pagewatch.llm.common import CACHE_WORDS, mix, parts
from pagewatch.session import discard, materialize

DEPTH = 4
DISCOUNT = 0.5
#: Runs seen more rarely are not kept.
MIN_COUNT = 3
#: Words and runs with so large a share of all tokens are known to all tasks, if they are not more than ``KNOWN_RUNS``; the
#: others are asked for. Only speed depends on it and on the bits of the table of runs that are worth a question.
SHARE = 2e-7
KNOWN_RUNS = 1 << 20
FILTER_BITS = 26
#: Tokens of a block, and tokens for each bucket: they bound a worker's memory. A bucket sends a row to each other one, so
#: their number follows the tokens only.
BLOCK_TOKENS = 1 << 19
BUCKET_TOKENS = 1 << 19
BUCKET_BITS = (6, 13)
#: Texts are scored in up to so many rounds, one for each ``ROUND_BLOCKS`` blocks, as questions take room on disk. So many
#: neighbouring buckets answer together, which makes fewer sums.
ROUNDS, ROUND_BLOCKS = 4, 64
TOGETHER = 4

#: The end token is the empty word, which no text holds.
END = b""


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, then the end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, without ends, and the number of each text's tokens with its end."""
    found = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts.fill_null("")))
    words, ends = found.flatten(), found.offsets.to_numpy()
    # White space at an end of a text leaves an empty word.
    full = pa.compute.binary_length(words).to_numpy() > 0
    lengths = np.diff(np.append(0, np.cumsum(full))[ends - ends[0]]) + 1
    return words.filter(pa.array(full)), lengths


def _run_hash(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Hash of a run, from those of the run without its last token and without its first."""
    return mix(context * np.uint64(0x9E3779B97F4A7C15) + suffix)


def _longer(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the runs one token longer that end at each place; one that would begin before its text has no meaning."""
    return _run_hash(np.roll(hashes, 1), hashes)


def _places(lengths: np.ndarray) -> np.ndarray:
    """Place of each token in its text."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


# -- rows that hold arrays

#: What the rows of a bucket or block are.
RUNS, ASKING, CONTEXTS, WORDS, ASK_RUNS, ASK_WORDS, GOT_RUNS, GOT_WORDS, TEXTS = range(9)
#: ``a`` and ``b`` are hashes, ``n`` counts or numbers of texts, the others floats.
TYPES = {"a": np.uint64, "b": np.uint64, "n": np.int64, "x": np.float64, "y": np.float64, "z": np.float64}
FRAME = "block long, bucket int, kind int, a binary, b binary, n binary, x binary, y binary, z binary"
NAMES = ["block", "bucket", "kind", *TYPES]


def _starts(values: np.ndarray) -> np.ndarray:
    """Where a new value begins among sorted ones."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])


def _about_sorted(values: np.ndarray) -> np.ndarray:
    """Places of some values in their order, as far as their first bits tell it: with the place in the last bits of each, values
    are sorted in a fraction of the time that it takes to sort places."""
    width = np.uint64(len(values).bit_length())
    found = np.sort(values >> width << width | np.arange(len(values), dtype=np.uint64))
    return (found & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)


def _firsts(values: np.ndarray) -> np.ndarray:
    """For each of some sorted values the place of the first that equals it."""
    starts = _starts(values)
    return np.repeat(starts, np.diff(np.append(starts, len(values))))


def _pieces(kind: int, starts: np.ndarray, block, bucket, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each piece of some arrays that are cut at ``starts``."""
    rows, out = len(starts), []
    for name, dtype in TYPES.items():
        if name not in columns:
            out.append(pa.nulls(rows, pa.binary()))
            continue
        values = np.ascontiguousarray(columns[name], dtype)
        ends = (np.append(starts, len(values)) * 8).astype(np.int32)
        out.append(pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends), pa.py_buffer(values)]))
    whole = lambda x, t: pa.array(np.broadcast_to(np.asarray(x, t), rows).copy())
    return pa.RecordBatch.from_arrays([whole(block, np.int64), whole(bucket, np.int32), whole(kind, np.int32), *out], NAMES)


def _dealt(kind: int, bits: int, by: np.ndarray, block: int = 0, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket of some sorted hashes, with its part of the arrays."""
    bucket = (by >> np.uint64(64 - bits)).astype(np.int32)
    starts = _starts(bucket)
    return _pieces(kind, starts, block, bucket[starts], **columns)


def _blob(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The bytes of all rows of a binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def _of(table: pa.Table | pa.RecordBatch, kind: int, names: str) -> list[np.ndarray]:
    """Some arrays of all rows of a kind, each put together."""
    rows = table.filter(pa.compute.equal(table.column("kind"), kind))
    return [_blob(rows.column(name)).view(TYPES[name]) for name in names]


def _only(df: DataFrame, names: str) -> DataFrame:
    """Rows with some of the arrays."""
    return df.withColumns({n: F.lit(None).cast("binary") for n in TYPES if n not in names})


def _by_bucket(df: DataFrame, run, key: str = "bucket", schema: str = FRAME) -> DataFrame:
    return df.groupBy(key).applyInArrow(run, schema)


# -- tables of fixed size that all tasks know


def _filter_slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word of the bit table for each hash, and its two bits."""
    one = np.uint64(1)
    bits = (one << (keys & np.uint64(63))) | (one << ((keys >> np.uint64(6)) & np.uint64(63)))
    return (keys >> np.uint64(64 - FILTER_BITS + 6)).astype(np.int64), bits


def _bit_table(rows: DataFrame, bits: int) -> np.ndarray:
    """A table of ``2 ** FILTER_BITS`` bits with those of the hashes in ``a`` set."""
    width = 1 << (FILTER_BITS - 6 - bits)

    def run(table: pa.Table) -> pa.Table:
        at, piece = _filter_slots(np.sort(_blob(table.column("a")).view(np.uint64)))
        starts, words = _starts(at), np.zeros(width, np.uint64)
        words[at[starts] % width] = np.bitwise_or.reduceat(piece, starts)
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "words": pa.array([words.tobytes()], pa.binary())})

    out = np.zeros((1 << bits, width), np.uint64)
    found = _by_bucket(rows.select("bucket", "a"), run, schema="bucket int, words binary").toArrow()
    for bucket, words in zip(found.column("bucket").to_pylist(), found.column("words")):
        out[bucket] = np.frombuffer(words.as_buffer(), np.uint64)
    return out.reshape(-1)


def _may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at, bits = _filter_slots(keys)
    return table[at] & bits == bits


class Lookup:
    """Values of some hashes. Hashes lie in order, each at or after the slot that its first bits name."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = max(4, int(1.25 * len(keys)).bit_length())

    def __len__(self) -> int:
        return len(self.keys)

    def spread(self) -> Lookup:
        """With the table laid out, which need not travel."""
        slots, n = (self.keys >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(self.keys))
        at = np.maximum.accumulate(slots - n) + n if len(n) else n
        size = max(1 << self.bits, int(at[-1]) + 1 if len(n) else 0) + 1
        self.table, self.out = np.full(size, ~np.uint64(0)), np.zeros(size)
        self.table[at], self.out[at] = self.keys, self.values
        return self

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is there, and its value or 0."""
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.flatnonzero(self.table[at] < keys)
        while len(todo):
            at[todo] += 1
            todo = todo[self.table[at[todo]] < keys[todo]]
        hit = self.table[at] == keys
        return hit, np.where(hit, self.out[at], 0.0)


def _known(rows: DataFrame, least: float, values: str) -> Lookup:
    """Hashes that were seen ``least`` times or more, but at most ``KNOWN_RUNS`` of the most frequent, and the sums of some
    columns for them."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, n = np.unique((4 * np.log2(_blob(batch.column(0)).view(np.int64))).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bits), pa.array(n)], ["bits", "n"])

    count = 0
    for bits, n in sorted(rows.select("n").mapInArrow(sizes, "bits long, n long").groupBy("bits").sum("n").collect(), reverse=True):
        count += n
        if count > KNOWN_RUNS:
            least = max(least, 2 ** ((bits + 1) / 4))
            break

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n, *parts = (_blob(batch.column(c)).view(TYPES[c]) for c in batch.schema.names)
            at = n >= least
            both = [keys[at].tobytes(), np.asarray(sum(parts), np.float64)[at].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in both], ["a", "x"])

    found = rows.select("a", "n", *values).mapInArrow(chosen, "a binary, x binary").toArrow()
    return Lookup(_blob(found.column("a")).view(np.uint64), _blob(found.column("x")).view(np.float64))


# -- blocks


def code_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | bool = True) -> DataFrame:
    """Blocks of texts: ids, numbers of tokens and whether they are trained on; the different words of the block, their hashes
    and counts in training, and the number of each token's word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, size = TaskContext.get().partitionId() << 32, 0
        ids, trained, lengths, flat = [], [], [], []

        def block() -> pa.RecordBatch:
            found = pa.chunked_array(flat).combine_chunks().dictionary_encode()
            different = found.dictionary.cast(pa.binary())
            length, train = np.concatenate(lengths), np.concatenate(trained)
            # The end has number 0, the words have the next ones in the order of their first places.
            code = np.zeros(length.sum(), np.uint32)
            inner = np.ones(len(code), bool)
            inner[np.cumsum(length) - 1] = False
            code[inner] = found.indices.to_numpy().astype(np.uint32) + 1
            words = [END, *different.to_pylist()]
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            own = np.repeat(train, length)
            # Frequent words have small numbers, so the upper halves lie apart and hardly take room.
            halves = code.view(np.uint16).reshape(-1, 2).T
            arrays = (
                length, train, _blob(different), np.array([len(w) for w in words], np.int32), hashes,
                np.bincount(code[own], minlength=len(words)), halves,
            )
            texts = pa.chunked_array(ids).combine_chunks()
            rows = [
                pa.array([serial]), pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts),
                *[pa.array([x.tobytes()], pa.binary()) for x in arrays], pa.array([int(own.sum())], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(
                rows, ["block", "ids", "lengths", "train", "words", "sizes", "keys", "seen", "codes", "tokens"])

        for batch in batches:
            for part in parts(batch):
                words, length = _split(part.column(1))
                ids.append(part.column(0))
                trained.append(part.column(2).to_numpy(zero_copy_only=False).astype(bool))
                lengths.append(length)
                flat.append(words)
                size += length.sum()
                if size >= BLOCK_TOKENS:
                    yield block()
                    serial, size = serial + 1, 0
                    for kept in (ids, trained, lengths, flat):
                        kept.clear()
        if lengths:
            yield block()

    train = F.lit(train) if isinstance(train, bool) else F.coalesce(train, F.lit(False))
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    coded = docs.select(F.col(id_col), F.col(text_col), train.alias("train")).mapInArrow(
        run, f"block long, ids array<{kind}>, lengths binary, train binary, words binary, sizes binary, keys binary, seen binary, codes binary, "
        "tokens long")
    # Blocks of a few large row groups are dealt out, so that all cores have some in every step.
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return coded if docs.rdd.getNumPartitions() >= cores else coded.repartition(4 * cores)


def _codes(blob: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(blob.view(np.uint16).reshape(2, -1).T).view(np.uint32).reshape(-1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The blocks of some batches, with their arrays."""
    types = {"lengths": np.int64, "train": bool, "keys": np.uint64, "codes": np.uint8}
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            out = {name: _blob(row.column(name)).view(t) for name, t in types.items() if name in row.schema.names}
            yield out | {"codes": _codes(out["codes"]), "block": row.column("block")[0].as_py(), "row": row}


def _word_counts(coded: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        for batch in batches:
            for words, sizes, seen in zip(*batch.columns):
                ends = np.append(0, np.cumsum(np.frombuffer(sizes.as_buffer(), np.int32))).astype(np.int32)
                rows = [pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), words.as_buffer()]),
                        pa.array(np.frombuffer(seen.as_buffer(), np.int64))]
                rows = pa.table(rows, ["word", "n"])
                both = pa.concat_tables([found, rows.filter(pa.compute.greater(rows.column("n"), 0))])
                found = both.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
                if len(found) > CACHE_WORDS:
                    yield from found.to_batches()
                    found = found.slice(0, 0)
        yield from found.to_batches()

    counted = coded.select("words", "sizes", "seen").mapInArrow(run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word binary, n)`` over all rows; every text adds one end, which is the empty word."""
    return _word_counts(code_texts(docs, text_col, text_col))


def _bucket_bits(coded: DataFrame) -> int:
    total = coded.agg(F.sum("tokens")).first()[0] or 0
    least, most = BUCKET_BITS
    return min(most, max(least, (total // BUCKET_TOKENS).bit_length()))


# -- levels


def _hashed(counts: DataFrame, bits: int) -> DataFrame:
    """Word counts as ``RUNS`` of one token, by the buckets of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.fromiter(map(xxhash.xxh64_intdigest, batch.column(0).to_pylist()), np.uint64, batch.num_rows)
            by = np.argsort(keys)
            yield _dealt(RUNS, bits, keys[by], a=keys[by], n=batch.column(1).to_numpy()[by])

    return counts.select("word", "n").mapInArrow(run, FRAME)


def _block_words(coded: DataFrame, bits: int) -> DataFrame:
    """The words of each block with their counts in training, by the buckets of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, seen in zip(*batch.columns):
                keys, n = np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(seen.as_buffer(), np.int64)
                by = np.argsort(keys)
                by = by[n[by] > 0]
                yield _dealt(RUNS, bits, keys[by], a=keys[by], n=n[by])

    return coded.select("keys", "seen").mapInArrow(run, FRAME)


def _merged_words(words: DataFrame) -> DataFrame:
    """One entry for each word, by the buckets of their hashes."""

    def run(table: pa.Table) -> pa.Table:
        keys, n = _of(table, RUNS, "an")
        by = np.argsort(keys)
        starts = _starts(keys[by])
        keys, n = keys[by][starts], np.add.reduceat(n[by], starts)
        return pa.Table.from_batches([_pieces(RUNS, np.zeros(1, int), 0, table.column("bucket")[0].as_py(), a=keys, n=n)])

    return _by_bucket(words, run)


def _word_runs(words: DataFrame, norm: int) -> DataFrame:
    """The words that are kept, as ``RUNS`` of one token with their unigram probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                keys, n = _of(batch.slice(at, 1), RUNS, "an")
                kept = n >= MIN_COUNT
                if kept.any():
                    yield _pieces(RUNS, np.zeros(1, int), 0, batch.column("bucket")[at].as_py(), a=keys[kept], n=n[kept],
                                  x=(n[kept] + 1) / norm, y=np.zeros(kept.sum()))

    return words.mapInArrow(run, FRAME)


def _word_sums(words: DataFrame) -> tuple[int, int]:
    """Tokens, and distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = _blob(batch.column(0)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([n.sum()]), pa.array([len(n)])], ["n", "v"])

    sums = words.select("n").mapInArrow(run, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return sums[0] or 0, sums[1] or 0


def _count_runs(length: int, table: np.ndarray, bits: int):
    """Counts of the runs of a length in a block, where both runs inside that are one token shorter may be kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            runs = block["keys"][block["codes"]]
            for _ in range(2, length):
                runs = _longer(runs)
            lengths = block["lengths"]
            kept = _may_hold(table, runs) & np.repeat(block["train"], lengths)
            at = np.flatnonzero((_places(lengths) >= length - 1) & kept & np.roll(kept, 1))
            context, suffix = runs[at - 1], runs[at]
            name = _run_hash(context, suffix)
            # Where cutting off bits parts equal names, a run has more than one row, which its bucket adds up.
            by = _about_sorted(name)
            starts = _starts(name[by])
            first, n = by[starts], np.diff(np.append(starts, len(by)))
            # Equal contexts side by side take less room.
            to, shift = name[first] >> np.uint64(64 - bits), np.uint64(bits)
            by = _about_sorted(to << np.uint64(64 - bits) | context[first] >> shift)
            first, n = first[by], n[by]
            yield _dealt(ASKING, bits, name[first], a=context[first], b=suffix[first], n=n)

    return run


def _frequent(bits: int):
    """Kept runs, dealt to the buckets of their suffixes."""

    def run(table: pa.Table) -> pa.Table:
        context, suffix, n = _of(table, ASKING, "abn")
        name = _run_hash(context, suffix)
        by = np.argsort(name)
        starts = _starts(name[by])
        n = np.add.reduceat(n[by], starts)
        at = by[starts[n >= MIN_COUNT]]
        context, suffix, n = context[at], suffix[at], n[n >= MIN_COUNT]
        by = np.argsort(suffix)
        return pa.Table.from_batches([_dealt(ASKING, bits, suffix[by], a=suffix[by], b=context[by], n=n[by])])

    return run


def _with_suffixes(bits: int):
    """What the tree makes of the runs' last tokens without their first, dealt to the buckets of their contexts."""

    def run(table: pa.Table) -> pa.Table:
        keys, unigram, factor = _of(table, RUNS, "axy")
        suffix, context, n = _of(table, ASKING, "abn")
        order = np.argsort(keys)
        # Kept runs consist of kept runs, so every suffix is found.
        found = order[np.searchsorted(keys, suffix, sorter=order)] if len(suffix) else np.zeros(0, int)
        by = np.argsort(context)
        found = found[by]
        return pa.Table.from_batches([_dealt(
            ASKING, bits, context[by], a=context[by], b=suffix[by], n=n[by], x=unigram[found], y=factor[found])])

    return run


def _level(bits: int):
    """Divergence test and smoothing of the contexts of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        keys, totals = _of(table, RUNS, "an")
        context, suffix, n, unigram, below = _of(table, ASKING, "abnxy")
        if not len(context):
            return pa.Table.from_batches([_dealt(RUNS, bits, context)])
        by = np.argsort(context)
        context, suffix, n, unigram, below = (x[by] for x in (context, suffix, n, unigram, below))
        order, starts = np.argsort(keys), _starts(context)
        total = totals[order[np.searchsorted(keys, context[starts], sorter=order)]]
        stored = np.diff(np.append(starts, len(context)))
        other = total - np.add.reduceat(n, starts)
        left = (other + DISCOUNT * stored) / total
        rest = np.log(left)
        each = lambda x: np.repeat(x, stored)
        made = np.log((n - DISCOUNT) / each(total) / unigram + each(left) * np.exp(below))
        gained = np.add.reduceat(n * (made - below), starts) + other * rest
        retained = gained > 0.5 * np.log(total) * stored
        own, key = each(retained), _run_hash(context, suffix)
        by = np.argsort(key)
        factor, gain = np.where(own, made, below), np.where(own, made - each(rest) - below, np.nan)
        at = starts[retained]
        return pa.Table.from_batches([
            _dealt(RUNS, bits, key[by], a=key[by], n=n[by], x=unigram[by], y=factor[by], z=gain[by]),
            _dealt(CONTEXTS, bits, context[at], a=context[at], n=total[retained], z=rest[retained]),
        ])

    return run


@contextmanager
def _shuffles_dropped(df: DataFrame) -> Iterator[None]:
    """Spark removes the files of a shuffle as its execution ends; else they stay until the driver collects garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        yield
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


@dataclass(frozen=True)
class Level:
    """The kept runs of one length: ``RUNS`` with key, count, unigram probability and ``log_factor`` of the last token, what
    the tree up to this length makes of it as a multiple of the former, and ``gain``, NaN if the context is not retained;
    ``CONTEXTS`` with key, count and ``rest`` of the retained ones."""

    rows: DataFrame

    @property
    def runs(self) -> DataFrame:
        return self.rows.where(F.col("kind") == RUNS)

    @property
    def gain(self) -> np.ndarray:
        """All gains of the level, for small trees."""
        gains = _blob(self.runs.select("z").toArrow().column(0)).view(np.float64)
        return gains[~np.isnan(gains)]


def build_level(coded: DataFrame, length: int, shorter: DataFrame, bits: int) -> Level:
    """The runs of a length, from the blocks and the runs one token shorter."""
    table = _bit_table(shorter, bits)
    asked = coded.select("block", "lengths", "train", "keys", "codes").mapInArrow(_count_runs(length, table, bits), FRAME)
    counted = _by_bucket(asked, _frequent(bits))
    tested = _by_bucket(counted.unionByName(_only(shorter, "axy")), _with_suffixes(bits))
    return Level(materialize(_by_bucket(tested.unionByName(_only(shorter, "an")), _level(bits)), "level"))


def _summed(bits: int):
    """``n``, ``rest`` and ``gain`` of all runs of a bucket that change a score."""

    def run(table: pa.Table) -> pa.Table:
        keys, n, gain = _of(table, RUNS, "anz")
        contexts, total, rest = _of(table, CONTEXTS, "anz")
        own = ~np.isnan(gain)
        keys, n = np.append(keys[own], contexts), np.append(n[own], total)
        rest = np.append(np.zeros(own.sum()), rest)
        gain = np.append(gain[own], np.zeros(len(contexts)))
        by = np.argsort(keys)
        starts, keys = _starts(keys[by]), keys[by]
        if not len(keys):
            return pa.Table.from_batches([_dealt(RUNS, bits, keys)])
        add = lambda x: np.add.reduceat(x[by], starts)
        return pa.Table.from_batches([_dealt(
            RUNS, bits, keys[starts], a=keys[starts], n=np.maximum.reduceat(n[by], starts), x=add(rest), y=add(gain))])

    return run


@dataclass(frozen=True)
class SuffixTree:
    """The words by their hashes, the frequent ones of them for all tasks, the levels of the tree, and key, ``n``,
    ``rest`` and ``gain`` of all runs that change a score, as context or with their last token."""

    words: DataFrame
    head: Lookup
    levels: list[Level]
    values: DataFrame
    bits: int

    def factors(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the tokens of a few texts, and of each the factor by which its context changes its probability."""
        place = _places(np.array([len(ws) for ws in words]))
        runs = [np.array([xxhash.xxh64_intdigest(w) for ws in words for w in ws], np.uint64)]
        for _ in range(DEPTH):
            runs.append(_longer(runs[-1]))
        wanted = np.unique(np.concatenate(runs))

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = [_blob(batch.column(c)).view(TYPES[c]) for c in batch.schema.names]
                at = np.isin(parts[0], wanted)
                yield pa.RecordBatch.from_arrays([pa.array(p[at].view(np.int64) if i == 0 else p[at]) for i, p in enumerate(parts)], ["key", "rest", "gain"])

        rows = self.values.select("a", "x", "y").mapInArrow(chosen, "key long, rest double, gain double").collect()
        found = {r["key"]: r for r in rows}
        total = np.zeros(len(place))
        for length, keys in enumerate(runs, 1):
            for at, key in enumerate(keys.view(np.int64).tolist()):
                if key in found and place[at] >= length - 1:
                    total[at] += found[key]["gain"]
                    if at + 1 < len(place) and place[at + 1] > place[at] and length <= DEPTH:
                        total[at + 1] += found[key]["rest"]
        return runs[0], np.exp(total)


def _fit(coded: DataFrame, words: DataFrame, bits: int, depth: int, share: float) -> tuple[SuffixTree, int, int]:
    total, distinct = _word_sums(words)
    shorter = _word_runs(words, total + distinct + 1)
    head = _known(shorter, share * total, "x")
    levels: list[Level] = []
    for length in range(2, depth + 2):
        # The end is no context. Of a run that is not the end, every occurrence has a successor.
        levels.append(build_level(coded, length, shorter, bits))
        shorter = levels[-1].runs
        if shorter.isEmpty():
            break
    rows = levels[0].rows
    for level in levels[1:]:
        rows = rows.unionByName(level.rows)
    return SuffixTree(words, head, levels, materialize(_by_bucket(_only(rows, "anz"), _summed(bits)), "values"), bits), total, distinct


def fit_tree(train: DataFrame, counts: DataFrame, text_col: str = "text", depth: int = DEPTH,
             share: float = SHARE) -> tuple[SuffixTree, int, int]:
    """The tree of a training corpus whose word counts are given, its tokens and its distinct tokens."""
    coded = materialize(code_texts(train, text_col, text_col).drop("words", "sizes"), "blocks")
    bits = _bucket_bits(coded)
    return _fit(coded, materialize(_merged_words(_hashed(counts, bits)), "words"), bits, depth, share)


# -- scores


def _score_blocks(tree: SuffixTree, top: Lookup, table: np.ndarray, unseen: float):
    """The part of the texts' scores that all tasks know, as ``TEXTS``, and questions for the rest."""
    head, bits = tree.head, tree.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known_runs = head.spread(), top.spread()
        for block in _blocks(batches):
            codes, vocabulary, lengths = block["codes"], block["keys"], block["lengths"]
            texts = len(lengths)
            owner = np.repeat(np.arange(texts), lengths)
            is_known, unigram = words.find(vocabulary)
            log = np.where(is_known, np.log10(np.where(is_known, unigram, 1.0)), unseen)
            base, known = np.bincount(owner, log[codes], texts), np.bincount(owner, is_known[codes], texts).astype(np.int64)
            # Single words are looked up once for a block.
            held = _may_hold(table, vocabulary)
            hit, value = known_runs.find(vocabulary)
            more = np.bincount(owner, value[codes], texts)
            runs, place = vocabulary[codes], _places(lengths)
            at = np.flatnonzero((held & ~hit)[codes])
            asked, askers = [runs[at]], [owner[at]]
            for length in range(2, DEPTH + 2):
                runs = _longer(runs)
                at = np.flatnonzero((place >= length - 1) & _may_hold(table, runs))
                who, keys = owner[at], runs[at]
                hit, value = known_runs.find(keys)
                more += np.bincount(who, value, texts)
                asked.append(keys[~hit])
                askers.append(who[~hit])
            rare = np.flatnonzero(~is_known[codes])
            yield _pieces(
                TEXTS, np.zeros(1, int), block["block"], block["block"] % (1 << bits), n=lengths, x=base, y=more,
                b=known.view(np.uint64),
            ).append_column("ids", block["row"].column("ids"))
            for kind, keys, who in (
                (ASK_RUNS, np.concatenate(asked), np.concatenate(askers)), (ASK_WORDS, vocabulary[codes[rare]], owner[rare]),
            ):
                by = np.argsort(keys)
                rows = _dealt(kind, bits, keys[by], block["block"], a=keys[by], n=who[by])
                yield rows.append_column("ids", pa.nulls(rows.num_rows, block["row"].column("ids").type))

    return run


def _answers(bits: int):
    """Sums for each text that asked, of the values in a bucket; the texts' own rows pass."""

    def summed(asks: pa.Table, got: int, keys: np.ndarray, column: str, values: np.ndarray) -> pa.RecordBatch:
        asks = asks.sort_by("block")
        each = [len(x) // 8 for x in asks.column("a").to_pylist()]
        asked, text = (_blob(asks.column(c)).view(TYPES[c]) for c in "an")
        row = np.repeat(_firsts(asks.column("block").to_numpy()), each)
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        found = np.minimum(np.searchsorted(keys, asked), len(keys) - 1) if len(keys) else np.zeros(0, int)
        hit = np.flatnonzero(keys[found] == asked) if len(keys) else found
        both = (row[hit] << 40) | text[hit]
        by = np.argsort(both)
        starts = _starts(both[by])
        at = hit[by[starts]]
        sums = np.add.reduceat(values[found[hit[by]]], starts) if len(starts) else np.zeros(0)
        cuts, own = _starts(asks.column("block").to_numpy()[row[at]]), {column: sums}
        if got == GOT_WORDS:
            own["b"] = np.diff(np.append(starts, len(by))).astype(np.uint64)
        return _pieces(got, cuts, asks.column("block").to_numpy()[row[at[cuts]]], 0, n=text[at], **own)

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind")
        of = lambda kind: table.filter(pa.compute.equal(kinds, kind))
        keys, rest, gain = _of(table, RUNS, "axy")
        words, n = _of(table, WORDS, "an")
        rows = []
        if (asks := of(ASK_RUNS)).num_rows:
            rows.append(summed(asks, GOT_RUNS, keys, "y", (rest + gain) / np.log(10)))
        if (asks := of(ASK_WORDS)).num_rows:
            rows.append(summed(asks, GOT_WORDS, words, "x", np.log10(n + 1)))
        ids = table.schema.field("ids").type
        return pa.concat_tables([
            of(TEXTS), *[pa.Table.from_batches([r.append_column("ids", pa.nulls(r.num_rows, ids))]).select(table.column_names)
                         for r in rows]])

    return run


def _text_scores(id_col: str):
    """One row for each text of a block, with its own part and all answers."""

    def run(table: pa.Table) -> pa.Table:
        (length, base, more, known), (who, gained), (asker, added, times) = (
            _of(table, TEXTS, "nxyb"), _of(table, GOT_RUNS, "ny"), _of(table, GOT_WORDS, "nxb"))
        texts = len(length)
        base = base + np.bincount(asker, added, texts)
        more = more + np.bincount(who, gained, texts)
        known = known.view(np.int64) + np.bincount(asker, times.view(np.int64), texts).astype(np.int64)
        ids = table.filter(pa.compute.equal(table.column("kind"), TEXTS)).column("ids").combine_chunks().flatten()
        return pa.table([ids, pa.array(length), pa.array(known), pa.array(base), pa.array(base + more)],
                        [id_col, "n_tokens", "n_known", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, train: DataFrame | Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` of every row of ``docs``, learned from ``train``: other
    rows, or a condition for those of ``docs``, which then are made into tokens only once."""
    with _shuffles_dropped(docs):
        return _scored(docs, train, id_col, text_col)


def _scored(docs: DataFrame, train: DataFrame | Column, id_col: str, text_col: str) -> DataFrame:
    def blocks(texts: DataFrame, key: str, trained: Column | bool) -> DataFrame:
        return materialize(code_texts(texts, key, text_col, trained).drop("words", "sizes"), "blocks", compression="zstd")

    if isinstance(train, Column):
        coded = learned = blocks(docs, id_col, train)
    else:
        coded, learned = blocks(docs, id_col, False), blocks(train, text_col, True)
    bits = _bucket_bits(learned)
    words = materialize(_merged_words(_block_words(learned, bits)), "words")
    tree, n_train, distinct = _fit(learned, words, bits, DEPTH, SHARE)
    top = _known(tree.values, SHARE * n_train, "xy")
    top.values = top.values / np.log(10)
    unseen = float(-np.log10(n_train + distinct + 1))
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    frame = f"{FRAME}, ids array<{kind}>"
    table, bits = _bit_table(tree.values, tree.bits), tree.bits
    for level in tree.levels:
        discard(level.rows)
    # Words are asked for by their counts, whether they are kept or not.
    words = _only(tree.words, "an").withColumn("kind", F.lit(WORDS))
    known = _only(tree.values, "axy").unionByName(words)
    rounds = min(ROUNDS, 1 + coded.count() // ROUND_BLOCKS)
    scored = None
    for turn in range(rounds):
        asked = coded.where(F.col("block") % rounds == turn).select("block", "ids", "lengths", "keys", "codes").mapInArrow(
            _score_blocks(tree, top, table, unseen), frame)
        told = asked.unionByName(known, allowMissingColumns=True).withColumn("bucket", F.expr(f"bucket div {TOGETHER}").cast("int"))
        some = materialize(_by_bucket(
            _by_bucket(told, _answers(bits), schema=frame), _text_scores(id_col), "block",
            f"`{id_col}` {kind}, n_tokens long, n_known long, base_score double, score double"), "scores")
        scored = some if scored is None else scored.unionByName(some)
    return scored.select(
        id_col, "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
