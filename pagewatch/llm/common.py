"""Small helpers that the operators of this subpackage share.

Every operator reads an id and a text column by name and ignores all other columns, so extra
columns cannot clash with its own. A null text counts as an empty one.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Texts are handled in slices of about so many characters, which bounds a worker's memory.
SLICE_CHARS = 2_000_000
#: Words that a Python worker remembers. Later ones are computed anew each time: only speed depends on it.
CACHE_WORDS = 500_000


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_bucket(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``. A null id counts as the empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % parts


def texts_of(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def parts(batch: pa.RecordBatch, text_at: int = 1, size_limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size_limit`` bytes of text each."""
    column = batch.column(text_at)
    sizes = np.asarray(
        pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    )
    start, total = 0, 0
    for at, size in enumerate(sizes.tolist()):
        total += size
        if total >= size_limit or at == len(sizes) - 1:
            yield batch.slice(start, at + 1 - start)
            start, total = at + 1, 0


def slices(
    batch: pa.RecordBatch, text_at: int = 1, size_limit: int = SLICE_CHARS
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with about ``size_limit`` bytes of text each, and their texts."""
    for part in parts(batch, text_at, size_limit):
        yield part, texts_of(part.column(text_at))


def worker_memory(kind: str, version: str) -> dict:
    """A dictionary that lives as long as the Python worker, so tasks share what they remember.

    Functions travel by value, so their modules' globals would start afresh with every task.
    Only the newest version of a kind is kept.
    """
    home = sys.modules.setdefault("_pagewatch_memory", types.ModuleType("_pagewatch_memory")).__dict__
    if home.get(kind, ("",))[0] != version:
        home[kind] = (version, {})
    return home[kind][1]


def word_hash(word: str) -> int:
    """64-bit hash of a word, equal in every process."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


class WordHashes(dict):
    """Word to 64-bit hash, computed once per word while it is remembered."""

    def __missing__(self, word: str) -> int:
        value = word_hash(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a uint64 array over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounded_fraction(rows: int, bound: int) -> float:
    """Share of rows that a hash sample may keep so that it stays below a bound."""
    return min(1.0, 0.95 * bound / max(rows, 1))


def in_sample(id_col: str, fraction: float) -> Column:
    """Sample by a hash of the id: the same rows in every run and on every executor."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(11)), F.lit(1 << 20)) < int(
        fraction * (1 << 20)
    )


def arrays(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a list column without nulls, as views of one numpy array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def lists(parts: list[np.ndarray], dtype: type) -> pa.ListArray:
    """A list column of numpy arrays."""
    offsets = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, dtype), *parts])))
