"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked list of symbols.

The vocabulary is a ``tokenizers`` file with byte-level symbols and word ends. A text is put in NFC,
its white space is dropped, it is lower-cased and split into pre-tokens; each pre-token is merged
once per worker and remembered. Merging keeps the symbols in a doubly linked list and the
candidate pairs in a heap by rank and place; entries whose symbols have changed meanwhile are stale
and skipped. Decoding joins the vocabulary strings of the ids by single spaces, because the
vocabulary file names no decoder.

Defined cases: null and empty texts have no tokens and decode to the empty text. A special string
inside a text is its own token. Repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from pagewatch.llm.common import lists, slices, worker_memory

#: White space as the vocabulary's normaliser sees it.
_SPACE = "\t-\r \x85\xa0  -     　"


#: Pieces, and pre-tokens, that a worker remembers, 200 to 300 bytes each. Later ones are encoded anew: only speed depends on it.
REMEMBERED = 100_000
#: Larger than any id of a vocabulary, for pairs of ids as one number; and the mark of merged symbols.
_BASE, _GONE = 1 << 24, -(1 << 60)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class BpeCodec:
    """Encoder and decoder of one vocabulary file. Only the file's text travels to the executors."""

    def __init__(self, text: str):
        self.text = text

    @classmethod
    def from_file(cls, path: str) -> BpeCodec:
        with open(path, encoding="utf-8") as file:
            return cls(file.read())

    def __reduce__(self):
        return (type(self), (self.text,))

    @cached_property
    def _spec(self) -> dict:
        return json.loads(self.text)

    @cached_property
    def vocab(self) -> dict[str, int]:
        return self._spec["model"]["vocab"]

    @cached_property
    def special(self) -> dict[str, int]:
        return {t["content"]: t["id"] for t in self._spec["added_tokens"]}

    @cached_property
    def ranks(self) -> dict[int, tuple[int, int]]:
        """Pair of ids, as one number, to the merge's rank and the id of the joined symbol."""
        merges = (m if isinstance(m, list) else m.split(" ") for m in self._spec["model"]["merges"])
        ids = self.vocab
        return {
            ids[a] * _BASE + ids[b]: (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)
        }

    @cached_property
    def _suffix(self) -> str:
        return self._spec["model"]["end_of_word_suffix"] or ""

    @cached_property
    def _pattern(self):
        return regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + _SPACE + r"\p{L}\p{N}]+")

    @cached_property
    def _special_pattern(self):
        return re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    @cached_property
    def _bytes(self) -> list[str]:
        return byte_symbols()

    @cached_property
    def _strings(self) -> dict[int, str]:
        return {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}

    @cached_property
    def _chunks(self):
        return re.compile(f"[^{_SPACE}]+")

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge a pre-token's symbols, lowest rank first, leftmost first among equals."""
        n = len(symbols)
        ranks = self.ranks
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        # An entry is rank * n + place of the left symbol.
        heap = []
        for i in range(n - 1):
            found = ranks.get(symbols[i] * _BASE + symbols[i + 1])
            if found:
                heap.append(found[0] * n + i)
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            j = right[i]
            found = ranks.get(symbols[i] * _BASE + symbols[j]) if j >= 0 else None
            if not found or found[0] != rank:
                continue  # stale: one of the two symbols has been merged meanwhile
            symbols[i], symbols[j] = found[1], _GONE
            after = right[i] = right[j]
            if after >= 0:
                left[after] = i
                found = ranks.get(symbols[i] * _BASE + symbols[after])
                if found:
                    heapq.heappush(heap, found[0] * n + i)
            before = left[i]
            if before >= 0:
                found = ranks.get(symbols[before] * _BASE + symbols[i])
                if found:
                    heapq.heappush(heap, found[0] * n + before)
        return [s for s in symbols if s >= 0]

    @cached_property
    def _byte_ids(self) -> tuple[list[int], list[int]]:
        """Ids of the byte symbols, inside and at the end of a pre-token."""
        return [self.vocab[s] for s in self._bytes], [self.vocab[s + self._suffix] for s in self._bytes]

    def _pretoken(self, word: str) -> list[int]:
        inner, last = self._byte_ids
        raw = word.encode("utf-8", "surrogatepass")
        symbols = [inner[b] for b in raw]
        symbols[-1] = last[raw[-1]]
        return self.merge(symbols)

    def _chunk(self, chunk: str, words: dict[str, list[int]]) -> bytes:
        """Ids of a piece of text without white space, as 32-bit integers."""
        out: list[int] = []
        parts = self._special_pattern.split(chunk) if self._special_pattern else [chunk]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                normal = unicodedata.normalize("NFC", part)
                # Letter by letter: a sigma at the end of a word is no special case.
                normal = "".join(map(str.lower, normal)) if "Σ" in normal else normal.lower()
                for word in self._pattern.findall(normal):
                    known = words.get(word)
                    if known is None:
                        known = array("i", self._pretoken(word))
                        if len(words) < REMEMBERED:
                            words[word] = known
                    out.extend(known)
        return array("i", out).tobytes()

    def encode_all(self, texts: list[str], memory: dict) -> list[np.ndarray]:
        """Ids of each text. ``memory`` remembers pieces and pre-tokens between calls."""
        chunks_known = memory.setdefault("chunks", {})
        words = memory.setdefault("words", {})
        get = chunks_known.get
        out = []
        for text in texts:
            chunks = self._chunks.findall(text)
            found = list(map(get, chunks))
            if None in found:
                fresh: dict[str, bytes] = {}
                for at, ids in enumerate(found):
                    if ids is None:
                        chunk = chunks[at]
                        if chunk not in fresh:
                            fresh[chunk] = self._chunk(chunk, words)
                            if len(chunks_known) < REMEMBERED:
                                chunks_known[chunk] = fresh[chunk]
                        found[at] = fresh[chunk]
            out.append(np.frombuffer(b"".join(found), np.int32))
        return out

    def decode_all(self, ids: list[np.ndarray]) -> list[str]:
        """Vocabulary strings joined by single spaces, as the vocabulary has no decoder of its own."""
        strings = self._strings
        return [" ".join([strings[i] for i in row.tolist()]) for row in ids]


def encode_texts(docs: DataFrame, codec: BpeCodec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>, decoded string)`` of every row."""

    version = hashlib.sha1(codec.text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = worker_memory("bpe", version)
        for batch in batches:
            for part, texts in slices(batch):
                ids = codec.encode_all(texts, memory)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists(ids, np.int32), pa.array(codec.decode_all(ids), pa.string())],
                    ["id", "ids", "decoded"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return (
        docs.select(F.col(id_col), F.col(text_col))
        .mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
        .withColumnRenamed("id", id_col)
    )
