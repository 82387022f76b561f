"""Token counts by rank-synchronous merging of ragged arrays.

The vocabulary is a ``sentencepiece`` BPE model without normalisation: a space becomes the mark
``▁``, a text gets one in front, and pieces merge by score. Two neighbouring characters that stand next to
each other in no piece can never merge, so every text is cut there; what lies between is a pre-token.
The new pre-tokens of a batch are held in one ragged array of symbols. In each round every pre-token
looks up the ranks of its neighbouring pairs, takes its lowest, and all of them merge at once; those
without a pair left are done. Symbols that are no piece count as one token per UTF-8 byte.

A round merges the places of a pre-token's lowest rank from the left, up to the first merge that makes a
pair of no higher rank possible: so the result is that of one merge after the other. A pre-token of which
a round would merge less than one symbol in ``SLOW``, which takes more symbols than that, is finished by a
heap of pairs over linked symbols: a run of spaces, in which each merge makes the next one possible, then
takes n log n steps. The others shrink by that share in a round, so all rounds together are linear.

Defined cases: null and empty texts have no tokens and no bytes. Repeated rows are counted each;
texts are read whole, in any length.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from pagewatch.llm.common import CACHE_WORDS, slices, worker_memory

MARK = "▁"
SLOW = 64
NEVER = np.iinfo(np.int64).max


class PieceCounter:
    """Counts the tokens of texts. Only the model's bytes travel to the executors."""

    def __init__(self, model: bytes):
        self.model = model

    @classmethod
    def from_file(cls, path: str) -> PieceCounter:
        with open(path, "rb") as file:
            return cls(file.read())

    def __reduce__(self):
        return (type(self), (self.model,))

    @cached_property
    def _pieces(self) -> list[tuple[str, float]]:
        """Ordinary pieces and their scores; the library is asked for the vocabulary only."""
        p = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        return [
            (p.id_to_piece(i), p.get_score(i))
            for i in range(p.get_piece_size())
            if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))
        ]

    @cached_property
    def _symbols(self) -> dict[str, int]:
        """Number of each piece; single characters outside the vocabulary get numbers as they appear."""
        return {piece: i for i, (piece, _) in enumerate(self._pieces)}

    @cached_property
    def _merges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted pair keys, with rank and joined symbol."""
        order = sorted(range(len(self._pieces)), key=lambda i: -self._pieces[i][1])
        rank = np.empty(len(order), np.int64)
        # Equal scores are equal ranks; the leftmost of them goes first.
        last, now = None, -1
        for i in order:
            now += self._pieces[i][1] != last
            last = self._pieces[i][1]
            rank[i] = now
        pairs = []
        ids = self._symbols
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
                if a is not None and b is not None:
                    pairs.append((a * len(ids) + b, rank[i], i))
        pairs.sort()
        table = np.array(pairs, np.int64)
        return table[:, 0], table[:, 1], table[:, 2]

    @cached_property
    def _pairs(self) -> dict[int, tuple[int, int]]:
        keys, ranks, joined = (x.tolist() for x in self._merges)
        return dict(zip(keys, zip(ranks, joined)))

    def _look_up(self, left: np.ndarray, right: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, ``NEVER`` for those that never merge or are not asked for, and its joined symbol."""
        keys, ranks, joined = self._merges
        pair = left * len(self._symbols) + right
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        return np.where(where & (keys[at] == pair), ranks[at], NEVER), joined[at]

    def _merges_one_by_one(self, symbols: list[int]) -> int:
        """Number of merges of one pre-token, lowest rank and leftmost first, over linked symbols."""
        pairs, n = self._pairs, len(self._symbols)
        size = len(symbols)
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        heap = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < size:
                found = pairs.get(symbols[a] * n + symbols[b])
                if found:
                    heapq.heappush(heap, (found[0], a, symbols[a], symbols[b], found[1]))

        for a in range(size - 1):
            offer(a, a + 1)
        merges = 0
        while heap:
            _, a, x, y, made = heapq.heappop(heap)
            b = after[a]
            if symbols[a] != x or b >= size or symbols[b] != y:
                continue
            merges += 1
            symbols[a], symbols[b] = made, -1
            after[a] = after[b]
            if after[a] < size:
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return merges

    @cached_property
    def _neighbours(self) -> np.ndarray:
        """Sorted keys of the character pairs that stand next to each other in some piece."""
        found = {(ord(a) << 21) | ord(b) for p in self._symbols for a, b in zip(p, p[1:])}
        return np.array(sorted(found), np.int64)

    @cached_property
    def _split(self):
        """Cheap first cut: at marks, and around characters that are in no longer piece."""
        joined = {c for p in self._symbols if len(p) > 1 for c in p}
        breaks = [c for c in "\n\t\r" if c not in joined]
        stop = "".join(map(re.escape, breaks))
        return re.compile(f"{MARK}*[^{MARK}{stop}]+|{MARK}+" + (f"|[{stop}]+" if stop else ""))

    def _merge_all(self, words: list[str]) -> np.ndarray:
        """Number of tokens of each word."""
        lengths = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        chars, inverse = np.unique(codes, return_inverse=True)
        table = np.array([self._symbols.get(chr(c), -1) for c in chars.tolist()])
        cost = np.array([len(chr(c).encode("utf-8", "surrogatepass")) for c in chars.tolist()])
        symbol = table[inverse]
        # Symbols outside the vocabulary never merge: they count as their bytes.
        count = np.bincount(owner, np.where(symbol < 0, cost[inverse], 1), len(words)).astype(np.int64)
        near = self._neighbours
        key = (codes[:-1] << 21) | codes[1:]
        at = np.minimum(np.searchsorted(near, key), len(near) - 1)
        apart = (near[at] != key) | (owner[:-1] != owner[1:]) | (symbol[:-1] < 0) | (symbol[1:] < 0)
        part = np.concatenate([[0], np.cumsum(apart)])  # pre-token of each symbol
        while len(symbol) > 1:
            rank, joined = self._look_up(symbol[:-1], symbol[1:], part[:-1] == part[1:])
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            ends = np.append(starts[1:], len(symbol))
            low = np.minimum.reduceat(np.append(rank, NEVER), starts)
            going = low < NEVER
            if not going.any():
                break
            # Places of the lowest rank that do not overlap, from the left.
            place = np.flatnonzero((rank < NEVER) & (rank == np.repeat(low, ends - starts)[:-1]))
            first = np.concatenate([[True], part[place][1:] != part[place][:-1]])
            run = np.concatenate([[True], (np.diff(place) != 1)]) | first
            begin = np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
            even = (np.arange(len(place)) - begin) % 2 == 0
            place, first = place[even], first[even]
            # A merge that makes a pair of no higher rank possible is the last of this round. Left of it
            # stands what the merge before it has made, if that one is its neighbour.
            made = joined[place]
            close = np.concatenate([[False], np.diff(place) == 2]) & ~first
            left = np.where(close, np.roll(made, 1), symbol[place - 1])
            right = symbol[np.minimum(place + 2, len(symbol) - 1)]
            has_left = (place > 0) & (part[place - 1] == part[place])
            has_right = (place + 2 < len(symbol)) & (part[np.minimum(place + 2, len(symbol) - 1)] == part[place])
            next_rank = np.minimum(self._look_up(left, made, has_left)[0], self._look_up(made, right, has_right)[0])
            opens = np.cumsum(next_rank <= rank[place]) - (next_rank <= rank[place])
            place = place[opens == np.maximum.accumulate(np.where(first, opens, 0))]
            # Where a round gets nowhere the pre-token is finished on its own.
            merged = np.bincount(np.searchsorted(starts, place, "right") - 1, minlength=len(starts))
            slow = going & (merged * SLOW < ends - starts)
            for a, b in zip(starts[slow].tolist(), ends[slow].tolist()):
                count[owner[a]] -= self._merges_one_by_one(symbol[a:b].tolist())
            going &= ~slow
            place = place[np.repeat(going, ends - starts)[place]]
            symbol = symbol.copy()
            symbol[place] = joined[place]
            np.subtract.at(count, owner[place], 1)
            stay = np.repeat(going, ends - starts)
            stay[place + 1] = False
            symbol, part, owner = symbol[stay], part[stay], owner[stay]
        return count

    def count_all(self, texts: list[str], known: dict[str, int]) -> list[int]:
        """Tokens of each text. ``known`` remembers pieces of text between calls."""
        split = self._split
        pieces = [split.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh = list({w for words in pieces for w in words if w not in known})
        now = dict(zip(fresh, self._merge_all(fresh).tolist())) if fresh else {}
        if len(known) < CACHE_WORDS:
            known.update(now)
            return [sum(map(known.__getitem__, words)) for words in pieces]
        return [sum(known[w] if w in known else now[w] for w in words) for words in pieces]


def token_counts(docs: DataFrame, counter: PieceCounter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens)`` of every row."""
    version = hashlib.sha1(counter.model).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_memory("pieces", version)
        for batch in batches:
            for part, texts in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counter.count_all(texts, known), pa.int64()), part.column(2)],
                    ["id", "n_tokens", "n_bytes"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    size = F.coalesce(F.octet_length(F.col(text_col)).cast("long"), F.lit(0).cast("long"))
    return (
        docs.select(F.col(id_col), F.col(text_col), size.alias("n_bytes"))
        .mapInArrow(run, f"id {kind}, n_tokens long, n_bytes long")
        .withColumnRenamed("id", id_col)
    )
