"""Secret scans with one combined deterministic automaton.

The regexes of all rules become one nondeterministic automaton over bytes. Subset construction makes it deterministic,
partition refinement minimal; bytes that no rule tells apart share a column of the transition array. The
automaton reads a text once, from its end to its start: after each byte its state says which rules have a match that starts
there. From those few places, leftmost first, a rule's own automaton runs forward to the end of the longest match, and the
search for that rule goes on behind it. So the matches of a rule are leftmost, longest and do not overlap, as those of a
regex whose repeats are greedy and whose alternatives exclude each other; matches of different rules may overlap.

A match is dropped, and not tried again, if what follows the rule's ``head`` is shorter than ``least``. Long counts
stay out of the patterns for that reason: only ``hex``, which no fixed letter begins, counts in the automaton.

Spans are in code points, end exclusive. A null text is an empty one and has no spans. Repeated rows and null ids are rows
like others; other columns are ignored. A text is read in time linear in its length for the rules here, as a forward run
reads each match once.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagewatch.llm.common import slices

SPANS = "array<struct<kind: string, start: int, end: int>>"
MAX_STATES = 20_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret: the regex ``head`` and ``body``; at least ``least`` characters have to match after the head."""

    kind: str
    body: str
    least: int
    head: str = ""


#: The kinds that every scan has, in the order that spans at one place are listed in. Fixed values.
BASE = (
    Rule("assign", r"[A-Za-z0-9+/_.=-]+", 6,
         head=r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
#: Published forms of keys and tokens. Fixed values.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]+", 15),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("bearer", r"[A-Za-z0-9._~+/-]+=*", 20, head=r"(?i:bearer)\x20+"),
    Rule("url", r"[A-Za-z0-9._~%!$&*+,;=-]+@[A-Za-z0-9.-]+", 8, head=r"[a-z][a-z0-9+.-]*://[A-Za-z0-9._~%+-]+:"),
    Rule("private", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----([A-Za-z0-9+/=\x20\x09-\x0D]+-----END ([A-Z]+ )*PRIVATE KEY-----)?", 27),
)
RULES = BASE + ADDED


class _Nfa:
    """Edges over sets of bytes, and empty edges, of regexes."""

    def __init__(self) -> None:
        self.size = 0
        self.edges: list[tuple[int, np.ndarray, int]] = []
        self.empty: list[tuple[int, int]] = []

    def state(self) -> int:
        self.size += 1
        return self.size - 1

    def add(self, pattern: str) -> tuple[int, int]:
        start = self.state()
        return start, self._sequence(re._parser.parse(pattern.encode()), start, False)

    def _edge(self, start: int, chosen: np.ndarray) -> int:
        end = self.state()
        self.edges.append((start, chosen, end))
        return end

    def _sequence(self, tokens, at: int, any_case: bool) -> int:
        for op, arg in tokens:
            at = self._token(str(op), arg, at, any_case)
        return at

    def _token(self, op: str, arg, at: int, any_case: bool) -> int:
        if op in ("LITERAL", "IN", "NOT_LITERAL", "ANY"):
            return self._edge(at, _bytes_of(op, arg, any_case))
        if op == "SUBPATTERN":
            _, on, off, inner = arg
            return self._sequence(inner, at, (any_case or bool(on & re.I)) and not off & re.I)
        if op == "BRANCH":
            end = self.state()
            self.empty += [(self._sequence(tokens, at, any_case), end) for tokens in arg[1]]
            return end
        if op == "MAX_REPEAT":
            least, most, inner = arg
            for _ in range(least):
                at = self._sequence(inner, at, any_case)
            if most == re._parser.MAXREPEAT:
                loop = self.state()
                self.empty += [(at, loop), (self._sequence(inner, loop, any_case), loop)]
                return loop
            end = self.state()
            for _ in range(most - least):
                self.empty.append((at, end))
                at = self._sequence(inner, at, any_case)
            self.empty.append((at, end))
            return end
        raise ValueError(f"a rule may not use {op.lower()}")


def _bytes_of(op: str, arg, any_case: bool) -> np.ndarray:
    chosen = np.zeros(256, bool)
    if op == "ANY":
        return np.arange(256) != ord("\n")
    negated = op == "NOT_LITERAL"
    for kind, value in arg if op == "IN" else [("LITERAL", arg)]:
        if str(kind) == "NEGATE":
            negated = True
        elif str(kind) == "RANGE":
            chosen[value[0]:value[1] + 1] = True
        elif str(kind) == "LITERAL":
            chosen[value] = True
        else:
            raise ValueError(f"a rule may not use {kind}")
    if any_case:
        upper, lower = slice(ord("A"), ord("Z") + 1), slice(ord("a"), ord("z") + 1)
        chosen[upper] |= chosen[lower]
        chosen[lower] = chosen[upper]
    return ~chosen if negated else chosen


@dataclass(frozen=True)
class Automaton:
    """A minimal deterministic automaton: ``moves[state, column]``, ``told[state]`` the rules as bits, state 0 starts.

    States that tell a rule come after all others.
    """

    columns: bytes
    moves: np.ndarray
    told: tuple[int, ...]

    @property
    def quiet(self) -> int:
        """Number of states that tell nothing."""
        return self.told.count(0)


def determinise(nfa: _Nfa, starts: list[int], ends: dict[int, int], backward: bool = False, again: bool = False) -> Automaton:
    """Subset construction from ``starts``, and minimisation. ``again`` lets a match begin at every byte."""
    edges = [(b, m, a) for a, m, b in nfa.edges] if backward else nfa.edges
    empty = [(b, a) for a, b in nfa.empty] if backward else nfa.empty
    masks = np.array([m for _, m, _ in edges])
    columns_of_edge, column = np.unique(masks, axis=1, return_inverse=True)
    closure = [1 << s for s in range(nfa.size)]
    changed = True
    while changed:
        changed = False
        for a, b in empty:
            if closure[a] | closure[b] != closure[a]:
                closure[a] |= closure[b]
                changed = True
    steps = [[[0] * nfa.size, 0] for _ in range(columns_of_edge.shape[1])]
    for (a, _, b), row in zip(edges, columns_of_edge):
        for c in np.flatnonzero(row).tolist():
            steps[c][0][a] |= closure[b]
            steps[c][1] |= 1 << a
    begin = 0
    for s in starts:
        begin |= closure[s]
    number, order, moves = {begin: 0}, [begin], []
    for subset in order:
        row = []
        for targets, able in steps:
            after, rest = begin if again else 0, subset & able
            while rest:
                low = rest & -rest
                after |= targets[low.bit_length() - 1]
                rest ^= low
            if after not in number:
                if len(number) == MAX_STATES:
                    raise ValueError("the rules need too many states; take counts out of their patterns")
                number[after] = len(number)
                order.append(after)
            row.append(number[after])
        moves.append(row)
    told = []
    for subset in order:
        bits = 0
        for state, rule in ends.items():
            bits |= (subset >> state & 1) << rule
        told.append(bits)
    return _minimal(column.ravel().astype(np.uint8).tobytes(), np.array(moves), told)


def _minimal(columns: bytes, moves: np.ndarray, told: list[int]) -> Automaton:
    """States that no text tells apart become one: partitions are refined until they stay."""
    block = np.unique(np.array(told, object).astype(str), return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    first = np.unique(block, return_index=True)[1]
    # The start comes first and states that tell a rule last.
    rank = sorted(range(len(first)), key=lambda b: (b != block[0], told[first[b]] != 0))
    if told[0]:
        raise ValueError("a rule may not match an empty text")
    place = np.empty(len(first), int)
    place[rank] = np.arange(len(first))
    chosen = first[rank]
    return Automaton(columns, place[block[moves[chosen]]], tuple(told[i] for i in chosen.tolist()))


class Scanner:
    """All rules as one automaton from the end of a text, and each rule's from its start."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        nfa, ends = _Nfa(), []
        begins: dict[int, int] = {}
        for i, rule in enumerate(rules):
            start, end = nfa.add(rule.head + rule.body)
            begins[start] = i
            ends.append(end)
        self.all = determinise(nfa, ends, begins, backward=True, again=True)
        self.each = [(self._forward(r.head + r.body), self._forward(r.head) if r.head else None) for r in rules]
        self._unpack()

    @staticmethod
    def _forward(pattern: str) -> Automaton:
        nfa = _Nfa()
        start, end = nfa.add(pattern)
        return determinise(nfa, [start], {end: 0})

    def _unpack(self) -> None:
        """The transition array as one list that is indexed by ``state * columns + column``."""
        width = self.all.moves.shape[1]
        self._width = width
        self._step = (self.all.moves * width).ravel().tolist()

    def starts(self, data: bytes) -> Iterator[tuple[int, int]]:
        """Places where a match of some rule starts, first to last, and the rules as bits. One pass over the bytes."""
        step, state, loud = self._step, 0, self.all.quiet * self._width
        places, states = array("q"), array("q")
        at = len(data)
        for column in data.translate(self.all.columns)[::-1]:
            at -= 1
            state = step[state + column]
            if state >= loud:
                places.append(at)
                states.append(state)
        told, width = self.all.told, self._width
        return ((at, told[state // width]) for at, state in zip(reversed(places), reversed(states)))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Matches as ``(start, rule, end)`` in code points, in that order."""
        data = text.encode("utf-8", "surrogatepass")
        found, free = [], [0] * len(self.rules)
        for at, bits in self.starts(data):
            while bits:
                rule = (bits & -bits).bit_length() - 1
                bits &= bits - 1
                if at >= free[rule]:
                    whole, head = self.each[rule]
                    free[rule] = end = _longest(whole, data, at)
                    if end - (_longest(head, data, at) if head else at) >= self.rules[rule].least:
                        found.append((at, rule, end))
        if len(data) == len(text):
            return found
        # Matches are ASCII, so byte offsets differ from those of characters by what lies before.
        extra = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) == 0x80)])
        return [(int(a - extra[a]), rule, int(b - extra[b])) for a, rule, b in found]

    def __reduce__(self):
        return Scanner, (self.rules,)


def _longest(automaton: Automaton, data: bytes, at: int) -> int:
    """End of the longest match that starts at a place where one does."""
    state, end, columns, moves, quiet = 0, at, automaton.columns, automaton.moves, automaton.quiet
    for i in range(at, len(data)):
        after = moves.item(state, columns[data[i]])
        if after >= quiet:
            end = i + 1
        elif after == state and (moves[state] == state).all():
            break
        state = after
    return end


def _struct(scanner: Scanner, spans: list[tuple[int, int, int]]) -> list[dict]:
    return [{"kind": scanner.rules[r].kind, "start": a, "end": b} for a, r, b in spans]


def find_secrets(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, base, spans``; spans by start, then by the order of the rules.

    ``base`` holds those of the rules in ``BASE``. No shuffle.
    """
    scanner = scanner or Scanner()
    base = {scanner.rules.index(r) for r in BASE if r in scanner.rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part, texts in slices(batch):
                found = [scanner.spans(t) for t in texts]
                columns = [
                    pa.array([_struct(scanner, [s for s in spans if s[1] in base]) for spans in found], kinds),
                    pa.array([_struct(scanner, spans) for spans in found], kinds),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "base", "spans"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, base {SPANS}, spans {SPANS}")


def mask_secrets(text: Column, scanner: Scanner | None = None) -> Column:
    """The text with every span replaced by its kind, as ``[KIND]``; of overlapping spans the first one's. Null stays null."""
    scanner = scanner or Scanner()

    @F.udf("string", useArrow=True)
    def masked(value: str | None) -> str | None:
        if value is None:
            return None
        made, free = [], 0
        for start, rule, end in scanner.spans(value):
            if start >= free:
                made += [value[free:start], f"[{scanner.rules[rule].kind.upper()}]"]
            free = max(free, end)
        return "".join([*made, value[free:]])

    return masked(text)


def secret_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    shown = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(shown, ",")
