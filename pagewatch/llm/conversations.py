"""Conversation structure repair: generalised LR over the roles, with edits that cost.

The legal orders of roles are a context-free grammar over their initials. Its SLR tables drive a parser that
keeps many stacks at once. A stack is a node, that is a state and a link to the node below it; equal nodes are one
object, so the stacks of a conversation are a graph with common tails. At every turn each stack top may keep, rerole or
delete the turn and insert turns before it. Equal tops merge to the least ``(cost, audit)``, where the audit
is the string of the edits' initials, so a stack top carries one value and a turn costs a bounded number of steps.

A conversation is parsed in pieces of ``PIECE`` turns. Only the first piece knows the stack it starts from; the others are
parsed from every stack that the grammar allows between two turns (``Grammar.entries``, ten for the grammar here), and the
pieces of a conversation are then chained by least ``(cost, audit)``. So turns of one huge conversation are parsed in many
tasks, and no task holds more than a piece of turns.

Turns are taken in the order of ``turn`` (nulls first), then role, then the MD5 of the text; rows equal in all three are alike.
A null role or text is one space. Null conversation ids are one conversation. Of the faults of a turn the first of these
counts: ``blank`` (no character but white space), ``duplicate`` (role and text seen earlier in the conversation), ``truncated``
(the last character other than white space is no ``.``, ``!`` or ``?``). Blank and duplicate turns are deleted; a truncated
one that stays costs ``TRUNCATED``. A role that the grammar does not know, the empty one too, is reroled or deleted.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagewatch.operators.skew import DEFAULT_POLICY, SkewPolicy, number_in_order
from pagewatch.sources.tables import materialize

#: ``(s?(ua)+)?`` as a grammar: productions of single letters, capitals are rules, the first rule is the start.
ROLES = ("C=", "C=B", "C=sB", "B=ua", "B=Bua")
#: Roles that a turn may be changed to, and that may be inserted, by their initials.
MADE_ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
PIECE = 4096
END = "$"
#: Fault codes of a turn.
FINE, BLANK, DUPLICATE, CUT = range(4)
WHITE = " \t\n\x0b\x0c\r"


@dataclass
class Node:
    """Top of a stack: an LR state over the node below."""

    state: int
    below: Node | None
    number: int


@dataclass
class Grammar:
    """SLR tables of a grammar and the stacks met so far."""

    productions: tuple[str, ...] = ROLES
    made: tuple[str, ...] = tuple(MADE_ROLES)
    moves: dict = field(default_factory=dict)
    nodes: dict = field(default_factory=dict)
    steps: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        rules = [tuple(p.split("=")) for p in self.productions]
        self.start = rules[0][0]
        self.rules = [("^", self.start), *rules]
        self.follow = self._follow()
        # The states are sets of (rule, dot); the first one starts the augmented rule.
        states = [self._closure({(0, 0)})]
        for state in states:
            for symbol in sorted({self.rules[r][1][d] for r, d in state if d < len(self.rules[r][1])}):
                target = self._closure({(r, d + 1) for r, d in state if self.rules[r][1][d:d + 1] == symbol})
                if target not in states:
                    states.append(target)
                self.moves[states.index(state), symbol] = states.index(target)
        self.complete = [[r for r, d in sorted(s) if d == len(self.rules[r][1])] for s in states]
        self.root = self._node(0, None)
        self.terminals = sorted({c for _, body in rules for c in body if not c.isupper()})
        self.entries = self._between_turns()

    def _closure(self, items: set) -> frozenset:
        while True:
            wanted = {self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}
            more = {(r, 0) for r, (head, _) in enumerate(self.rules) if head in wanted} - items
            if not more:
                return frozenset(items)
            items = items | more

    def _follow(self) -> dict[str, set]:
        """Terminals that may stand after each rule's text."""
        heads = {h for h, _ in self.rules}
        empty: set = set()
        first = {h: set() for h in heads}
        follow = {h: set() for h in heads}
        follow["^"].add(END)
        changed = True
        while changed:
            before = (len(empty), sum(map(len, first.values())), sum(map(len, follow.values())))
            for head, body in self.rules:
                if all(c in empty for c in body):
                    empty.add(head)
                for c in body:
                    first[head] |= first[c] if c in heads else {c}
                    if c not in empty:
                        break
                after = set(follow[head])
                for c in reversed(body):
                    if c in heads:
                        follow[c] |= after
                        after = first[c] | (after if c in empty else set())
                    else:
                        after = {c}
            changed = before != (len(empty), sum(map(len, first.values())), sum(map(len, follow.values())))
        return follow

    def _node(self, state: int, below: Node | None) -> Node:
        key = (state, None if below is None else below.number)
        if key not in self.nodes:
            self.nodes[key] = Node(state, below, len(self.nodes))
        return self.nodes[key]

    def _reduced(self, top: Node, ahead: str) -> list[Node]:
        """The stack and all that reductions make of it if ``ahead`` comes next."""
        found = [top]
        for node in found:
            for rule in self.complete[node.state]:
                head, body = self.rules[rule]
                if rule and ahead in self.follow[head]:
                    below = node
                    for _ in body:
                        below = below.below
                    made = self._node(self.moves[below.state, head], below)
                    if made not in found:
                        found.append(made)
        return found

    def step(self, top: Node, symbol: str) -> list[Node]:
        """Stacks after the symbol; at the end, the stack itself if it may end there."""
        key = (top.number, symbol)
        if key not in self.steps:
            reduced = self._reduced(top, symbol)
            if symbol == END:
                self.steps[key] = [top] if any(0 in self.complete[n.state] for n in reduced) else []
            else:
                self.steps[key] = [
                    self._node(self.moves[n.state, symbol], n) for n in reduced if (n.state, symbol) in self.moves
                ]
        return self.steps[key]

    def _between_turns(self, most: int = 64) -> list[Node]:
        """Every stack that may stand between two turns."""
        found = [self.root]
        for top in found:
            for symbol in self.terminals:
                found += [n for n in self.step(top, symbol) if n not in found]
            if len(found) > most:
                raise ValueError("the grammar nests: its stacks have no bound")
        return found

    def __reduce__(self):
        return Grammar, (self.productions, self.made)


#: Least way to a stack top: cost, audit, and the initial that each edit leaves (``-`` for a deletion).
Way = tuple[int, str, str]


def _inserted(tops: dict[int, tuple[Node, Way]], grammar: Grammar) -> dict[int, tuple[Node, Way]]:
    """The tops and all that insertions make of them."""
    tops = dict(tops)
    pending = list(tops)
    while pending:
        node, (cost, audit, roles) = tops[pending.pop()]
        for symbol in grammar.made:
            way = (cost + INSERT, audit + "I", roles + symbol)
            for made in grammar.step(node, symbol):
                if made.number not in tops or way < tops[made.number][1]:
                    tops[made.number] = (made, way)
                    pending.append(made.number)
    return tops


def parse_piece(turns: list[tuple[str, int]], entry: Node, grammar: Grammar) -> dict[int, tuple[Node, Way]]:
    """Least way to every stack top after the turns, given as ``(initial, fault)``."""
    tops = {entry.number: (entry, (0, "", ""))}
    for initial, fault in turns:
        after: dict[int, tuple[Node, Way]] = {}

        def reach(node: Node, way: Way) -> None:
            if node.number not in after or way < after[node.number][1]:
                after[node.number] = (node, way)

        extra = TRUNCATED if fault == CUT else 0
        for node, (cost, audit, roles) in _inserted(tops, grammar).values():
            reach(node, (cost + DELETE, audit + "D", roles + "-"))
            if fault in (BLANK, DUPLICATE):
                continue
            if initial in grammar.terminals:
                for made in grammar.step(node, initial):
                    reach(made, (cost + extra, audit + "K", roles + initial))
            for symbol in grammar.made:
                for made in grammar.step(node, symbol):
                    reach(made, (cost + REROLE + extra, audit + "R", roles + symbol))
        tops = after
    return tops


def finish(tops: dict[int, tuple[Node, Way]], grammar: Grammar) -> Way | None:
    """The least way that ends in a whole conversation, if insertions can end one."""
    return min((way for node, way in _inserted(tops, grammar).values() if grammar.step(node, END)), default=None)


# -- turns in order


def _keyed(conv: Column) -> Column:
    """A conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text", policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """Turns with their place in the conversation and their fault, as a table.

    ``conv, conv_id, pos, turn, role, text, initial, fault``. Places are counted with hot conversations cut
    along their order. A duplicate is told by the least place of its role and text, which is counted before the shuffle.
    """
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in (text_col, role_col))
    rows = turns.select(
        _keyed(F.col(conv_col)).alias("conv"), F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"),
    ).withColumn("text_key", F.md5(F.col("text").cast("binary")))
    numbered = number_in_order(rows, "conv", ["turn", "role", "text_key"], "place", policy)
    last = F.rtrim(F.col("text"), F.lit(WHITE))
    told = materialize(numbered.select(
        "conv", "conv_id", (F.col("place") - 1).alias("pos"), "turn", "role", "text", "text_key",
        F.substring("role", 1, 1).alias("initial"),
        (last == "").alias("blank"), (~F.right(last, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    ), "turns")
    again = told.groupBy("conv", "role", "text_key").agg(F.min("pos").alias("seen"), F.count("*").alias("n"))
    return told.join(again.where("n > 1").drop("n"), ["conv", "role", "text_key"], "left").select(
        "conv", "conv_id", "pos", "turn", "role", "text", "initial",
        F.when(F.col("blank"), BLANK).when(F.col("pos") > F.col("seen"), DUPLICATE).when(F.col("cut"), CUT)
        .otherwise(FINE).alias("fault"),
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _grouped(rows: Iterator[tuple], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows with equal leading columns; each run must be read to its end."""
    row = next(rows, None)
    while row is not None:
        key = row[:keys]

        def run() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[:keys] == key:
                yield row
                row = next(rows, None)

        yield key, run()


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


WAY_TYPE = pa.list_(pa.struct([
    ("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("roles", pa.string()),
]))
PIECE_SCHEMA = pa.schema([
    ("conv", pa.string()), ("piece", pa.int64()), ("ways", WAY_TYPE), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()),
    ("turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
])


def _parse(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple]:
            for (conv, piece), rows in _grouped(_rows(batches), 2):
                rows = list(rows)
                given = [(initial, fault) for *_, initial, fault in rows]
                ways = [
                    {"entry": entry.number, "exit": exit_, "cost": way[0], "audit": way[1], "roles": way[2]}
                    for entry in (grammar.entries if piece else [grammar.root])
                    for exit_, (_, way) in parse_piece(given, entry, grammar).items()
                ]
                turns = [turn for _, _, _, turn, _, _ in rows if turn is not None]
                faults = [fault for _, fault in given]
                illegal = sum(a + b not in LEGAL_PAIRS for (a, _), (b, _) in zip(given, given[1:]))
                yield (conv, piece, ways, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal,
                       given[0][0], given[-1][0], len(set(turns)), min(turns, default=None), max(turns, default=None))

        yield from _batched(pieces(), PIECE_SCHEMA, 256)

    return run


CHAIN_SCHEMA = pa.schema([
    ("conv", pa.string()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
    ("roles", pa.string()), ("ends", pa.list_(pa.int64())),
])


def _chain(grammar: Grammar):
    """One row per conversation from its pieces, which come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_number = {n.number: n for n in grammar.entries}

        def whole() -> Iterator[tuple]:
            for (conv,), pieces in _grouped(_rows(batches), 1):
                # Per stack top: cost, audit, roles, and the ends of the pieces in the audit as a chain.
                tops = {grammar.root.number: (0, "", "", None)}
                counts, turns, low, high, before, last_turn = [0] * 4, 0, None, None, None, None
                for _, _, ways, *told, first_role, last_role, n, first, last in pieces:
                    reached: dict[int, tuple] = {}
                    for way in ways:
                        if way["entry"] not in tops:
                            continue
                        cost, audit, roles, ends = tops[way["entry"]]
                        audit += way["audit"]
                        made = (cost + way["cost"], audit, roles + way["roles"], (ends, len(audit)))
                        if way["exit"] not in reached or made[:2] < reached[way["exit"]][:2]:
                            reached[way["exit"]] = made
                    tops = reached
                    counts = [a + b for a, b in zip(counts, told)]
                    counts[3] += before is not None and before + first_role not in LEGAL_PAIRS
                    before = last_role
                    turns += n - (n > 0 and first == last_turn)
                    low = first if low is None else low
                    high, last_turn = (last, last) if n else (high, last_turn)
                # Insertions after the last turn belong to the last piece.
                (cost, audit, roles), best = min(
                    (way, k) for k, (*so_far, _) in tops.items()
                    if (way := finish({k: (by_number[k], tuple(so_far))}, grammar)) is not None
                )
                chain, ends = tops[best][3], []
                while chain is not None:
                    chain, end = chain
                    ends.append(end)
                ends = [*ends[::-1][:-1], len(audit)]
                yield (conv, 0 if low is None else high - low + 1 - turns, *counts, cost, audit, roles, ends)

        yield from _batched(whole(), CHAIN_SCHEMA, 64)

    return run


def _ddl(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int"}

    def of(kind: pa.DataType) -> str:
        if pa.types.is_list(kind):
            return f"array<{of(kind.value_type)}>"
        if pa.types.is_struct(kind):
            return f"struct<{', '.join(f'{f.name}: {of(f.type)}' for f in kind)}>"
        return names[kind]

    return ", ".join(f"{f.name} {of(f.type)}" for f in schema)


def repairs(ordered: DataFrame, grammar: Grammar | None = None, piece: int = PIECE) -> DataFrame:
    """Per conversation of ``ordered_turns`` its faults and cheapest edits.

    ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, roles, ends``: ``audit`` has one of ``K``, ``R``,
    ``D``, ``I`` per edit, ``roles`` the initial that the edit leaves, ``ends`` where each piece of turns ends in them.
    """
    grammar = grammar or Grammar()
    pieces = (
        ordered.select("conv", F.floor(F.col("pos") / piece).alias("piece"), "pos", "turn", "initial", "fault")
        .repartition("conv", "piece").sortWithinPartitions("conv", "piece", "pos")
        .mapInArrow(_parse(grammar), _ddl(PIECE_SCHEMA))
    )
    return (
        pieces.repartition("conv").sortWithinPartitions("conv", "piece").mapInArrow(_chain(grammar), _ddl(CHAIN_SCHEMA))
    )


REPAIRED_SCHEMA = pa.schema([
    ("conv", pa.string()), ("piece", pa.int64()), ("at", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()),
    ("role", pa.string()), ("text", pa.string()),
])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made() -> Iterator[tuple]:
        for (conv, piece), rows in _grouped(_rows(batches), 2):
            # The edits of a piece come before its turns.
            *_, audit, roles = next(rows)
            turns = ((turn, role, text) for _, _, _, turn, role, text, _, _ in rows)
            for at, (edit, initial) in enumerate(zip(audit, roles)):
                turn, role, text = (None, None, "") if edit == "I" else next(turns)
                if edit in "IR":
                    role = MADE_ROLES[initial]
                if edit != "D":
                    yield conv, piece, at, edit, turn, role, text
            for _ in turns:
                raise ValueError("edits and turns do not fit")

    yield from _batched(made(), REPAIRED_SCHEMA, 512)


def repaired_turns(ordered: DataFrame, repaired: DataFrame, piece: int = PIECE) -> DataFrame:
    """The turns that remain, in the order of ``(piece, at)``: ``conv, piece, at, edit, turn, role, text``.

    Turns meet their edits by piece, so a huge conversation is spread over tasks.
    """
    begin = F.when(F.col("piece") == 0, 0).otherwise(F.get("ends", F.col("piece") - 1))
    length = F.get("ends", F.col("piece")) - begin
    edits = repaired.select("conv", "audit", "roles", "ends", F.posexplode("ends").alias("piece", "_")).select(
        "conv", F.col("piece").cast("long").alias("piece"), F.lit(-1).cast("long").alias("pos"),
        F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"),
        F.substring(F.col("audit"), begin + 1, length).alias("audit"),
        F.substring(F.col("roles"), begin + 1, length).alias("roles"),
    )
    turns = ordered.select(
        "conv", F.floor(F.col("pos") / piece).alias("piece"), "pos", "turn", "role", "text",
        F.lit("").alias("audit"), F.lit("").alias("roles"),
    )
    return (
        turns.unionByName(edits).repartition("conv", "piece").sortWithinPartitions("conv", "piece", "pos")
        .mapInArrow(_apply, _ddl(REPAIRED_SCHEMA))
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digests() -> Iterator[tuple]:
        for (conv,), lines in _grouped(_rows(batches), 1):
            sha = hashlib.sha256()
            for i, (_, _, _, line) in enumerate(lines):
                sha.update((b"\n" if i else b"") + line.encode())
            yield conv, sha.hexdigest()

    schema = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])
    yield from _batched(digests(), schema, 1024)


def repaired_digest(remaining: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines: ``conv, repaired_sha256``.

    The digest of one conversation is sequential by definition: its lines pass one task as a sorted stream, and
    the task holds one batch of them.
    """
    lines = remaining.select("conv", "piece", "at", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv").sortWithinPartitions("conv", "piece", "at").mapInArrow(
        _digest, "conv string, repaired_sha256 string")


def damaged_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """Turns with faults put in by ``crc32(conv_id:turn) % 20``: ``conv_id, turn, role, text``.

    0 drops a turn, 1 empties its text, 2 removes its ``.``, ``!`` and ``?``, 3 repeats it, 4 makes its role ``user``.
    A null is one space in the key, the role and the text; null ids and turns stay null.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in (conv_col, turn_col)))
    fate = (F.crc32(key.cast("binary")) % 20).alias("fate")
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"), fate,
    ).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        copies.alias("copy"),
    ).drop("copy")
