"""Personal data: base patterns, and spans that a character-level BiLSTM-CRF adds to them.

The tagger is trained here on at most ``max_windows`` windows around digits, at-signs and bracketed "at" of
at most ``max_train_docs`` documents. Labels are what has the form of a base span (values and checksums are
looked at afterwards), and what is put between two words of these windows: written forms that the patterns miss
(``pii_forms.py``), labelled by their kind, and look-alikes such as dates and ISBNs, labelled as nothing. All
kinds hold a digit, an at-sign or a bracketed "at", so windows without cannot hold a span; all others are tagged.
Windows overlap; the scores of a position are the mean over its windows, weighted by how deep it lies in them,
and each stretch of overlapping windows is decoded as a whole with the transitions. A span
of the tagger is kept if it overlaps no base span, has at most ``LONGEST`` characters and passes the check of its kind.

Defined cases: null and empty texts have no spans. If no document has a window nothing is
trained and nothing added. Positions are code points, ends exclusive. Repeated rows are
treated each; texts are read whole, in any length.
"""

from __future__ import annotations

import pickle
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagewatch.llm.common import bounded_fraction, in_sample, slices
from pagewatch.llm.lstm_crf import Tagger, best_paths, emissions, train
from pagewatch.llm.pii_forms import KINDS, insertion, luhn

#: Training windows that are made of the given ones by putting something in, at least.
MADE = 4_000
LONGEST = 254
WINDOW, STRIDE, REACH = 96, 48, 24
_SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TRIGGER = re.compile(r"[0-9@]+|[(\[{<][\x20]?[aA][tT][\x20]?[)\]}>]")
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_AT = re.compile(r"\s*[(\[{<]\s?at\s?[)\]}>]\s*|\s*@\s*", re.I)
_MAIL_DOT = re.compile(r"\s*[(\[{<]\s?dot\s?[)\]}>]\s*", re.I)
_IP_DOT = re.compile(r"\s*[(\[{]?\s*\.\s*[)\]}]?\s*")
_CARD_LIKE = re.compile(r"[0-9]+(?:[\x20._/-]{0,3}[0-9]+)*")
_PHONE_LIKE = re.compile(r"[+(]{0,2}[0-9][\x20()./0-9-]*[0-9]")
_ISBN = re.compile(r"97[89](?:[\x20-]?[0-9]){10}(?![0-9])")
#: Dates and times, thousands, years: digits that are no phone number.
_NO_PHONE = re.compile(
    r"(?:19|20)[0-9]{2}([-/. ])[0-9]{1,2}\1[0-9]{1,2}.*|[0-9]{1,2}([-/. ])[0-9]{1,2}\2(?:19|20)[0-9]{2}.*"
    r"|[0-9]{1,3}(?:\.[0-9]{3})+|[0-9]+\.[0-9]+|(?:(?:19|20)[0-9]{2}[\x20./-]*)+"
)

#: Inputs: padding, the printable ASCII characters (letters without case, brackets of one side alike, digits but
#: for 0 alike), line ends, other white space, other letters by a hash, and anything else.
LETTERS = 32
CLASSES = 1 + 95 + 2 + LETTERS + 1
_ALIKE = str.maketrans("[{<]}>23456789", "((()))11111111")


def _class_table() -> np.ndarray:
    table = np.full(1 << 16, CLASSES - 1, np.uint8)
    for c in range(1 << 16):
        s = chr(c)
        if 32 <= c < 127:
            table[c] = 1 + ord(s.lower().translate(_ALIKE)) - 32
        elif s.isspace():
            table[c] = 96 if s in "\r\n" else 97
        elif s.isalpha():
            table[c] = 98 + (c * 40503 >> 4) % LETTERS
    return table


_TABLE = _class_table()
N_TAGS = 1 + 2 * len(KINDS)
# A span is begun by its own tag; it cannot be continued from anything else.
FORBIDDEN = np.array(
    [[b > 0 and b % 2 == 0 and a not in (b - 1, b) for b in range(N_TAGS)] for a in range(N_TAGS)]
)

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern would, but each at-sign is looked at once, so long runs cost no retries."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        done = max(done, at + 1)
        at = text.find("@", done)


def _is_ip(found: str) -> bool:
    return all(p.isdigit() and len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found.split("."))


def base_spans(text: str, checked: bool = True) -> list[Span]:
    """Spans of the base patterns. Unchecked, addresses and cards need the form but not the values."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if not checked or _is_ip(m.group()):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and (not checked or luhn(digits)):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def window_starts(text: str) -> list[int]:
    """Starts of overlapping windows that cover every digit and at-sign with room on both sides."""
    starts: list[int] = []
    begin = end = None
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), m.end() + REACH
        if end is not None and a <= end:
            end = b
            continue
        if end is not None:
            starts += _cover(begin, end)
        begin, end = a, b
    return starts + _cover(begin, end) if end is not None else starts


def _cover(begin: int, end: int) -> list[int]:
    return list(range(begin, max(begin + 1, end - WINDOW + STRIDE), STRIDE))


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(points, (1 << 16) - 1)]


def _tags(n: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(n, np.int8)
    for kind, a, b in reversed(spans):
        k = KINDS.index(kind)
        tags[a:b] = 2 + 2 * k
        tags[a] = 1 + 2 * k
    return tags


@dataclass(frozen=True)
class PiiModel:
    """``tagger`` is None if there was nothing to learn from."""

    tagger: Tagger | None


def with_insertion(rng: random.Random, text: str, tags: np.ndarray, held_out: bool = False) -> tuple[str, np.ndarray]:
    """The text with something put between two of its words, where no span is, and its tags."""
    places = [i for i, c in enumerate(text) if c in " \n" and (i + 1 >= len(text) or tags[i + 1] % 2 or not tags[i + 1])] or [len(text)]
    at = rng.choice(places)
    put, kind, a, b = insertion(rng, held_out)
    inner = _tags(len(put), [(kind, a, b)] if kind else [])
    return f"{text[:at]} {put}{text[at:]}", np.concatenate([tags[:at], [0], inner, tags[at:]]).astype(np.int8)


def fit_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            max_train_docs: int = 30_000, max_windows: int = 2_000) -> PiiModel:
    """Train on at most ``max_windows`` windows of at most ``max_train_docs`` documents, by id hash."""
    fraction = bounded_fraction(docs.count(), max_train_docs)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                rows = []
                for row, text in enumerate(texts):
                    starts = window_starts(text)
                    if starts:
                        tags = _tags(len(text), base_spans(text, checked=False))
                        rows += [(row, s, text[s : s + WINDOW], tags[s : s + WINDOW].tobytes()) for s in starts]
                if rows:
                    at, start, words, tags = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(at)), pa.array(start, pa.int32()),
                         pa.array(words, pa.string()), pa.array(tags, pa.binary())],
                        ["id", "start", "words", "tags"])

    windows = (
        docs.where(in_sample(id_col, fraction))
        .select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))
        .mapInArrow(read, "id string, start int, words string, tags binary")
        .orderBy(F.xxhash64("id", "start"), "id", "start", "words")
        .limit(max_windows)
    )
    # The bounded sample is fitted in one task, where numpy keeps to the task's own core.
    fitted = windows.select("words", "tags").mapInArrow(_fit, "model binary").first()
    return PiiModel(Tagger(**pickle.loads(bytes(fitted["model"]))) if fitted else None)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    given: list[tuple[str, np.ndarray]] = []
    for batch in batches:
        given += zip(batch.column(0).to_pylist(), [np.frombuffer(t, np.int8) for t in batch.column(1).to_pylist()])
    if not given:
        return
    rng = random.Random(5)
    rows = [(*pair, 0) for pair in given]
    for _ in range(-(-MADE // len(given))):
        for words, tags in given:
            made = with_insertion(rng, words, tags)
            rows.append((*made, rng.randint(0, len(made[0]) - len(words))))
    x, y = np.zeros((len(rows), WINDOW), np.uint8), np.zeros((len(rows), WINDOW), np.int8)
    for i, (words, tags, start) in enumerate(rows):
        part = slice(start, start + WINDOW)
        codes = _codes(words)[part]
        x[i, : len(codes)], y[i, : len(codes)] = codes, tags[part]
    # A window may begin inside a span; its first tag then counts as the beginning.
    inner = (y[:, 0] > 0) & (y[:, 0] % 2 == 0)
    y[inner, 0] -= 1
    tagger = train(x, y, CLASSES, N_TAGS, FORBIDDEN)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(tagger))], pa.binary())], ["model"])


def _spans_of(tags: np.ndarray, offset: int) -> Iterator[Span]:
    """Spans of a tag sequence; a continuation of another kind begins a span."""
    begin, kind = 0, -1
    for i, tag in enumerate([*tags.tolist(), 0]):
        now = (tag - 1) // 2 if tag else -1
        if kind >= 0 and (now != kind or tag % 2 == 1):
            yield KINDS[kind], offset + begin, offset + i
            kind = -1
        if now >= 0 and kind < 0:
            begin, kind = i, now


def _in_isbn(text: str, a: int, b: int) -> bool:
    return any(m.start() < b and a < m.end() for m in _ISBN.finditer(text, max(0, a - 17), b + 17))


def _fits(kind: str, text: str, a: int, b: int) -> bool:
    """Whether a span of the tagger can be of its kind: its form, its values, and no half of a longer word or number."""
    found = text[a:b]
    if b - a > LONGEST or (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
        return False
    if kind == "email":
        return bool(_MAIL.fullmatch(_MAIL_DOT.sub(".", _AT.sub("@", found))))
    if kind == "ip":
        parts = _IP_DOT.split(found)
        return len(parts) == 4 and _is_ip(".".join(parts))
    digits = "".join(c for c in found if c in "0123456789")
    if kind == "card":
        return 16 <= len(digits) <= 19 and bool(_CARD_LIKE.fullmatch(found)) and luhn(digits)
    return (
        8 <= len(digits) <= 15 and bool(_PHONE_LIKE.fullmatch(found)) and (found != digits or found[0] == "0")
        and not _NO_PHONE.fullmatch(found) and not _in_isbn(text, a, b)
    )


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A span without the white space and stops around it."""
    while a < b and (text[a].isspace() or text[a] in ".,;:"):
        a += 1
    while a < b and (text[b - 1].isspace() or text[b - 1] in ".,;:"):
        b -= 1
    return a, b


def _stretches(starts: list[int]) -> list[tuple[int, int]]:
    """Ranges of windows that overlap or touch each other."""
    cuts = [0] + [k for k in range(1, len(starts)) if starts[k] > starts[k - 1] + WINDOW] + [len(starts)]
    return list(zip(cuts, cuts[1:]))


def added_spans(texts: list[str], base: list[list[Span]], model: PiiModel) -> list[list[Span]]:
    """The tagger's spans that overlap no base span."""
    out: list[list[Span]] = [[] for _ in texts]
    if model.tagger is None:
        return out
    weight = 1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.float32)[:, None]
    places: list[tuple[int, int]] = []  # text and begin of each stretch
    sums: list[np.ndarray] = []
    waiting: list[tuple[int, int, np.ndarray]] = []  # stretch, offset, codes

    def flush() -> None:
        if waiting:
            scores = emissions(model.tagger, np.stack([codes for _, _, codes in waiting]))
            for (k, at, _), one in zip(waiting, scores):
                sums[k][at : at + WINDOW, :-1] += one * weight
                sums[k][at : at + WINDOW, -1:] += weight
            waiting.clear()

    for row, text in enumerate(texts):
        starts = window_starts(text)
        if not starts:
            continue
        codes = _codes(text)
        codes = np.concatenate([codes, np.zeros(WINDOW, codes.dtype)])
        for i, j in _stretches(starts):
            places.append((row, starts[i]))
            sums.append(np.zeros((starts[j - 1] + WINDOW - starts[i], N_TAGS + 1), np.float32))
            for s in starts[i:j]:
                waiting.append((len(places) - 1, s - starts[i], codes[s : s + WINDOW]))
                if len(waiting) == 512:
                    flush()
    flush()
    paths = best_paths(model.tagger, [x[:, :-1] / x[:, -1:] for x in sums])
    covered: dict[int, bytearray] = {}
    for (row, begin), tags in zip(places, paths):
        text = texts[row]
        for kind, a, b in _spans_of(tags, begin):
            a, b = _trimmed(text, a, min(b, len(text)))
            if a >= b or not _fits(kind, text, a, b):
                continue
            if row not in covered:
                covered[row] = bytearray(len(text))
                for _, x, y in base[row]:
                    covered[row][x:y] = b"\1" * (y - x)
            if covered[row].find(1, a, b) < 0:
                out[row].append((kind, a, b))
    return out


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _struct_lists(rows: list[list[Span]]) -> pa.Array:
    return pa.array(
        [[{"kind": k, "start": a, "end": b} for k, a, b in row] for row in rows],
        pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])),
    )


def find_pii(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, base, spans)``: the base spans, and all spans, ordered by kind and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, model)
                every = [_ordered(b + m) for b, m in zip(base, more)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _struct_lists(base), _struct_lists(every)], ["id", "base", "spans"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return (
        docs.select(F.col(id_col), F.col(text_col))
        .mapInArrow(run, f"id {kind}, base {_SPAN_TYPE}, spans {_SPAN_TYPE}")
        .withColumnRenamed("id", id_col)
    )


def masked(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by the first one's kind in brackets."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def redact(text: Column | str, model: PiiModel) -> Column:
    """Text column with all spans replaced by their kind. Null stays null."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in parts:
            out: list[str | None] = []
            group: list[str] = []
            for at, t in enumerate(series):
                group.append("" if t is None else t)
                if at + 1 < len(series) and len(group) < 500:
                    continue
                base = [base_spans(x) for x in group]
                more = added_spans(group, base, model)
                out += [masked(x, b + m) for x, b, m in zip(group, base, more)]
                group = []
            yield pd.Series([None if was is None else now for was, now in zip(series, out)], dtype=object)

    return run(text)


def span_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
