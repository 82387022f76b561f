"""WARC archives with segmented records: writing, and reassembly on reading.

Writing. A page is an HTTP response whose body is framed in chunks. Of pages with equal bodies of at
least ``min_revisit`` bytes the one with the largest id is stored as a response, the others as
revisits of it. A block longer than ``segment_bytes`` is cut into segments: the first is the
response with ``WARC-Segment-Number: 1``, the others are continuation records that name the
first by ``WARC-Segment-Origin-ID``; the last tells the total length. Spark writes the records as text
files whose line end is the end of a record, so every task writes archives of its own to any store.

Reading. Files are split at the version line of a record. Chunk borders cut every ``WARC/1.1`` of a body, segment borders none
that is left, and a URL's is escaped, so whatever line ends follow, neither block nor header holds that line. Records without segments are decoded on the spot. Continuations and their first records are grouped by
origin and ordered by segment number; the total length is verified, then the chunked framing is taken off.

Defined cases: a null or empty page has an empty body, which is a response. A page with a null id is
written under the id ``null`` and read as such. Repeated ids get one record each, told apart by a number.
A record whose segments are missing, or whose length or another number is wrong or no number, is read with ``complete`` false and without
a body. What has no ``WARC-Record-ID`` is no record. Archives are read by their version, 1.1 unless told; a file of another one ends
the reading with an error, as its records could not be told apart.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewatch.sources.tables import materialize

NAME = b"WARC/1.1"
VERSION = NAME + b"\r\n"
END = "\r\n\r\n"
CHUNK = 4096
MIN_REVISIT = 1000
SEGMENT = 16_384
_DATE = "2024-01-01T00:00:00Z"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """HTTP chunked framing. A chunk ends inside every ``WARC/1.1`` of the body, as the line end after a chunk would
    make a version line of one at its end."""
    cuts = {*range(0, len(body), size)} | {m.start() + 5 for m in re.finditer(re.escape(NAME), body)}
    edges = [*sorted(cuts), len(body)]
    parts = [b"%x\r\n%b\r\n" % (b - a, body[a:b]) for a, b in zip(edges, edges[1:]) if b > a]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes | None:
    """The body of a chunked framing, or None if it is broken."""
    out, at = [], 0
    while True:
        line = framed.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(framed[at:line].split(b";")[0], 16)
        except ValueError:
            return None
        at = line + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or framed[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(framed[at : at + size])
        at += size + 2


def segments(block: bytes, size: int) -> list[bytes]:
    """Pieces of at most ``size`` bytes; none ends with ``WARC/1.1``, which the end of its record would make a version line."""
    out, at = [], 0
    while at < len(block):
        end = min(at + size, len(block))
        if block[at:end].endswith(NAME):
            end -= 3
        out.append(block[at:end])
        at = end
    return out or [b""]


def _record(kind: str, record_id: str, uri: str, block: bytes, **fields: str | int) -> bytes:
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": _DATE, "WARC-Target-URI": uri,
        **{k.replace("_", "-"): str(v) for k, v in fields.items()},
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return VERSION + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block


def _uri(url: str | None) -> str:
    """A URL as a header value: white space is escaped, and the dot of a ``WARC/1.1`` at the end of the line."""
    uri = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url or "")
    return re.sub(r"WARC/1\.1$", "WARC/1%2E1", uri)


def _write_page(page: str, serial: int, url: str, body: bytes, digest: str, refers_to: str | None,
                segment_bytes: int) -> list[bytes]:
    record_id = f"urn:page:{page}:{serial}"
    http = f"HTTP/1.1 200 OK\r\nX-Payload-Length: {len(body)}\r\n"
    if refers_to is not None:
        block = f"{http}\r\n".encode()
        return [_record("revisit", record_id, url, block, **{
            "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Refers-To": f"<urn:page:{refers_to}>",
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"})]
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(body)
    pieces = segments(block, segment_bytes)
    named = {"WARC-Payload-Digest": f"sha1:{digest}"}
    if len(pieces) == 1:
        return [_record("response", record_id, url, block, **named)]
    out = [_record("response", record_id, url, pieces[0], **named, **{"WARC-Segment-Number": 1})]
    for number, piece in enumerate(pieces[1:], 2):
        last = {"WARC-Segment-Total-Length": len(block)} if number == len(pieces) else {}
        out.append(_record("continuation", f"{record_id}:{number}", url, piece, **{
            "WARC-Segment-Origin-ID": f"<{record_id}>", "WARC-Segment-Number": number}, **last))
    return out


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
               min_revisit: int = MIN_REVISIT, segment_bytes: int = SEGMENT) -> None:
    """Write all pages as archives below ``path``."""
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).alias("page"), F.col(url_col).alias("url"), body.alias("body"),
        F.when(F.octet_length(body) >= min_revisit, F.sha2(body, 256)).alias("same"),
    )
    # Grouped on digests alone: equal bodies meet in a partial aggregate, however many there are.
    keepers = rows.where("same IS NOT NULL").groupBy("same").agg(F.max("page").alias("keeper"), F.count("*").alias("n"))
    # As a table its size is known, so the join sends it to all tasks if it is small and only else moves bodies.
    keepers = materialize(keepers.where("n > 1").drop("n"), "keepers")
    joined = rows.join(keepers, "same", "left").select(
        F.col("page").cast("string"), F.col("keeper").cast("string"), "url", "body",
        F.monotonically_increasing_id().alias("serial"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records: list[bytes] = []
            size = 0
            for page, keeper, url, content, serial in zip(*(batch.column(i).to_pylist() for i in range(5))):
                digest = hashlib.sha1(content).hexdigest()
                refers = keeper if keeper is not None and keeper != page else None
                records += _write_page("null" if page is None else page, serial, _uri(url), content, digest, refers,
                                       segment_bytes)
                size += len(content)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])
                    records, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

    # A cast of bytes to text keeps them as they are; the text writer writes them so.
    records = joined.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", END).text(path)


def _number(text: str | None) -> int | None:
    """A count, or None if there is none or it is no number."""
    return int(text) if text and text.isascii() and text.isdigit() and len(text) < 19 else None


def _parse(record: bytes) -> dict | None:
    """Fields and block of a record without its version line; None if it holds no header."""
    head, found, rest = record.partition(b"\r\n\r\n")
    if not found:
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    length = _number(fields.get("content-length"))
    whole = length is not None and length <= len(rest)
    return {"fields": fields, "block": rest[:length] if whole else b"", "whole": whole}


_RECORD = (
    "record_id string, kind string, uri string, digest string, refers_to string, origin string, number int, "
    "total long, whole boolean, block binary"
)
_PAGE = (
    "record_id string, kind string, uri string, digest string, refers_to string, payload_bytes long, "
    "payload_digest string, payload binary, complete boolean"
)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for raw in batch.column(0).to_pylist():
            if raw and re.match(rb"WARC/\d", raw):
                raise ValueError(f"an archive of another version: {raw[:8].decode()}")
            made = _parse(raw) if raw else None
            if made is None:
                continue
            f = made["fields"]
            own = f.get("warc-record-id", "").strip("<>")
            if not own:
                continue
            stated = f.get("warc-segment-number")
            number = _number(stated)
            number = number if number is None or number < 1 << 31 else None
            out.append((
                own, f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-payload-digest"),
                f.get("warc-refers-to", "").strip("<>") or None,
                f.get("warc-segment-origin-id", "").strip("<>") or (own if number is not None else None),
                number, _number(f.get("warc-segment-total-length")), made["whole"] and (number is None) == (stated is None),
                made["block"],
            ))
        yield _table(out, _RECORD)


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds)], list(names))


def _page(row: dict, block: bytes, complete: bool) -> tuple:
    head, _, framed = block.partition(b"\r\n\r\n")
    fields = dict(
        (n.strip().lower(), v.strip()) for n, _, v in (h.partition(b":") for h in head.split(b"\r\n")[1:])
    )
    body = None
    if row["kind"] != "revisit" and complete:
        body = unchunked(framed) if fields.get(b"transfer-encoding") == b"chunked" else framed
    stated = (row["digest"] or "").removeprefix("sha1:")
    if row["kind"] == "revisit":
        size, digest = _number(fields.get(b"x-payload-length", b"").decode("latin-1")), stated
        size = -1 if size is None else size
    else:
        size = -1 if body is None else len(body)
        digest = None if body is None else hashlib.sha1(body).hexdigest()
        complete = complete and digest == stated
    return (row["record_id"], row["kind"], row["uri"], row["digest"], row["refers_to"], size, digest, body, complete)


def _pages_of_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _table([_page(r, r["block"], r["whole"]) for r in batch.to_pylist()], _PAGE)


def _pages_of_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per origin with its segments; verifies numbers and total length."""
    for batch in batches:
        out = []
        for origin, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parts.sort(key=lambda p: p["number"])
            block = b"".join(p["block"] for p in parts)
            complete = (
                [p["number"] for p in parts] == list(range(1, len(parts) + 1))
                and all(p["whole"] for p in parts) and parts[-1]["total"] == len(block)
            )
            first = parts[0] | {"record_id": origin, "kind": parts[0]["kind"]}
            out.append(_page(first, block, complete))
        yield _table(out, _PAGE)


def read_warc(spark: SparkSession, path: str, version: str = "1.1") -> DataFrame:
    """All pages of the archives of a version below ``path``: record, kind, payload and whether it is complete."""
    lines = spark.read.option("lineSep", f"WARC/{version}\r\n").text(path).select(F.col("value").cast("binary"))
    records = lines.mapInArrow(_records, _RECORD)
    whole = records.where("number IS NULL").mapInArrow(_pages_of_whole, _PAGE)
    parts = records.where("number IS NOT NULL")
    fields = [c.split()[0] for c in _RECORD.split(", ") if c.split()[0] != "origin"]
    grouped = parts.groupBy("origin").agg(F.collect_list(F.struct(*fields)).alias("parts"))
    return whole.unionByName(grouped.mapInArrow(_pages_of_segments, _PAGE))
