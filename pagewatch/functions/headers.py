"""Response header maps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Headers that change on every request, and the headers that are compared.
VOLATILE_HEADERS = [
    "date", "server", "set-cookie", "x-request-id", "via", "connection",
    "x-runtime", "x-served-by", "x-cache", "x-cdn", "transfer-encoding",
]
COMPARED_HEADERS = ["last-modified", "etag", "content-type", "content-length", "cache-control"]


def normalize_headers(headers: Column) -> Column:
    """Lower-case keys; of keys that collide, the later entry wins."""
    names = F.transform(F.map_keys(headers), lambda k: F.lower(k))
    backwards = F.reverse(names)
    entries = F.transform(
        F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))
    )
    last = F.filter(
        entries, lambda e, i: F.array_position(backwards, e["key"]) == F.size(backwards) - i
    )
    return F.map_from_entries(last)


def drop_volatile(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, v: ~k.isin(VOLATILE_HEADERS))


def header(headers: Column, name: str) -> Column:
    """Value of one header, whatever the case of its name; the last entry wins."""
    hits = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.try_element_at(hits, F.lit(-1))["value"]
