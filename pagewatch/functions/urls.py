"""URL keys as codegen-friendly column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*:"
_FRONT = rf"^(?:{_SCHEME})?(?://[^/?#]*)?"


def authority(url: Column) -> Column:
    return F.regexp_extract(url, rf"^(?:{_SCHEME})?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    """Path without the parameters (';...') of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, _FRONT + "([^?#]*)", 1), r";[^/]*$", "")


def normalize_url(url: Column) -> Column:
    """History key of a URL: lower-case scheme and host, no default port, query or fragment.

    A chain of single steps: the URL is read three times, however deep it is nested, so the
    expression stays small in generated code.
    """
    front = F.lower(F.regexp_extract(url, _FRONT, 0))
    front = F.regexp_replace(front, r"^(?:(http://[^/]*):80|(https://[^/]*):443)$", "$1$2")
    # Without a scheme a URL counts as http.
    front = F.regexp_replace(front, r"^(?=//|$)", "http:")
    front = F.regexp_replace(front, r"^([^/]*:)$", "$1//")
    tail = F.regexp_replace(path(url), r"(?s)^(.+)/$", "$1")
    return F.when(url.isNull() | (url == ""), url).otherwise(F.concat(front, tail))


def history_key(final_url: Column, url: Column) -> Column:
    return normalize_url(F.coalesce(F.nullif(final_url, F.lit("")), url))


# Lookup order of the candidate keys of a URL.
TIER_RAW, TIER_NORMALIZED, TIER_VARIANT, TIER_DECLARED = 1, 2, 3, 4


def url_variants(url: Column) -> Column:
    """Other spellings of a URL in a fixed order: as it is, http, https, www toggled."""

    def with_scheme(name: str) -> Column:
        has_it = F.startswith(F.lower(url), F.lit(f"{name}:"))
        return F.when(~has_it, normalize_url(F.regexp_replace(url, rf"^(?:{_SCHEME})?", f"{name}:")))

    front = rf"^((?:{_SCHEME})?//)"
    toggled = F.when(
        url.rlike(front + r"www\."), F.regexp_replace(url, front + r"www\.", "$1")
    ).otherwise(F.regexp_replace(url, front, "$1www."))
    forms = F.array(
        normalize_url(url), with_scheme("http"), with_scheme("https"), normalize_url(toggled)
    )
    return F.array_distinct(F.array_compact(forms))


def candidate_keys(url: Column) -> Column:
    """``array<struct<tier, rank, key>>`` of the keys under which a URL may be stored."""

    def entry(tier: int, rank: Column, key: Column) -> Column:
        return F.struct(
            F.lit(tier).alias("tier"), rank.cast("int").alias("rank"), key.alias("key")
        )

    variants = F.transform(url_variants(url), lambda v, i: entry(TIER_VARIANT, i, v))
    return F.concat(
        F.array(
            entry(TIER_RAW, F.lit(0), url), entry(TIER_NORMALIZED, F.lit(0), normalize_url(url))
        ),
        variants,
    )
