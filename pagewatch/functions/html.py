"""HTML extraction with regular expressions, inside the JVM.

Contract: tags are well formed; blocks (``script``, ``style``, ``nav``, ``header``, ``footer``, comments, anchors, titles)
end at the first end tag of their name. A block without one runs to the end of the page, so no part of a page is scanned
again for every start: the time is linear. Attributes may come in any order and in any of the three quoting styles.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, functions as F

from pagewatch.functions.text import _once, decode_entities, occurrences, strip

# The rest of a start tag: quoted values may hold '>'. Possessive, so it never backtracks.
_REST = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
_ANY_TAG = rf"(?s)<(?:/?[a-zA-Z](?:{_REST}|[^>]*>)|[!?][^>]*>)"

# Every pattern starts with one plain '<', so the scan skips the text between tags quickly.
# Comments and raw-text blocks go in one alternation, so that neither hides the other.
# A block without an end tag runs to the end of the page: one scan finds that, and nothing is scanned twice.
_OPAQUE = (
    r"(?is)<(?:!--.*?(?:-->|\z)|script\b[^>]*>.*?(?:</script\s*>|\z)|style\b[^>]*>.*?(?:</style\s*>|\z))"
)
_OPAQUE_SCRIPT = r"(?is)<(?:!--.*?(?:-->|\z)|script\b[^>]*>(.*?)(?:</script\s*>|\z))"
_CHROME = (
    r"(?is)<(?:nav\b[^>]*>.*?(?:</nav\s*>|\z)|footer\b[^>]*>.*?(?:</footer\s*>|\z)|header\b[^>]*>.*?(?:</header\s*>|\z))"
)
_ANCHOR = rf"(?is)<a\b{_REST}.*?(?:</a\s*>|\z)"
_TITLE = r"(?is)<title\b[^>]*>.*?(?:</title\s*>|\z)"

_ATTR_NAME = r"[^\s=>\"'/]+"
_ATTR_VALUE = r"(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
# One attribute with the space before it. Possessive throughout: a tag may have any number of them.
_ATTR = rf"[\s/]++{_ATTR_NAME}+(?:\s*+=\s*+{_ATTR_VALUE})?+"


def visible_document(html: Column) -> Column:
    """The document without comments, scripts and styles."""
    return F.regexp_replace(html, _OPAQUE, "")


def reduced_document(document: Column) -> Column:
    """A visible document without its navigation, header and footer blocks."""
    return F.regexp_replace(document, _CHROME, "")


def drop_tags(document: Column) -> Column:
    return F.regexp_replace(document, _ANY_TAG, "")


def document_text(reduced: Column) -> Column:
    """Text of all tags joined without separators, entities decoded."""
    return decode_entities(drop_tags(reduced))


def start_tags(document: Column, name: str) -> Column:
    return F.regexp_extract_all(document, F.lit(rf"(?is)<{name}\b{_REST}"), F.lit(0))


def attribute_list(tag: Column) -> Column:
    """The attributes of a start tag as written, one after the other.

    So a name inside another value cannot match, and the depth of the match does not grow with their number.
    """
    return F.regexp_extract_all(tag, F.lit(rf"(?is)(?:^<[a-z][^\s/>]*+|(?!^)\G)({_ATTR})"), F.lit(1))


def listed_attribute(listed: Column, name: str) -> Column:
    """Value of a listed attribute as written, without quotes: null if absent, '' if it has no value. The last of a name counts."""
    named = F.filter(listed, lambda a: a.rlike(rf"(?is)^[\s/]+{name}(?:\s*=|$)"))
    return F.regexp_replace(
        F.try_element_at(named, F.lit(-1)), rf"(?is)^[\s/]+{name}(?:\s*=\s*[\"']?)?|[\"']\z", ""
    )


def raw_attribute(tag: Column, name: str) -> Column:
    return listed_attribute(attribute_list(tag), name)


def attribute(tag: Column, name: str) -> Column:
    """Attribute value with entities decoded."""
    return decode_entities(raw_attribute(tag, name), keep_unknown=True)


_META_ATTRIBUTES = {
    "name": "name", "property": "property", "http_equiv": "http-equiv",
    "charset": "charset", "content": "content",
}


def meta_tags(document: Column) -> Column:
    """``array<struct<pos, name, property, http_equiv, charset, content>>`` in document order."""
    raw = F.transform(
        F.transform(start_tags(document, "meta"), attribute_list),
        lambda listed: F.struct(*[listed_attribute(listed, a).alias(f) for f, a in _META_ATTRIBUTES.items()]),
    )
    return F.transform(
        raw,
        lambda m, i: F.struct(
            i.alias("pos"),
            *[decode_entities(m[f], keep_unknown=True).alias(f) for f in _META_ATTRIBUTES],
        ),
    )


def title(document: Column) -> Column:
    # Without a title the element is empty. ``regexp_substr`` would search the page twice.
    element = F.regexp_extract(document, _TITLE, 0)
    return _once(element, lambda e: F.when(e != "", strip(decode_entities(drop_tags(e)))))


def first_tag(metas: Column, field: str, value: str) -> Column:
    """The first meta tag whose attribute equals the value, even if its content is empty."""
    return F.get(F.filter(metas, lambda m: m[field] == value), F.lit(0))


def meta_description(metas: Column) -> Column:
    return strip(first_tag(metas, "name", "description")["content"])


def canonical_link(document: Column) -> Column:
    # The token is compared as written, so a byte search spares pages without it the scan for tags.
    links = F.filter(
        F.when(F.contains(document, F.lit("canonical")), start_tags(document, "link")),
        lambda tag: F.array_contains(F.split(raw_attribute(tag, "rel"), r"\s+"), "canonical"),
    )
    return _once(F.get(links, F.lit(0)), lambda tag: F.nullif(strip(attribute(tag, "href")), F.lit("")))


def prefixed_entries(metas: Column, field: str, prefix: str) -> Column:
    """Entries ``(key, value)`` of metas whose attribute starts with a prefix, in any case."""
    hits = F.filter(
        metas, lambda m: F.startswith(F.lower(m[field]), F.lit(prefix)) & (m["content"] != "")
    )
    return F.transform(
        hits,
        lambda m: F.struct(
            F.replace(F.lower(m[field]), F.lit(prefix), F.lit("")).alias("key"),
            m["content"].alias("value"),
        ),
    )


def last_wins(entries: Column, backward_keys: Column) -> Column:
    """Map of an entry array, where the last entry of a key wins.

    ``backward_keys`` holds the keys from last to first. Pass it as a column of an earlier
    projection: an expression would be evaluated again for every entry.
    """
    return F.map_from_entries(
        F.filter(
            entries,
            lambda e, i: F.array_position(backward_keys, e["key"]) == F.size(backward_keys) - i,
        )
    )


# Named meta tags that are kept, names compared with exact case.
OTHER_META_NAMES = [
    "keywords", "author", "viewport", "robots", "generator", "theme-color",
    "msapplication-TileColor", "application-name",
]


def other_entries(metas: Column) -> Column:
    """The first tag of each listed name, then the http-equiv tags in document order."""

    def of_name(name: str) -> Column:
        content = first_tag(metas, "name", name)["content"]
        entry = F.struct(F.lit(name).alias("key"), content.alias("value"))
        return F.when(content != "", entry)

    named = F.array_compact(F.array(*[of_name(n) for n in OTHER_META_NAMES]))
    equivs = F.filter(metas, lambda m: (m["http_equiv"] != "") & (m["content"] != ""))
    http_equiv = F.transform(
        equivs,
        lambda m: F.struct(
            F.concat(F.lit("http_equiv_"), F.lower(m["http_equiv"])).alias("key"),
            m["content"].alias("value"),
        ),
    )
    return F.concat(named, http_equiv)


def json_ld_bodies(html: Column) -> Column:
    """Bodies of JSON-LD scripts that are not inside a comment."""
    # The type is compared as written, so a byte search spares pages without it the scan for blocks.
    possible = html.isNull() | F.contains(html, F.lit("application/ld+json"))
    blocks = F.when(possible, F.regexp_extract_all(html, F.lit(_OPAQUE_SCRIPT), F.lit(0))).otherwise(
        F.array().cast("array<string>")
    )
    scripts = F.filter(
        blocks,
        lambda b: F.startswith(F.lower(b), F.lit("<script"))
        & (
            raw_attribute(F.regexp_substr(b, F.lit(r"(?s)^<[^>]*>")), "type")
            == "application/ld+json"
        ),
    )
    # A block is one match, from its start tag to its end tag, if it has one.
    return F.transform(scripts, lambda b: F.regexp_extract(b, r"(?is)^<script\b[^>]*>(.*?)(?:</script\s*>)?\z", 1))


def item_types(document: Column) -> Column:
    """Values of the ``itemtype`` attribute of all tags that carry one."""
    # Byte searches for a rare part of the name, in any case, spare pages without it the scan for tags.
    possible = document.isNull()
    for part in map("".join, product("mM", "tT", "yY")):
        possible = possible | F.contains(document, F.lit(part))
    tags = F.when(
        possible,
        F.regexp_extract_all(
            document, F.lit(rf"(?is)<[a-z][^\s/>]*(?=[\s/])(?=[^>]*\bitemtype\b){_REST}"), F.lit(0)
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_compact(F.transform(tags, lambda tag: raw_attribute(tag, "itemtype")))


def microdata(types: Column) -> Column:
    """Number of items and the distinct types of the first five."""
    first = F.filter(F.slice(types, 1, 5), lambda t: t != "")
    return F.struct(
        F.size(types).alias("item_count"),
        F.array_sort(F.array_distinct(first)).alias("sample_types"),
    )


# Domains of social links, and link schemes that are skipped.
SOCIAL_DOMAINS = ["facebook.com", "twitter.com", "linkedin.com", "instagram.com", "youtube.com"]
SKIPPED_SCHEMES = ["javascript:", "mailto:", "tel:"]
LINK_TEXT_CHARS = 100


def anchors(document: Column) -> Column:
    return F.regexp_extract_all(document, F.lit(_ANCHOR), F.lit(0))


def anchor_fields(anchors_: Column) -> Column:
    """``array<struct<pos, href, title, text>>`` of the anchors that carry an href."""
    start = rf"(?is)^<a\b{_REST}"
    listed = F.transform(
        anchors_,
        lambda a, i: F.struct(
            i.alias("pos"), a.alias("anchor"), attribute_list(F.regexp_extract(a, start, 0)).alias("listed")
        ),
    )
    raw = F.transform(
        listed,
        lambda a: F.struct(
            a["pos"].alias("pos"),
            listed_attribute(a["listed"], "href").alias("href"),
            listed_attribute(a["listed"], "title").alias("title"),
            F.transform(
                F.split(a["anchor"], _ANY_TAG, -1), lambda piece: strip(decode_entities(piece))
            ).alias("texts"),
        ),
    )
    return F.transform(
        F.filter(raw, lambda a: a["href"].isNotNull()),
        lambda a: F.struct(
            a["pos"].alias("pos"),
            strip(decode_entities(a["href"], keep_unknown=True)).alias("href"),
            F.coalesce(decode_entities(a["title"], keep_unknown=True), F.lit("")).alias("title"),
            F.array_join(a["texts"], "").alias("text"),
        ),
    )


def is_followed(href: Column) -> Column:
    """Neither empty nor of a scheme that names no page."""
    skipped = F.lit(False)
    for prefix in SKIPPED_SCHEMES:
        skipped = skipped | F.startswith(F.lower(href), F.lit(prefix))
    return (href != "") & ~skipped


def link_category(href: Column, page_domain: Column) -> Column:
    lowered = F.lower(href)
    social = F.lit(False)
    for domain in SOCIAL_DOMAINS:
        social = social | F.contains(lowered, F.lit(domain))
    own = F.startswith(lowered, F.lit("/")) | ((page_domain != "") & F.contains(lowered, page_domain))
    return F.when(own, "internal").when(social, "social").otherwise("external")


def page_links(fields: Column, page_domain: Column) -> Column:
    """``array<struct<category, url, text, title, pos>>``."""
    return F.transform(
        F.filter(fields, lambda a: is_followed(a["href"])),
        lambda a: F.struct(
            link_category(a["href"], page_domain).alias("category"),
            a["href"].alias("url"),
            F.left(a["text"], F.lit(LINK_TEXT_CHARS)).alias("text"),
            F.left(a["title"], F.lit(LINK_TEXT_CHARS)).alias("title"),
            a["pos"].alias("pos"),
        ),
    )


COUNTED_TAGS = "h[1-6]|img|p|ul|ol|main|article|form"


def tag_names(reduced: Column) -> Column:
    """Names of the counted start tags as one text, ``<h1><p><p>``: one pass for all counts."""
    names = F.regexp_extract_all(reduced, F.lit(rf"(?i)<({COUNTED_TAGS})(?=[\s/>])"), F.lit(1))
    return F.lower(F.concat(F.lit("<"), F.array_join(names, "><"), F.lit(">")))


def tag_count(names: Column, *tags: str) -> Column:
    counts = [occurrences(names, f"<{tag}>") for tag in tags]
    return counts[0] if len(counts) == 1 else counts[0] + counts[1]


def heading_counts(names: Column) -> Column:
    return F.struct(*[tag_count(names, f"h{n}").alias(f"h{n}") for n in range(1, 7)])


def has_tag(names: Column, *tags: str) -> Column:
    found = F.lit(False)
    for tag in tags:
        found = found | F.contains(names, F.lit(f"<{tag}>"))
    return found


def has_main_content(reduced: Column, names: Column) -> Column:
    by_class = reduced.rlike(
        rf"(?is)<[a-z][^\s/>]*+(?:(?![\s/]+class\s*=){_ATTR})*+[\s/]++class\s*=\s*"
        r"(?:\"[^\"]*(?:content|main)|'[^']*(?:content|main)|[^\s\"'>]*(?:content|main))"
    )
    return has_tag(names, "main", "article") | by_class


def has_comment_text(reduced: Column, text: Column) -> Column:
    """Whether one text node shows comment marks; real comments are no text."""
    shown = F.exists(
        F.split(reduced, _ANY_TAG, -1),
        lambda node: F.contains(decode_entities(node), F.lit("<!--"))
        & F.contains(decode_entities(node), F.lit("-->")),
    )
    possible = F.contains(text, F.lit("<!--")) & F.contains(text, F.lit("-->"))
    return F.when(possible, shown).otherwise(False)


def page_language(document: Column) -> Column:
    tag = F.regexp_extract(document, rf"(?is)<html\b{_REST}", 0)
    return _once(tag, lambda t: F.when(t != "", F.nullif(strip(attribute(t, "lang")), F.lit(""))))


def _charset_of(content_type: Column) -> Column:
    # An upper-case CHARSET= names no charset.
    value = strip(F.regexp_extract(content_type, r"charset=([^;]*)", 1))
    return F.when(F.contains(content_type, F.lit("charset=")), value)


def page_charset(metas: Column, content_type: Column) -> Column:
    declared = F.get(F.filter(metas, lambda m: m["charset"].isNotNull()), F.lit(0))["charset"]
    equiv = F.get(
        F.filter(metas, lambda m: F.contains(F.lower(m["http_equiv"]), F.lit("content-type"))), F.lit(0)
    )["content"]
    return (
        F.when(declared.isNotNull(), F.nullif(strip(declared), F.lit("")))
        .when(F.contains(F.lower(equiv), F.lit("charset=")), _charset_of(equiv))
        .otherwise(_charset_of(content_type))
    )
