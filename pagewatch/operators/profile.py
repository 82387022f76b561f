"""Page profile: HTML columns to one ``profile`` struct per capture.

Everything is a chain of projections, so profiling runs where the rows are read and
needs no shuffle. Shared intermediate texts are columns of their own projection: each is
computed once per page, however many fields read it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pagewatch.functions import html as H
from pagewatch.functions import jsonld as J
from pagewatch.functions import text as X
from pagewatch.functions.headers import header
from pagewatch.functions.urls import authority

def parse_error(status: Column, content_type: Column, failed: Column) -> Column:
    """Why an answered capture cannot be profiled; null where it can, or where none came."""
    lowered = F.lower(F.coalesce(content_type, F.lit("")))
    status_text = F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" - Cannot parse HTML"))
    return (
        F.when(failed, F.lit(None).cast("string"))
        .when(status != 200, status_text)
        .when(
            ~F.contains(lowered, F.lit("text/html")),
            F.concat(F.lit("Non-HTML content type: "), lowered),
        )
    )


def _structured_json() -> Column:
    """Canonical text of all structured data of a page."""
    micro = F.col("_micro")
    micro_json = F.when(
        micro["item_count"] > 0,
        F.concat(
            F.lit('{"item_count":'), micro["item_count"].cast("string"), F.lit(',"sample_types":'),
            F.to_json(micro["sample_types"]), F.lit("}"),
        ),
    ).otherwise(F.lit("{}"))
    return F.concat(
        F.lit('{"json_ld":['), F.array_join("_json_ld", ","), F.lit('],"microdata":'), micro_json,
        F.lit("}"),
    )


def with_page_fields(captures: DataFrame) -> DataFrame:
    """Add the intermediate columns of a profile; captures that are not parsed get nulls."""
    # A capture without a status is a transport failure: it has no profile at all.
    failed = F.col("status_code").isNull() | F.col("error").isNotNull()
    content_type = header(F.col("headers"), "content-type")
    gated = captures.withColumn("_content_type", content_type).withColumn(
        "_parse_error", parse_error(F.col("status_code"), F.col("_content_type"), failed)
    )
    gated = gated.withColumn("_failed", failed).withColumn(
        "_html", F.when(~F.col("_failed") & F.col("_parse_error").isNull(), F.coalesce("html", F.lit("")))
    )
    documents = gated.withColumn("_doc", H.visible_document(F.col("_html")))
    reduced = documents.withColumn("_reduced", H.reduced_document(F.col("_doc")))
    # Tags come off in a step of their own, which stays inside generated code.
    bare = reduced.withColumn("_bare", H.drop_tags(F.col("_reduced")))
    texts = bare.withColumn("_raw", X.decode_entities(F.col("_bare"))).withColumns(
        {"_text": X.collapse_spaces(F.col("_raw")), "_lower": F.lower("_raw")}
    ).withColumns(
        {"_folded": X.fold_case(F.col("_raw"), F.col("_lower")), "_hits": X.phrase_hits(F.col("_lower"))}
    )
    # Counts are columns before they meet a condition: a branch would compute them twice.
    counted = texts.withColumns(
        {f"_n_{category}": n for category, n in X.hit_counts(F.col("_hits"), F.col("_lower")).items()}
    ).withColumns(
        {
            "_versions": X.version_marks(F.col("_raw"), F.col("_folded")),
            "_dates": X.date_marks(F.col("_raw"), F.col("_folded")),
            "_tag_names": H.tag_names(F.col("_reduced")),
        }
    )
    tags = counted.withColumns(
        {
            "_metas": H.meta_tags(F.col("_doc")),
            "_items": H.item_types(F.col("_doc")),
            "_anchors": H.anchor_fields(H.anchors(F.col("_doc"))),
            "_json_ld": F.filter(
                F.transform(H.json_ld_bodies(F.col("_html")), J.canonical_or_null),
                lambda body: body.isNotNull(),
            ),
        }
    )
    entries = tags.withColumns(
        {
            "_og": H.prefixed_entries(F.col("_metas"), "property", "og:"),
            "_twitter": H.prefixed_entries(F.col("_metas"), "name", "twitter:"),
            "_other": H.other_entries(F.col("_metas")),
            "_micro": H.microdata(F.col("_items")),
        }
    )
    return entries.withColumns(
        {
            "_og_keys": F.reverse(F.col("_og")["key"]),
            "_twitter_keys": F.reverse(F.col("_twitter")["key"]),
            "_other_keys": F.reverse(F.col("_other")["key"]),
            "_structured": F.when(F.col("_html").isNotNull(), _structured_json()),
            "_page_domain": authority(F.coalesce("final_url", "url")),
        }
    )


def _content(parts: list[str] | None = None) -> Column:
    names, clean = F.col("_tag_names"), F.col("_text")
    counts = {category: F.col(f"_n_{category}") for category in X.POLICY_PHRASES}
    built = {
        "word_count": lambda: X.word_count(clean),
        "text_preview": lambda: X.preview(clean),
        "headings": lambda: H.heading_counts(names),
        "image_count": lambda: H.tag_count(names, "img"),
        "has_main_content": lambda: H.has_main_content(F.col("_reduced"), names),
        "paragraph_count": lambda: H.tag_count(names, "p"),
        "list_count": lambda: H.tag_count(names, "ul", "ol"),
        **{f"{category}_keyword_count": lambda c=c: c for category, c in counts.items()},
        "version_indicators": lambda: F.col("_versions"),
        "date_indicators": lambda: F.col("_dates"),
        "has_legal_language": lambda: F.greatest(*counts.values()) > 0,
    }
    return F.struct(*[built[name]().alias(name) for name in (parts or built)])


def _forms() -> Column:
    return F.coalesce(H.has_tag(F.col("_tag_names"), "form"), F.lit(False))


def _comments() -> Column:
    return F.coalesce(H.has_comment_text(F.col("_reduced"), F.col("_raw")), F.lit(False))


def _charset() -> Column:
    parsed_type = F.when(F.col("_html").isNotNull(), F.col("_content_type"))
    return H.page_charset(F.col("_metas"), parsed_type)


# Profile fields over the intermediate columns; only those asked for are built.
PROFILE_FIELDS: dict[str, Callable[[], Column]] = {
    "error": lambda: F.col("_parse_error"),
    "title": lambda: H.title(F.col("_doc")),
    "meta_description": lambda: H.meta_description(F.col("_metas")),
    "canonical_url": lambda: H.canonical_link(F.col("_doc")),
    "og_metadata": lambda: H.last_wins(F.col("_og"), F.col("_og_keys")),
    "twitter_metadata": lambda: H.last_wins(F.col("_twitter"), F.col("_twitter_keys")),
    "other_metadata": lambda: H.last_wins(F.col("_other"), F.col("_other_keys")),
    "json_ld": lambda: F.col("_json_ld"),
    "microdata": lambda: F.when(F.col("_micro.item_count") > 0, F.col("_micro")),
    "structured_canonical": lambda: F.col("_structured"),
    "structured_hash": lambda: J.json_hash(F.col("_structured")),
    "important_links": lambda: H.page_links(F.col("_anchors"), F.col("_page_domain")),
    "content_analysis": lambda: F.when(F.col("_html").isNotNull(), _content()),
    "language": lambda: H.page_language(F.col("_doc")),
    "charset": _charset,
    "has_forms": _forms,
    "has_comments": _comments,
}


def profile_captures(captures: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Replace ``html`` by ``profile``.

    A capture that failed in transport has a null profile; one that answered but cannot be
    parsed has a profile with ``error`` set and empty fields. ``fields`` keeps only some
    profile fields, and the others are then never computed; ``content_analysis.<part>`` keeps some parts of
    the content analysis only. Spark would compute them all, as the struct stands in a condition.
    """
    fields = fields or list(PROFILE_FIELDS)
    parts = [name.removeprefix("content_analysis.") for name in fields if name.startswith("content_analysis.")]
    chosen = [PROFILE_FIELDS[name]().alias(name) for name in fields if name in PROFILE_FIELDS]
    if parts:
        content = F.when(F.col("_html").isNotNull(), _content(parts))
        chosen.append(content.alias("content_analysis"))
    kept = [c for c in captures.columns if c != "html"]
    profile = F.when(~F.col("_failed"), F.struct(*chosen)).alias("profile")
    return with_page_fields(captures).select(*kept, profile)
