"""Change rules: one array of change structs per pair of current and previous capture.

A rule is a condition and the columns of its change row. All rules of a pair are elements
of one array, so they cost one projection, no join and no shuffle. Add your own rules by
passing a longer list to ``changes_array``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pagewatch.functions import jsonld as J
from pagewatch.functions.headers import COMPARED_HEADERS, drop_volatile
from pagewatch.functions.text import POLICY_PHRASES

OG_FIELDS = ["title", "description", "image", "url"]


@dataclass(frozen=True)
class Thresholds:
    content_size: int = 1000
    word_count: int = 50
    word_count_major: int = 100
    policy_keyword_count: int = 2


def differs(a: Column, b: Column) -> Column:
    """Inequality in which two nulls are equal."""
    return ~a.eqNullSafe(b)


def set_differs(a: Column, b: Column) -> Column:
    """Whether two arrays differ as sets; a missing array is empty."""
    nothing = F.array().cast("array<string>")
    left = F.array_sort(F.array_distinct(F.coalesce(a, nothing)))
    right = F.array_sort(F.array_distinct(F.coalesce(b, nothing)))
    return left != right


def _header_field(name: str) -> str:
    return "header_" + name.replace("-", "_")


#: What rules look at in the manifest of linked documents.
SEEN_DOCUMENTS = "MAP<STRING, STRUCT<hash: STRING, status_code: INT>>"


def snapshot(prefix: str = "", documents: bool = False) -> Column:
    """The part of a capture record that rules look at. Headers must be normalised.

    ``documents`` tells whether the records have a manifest; without one, documents are not followed.
    """

    def col(name: str) -> Column:
        return F.col(prefix + name)

    content = col("profile.content_analysis")
    stable = drop_volatile(col("headers"))
    return F.struct(
        col("url").alias("url"),
        col("captured_at").alias("captured_at"),
        col("ordinal").alias("ordinal"),
        col("status_code").alias("status_code"),
        col("final_url").alias("final_url"),
        F.coalesce(col("content_length"), F.lit(0)).cast("bigint").alias("content_length"),
        *[stable[h].alias(_header_field(h)) for h in COMPARED_HEADERS],
        col("profile").isNotNull().alias("has_profile"),
        (col("profile").isNotNull() & col("profile.error").isNull()).alias("is_parsed"),
        col("profile.title").alias("title"),
        col("profile.meta_description").alias("meta_description"),
        col("profile.canonical_url").alias("canonical_url"),
        *[col("profile.og_metadata")[f].alias(f"og_{f}") for f in OG_FIELDS],
        F.coalesce(col("profile.structured_canonical"), F.lit("{}")).alias("structured_canonical"),
        col("profile.other_metadata")["version"].alias("version"),
        F.coalesce(content["word_count"], F.lit(0)).alias("word_count"),
        content["headings"].alias("headings"),
        *[
            F.coalesce(content[f"{c}_keyword_count"], F.lit(0)).alias(f"{c}_keyword_count")
            for c in POLICY_PHRASES
        ],
        F.coalesce(content["version_indicators"], F.array().cast("array<string>")).alias(
            "version_indicators"
        ),
        F.coalesce(content["has_legal_language"], F.lit(False)).alias("has_legal_language"),
        (
            F.transform_values(
                col("documents"),
                lambda _, d: F.struct(d["hash"].alias("hash"), d["status_code"].alias("status_code")),
            ) if documents else F.lit(None).cast(SEEN_DOCUMENTS)
        ).alias("documents"),
    )


@dataclass(frozen=True)
class Rule:
    ordinal: int
    change_type: str
    source: str
    severity: Column | str
    when: Column
    old: Column | None = None
    new: Column | None = None
    field: str | None = None
    policy_alert: bool = False
    delta: Column | None = None
    percent: Column | None = None

    def change(self) -> Column:
        return change_struct(
            self.ordinal, self.change_type, self.source, self.severity, self.policy_alert,
            F.lit(self.field), self.old, self.new, self.delta, self.percent,
        )


def change_struct(
    ordinal: int, change_type: str, source: str, severity: Column | str, policy_alert: bool,
    field: Column, old: Column | None, new: Column | None,
    delta: Column | None = None, percent: Column | None = None,
) -> Column:
    def or_null(value: Column | None, kind: str) -> Column:
        return (F.lit(None) if value is None else value).cast(kind)

    return F.struct(
        F.lit(ordinal).alias("rule_ordinal"),
        F.lit(change_type).alias("change_type"),
        F.lit(source).alias("source"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        F.lit(policy_alert).alias("policy_alert"),
        field.cast("string").alias("field"),
        or_null(old, "string").alias("old_value"),
        or_null(new, "string").alias("new_value"),
        or_null(delta, "double").alias("delta"),
        or_null(percent, "double").alias("change_percent"),
    )


def change_percent(old: Column, new: Column) -> Column:
    return F.abs(new - old) / F.greatest(old, F.lit(1)) * 100


def structured_differs(cur: Column, prev: Column) -> Column:
    """Both profiled, the current page parsed, and the canonical structured data unlike.

    Hashes of equal texts are equal, so the texts are compared and hashed only where a
    change is reported.
    """
    return (
        cur["is_parsed"]
        & prev["has_profile"]
        & (cur["structured_canonical"] != prev["structured_canonical"])
    )


def http_rules(cur: Column, prev: Column, limits: Thresholds) -> list[Rule]:
    source = "http_metadata"
    status = cur["status_code"]
    size = cur["content_length"] - prev["content_length"]
    rules = [
        Rule(
            2, "status_change", source,
            F.when(status >= 400, "high").otherwise("medium"),
            differs(status, prev["status_code"]),
            prev["status_code"], status,
        ),
        Rule(
            3, "redirect_change", source, "medium",
            differs(cur["final_url"], prev["final_url"]), prev["final_url"], cur["final_url"],
        ),
        Rule(
            4, "content_size_change", source, "medium",
            F.abs(size) > limits.content_size,
            prev["content_length"], cur["content_length"],
            delta=size, percent=change_percent(prev["content_length"], cur["content_length"]),
        ),
    ]
    for i, name in enumerate(COMPARED_HEADERS):
        new, old = cur[_header_field(name)], prev[_header_field(name)]
        severity = "low" if name == "last-modified" else "medium"
        rules.append(Rule(5 + i, "header_change", source, severity, differs(new, old), old, new, name))
    return rules


def html_rules(cur: Column, prev: Column, limits: Thresholds) -> list[Rule]:
    source = "html_metadata"
    both = cur["has_profile"] & prev["has_profile"]
    plain = [
        (10, "title_change", "high", "title"),
        (11, "meta_description_change", "medium", "meta_description"),
        (12, "canonical_url_change", "medium", "canonical_url"),
    ]
    rules = [
        Rule(n, kind, source, severity, both & differs(cur[f], prev[f]), prev[f], cur[f])
        for n, kind, severity, f in plain
    ]
    for i, name in enumerate(OG_FIELDS):
        new, old = cur[f"og_{name}"], prev[f"og_{name}"]
        rules.append(
            Rule(13 + i, "opengraph_change", source, "medium", both & differs(new, old), old, new, name)
        )
    rules.append(
        Rule(
            17, "structured_data_change", source, "medium", structured_differs(cur, prev),
            J.json_hash(prev["structured_canonical"]), J.json_hash(cur["structured_canonical"]),
        )
    )
    return rules


def content_rules(cur: Column, prev: Column, limits: Thresholds) -> list[Rule]:
    both = cur["has_profile"] & prev["has_profile"]
    words = cur["word_count"] - prev["word_count"]
    rules = [
        Rule(
            20, "word_count_change", "content_analysis",
            F.when(F.abs(words) > limits.word_count_major, "medium").otherwise("low"),
            both & (F.abs(words) > limits.word_count),
            prev["word_count"], cur["word_count"],
            delta=words, percent=change_percent(prev["word_count"], cur["word_count"]),
        ),
        Rule(
            21, "heading_structure_change", "content_analysis", "low",
            both & differs(cur["headings"], prev["headings"]),
            F.coalesce(F.to_json(prev["headings"]), F.lit("{}")),
            F.coalesce(F.to_json(cur["headings"]), F.lit("{}")),
        ),
        Rule(
            22, "version_change", "policy_analysis", "high",
            both & differs(cur["version"], prev["version"]),
            prev["version"], cur["version"], policy_alert=True,
        ),
    ]
    for i, category in enumerate(POLICY_PHRASES):
        new, old = cur[f"{category}_keyword_count"], prev[f"{category}_keyword_count"]
        rules.append(
            Rule(
                23 + i, "policy_keyword_change", "policy_analysis", "medium",
                both & (F.abs(new - old) > limits.policy_keyword_count),
                old, new, category, True, delta=new - old,
            )
        )
    rules += [
        Rule(
            29, "version_indicator_change", "policy_analysis", "high",
            both & set_differs(cur["version_indicators"], prev["version_indicators"]),
            F.to_json(prev["version_indicators"]), F.to_json(cur["version_indicators"]),
            policy_alert=True,
        ),
        Rule(
            30, "legal_language_change", "policy_analysis", "medium",
            both & (cur["has_legal_language"] != prev["has_legal_language"]),
            prev["has_legal_language"], cur["has_legal_language"], policy_alert=True,
        ),
    ]
    return rules


RuleSet = Callable[[Column, Column, Thresholds], list[Rule]]
DEFAULT_RULES: list[RuleSet] = [http_rules, html_rules, content_rules]


def _model_card_changes(cur_card: Column, prev_card: Column) -> Column:
    changed = F.filter(
        F.array(*[F.lit(f) for f in J.MODEL_CARD_FIELDS]),
        lambda f: differs(cur_card[f], prev_card[f]),
    )
    return F.transform(
        changed,
        lambda f: change_struct(
            18, "model_card_change", "structured_data", "high", True, f, prev_card[f], cur_card[f]
        ),
    )


def document_changes(cur: Column, prev: Column) -> Column:
    """Documents that a page links to newly, no longer, or with another body; in order of their links.

    Only where the current manifest is there. A stored page without one had no documents.
    """
    none = F.create_map().cast(SEEN_DOCUMENTS)

    def change(link: Column, new: Column, old: Column) -> Column:
        def row(kind: str, severity: str) -> Column:
            return change_struct(
                19, f"linked_document_{kind}", "linked_documents", severity, False, link, old["hash"], new["hash"]
            )

        return (
            F.when(old.isNull(), row("added", "medium")).when(new.isNull(), row("removed", "medium"))
            .when(differs(old["hash"], new["hash"]), row("changed", "high"))
        )

    both = F.map_zip_with(cur["documents"], F.coalesce(prev["documents"], none), change)
    return F.transform(
        F.array_sort(F.map_entries(F.map_filter(both, lambda _, c: c.isNotNull()))), lambda e: e["value"]
    )


def with_changes(
    pairs: DataFrame,
    limits: Thresholds = Thresholds(),
    rule_sets: list[RuleSet] | None = None,
) -> DataFrame:
    """Add ``changes`` to rows that hold ``cur`` and ``prev`` snapshots.

    Changes are in rule order. Without a previous snapshot there is one change, the first
    detection; a late capture has none. Model cards are walked only where structured data changed.
    """
    cur, prev = F.col("cur"), F.col("prev")
    rules = [r for build in (rule_sets or DEFAULT_RULES) for r in build(cur, prev, limits)]
    rules.sort(key=lambda r: r.ordinal)

    def fired(chosen: list[Rule]) -> Column:
        return F.array_compact(F.array(*[F.when(r.when, r.change()) for r in chosen]))

    walked = structured_differs(cur, prev)
    cards = pairs.withColumns(
        {
            "_cur_card": F.from_json(
                J.model_card(F.when(walked, cur["structured_canonical"])), "map<string,string>"
            ),
            "_prev_card": F.from_json(
                J.model_card(F.when(walked, prev["structured_canonical"])), "map<string,string>"
            ),
        }
    )
    no_changes = F.array_compact(F.array(F.when(F.lit(False), _first_detection())))
    card_changes = F.when(
        F.col("_cur_card").isNotNull(), _model_card_changes(F.col("_cur_card"), F.col("_prev_card"))
    ).otherwise(no_changes)
    followed = cur["has_profile"] & prev["has_profile"] & cur["documents"].isNotNull()
    late = F.col("is_late") if "is_late" in pairs.columns else F.lit(False)
    changes = (
        F.when(late, no_changes)
        .when(prev.isNull(), F.array(_first_detection()))
        .otherwise(
            F.concat(
                fired([r for r in rules if r.ordinal < 18]),
                card_changes,
                F.when(followed, document_changes(cur, prev)).otherwise(no_changes),
                fired([r for r in rules if r.ordinal > 18]),
            )
        )
    )
    return cards.withColumn("changes", changes).drop("_cur_card", "_prev_card")


def _first_detection() -> Column:
    return change_struct(
        1, "first_detection", "direct_metadata", "low", False, F.lit(None), None,
        F.lit("URL detected for the first time"),
    )


def long_changes(detected: DataFrame, *keys: str) -> DataFrame:
    """One row per change.

    The outer form keeps the optimizer from adding a filter on the array, for which all rules
    would be evaluated a second time.
    """
    return detected.select(*keys, F.inline_outer("changes")).where("rule_ordinal IS NOT NULL")


def policy_changes(changes: DataFrame) -> DataFrame:
    return changes.where("policy_alert")


def changes_per_capture(changes: DataFrame, *keys: str) -> DataFrame:
    """Group long change rows into one record per capture, in rule order.

    A group is one capture; its size is bounded by the rules and the links of that page.
    """
    rest = [c for c in changes.columns if c not in keys and c != "rule_ordinal"]
    return changes.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rule_ordinal", *rest))).alias("changes")
    )
