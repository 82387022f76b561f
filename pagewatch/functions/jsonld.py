"""Canonical JSON, its hash, and the fields of model-card objects."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Fields of a model-card object that are compared.
MODEL_CARD_FIELDS = [
    "name", "version", "datePublished", "releaseDate", "description", "identifier", "license",
    "evaluation", "safety", "safetyMitigations", "allowedUse", "prohibitedUse", "metrics",
    "usageGuidelines",
]


def canonical_or_null(text: Column) -> Column:
    """Key-sorted compact JSON, or null where the text is not JSON."""
    return F.to_json(F.try_parse_json(text))


def canonical_json(text: Column) -> Column:
    """Key-sorted compact JSON; text that is not JSON becomes a JSON string of itself."""
    return F.coalesce(canonical_or_null(text), F.to_json(text.cast("variant")))


def json_hash(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def _is_model_card(obj: dict) -> bool:
    declared = obj.get("@type") or obj.get("type") or []
    labels = declared if isinstance(declared, list) else [declared]
    marked = any(
        mark in str(label).lower() for label in labels for mark in ("model", "softwareapplication")
    )
    return marked or any(key.lower() in ("model", "safety") for key in obj)


def _card_of(text: str | None) -> str | None:
    if text is None:
        return None
    card: dict = {}
    pending = [json.loads(text)]
    while pending:  # document order: a node before its children
        node = pending.pop()
        if isinstance(node, dict):
            if _is_model_card(node):
                card.update((f, node[f]) for f in MODEL_CARD_FIELDS if f in node)
            children = list(node.values())
        else:
            children = node if isinstance(node, list) else []
        pending.extend(reversed(children))
    # A JSON null is no value: a field that turns into null has gone, not changed.
    texts = {field: _compact(value) for field, value in card.items() if value is not None}
    return json.dumps(texts, ensure_ascii=False)


def _compact(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


@F.pandas_udf(StringType())
def _cards(texts: pd.Series) -> pd.Series:
    return texts.map(_card_of, na_action="ignore")


def model_card(canonical: Column) -> Column:
    """Model-card fields found at any depth of a canonical text, as ``{field: JSON text}``.

    Nesting has no bound, which built-in functions cannot follow, so this is the one Arrow
    function of the package. Callers apply it only to rows whose hash has changed.
    """
    return _cards(canonical)
