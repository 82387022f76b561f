"""One query per operator of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewatch.llm.bpe import BpeCodec, encode_texts
from pagewatch.llm.common import crc_bucket, documents
from pagewatch.llm.conversations import damaged_turns, ordered_turns, repaired_digest, repaired_turns, repairs
from pagewatch.llm.decontaminate import benchmark_overlaps
from pagewatch.llm.hilbert import hilbert_shards
from pagewatch.llm.jaccard import jaccard_classes
from pagewatch.llm.multiset import edit_likeness
from pagewatch.llm.oracle import ORACLES as ORACLES
from pagewatch.llm.phrases import collocations
from pagewatch.llm.pii import KINDS, find_pii, fit_pii, span_text
from pagewatch.llm.secrets import BASE, find_secrets, secret_text
from pagewatch.llm.suffix_tree import score_texts
from pagewatch.llm.token_counts import PieceCounter, token_counts
from pagewatch.llm.toxicity import fit_toxicity, score_toxicity, training_rows
from pagewatch.llm.warc import read_warc, write_warc
from pagewatch.session import shared_dir
from pagewatch.sources.tables import materialize


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_toxicity(docs, training_rows(documents(spark, sf_dir, "labels")))
    return score_toxicity(docs, model)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counter = PieceCounter.from_file(public_tokenizers.path("piece_bpe_32k.model"))
    counted = token_counts(documents(spark, sf_dir), counter)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sharded = hilbert_shards(docs, ["source", "lang", "n_chars"], 24)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_texts(docs, crc_bucket("doc_id", 7) != 2)
    return scored.select(
        "doc_id", (crc_bucket("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score",
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_overlaps(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_warc(documents(spark, sf_dir, "pages"), path)
    page = lambda name: F.element_at(F.split(name, ":"), 3).try_cast("long")
    return read_warc(spark, path).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"),
        page("refers_to").alias("refers_to"), "complete",
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir))


def op8_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = edit_likeness(documents(spark, sf_dir))
    return made.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def _sha256_of_ids(ids: str) -> Column:
    """Lower-case hex digest of the ids as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("string")
    def digest(rows: pd.Series) -> pd.Series:
        return rows.map(lambda row: hashlib.sha256(row.astype("<u4").tobytes()).hexdigest())

    return digest(ids)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = BpeCodec.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoded = encode_texts(documents(spark, sf_dir), codec)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        _sha256_of_ids("ids").alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def _spans_of_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = find_pii(docs, fit_pii(docs))
    return found.select(
        "doc_id",
        *[_spans_of_kind("base", kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *[_spans_of_kind("base", rule.kind).alias(f"n_{rule.kind}") for rule in BASE],
        F.sha2(secret_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secret_text(F.col("spans")).alias("spans"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = documents(spark, sf_dir, "conversations")
    ordered = ordered_turns(damaged_turns(given))
    repaired = materialize(repairs(ordered), "repairs")
    digests = repaired_digest(repaired_turns(ordered, repaired))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    return (
        given.select("conv_id").distinct().withColumn("conv", key)
        .join(repaired, "conv", "left").join(digests, "conv", "left")
        .select(
            "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
        )
    )


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_hilbert_sharding": op3_hilbert_sharding,
    "op4_suffix_tree": op4_suffix_tree,
    "op5_decontaminate": op5_decontaminate,
    "op6_warc": op6_warc,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_multiset_hash": op8_multiset_hash,
    "op9_bpe": op9_bpe,
    "op10_pii": op10_pii,
    "op11_secret_scan": op11_secret_scan,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_phrase_collocations": op13_phrase_collocations,
}
