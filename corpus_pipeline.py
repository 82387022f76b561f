"""The training-data pipeline: toxicity, near duplicates, benchmark leaks, personal data, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewatch.llm.bpe import BpeCodec, encode_texts
from pagewatch.llm.common import documents
from pagewatch.llm.decontaminate import benchmark_overlaps
from pagewatch.llm.jaccard import jaccard_classes
from pagewatch.llm.pii import fit_pii, redact
from pagewatch.llm.toxicity import fit_toxicity, toxicity_score, training_rows
from pagewatch.session import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the model's threshold."""
    model = fit_toxicity(docs, training_rows(documents(spark, sf_dir, "labels")))
    return docs.where(toxicity_score(F.col("text"), model) < model.threshold)


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with a key of their own: ids may be null, or come with different texts."""
    return docs.withColumn("_key", F.xxhash64("doc_id", "text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class, once; one without an id if none of its class has one."""
    keyed = _keyed(docs)
    classes = jaccard_classes(keyed, id_col="_key").select("_key", "class_id").distinct()
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_key"))
    kept = keyed.select("doc_id", "_key").join(classes, "_key").groupBy("class_id").agg(F.min(first)["_key"].alias("_key"))
    return keyed.join(kept.select("_key"), "_key", "left_semi").dropDuplicates(["_key"]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an accepted overlap with a benchmark item, each by its own text."""
    keyed = _keyed(docs)
    overlaps = benchmark_overlaps(keyed, documents(spark, sf_dir, "benchmark"), id_col="_key")
    return keyed.join(overlaps.select("_key").distinct(), "_key", "left_anti").select(docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` follows the text."""
    cleaned = docs.withColumn("text", redact(F.col("text"), fit_pii(docs)))
    return cleaned.withColumn(
        "n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    )


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: ``doc_id, n_tokens, ids, decoded``."""
    codec = BpeCodec.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoded = encode_texts(docs, codec)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("bpe", encode),
]

#: Trained models and sketches have no SQL; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
