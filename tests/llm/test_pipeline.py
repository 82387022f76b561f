"""The pipeline stage by stage, and as a whole against a brute-force version."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pagewatch.llm import decontaminate, pii
from tests.llm.test_llm import brute_classes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "bpe",
    ]


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    before = {r.doc_id: r.text for r in docs.collect()}

    kept = stages["toxicity"](spark, docs, sf_dir)
    assert kept.columns == COLUMNS
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    left = {r.doc_id for r in kept.collect()}
    clean = [i for i in before if labels.get(i) == 0]
    assert sum(i in left for i in clean) >= 0.95 * len(clean)

    kept = stages["ngram_jaccard_join"](spark, docs, sf_dir)
    firsts = {c for _, c, _ in brute_classes(sorted(before.items()))}
    assert kept.columns == COLUMNS and sorted(r.doc_id for r in kept.collect()) == sorted(firsts)

    kept = stages["benchmark_decontamination"](spark, docs, sf_dir)
    items = [decontaminate.words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def leaks(text):
        words = decontaminate.words(text)
        joined = f" {' '.join(words)} "
        return any(f" {' '.join(item)} " in joined for item in items)

    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in before.items() if not leaks(t))

    kept = stages["pii"](spark, docs, sf_dir)
    assert kept.columns == COLUMNS
    for r in kept.collect():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        if not pii.base_spans(before[r.doc_id]):
            assert r.text == before[r.doc_id]

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in stages["bpe"](spark, docs, sf_dir).collect():
        assert r.ids == library.encode(before[r.doc_id], add_special_tokens=False).ids


def test_whole_run(spark, sf_dir):
    done = corpus_pipeline.run(spark, sf_dir)
    assert done.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert 0 < done.count() < spark.read.parquet(f"{sf_dir}/documents.parquet").count()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, sf_dir, name, stage):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "text", "en", "s", 4), (2, "", "en", "s", 0)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, kinds)
    assert stage(spark, docs, sf_dir).where(F.col("doc_id").isNull()).count() == 1
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_texts_decide_where_ids_do_not(spark, sf_dir):
    """One id with two texts, and rows without an id, are kept or dropped by their own text."""
    item = next(r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len(r.text.split()) > 20)
    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in ("red", "blue"))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b), (None, a), (None, "own words of a row without an id " * 3), (4, item), (4, "clean " * 30),
            (None, f"before {item} after")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    kept = {(r.doc_id, r.text) for r in stages["ngram_jaccard_join"](spark, docs, sf_dir).collect()}
    assert {t for _, t in kept} >= {rows[0][1], rows[1][1], rows[5][1], rows[7][1]}
    assert (1, a) in kept and (1, b) in kept and not kept & {(2, a + " more"), (3, b), (None, a)}
    clean = sorted((r.doc_id or 0, r.text) for r in stages["benchmark_decontamination"](spark, docs, sf_dir).collect())
    assert clean == sorted((i or 0, t) for i, t in rows if item not in t)
