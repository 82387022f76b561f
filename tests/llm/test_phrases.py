"""Phrase collocations against plain counting, filters as round trips, odd inputs, and SQL."""

from __future__ import annotations

import random
import re
import sys
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagewatch.llm import phrases as P
from pagewatch.llm.oracle import ORACLES
from pagewatch.llm.queries import QUERIES
from tools.compare import rows_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=2000):
    """Ranked phrases by counting every n-gram of every piece."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    found = []
    for lang, f in counts.items():
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        dropped = {
            g[i:i + k] for g, a in candidates.items() for k in range(2, len(g)) for i in range(len(g) - k + 1)
            if 100 * a >= 80 * f[g[i:i + k]]
        }
        scored = []
        for g, a in candidates.items():
            if g not in dropped:
                score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(found)


def made(rng, n):
    """Texts of few words, so that many phrases are common, with other pieces and white space between."""
    words = ["New", "york", "of", "the", "É", "été", "日本", "a b", "x\x00y", "d'or"]
    return [
        (rng.choice(["en", "fr", None, "und", ""]),
         "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 80))))
        for _ in range(n)
    ]


def collected(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_equal_plain_counting(spark, seed):
    rows = made(random.Random(seed), 300) + [("en", None), ("en", ""), ("en", "word " * 40_000), ("en", "same same. " * 200)] * 2
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, word string").repartition(5)
    assert collected(P.collocations(df)) == brute(rows)
    assert collected(P.collocations(df, least=5, top=7)) == brute(rows, 5, 7)


def test_many_filters_merge_to_the_same_counts(spark, monkeypatch):
    rows = made(random.Random(3), 400)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    monkeypatch.setattr(P, "HELD", 50)
    monkeypatch.setattr(P, "FRESH", 20)
    monkeypatch.setattr(P, "COUNTED", 3)
    monkeypatch.setattr(P, "REMEMBERED", 3)
    assert collected(P.collocations(df)) == brute(rows)


@pytest.mark.parametrize("words", [2, 3, 4])
@pytest.mark.parametrize("block_bits", [0, 5, 24])
def test_filter_gives_back_what_it_counted(words, block_bits):
    rng = np.random.default_rng(words)
    grams = [rng.integers(1, 2**64, 500, np.uint64) for _ in range(words)]
    grams = [np.concatenate([g, g[:100]]) for g in grams]
    keys, counts = P.summed(P.permuted(grams), rng.integers(1, 1000, 600).astype(np.int64))
    assert len(counts) == 500
    want = Counter()
    block = (keys[0] >> np.uint64(63) >> np.uint64(63 - block_bits) if block_bits == 0 else keys[0] >> np.uint64(64 - block_bits)).astype(np.int64)
    for b in set(block.tolist()):
        own = block == b
        kept = P.CountingFilter.of([k[own] for k in keys], counts[own], b, block_bits)
        back, n = kept.entries(words, b, block_bits)
        assert all((x == k[own]).all() for x, k in zip(back, keys)) and (n == counts[own]).all()
        want.update({tuple(int(c[i]) for c in P.permuted(back)): int(n[i]) for i in range(len(n))})
    assert set(want) == set(zip(*(map(int, g[:500]) for g in grams)))


def test_equal_first_columns_stay_apart():
    first = np.array([7, 7, 7, 1, 7], np.uint64)
    keys, counts = P.summed([first, np.array([2, 1, 2, 5, 1], np.uint64)], np.array([1, 10, 100, 3, 1000]))
    assert list(zip(*(k.tolist() for k in keys), counts.tolist())) == [(1, 5, 3), (7, 1, 1010), (7, 2, 101)]


def test_seed_changes_if_two_words_share_an_id(spark, monkeypatch):
    df = spark.createDataFrame([("en", "one two three")], "lang string, text string")
    count, seeds = P._count_words, []

    def clash(seed):
        seeds.append(seed)
        counted = count(seed)

        def run(batches):
            for batch in counted(batches):
                yield batch.set_column(0, "id", pa.array([5] * batch.num_rows, pa.int64())) if seed == 0 else batch

        return run

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    monkeypatch.setattr(P, "_count_words", clash)
    words, seed = P.word_table(df)
    assert seeds == [0, 1] and seed == 1 and words.count() == 3
    with pytest.raises(ValueError):
        P.word_table(df, seeds=[0])


def test_large_counts_do_not_overflow(spark):
    big = 2**62
    gram = [[1], [2], [1, 2]]
    counts = spark.createDataFrame([(g, big) for g in gram], "gram array<long>, n long")
    got = P._weakest_cut(counts.where(F.size("gram") > 1), counts).first()
    assert (got.score, got.l, got.r) == (1_000_000, big, big)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert P.collocations(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert P.collocations(empty).count() == 0
    assert P.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).count() == 0


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    df = QUERIES["op13_phrase_collocations"](spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(ORACLES["op13_phrase_collocations"])
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())
