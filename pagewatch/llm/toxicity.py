"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A text is lower-cased, everything that is no letter becomes a space, and its character n-grams
are hashed into ``2**BITS`` features, present or absent. A feature's value is its naive Bayes
log-count ratio between toxic and clean training texts; a logistic regression on these scaled
features gives the score, after Platt's calibration. It is fitted on at most ``max_train_docs`` labelled rows, half of
them of each class as far as there are, chosen by a hash of the id.

Defined cases: null and empty texts have no features and get the score of the intercept. Rows
with a null label are not learned from; of several labels of a document the largest counts.
Without labelled rows of both classes every score is the prior (0 without any label). Repeated
rows are scored one by one; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagewatch.llm.common import bounded_fraction, crc_bucket, in_sample, slices
from pagewatch.sources.tables import materialize

BITS = 20
SIZES = (3, 4, 5, 6)
#: Texts are read in slices of about so many characters: each takes a hundred bytes of a worker's memory.
SLICE = 250_000
_PLAIN = np.array([c if chr(c).isalpha() else 32 for c in range(1 << 16)], np.uint32)


@dataclass(frozen=True)
class ToxicityModel:
    """Weights by feature (log-count ratio times coefficient), intercept, decision threshold."""

    weights: np.ndarray
    intercept: float
    threshold: float = 0.7


def _features(texts: list[str], wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the n-grams of each text, once per row; only features that are wanted."""
    padded = [f" {t.lower()} " for t in texts]
    ends = np.cumsum([len(t) for t in padded])
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < 1 << 16, _PLAIN[np.minimum(codes, (1 << 16) - 1)], codes)
    found = []
    rolled = codes.astype(np.uint32) * np.uint32(2654435761)
    for n in range(2, max(SIZES) + 1):
        if len(codes) < n:
            break
        rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint32(15))) * np.uint32(2246822519) + codes[n - 1 :]
        if n not in SIZES:
            continue
        feature = ((rolled ^ np.uint32(n)) * np.uint32(3266489917)) >> np.uint32(32 - BITS)
        at = np.arange(len(feature)) if wanted is None else np.flatnonzero(wanted[feature])
        row = np.searchsorted(ends, at, side="right")
        inside = at + n <= ends[row]
        found.append((row[inside].astype(np.int64) << BITS) | feature[at[inside]].astype(np.int64))
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys >> BITS, keys & ((1 << BITS) - 1)


def _logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, n_cols: int,
              penalty: float, steps: int = 120) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by accelerated gradient descent on sparse rows."""
    n = len(y)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    norm = np.bincount(rows, values**2, n).max() + 1.0
    rate = 4.0 / (norm + 4 * penalty)
    w, b = np.zeros(n_cols), 0.0
    vw, vb = w, b
    for step in range(steps):
        margin = np.bincount(rows, values * vw[cols], n) + vb
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y)
        grad = np.bincount(cols, values * error[rows], n_cols) + penalty * vw
        nw, nb = vw - rate * grad, vb - rate * error.sum()
        pace = step / (step + 3)
        vw, vb, w, b = nw + pace * (nw - w), nb + pace * (nb - b), nw, nb
    return w, b


def _calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities: Platt's fit with softened targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, 0.5 / max(n1, 1), 0.5 / max(n0, 1))
    spread = margin.std() or 1.0
    x = np.stack([margin / spread, np.ones_like(margin)])
    at = np.array([1.0, -margin.mean() / spread])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -40, 40)))
        grad = x @ (weight * (p - target)) + 1e-6 * at
        curve = (x * (weight * p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, grad)
        at = at - step * min(1.0, 2.0 / np.abs(step).max())
    return float(at[0] / spread), float(at[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", max_train_docs: int = 8000, min_docs: int = 3,
                 min_ratio: float = 1.0, penalty: float = 1e-6, threshold: float = 0.7) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows; ``labels`` must hold training rows only.

    The sample's ids are at most ``max_train_docs``, so they may be broadcast. Of an id that several rows have, one text is
    learned from, the least by hash and value; so the sample has at most so many rows too, and the driver
    gets at most so many lists of features.
    """
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    )
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    empty = np.zeros(1 << BITS, np.float32)
    if not toxic or not clean:
        return ToxicityModel(empty, 40.0 if toxic else -40.0, threshold)
    half = max_train_docs // 2
    chosen = known.where(
        F.when(F.col("_y") == 1, in_sample("_id", bounded_fraction(toxic, half)))
        .otherwise(in_sample("_id", bounded_fraction(clean, half)))
    ).limit(max_train_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Texts with each feature, toxic and all; feature -1 counts the texts themselves.
        toxic_texts = np.zeros(1 << BITS, np.int32)
        all_texts = np.zeros(1 << BITS, np.int32)
        p = n = 0
        for batch in batches:
            for part, texts in slices(batch, size_limit=SLICE):
                y = part.column(2).to_numpy(zero_copy_only=False)
                rows, features = _features(texts, None)
                all_texts += np.bincount(features, minlength=1 << BITS).astype(np.int32)
                toxic_texts += np.bincount(features[y[rows] == 1], minlength=1 << BITS).astype(np.int32)
                p, n = p + int(y.sum()), n + len(texts)
        seen = np.flatnonzero(all_texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1).astype(np.int32)),
             pa.array(np.append(toxic_texts[seen], p).astype(np.int64)),
             pa.array(np.append(all_texts[seen], n).astype(np.int64))], ["f", "p", "n"])

    one = F.min(F.struct(F.xxhash64("_t"), F.col("_t")))["_t"]
    learned = materialize(
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
        .join(F.broadcast(chosen), "_id")
        .groupBy(F.col("_id").cast("string").alias("_id")).agg(one.alias("_t"), F.max("_y").alias("_y"))
        # Few rows that are dear to read: one task each of many, not one task for all.
        .repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))),
        "labelled",
    )
    # First the number of texts with each feature, then only the features that tell the classes apart.
    stats = (
        learned.mapInArrow(count, "f int, p long, n long")
        .groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        .where((F.col("n") >= min_docs) | (F.col("f") < 0)).toArrow()
    )
    found = stats.to_pandas()
    total = found[found.f < 0]
    found = found[found.f >= 0]
    positive, texts_read = int(total.p.sum()), int(total.n.sum())
    if not positive or positive == texts_read or found.empty:
        return ToxicityModel(empty, float(np.log(toxic / clean)), threshold)
    feature, p, n = (found[c].to_numpy() for c in ("f", "p", "n"))
    ratio = np.log((p + 1) / (positive + 2)) - np.log((n - p + 1) / (texts_read - positive + 2))
    keep = np.abs(ratio) >= min_ratio
    feature, ratio = feature[keep], ratio[keep]
    wanted = np.zeros(1 << BITS, bool)
    wanted[feature] = True

    def reread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, size_limit=SLICE):
                rows, found = _features(texts, wanted)
                cuts = np.searchsorted(rows, np.arange(len(texts) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], ["id", "y", "f"])

    sample = (
        learned.mapInArrow(reread, "id string, y int, f array<int>")
        .orderBy(F.xxhash64("id"), "id", F.size("f"))
        .toArrow()
    )
    y = sample.column("y").to_numpy().astype(float)
    lists = sample.column("f").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    place = np.full(1 << BITS, -1)
    place[feature] = np.arange(len(feature))
    cols = place[lists.flatten().to_numpy()]
    rows = np.repeat(np.arange(len(y)), lengths)
    w, b = _logistic(rows, cols, ratio[cols], y, len(feature), penalty)
    margin = np.bincount(rows, ratio[cols] * w[cols], len(y)) + b
    scale, shift = _calibrated(margin, y)
    weights = empty.copy()
    weights[feature] = scale * w * ratio
    return ToxicityModel(weights, float(scale * b + shift), threshold)


def text_scores(texts: list[str], model: ToxicityModel) -> np.ndarray:
    rows, features = _features(texts, model.weights != 0)
    margin = np.bincount(rows, model.weights[features], len(texts)) + model.intercept
    return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def toxicity_score(text: Column | str, model: ToxicityModel) -> Column:
    """Score column between 0 and 1."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out, group, size = [], [], 0
            for t in texts:
                group.append(t or "")
                size += len(group[-1])
                if size >= SLICE:
                    out.append(text_scores(group, model))
                    group, size = [], 0
            out.append(text_scores(group, model))
            yield pd.Series(np.concatenate(out))

    return score(text)


def training_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels that may be learned from: the others are held out."""
    return labels.where(crc_bucket(id_col, 3) != 1)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row."""
    return docs.select(
        F.col(id_col),
        (crc_bucket(id_col, 3) == 1).alias("held_out"),
        toxicity_score(F.col(text_col), model).alias("score"),
    ).withColumn("predicted", F.when(F.col("score") >= model.threshold, 1).otherwise(0))
