"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import shared_dir, tidy

#: Hash space of the features; dense float32 weights are 1 MB, so the broadcast is bounded.
BITS = 18
#: The model is fitted on at most so many labelled rows, those with the smallest hash of their doc_id.
MAX_TRAINING_ROWS = 8192
#: And of these, in that order, on as many as have so many buckets together, which bounds the learner's memory.
MAX_TRAINING_BUCKETS = 1 << 26
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 1.0
#: Buckets that fewer training rows have are not learnt from.
MIN_ROWS = 3
FOLDS = 5

_WORD = re.compile(r"\w+")
_MIX1, _MIX2, _MIX3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


class _Words(dict):
    """CRC-32 of a word; remembers a bounded number."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return value


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * _MIX2
    return (h ^ (h >> np.uint32(13))) >> np.uint32(32 - BITS)


def features(text: str | None, words: _Words | None = None) -> np.ndarray:
    """The distinct buckets of a text's words, word pairs and pairs with one word between, lower-cased."""
    known = _Words() if words is None else words
    w = np.array([known[x] for x in _WORD.findall((text or "").lower())], dtype=np.uint32)
    if not len(w):
        return np.zeros(0, np.uint32)
    parts = [w * _MIX1]
    if len(w) > 1:
        parts.append((w[:-1] * _MIX3) ^ (w[1:] * _MIX1) ^ _MIX2)
    if len(w) > 2:
        parts.append((w[:-2] * _MIX2) ^ (w[2:] * _MIX3) ^ _MIX1)
    seen = np.zeros(1 << BITS, bool) if len(w) > 50_000 else None
    buckets = _bucket(np.concatenate(parts))
    if seen is None:
        return np.unique(buckets)
    seen[buckets] = True
    return np.flatnonzero(seen).astype(np.uint32)


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learnt from: crc32 of the key as text leaves no remainder by FOLDS."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and intercept. Each coordinate has its own rate alpha / (beta + sqrt(sum of squared gradients))."""
    z, n, common = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS, np.int32)
    for x, _ in rows:
        common[x] += 1
    rows = [(x[common[x] >= MIN_ROWS], y) for x, y in rows]
    positive = sum(y for _, y in rows)
    bias, bias_n = float(np.log((positive + 1) / (len(rows) - positive + 99))), 0.0

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for x, y in rows:
            w = weights(zx := z[x], nx := n[x])
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            grown = nx + g * g
            z[x] = zx + g - (np.sqrt(grown) - np.sqrt(nx)) / ALPHA * w
            n[x] = grown
            bias_n += g * g
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * g
    return weights(z, n), bias


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", max_rows: int = MAX_TRAINING_ROWS) -> tuple[np.ndarray, float]:
    """Fit on labelled rows outside the held-out fold.

    Of labels that repeat a doc_id the largest counts; null labels and labels of unknown documents are left out. Which
    rows form the bounded sample follows a hash of their ids. They are turned into buckets where they lie; one task
    learns, as FTRL is sequential, and only non-zero weights come back to the driver.
    """
    own = labels.where(F.col(target).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col(target)).cast("int").alias("y"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # 12 bytes a row
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y")

    @tidy()
    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "y": b.y, "x": [features(t, words).tobytes() for t in b.text]})

    @tidy()
    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got, held = [], 0
        for b in batches:
            for x, y in zip(b.x, b.y, strict=True):
                held += len(x) // 4
                if held <= MAX_TRAINING_BUCKETS:
                    got.append((np.frombuffer(x, np.uint32), int(y > 0)))
        w, bias = ftrl(got)
        at = np.flatnonzero(w)
        yield pd.DataFrame({"bucket": np.append(at, -1), "weight": np.append(w[at], bias)})

    found = (
        rows.mapInPandas(featurise, "doc_id long, y int, x binary")
        .repartition(1)
        .sortWithinPartitions(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id", "x")  # whatever the partitions
        .mapInPandas(learn, "bucket int, weight double")
    ).toPandas()
    out, bias = np.zeros(1 << BITS, np.float32), float(np.log(1 / 99))
    if len(found):
        real = found[found.bucket >= 0]
        out[real.bucket.to_numpy()] = real.weight.to_numpy()
        bias = float(found.loc[found.bucket < 0, "weight"].iloc[0])
    return out, bias


def scorer(spark, model: tuple[np.ndarray, float]):
    """A pandas UDF from texts to scores with the model's compact weights broadcast."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    @tidy()
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, bias = sent.value
        words = _Words()
        for batch in texts:
            yield pd.Series([1 / (1 + np.exp(-np.clip(float(w[features(t, words)].sum(dtype=np.float64)) + bias, -35, 35))) for t in batch], dtype="float64")

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `held_out`, `score`, `predicted`.

    The whole text counts, however long; labels, source, language and id are not inputs. Null and empty texts get the intercept's
    score. A null doc_id is not held out. With no label at all every score is 0.01. Repeated rows get equal scores; an
    empty table gives an empty result. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    score = scorer(spark, train(docs, labels))
    return docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def toxicity_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` whose score is below one half, with all their columns, whatever their names.

    Null and empty texts get the intercept's score and stay; repeated rows stay or go together; an empty table gives
    an empty result.
    """
    score = scorer(docs.sparkSession, train(docs, labels))
    return docs.select(F.struct(*docs.columns).alias("row"), score("text").alias("score")).where("score < 0.5").select("row.*")
