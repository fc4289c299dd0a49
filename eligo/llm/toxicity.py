"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are presence bits of single words, their stems (first STEMS letters), word pairs and pairs
with one word between, hashed to 2**BITS places. Each coordinate has its own rate, and the L1 term leaves most weights at zero,
so what is sent to the tasks is a short list of places and weights (at most 2**BITS of each).

The model is fitted on at most about `limit` labelled documents, chosen by a hash of the id: a
documented bound. Scores cover every document and its whole text.

Defined cases: null and empty texts get the score of the intercept; a null id is not held out and
is never learned from; several labels of one id count as their largest, and several rows of one id as one example; with no labels at all
the score is 0.5; repeated rows score alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligo.llm.common import bounded_sample

BITS = 20
LIMIT = 8000
EPOCHS = 4
MIN_DOCS = 6
THRESHOLD = 0.3
STEMS = (4, 5)
TOKEN = re.compile(r"[^\W_]+")


class _Hashes(dict):
    """Word -> 64-bit hash of it, or of its first letters, kept for the words seen lately."""

    def __init__(self, letters: int | None = None):
        super().__init__()
        self.letters = letters

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        data = word[: self.letters].encode("utf-8", "surrogatepass") + bytes([self.letters or 0])
        self[word] = h = zlib.crc32(data) << 32 | zlib.crc32(data, 0x9E3779B9)
        return h


def caches() -> list[_Hashes]:
    """One for words, one for each kind of stem."""
    return [_Hashes(), *map(_Hashes, STEMS)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x >> np.uint64(64 - BITS)).astype(np.int32)


def features(text: str | None, seen: list[_Hashes]) -> np.ndarray:
    """Places of the text's words, stems, neighbours and skip pairs; repeats are left in."""
    words = TOKEN.findall(text.lower()) if text else []
    h, *stems = (np.fromiter(map(s.__getitem__, words), dtype=np.uint64, count=len(words)) for s in seen)
    left = h * np.uint64(0x9E3779B97F4A7C15)
    return np.concatenate([_mixed(h), *map(_mixed, stems), _mixed(left[:-1] + h[1:] + np.uint64(1)), _mixed(left[:-2] + h[2:] + np.uint64(2))])


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen = caches()
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": [np.unique(features(t, seen)) for t in b["text"]]})


def _learned(rows: pd.DataFrame) -> pd.DataFrame:
    """The sample, in an order that does not depend on where its rows came from -> places and weights; place -1 is the intercept."""
    rows = rows.assign(order=[zlib.crc32(str(x).encode()) for x in rows["doc_id"]]).sort_values(["order", "doc_id"], kind="stable")
    seen_in = np.zeros(1 << BITS, dtype=np.int64)
    for x in rows["x"]:
        seen_in[x] += 1
    # a feature of fewer than MIN_DOCS documents tells documents apart, not labels
    at, w, bias = fit_ftrl([(x[seen_in[x] >= MIN_DOCS], int(y)) for x, y in zip(rows["x"], rows["y"], strict=True)])
    return pd.DataFrame({"place": np.append(at, -1), "weight": np.append(w, bias)})


def fit_ftrl(rows: list[tuple[np.ndarray, int]], alpha: float = 0.3, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Places, weights (those not zero) and intercept."""
    z, n, bias, nb = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for i, y in rows:
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30)))
            g = p - y
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
            nb += g * g
            bias -= alpha * g / (beta + np.sqrt(nb))
    w = weights(np.arange(1 << BITS))
    at = np.flatnonzero(w)
    return at, w[at], float(bias)


def held_out(remainder: int, modulus: int) -> Column:
    """Rows kept from learning, by a checksum of the id; false for null ids."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray, float]:
    """Learn from the labelled documents that are not held out."""
    named = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    some = F.broadcast(bounded_sample(named.where(~held_out(2, 4)), F.col("doc_id"), limit))  # at most about `limit` rows
    got = docs.select("doc_id", "text").join(some, "doc_id").groupBy(F.col("doc_id").cast("long").alias("doc_id"), "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r"))
    got = got.select("doc_id", "y", "r.text")  # an id of many rows is one example
    # one task learns from the sample, whose size is bounded, and returns the weights that are not zero
    rows = got.mapInPandas(_sampled, "doc_id long, y int, x array<int>").groupBy().applyInPandas(_learned, "place int, weight double")
    model = rows.toPandas()
    here = model["place"] >= 0
    return model["place"][here].to_numpy(), model["weight"][here].to_numpy(), float(model["weight"][~here].sum())


def score(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The documents with their columns, and __score."""
    places, weights, bias = fit(docs, labels, limit)
    model = docs.sparkSession.sparkContext.broadcast((places, weights, bias))

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, w, b = model.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        seen = caches()
        for s in texts:
            out = np.full(len(s), b)
            for k, t in enumerate(s):
                if t:
                    i = features(t, seen)
                    i = i[dense[i] != 0]
                    out[k] += dense[np.unique(i)].sum()
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -500, 500))))

    return docs.withColumn("__score", scored("text"))


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = LIMIT, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    rows = score(docs, labels, limit)
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(2, 4).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: int = LIMIT, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with their own columns, less those that the model rejects."""
    return score(docs, labels, limit).where(F.col("__score") < threshold).select(*docs.columns)
