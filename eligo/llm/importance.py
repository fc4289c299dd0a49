"""Target-distribution importance resampling: documents whose word features look like those of a target text collection are drawn more often.

Features are hashed into buckets. What every bucket is worth (`gains`, a whole number) follows from its counts in the target
and in the documents, over all rows of both; the counts of a task are one array, and only an entry for each bucket reaches
the driver. A document's weight is the floored mean of its features' gains, looked up in that array, and
its score adds seeded Gumbel noise, so that the highest scores are a draw without replacement by weight.

The draw takes the highest `percent` of the scores by weighted median of medians: each task gives the median of the keys
that are left in its partition and their number, the median of those weighed by the numbers divides the keys, and the side that cannot
hold the cutoff, at least a quarter of what was left, is discarded; a round is one job without a shuffle, and a row for each task reaches the driver. The
round that meets the cutoff key itself is the last. The winners alone are sorted, by ranges.

Defined cases: null and empty texts have no features, weight 0 and no place in the draw; a null id counts as an empty one in the
noise and comes last among ties; each of equal rows is a document; without target text all gains come from the documents' counts alone; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligo.functions.ranks import numbered
from eligo.llm.common import cut

BUCKETS = 10_000
SCALE = 1000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
STRETCH = 1 << 20  # bytes of a text that are taken apart at once
# bytes of words as they are, A-Z in lower case, the others as spaces
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def features(text: bytes | None) -> Iterator[tuple[int, np.ndarray]]:
    """By stretch of a text: its number of words, and the hashes of their features: every word, and every two neighbours joined by a space."""
    plain, at, last = (text or b"").translate(PLAIN), 0, None
    while at < len(plain):
        end = plain.find(b" ", at + STRETCH)
        end = len(plain) if end < 0 else end
        words = plain[at:end].split()
        at = end
        if words:
            one = np.fromiter(map(crc32, words), dtype=np.uint32, count=len(words))
            spaced = [b" " + w for w in words]
            ahead = one[:-1].tolist() if last is None else [last, *one[:-1].tolist()]
            two = np.fromiter(map(crc32, spaced[1:] if last is None else spaced, ahead), dtype=np.uint32, count=len(ahead))
            last = int(one[-1])
            yield len(words), np.concatenate([one, two])


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all texts each bucket holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, hashes in features(text.as_py()):
                    total += np.bincount(hashes % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    got = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, dtype=np.int64)
    out[got["bucket"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket is worth, from its counts in the documents and in the target: floored thousandths of the log ratio of smoothed shares."""
    n, all_documents, all_target = len(documents), float(documents.sum()), float(target.sum())
    ratio = ((target + 1.0) * (all_documents + n)) / ((documents + 1.0) * (all_target + n))
    return np.array([math.floor(SCALE * math.log(r)) for r in ratio], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in floored thousandths, from a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 2**32)))


def scored(docs: DataFrame, worth: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each document row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                n_words = n = total = 0
                for words, hashes in features(text.as_py()):
                    n_words, n = n_words + words, n + len(hashes)
                    total += int(worth[hashes % len(worth)].sum())
                weight = total // n if n else 0
                out.append((n_words, n, weight, weight + noise(doc_id, seed)))
            columns = [pa.array(c, pa.int64()) for c in (ids, *(zip(*out, strict=True) if out else [[]] * 4))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


KEY = ["score", "is_null", "id"]  # highest score first, then ids, null last


def _before(a: np.ndarray, b: tuple) -> np.ndarray:
    """Which keys (rows of a: minus score, is_null, id) stand before b."""
    return (a[0] < b[0]) | ((a[0] == b[0]) & ((a[1] < b[1]) | ((a[1] == b[1]) & (a[2] < b[2]))))


def _median(keys: np.ndarray) -> tuple[int, int, int, int]:
    """Number of keys, and the lower median of them."""
    n = keys.shape[1]
    if not n:
        return 0, 0, 0, 0
    return n, *(int(x) for x in keys[:, np.lexsort(keys[::-1])[(n - 1) // 2]])


def cutoff(keys: DataFrame, k: int) -> tuple[int, int, int] | None:
    """The key (minus score, is_null, id) of the k-th place among rows (score, is_null, id); None if there are fewer rows, or k is 0.

    Keys between two bounds are left; a job divides them by a pivot and gives, for each partition and side, the number of keys and their
    median, so that the next pivot is known whichever side goes on.
    """
    if k < 1:
        return None
    low = high = pivot = None
    while True:

        def sides(batches: Iterator[pd.DataFrame], low=low, high=high, pivot=pivot) -> Iterator[pd.DataFrame]:
            parts = []
            for b in batches:
                a = np.stack([-b["score"].to_numpy(), b["is_null"].to_numpy(dtype=np.int64), b["id"].to_numpy()])
                if high is not None:
                    a = a[:, _before(a, high)]
                if low is not None:
                    same = (a == np.array(low)[:, None]).all(axis=0)
                    a = a[:, ~(_before(a, low) | same)]
                parts.append(a)
            a = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), dtype=np.int64)
            if pivot is None:
                first, same, second = a[:, :0], np.zeros(0), a
            else:
                less, same = _before(a, pivot), (a == np.array(pivot)[:, None]).all(axis=0)
                first, second = a[:, less], a[:, ~(less | same)]
            row = (*_median(first), int(same.sum()), *_median(second))
            yield pd.DataFrame([row], columns=["n1", "a1", "b1", "c1", "same", "n2", "a2", "b2", "c2"])

        left = keys.select(*KEY)
        if low is not None:
            left = left.where(F.col("score") <= -low[0])
        if high is not None:
            left = left.where(F.col("score") >= -high[0])
        got = left.mapInPandas(sides, "n1 long, a1 long, b1 long, c1 long, same long, n2 long, a2 long, b2 long, c2 long").collect()  # a row for each task
        ahead, same, after = (sum(r[c] for r in got) for c in ("n1", "same", "n2"))
        if ahead < k <= ahead + same:
            return pivot
        if k <= ahead:
            high, side = pivot, 1
        elif after:
            low, side, k = pivot, 2, k - ahead - same
        else:
            return None
        medians = sorted((tuple(r[f"{c}{side}"] for c in "abc"), r[f"n{side}"]) for r in got if r[f"n{side}"])
        half, seen = sum(n for _, n in medians) / 2, 0
        for pivot, n in medians:
            seen += n
            if seen >= half:
                break


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each document row; rank (from 1) is null where the document is not drawn."""
    worth = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    key = (F.col("doc_id").isNull().alias("is_null"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    rows = cut(scored(docs, worth, seed).select("*", *key), "scores")
    able = rows.where(F.col("n_words") >= least_words)
    k = percent * able.count() // 100
    last = cutoff(able, k)
    cols = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return rows.select(*cols, F.lit(None).cast("long").alias("rank"))
    tie = F.struct("is_null", "id") <= F.struct(F.lit(bool(last[1])).alias("is_null"), F.lit(last[2]).cast("long").alias("id"))
    won = (F.col("n_words") >= least_words) & ((F.col("score") > -last[0]) | ((F.col("score") == -last[0]) & tie))
    winners = numbered(rows.where(won), [F.desc("score"), F.col("is_null"), F.col("id")], "place")  # rows equal to the last one are more than needed
    rank = F.when(F.col("place") < k, F.col("place") + 1)
    return winners.select(*cols, rank.alias("rank")).unionByName(rows.where(~won).select(*cols, F.lit(None).cast("long").alias("rank")))
