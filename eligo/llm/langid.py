"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of 1 to 3 code points (lower case, everything but letters as a space) are hashed to
2**BITS places. Document frequencies are counted over all labelled documents that are not held
out; weights are learned from at most about `limit` of them (a documented bound, shared equally by the languages) by
follow-the-regularised-leader with an elastic net (L1 for sparsity, L2 in the proximal term). A
temperature fitted on a fifth of that sample, which the weights have not seen, calibrates scores.

Defined cases: a text that is null or has no letter is `und` with score 0; null ids are not held
out and never learned from; with no labelled documents every text is `und`; repeated rows get the
same answer; an id of several rows is one example.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligo.llm.toxicity import held_out

BITS = 14
SIZE = 1 << BITS
LIMIT = 4000
EPOCHS = 3
FEW = 10_000
UND = "und"


def letters() -> np.ndarray:
    """By code point: is it a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def counts(text: str | None, letter: np.ndarray) -> np.ndarray | None:
    """How often each place is hit by the text's n-grams; None if it has no letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letter[c]
    if not is_letter.any():
        return None
    c = np.where(is_letter, c, 32).astype(np.uint32)
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]])
    one = c * np.uint32(0x9E3779B1)
    two = one[:-1] * np.uint32(0x85EBCA6B) + one[1:]
    three = two[:-1] * np.uint32(0xC2B2AE35) + one[2:]
    mix = np.concatenate([one, two + np.uint32(77), three + np.uint32(991)])
    mix ^= mix >> np.uint32(15)
    mix *= np.uint32(0x2C1B3C6D)
    return np.bincount(mix >> np.uint32(32 - BITS), minlength=SIZE)


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    letter, df, n = letters(), np.zeros(SIZE, dtype=np.int64), 0
    for b in batches:
        for t in b["text"]:
            if (c := counts(t, letter)) is not None:
                df += c > 0
                n += 1
    at = np.flatnonzero(df)
    yield pd.DataFrame({"place": np.append(at, -1), "n": np.append(df[at], n)})


def weigh(c: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and TF-IDF values of one text, of length 1."""
    at = np.flatnonzero(c)
    x = (1 + np.log(c[at])) * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-12)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, places x classes; most are zero."""
    z, n = np.zeros((SIZE, classes)), np.zeros((SIZE, classes))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for at, x, y in rows:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The one of a grid of temperatures with the least log loss."""
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 5, 60):
        s = logits / t
        s -= s.max(axis=1, keepdims=True)
        loss = (np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean()
        best = min(best, (float(loss), float(t)))
    return best[1]


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    letter = letters()
    for b in batches:
        keep, xs, ns = [], [], []
        for k, t in enumerate(b["text"]):
            if (c := counts(t, letter)) is not None:
                at = np.flatnonzero(c)
                keep.append(k)
                xs.append(at.astype(np.int32))
                ns.append(c[at].astype(np.int32))
        yield pd.DataFrame({"doc_id": b["doc_id"].iloc[keep], "lang": b["lang"].iloc[keep], "x": xs, "c": ns})


def _learned(rows: pd.DataFrame, idf: np.ndarray) -> pd.DataFrame:
    """The sample, in an order that does not depend on where its rows came from -> weights by language and place.

    Each language has a row of place -1, and the row without a language holds the temperature.
    """
    rows = rows.assign(order=[zlib.crc32(f"o{x}".encode()) for x in rows["doc_id"]]).sort_values(["order", "doc_id"], kind="stable")
    classes = sorted(set(rows["lang"]))
    data = []
    for x, c, lang in zip(rows["x"], rows["c"], rows["lang"], strict=True):
        full = np.zeros(SIZE)
        full[x] = c
        data.append((*weigh(full, idf), classes.index(lang)))
    check = data[: len(data) // 5]
    w = fit_ftrl(data[len(check) :], len(classes))
    t = temperature(np.array([x @ w[at] for at, x, _ in check]), np.array([y for *_, y in check])) if check else 1.0
    place, k = np.nonzero(w)
    names = np.array(classes, dtype=object)
    return pd.DataFrame(
        {"lang": [*names[k], *classes, None], "place": np.concatenate([place, np.full(len(classes) + 1, -1)]).astype("int32"), "weight": np.concatenate([w[place, k], np.zeros(len(classes)), [t]])}
    )


def fit(docs: DataFrame, limit: int = LIMIT):
    """(classes, idf, weights, temperature), or None without labelled texts."""
    known = docs.where("lang is not null and doc_id is not null and text is not null").where(~held_out(0, 5)).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    freq = known.select("text").mapInPandas(_frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # at most SIZE + 1 rows
    df = np.zeros(SIZE)
    there = freq[freq["place"] >= 0]
    df[there["place"].to_numpy()] = there["n"]
    total = int(freq.loc[freq["place"] < 0, "n"].sum())
    if not total:
        return None
    idf = np.log((1 + total) / (1 + df)) + 1
    # an equal share for each language, so that rare ones are learned too; of rows of one id one text counts
    each = known.groupBy("lang").agg(F.count("*").alias("n"))
    languages = each.count()
    each = each.select(F.col("lang").alias("__l"), F.least(F.lit(1.0), F.lit(limit / max(1, languages)) / F.col("n")).alias("share"))
    each = F.broadcast(each) if languages <= FEW else each  # so that texts of a frequent language stay where they are
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 33) < F.col("share") * 2**31
    some = known.join(each, F.col("lang") == F.col("__l")).where(drawn).groupBy("doc_id").agg(F.min(F.struct("lang", F.xxhash64("text").alias("h"), "text")).alias("r"))
    rows = some.select("doc_id", "r.lang", "r.text").mapInPandas(_texts, "doc_id long, lang string, x array<int>, c array<int>")
    # one task learns from the sample, whose size is bounded, and returns the weights that are not zero
    model = rows.groupBy().applyInPandas(lambda r: _learned(r, idf), "lang string, place int, weight double").toPandas()
    classes = sorted(set(model["lang"].dropna()))
    w = np.zeros((SIZE, len(classes)))
    here = model[model["place"] >= 0]
    w[here["place"], [classes.index(x) for x in here["lang"]]] = here["weight"]
    return classes, idf, w, float(model.loc[model["lang"].isna(), "weight"].sum())


def identify(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, limit))  # SIZE x classes weights at most

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letter, got = letters(), model.value
        for s in texts:
            names, scores = [], []
            for text in s:
                c = counts(text, letter) if got else None
                if c is None:
                    names.append(UND)
                    scores.append(0.0)
                    continue
                classes, idf, w, t = got
                at, x = weigh(c, idf)
                v = x @ w[at] / t
                p = np.exp(v - v.max())
                names.append(classes[int(v.argmax())])
                scores.append(float(p.max() / p.sum()))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(0, 5).alias("held_out"), guess("text").alias("g"))
    return rows.select("doc_id", "held_out", "g.lang_pred", "g.score")
