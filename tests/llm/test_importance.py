"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from eligo.llm import importance


def plain(docs, target, percent=25, least=20, n=10_000):
    """[(doc_id, n_features, weight, score, rank)] as the contract says."""

    def feats(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    def counts(texts):
        out = [0] * n
        for t in texts:
            for f in feats(t)[1]:
                out[zlib.crc32(f.encode()) % n] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + n) / ((x + 1) * (sum(t) + n)))) for x, y in zip(s, t)]
    rows = []
    for i, x in docs:
        words, fs = feats(x)
        w = sum(gain[zlib.crc32(f.encode()) % n] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((-r[3], r[0] is None, r[0] or 0, k) for k, r in enumerate(rows) if r[4] >= least)
    rank = {a[3]: j + 1 for j, a in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], rank.get(k)) for k, r in enumerate(rows)]


def same(got, want):
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    stock = ["alpha", "Beta", "éclair", "x1", "don't", "über", "日本", "gamma", "A", "2024", "a-b", " z"]
    return [" ".join(rng.choice(stock) for _ in range(rng.randrange(0, 60))) for _ in range(300)]


def test_equals_the_plain_version(spark, texts, monkeypatch):
    docs = [*enumerate(texts), (None, texts[0] + " tail" * 30), (None, texts[0] + " tail" * 30), (400, None), (401, ""), (402, "!? ."), (5, texts[5]), (5, texts[5]), (7, texts[8] * 3), (-9, "word " * 5000)]
    target = [*texts[:20], None, "", "alpha beta gamma " * 40]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1))
    tf = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.resample(df, tf)
    assert [f"{c} {t}" for c, t in got.dtypes] == [f"{c} bigint" for c in ("doc_id", "n_features", "weight", "score", "rank")]
    same(got.collect(), plain(docs, target))
    monkeypatch.setattr(importance, "STRETCH", 40)  # features across the stretches of a text
    assert [len(h) for _, h in importance.features(b"aa " * 60)] != [119] and sum(len(h) for _, h in importance.features(b"aa " * 60)) == 119
    whole = [zlib.crc32(w) for w in (b"aa", b"aa aa")]
    assert {int(h) for _, hs in importance.features(b"aa " * 60) for h in hs} == set(whole)
    same(importance.resample(df, tf.limit(0)).collect(), plain(docs, []))


def test_empty_and_small(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:3])], "doc_id long, text string")
    tf = df.select("text")
    assert importance.resample(df.limit(0), tf).count() == 0
    assert all(r["rank"] is None for r in importance.resample(df, tf).collect())


@pytest.mark.parametrize("parts", [1, 7])
def test_cutoff(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([rng.randrange(-5, 5), rng.randrange(-(10**6), 10**6)]), rng.random() < 0.05, rng.randrange(40)) for _ in range(3000)] + [(3, False, 1)] * 900
    order = sorted((-s, n, i) for s, n, i in rows)
    df = spark.createDataFrame(rows, "score long, is_null boolean, id long").repartition(parts).cache()
    for k in (1, 17, 1500, 2222, 3899, 3900):
        assert importance.cutoff(df, k) == order[k - 1]
    assert importance.cutoff(df, 3901) is None and importance.cutoff(df, 0) is None and importance.cutoff(df.limit(0), 1) is None
    df.unpersist()
