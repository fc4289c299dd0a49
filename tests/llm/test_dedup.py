"""Line dedup, SimHash and embedding near-duplicates against brute force, and their edge cases."""

import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eligo.llm import linededup, simhash, vecdedup


def distance(a, b):
    """Edit distance of code points."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def within(a, b, k):
    """Is the distance k or less? Equal beginnings and ends are left out first."""
    if abs(len(a) - len(b)) > k:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    return max(len(a), len(b)) <= k or k > 1 and len(a) < 80 and distance(a, b) <= k


def plain_lines(docs, k=1):
    """{doc_id: kept text} by comparing every pair of lines."""
    first, blank = {}, re.compile(r"[\x20\x09-\x0D]*")
    for i, t in sorted(docs):
        for n, line in enumerate((t or "").split("\n")):
            if not blank.fullmatch(line):
                first.setdefault(line, (i, n))
    long = [x for x in first if len(x) >= 16]
    gone = {a for a in long for b in long if first[b] < first[a] and within(a, b, k)}
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if blank.fullmatch(x) or first[x] == (i, n) and x not in gone) for i, t in docs}


def edited(rng, text, n):
    for _ in range(n):
        i, r = rng.randrange(len(text)), rng.random()
        text = text[:i] + text[i + 1 :] if r < 0.3 else text[:i] + rng.choice("abcé") + text[i + (r > 0.6) :]
    return text


@pytest.mark.parametrize("k", [1, 2])
def test_lines_equal_brute_force(spark, k):
    rng, lines = random.Random(5), []
    for _ in range(50):
        base = "".join(rng.choice("ab é") for _ in range(rng.choice([16, 17, 31, 32, 33, 40])))
        lines += [base, *(edited(rng, base, rng.choice([1, 1, 2, 3])) for _ in range(5))]
    rng.shuffle(lines)
    docs = [(i, "\n".join([*lines[i * 3 : i * 3 + 3], "short", f"shor{i % 7}"])) for i in range(len(lines) // 3)] + [(900, None), (901, ""), (902, "x" * 30_000), (903, "x" * 30_000 + "\n\n \n"), (904, "shorx\n\t")]
    df = spark.createDataFrame([*docs, docs[3]], "doc_id long, text string")
    rows = linededup.dedup_lines(df, max_edits=k).collect()
    assert len(rows) == len(docs) + 1
    assert {r.doc_id: r.text for r in rows} == plain_lines(docs, k)
    counts = {r.doc_id: (r.n_lines, r.n_dropped) for r in rows if r.doc_id >= 900}
    assert counts == {900: (0, 0), 901: (1, 0), 902: (1, 0), 903: (4, 1), 904: (2, 0)}


def test_lines_that_share_halves(spark):
    rng = random.Random(6)
    head, tail = ("".join(rng.choice("abcdefgh ") for _ in range(700)) for _ in range(2))
    docs = [(i, head + edited(rng, tail, 1 + i % 3)) for i in range(12)] + [(20 + i, edited(rng, head, 1 + i % 2) + tail) for i in range(12)] + [(40, head + tail), (41, tail + head)]
    docs += [(50, head), (51, head[1:]), (52, head + "z"), (53, "z" + head), (54, head[:350] + head[351:])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()} == plain_lines(docs)


def test_long_lines_and_many_lines_take_linear_time(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_000_000))
    many = "\n".join(f"line {k} of {k * 7919 % 100_003}" for k in range(100_000))
    docs = [(1, long), (2, long[:600_000] + "Z" + long[600_001:]), (3, many), (4, many.replace("line 77 ", "line 7 7 "))]
    start = time.monotonic()
    got = {r.doc_id: (len(r.text), r.n_dropped) for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_chars=40).collect()}
    assert got == {1: (1_000_000, 0), 2: (0, 1), 3: (len(many), 0), 4: (len("line 7 7 of 209658"[:12] + str(77 * 7919 % 100_003)), 99_999)}
    assert time.monotonic() - start < 100


def test_hot_line_and_extra_columns(spark):
    line = "a line that very many documents share"
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(line)).otherwise(F.concat(F.lit("unique words only here "), F.sha1(F.col("id").cast("string").cast("binary")))).alias("text"))
    df = df.withColumn("line", F.lit(1)).withColumn("stay", F.lit("x")).withColumn("n_chars", F.length("text").cast("long"))
    df = df.unionByName(df.limit(5)).unionByName(df.limit(2).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string")))
    got = linededup.drop_repeated_lines(df)
    assert got.columns == df.columns
    rows = got.where("doc_id is not null").collect()
    assert sorted(r.doc_id for r in rows) == [0] + [i for i in range(300) if i % 3]
    empty = linededup.drop_repeated_lines(df.limit(0))
    assert empty.columns == df.columns and empty.count() == 0


def test_short_lines_keep_a_document(spark):
    footer = "a footer that both documents share"
    docs = [(1, footer), (2, f"one\ntwo\n\nthree\n{footer}"), (3, footer), (4, f"\n \u3000\t\n{footer}"), (5, None), (6, ""), (7, "tiny"), (8, " \n"), (9, "two\nnew"), (10, "one\n ")]
    got = linededup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == {1: footer, 2: "one\ntwo\n\nthree", 5: None, 6: "", 7: "tiny", 8: " \n", 9: "new"}


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    h = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def roots(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    docs = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(80)]
        for _ in range(4):
            copy = list(base)
            copy[rng.randrange(80)] = rng.choice(words)
            docs.append((len(docs) * 7 % 1000, " ".join(copy) if g % 2 else "  ".join(copy).upper()))
    docs += [(1001, None), (1002, ""), (1003, " \t\n"), (1004, "one"), (1005, "ONE"), (1006, "Éé two"), (1007, "a\x00b c d")]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    codes = {i: fingerprint(t) for i, t in docs}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == codes
    assert all(len(r.fingerprint) == 16 for r in got.values())
    want = roots(list(codes), lambda a, b: (codes[a] ^ codes[b]).bit_count() <= 2)
    assert {i: r.component_id for i, r in got.items()} == want
    assert len(set(want.values())) < len(docs)


@pytest.mark.parametrize("bucket", [2, 64])
def test_heavy_buckets_lose_no_link(spark, bucket):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    codes = sorted({base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.3) << rng.randrange(64) for _ in range(150)} | {rng.getrandbits(64) for _ in range(20)})
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    edges = simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long"), bucket).collect()
    got = roots(signed, lambda a, b: (a, b) in pairs or (b, a) in pairs) if (pairs := {(r.a, r.b) for r in edges}) else {}
    want = roots(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    assert got == want
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in pairs) or bucket == 2


def test_keep_one_of_each_group(spark):
    rows = [(5, "same text of some words", "a"), (3, "same text of some words", "b"), (3, "same text of some words", "b"), (9, "another text with other words", "c"), (None, "same text of some words", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns and sorted((r.doc_id, r.fp) for r in got.collect()) == [(3, "b"), (9, "c")]
    assert simhash.keep_one(df.limit(0)).count() == 0
    nulls = simhash.near_duplicates(spark.createDataFrame([(None, "x y"), (None, "x y")], "doc_id long, text string")).collect()
    assert [r.component_id for r in nulls] == [None, None]
    long = "some words of a very long text " * 40_000
    same = simhash.near_duplicates(spark.createDataFrame([(4, long), (2, long), (2, long)], "doc_id long, text string")).collect()
    assert [(r.component_id, int(r.fingerprint, 16)) for r in same] == [(2, fingerprint(long))] * 3


def brute_vectors(rows, t=0.98):
    out = {}
    ok = [v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    link = np.zeros((len(rows), len(rows)), dtype=bool)
    for i, (_, v, lab) in enumerate(rows):
        for j, (_, w, other) in enumerate(rows):
            if i != j and ok[i] and ok[j] and lab == other and len(v) == len(w):
                a, b = np.float32(v).astype(float), np.float32(w).astype(float)
                link[i, j] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= t
    label = list(range(len(rows)))
    while True:
        new = [min([label[i], *(label[j] for j in np.flatnonzero(link[i]))], key=lambda k: rows[k][0]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    for i, (vid, *_) in enumerate(rows):
        out[vid] = (int(link[i].sum()), rows[label[i]][0])
    return out


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        base = rng.normal(size=16)
        rows += [(len(rows) + k, [float(np.float32(x)) for x in base + rng.normal(0, 0.06, 16)], g % 3) for k in range(10)]
    hot = [float(np.float32(x)) for x in rng.normal(size=16)]
    rows += [(1000 + k, hot if k % 2 else [2 * x for x in hot], 1) for k in range(60)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, hot, None), (2005, hot[:8], 1), (2006, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("clash"))
    want = brute_vectors(rows)
    for tile in (16, 512):
        got = vecdedup.near_duplicates(df, tile=tile).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert vecdedup.near_duplicates(df.limit(0)).count() == 0
    ends = [(1, [1e-200, 1e-200], 0), (2, [2e-200, 2e-200], 0), (3, [1e308, 1e308], 0), (4, [1e308, -1e308], 0), (5, [5e-324, 5e-324], 0)]
    got = vecdedup.near_duplicates(spark.createDataFrame(ends, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1)}


def test_bounds_drop_no_pair():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 24))
    x[30:] = x[:30] + rng.normal(0, 0.08, (30, 24))
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    i, j = vecdedup.linked(x, x, axes, 0.98, True)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(60) for b in range(a + 1, 60) if u[a] @ u[b] >= 0.98}
