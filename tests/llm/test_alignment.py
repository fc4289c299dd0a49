"""Token alignment against the libraries and a plain version."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from eligo.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(docs):
    """Rows as the contract says, from whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = alignment.byte_letters()
    entry = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}

    def raw(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    out, links, total = [], [], Counter()
    for i, t in docs:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        if t and not b"".join(entry[k] for k in x) == b"".join(map(raw, y)) == b" " + t.encode():
            x, y = [], []
        at, ends = 0, {}
        for k in x:
            at += len(entry[k])
            ends[at] = k
        at, groups, mine, ga = 0, [], [], iter(x)
        own, reach = [], 0
        for k in y:
            own.append(k)
            at += len(raw(k))
            if at in ends:
                side = []
                while reach < at:
                    side.append(next(ga))
                    reach += len(entry[side[-1]])
                groups.append(f"{','.join(map(str, side))}|{','.join(map(str, own))}")
                mine.append((ends[at], k))
                own = []
        total.update(mine)
        links.append(mine)
        out.append((i, len(x), len(y), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
    top = {}
    for (_, k), n in total.items():
        top[k] = max(top.get(k, 0), n)
    return [(i, na, nb, ng, ng, sum(total[p] == top[p[1]] for p in m), sum(total[p] for p in m), d) for (i, na, nb, ng, d), m in zip(out, links)]


@pytest.mark.parametrize("hot", [0, 300, 1 << 18])
def test_equals_the_plain_version(spark, monkeypatch, hot):
    rng = random.Random(2)
    stock = ["word", "words", "Überraschung", "日本語", "don't", "42", "naïve", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "...", "émigré", "😀", "á", "x y", "​", "zz\0z", "\x1c", "ſ", "ﬁ", "(((", "﻿"]
    texts = ["".join(rng.choice(stock) + rng.choice([" ", " ", " ", " ", "  ", "\n", "", "\t ", " \n", ".\n"]) for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    texts += ["", " ", "  lead", "tail  ", "\n", "has ▁ mark", "▁", "x", "long" * 3000, "a b " * 4000, "=" * 900 + " " + "-" * 77, "\r\nx   y"]
    docs = [*enumerate(texts), (900, None), (None, texts[0]), (None, texts[0]), (3, texts[3]), (3, texts[4])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("n", F.lit("clash")).withColumn("row", F.lit("clash"))
    monkeypatch.setattr(alignment, "STEP", 2000)
    got = [tuple(r) for r in alignment.align(df, A, B, hot=hot).collect()]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(got, key=key) == sorted(plain(docs), key=key)


def test_texts_across_batches(monkeypatch):
    monkeypatch.setattr(alignment, "KEEP", 50)
    own = alignment.Models(A, B)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["abc", "de" * rng.randrange(1, 60), "fg, h"]) for _ in range(40)) for _ in range(30)]
    want = {r[0]: r for r in plain(list(enumerate(texts)))}
    for s in range(0, 30, 7):
        for k, (n_a, n_b, n_groups, digest, same, same_n, other, other_n) in enumerate(own.texts_of(texts[s : s + 7]), s):
            assert (n_a, n_b, n_groups, digest) == (*want[k][1:4], want[k][7]) and same_n.sum() + other_n.sum() == n_groups


def test_identity_map():
    own = alignment.Models(A, B)
    hits = [i for i, k in enumerate(own.same) if k >= 0]
    assert len(hits) > 5000 and all(own.bytes_a[i] == own.bytes_b[own.same[i]] for i in hits)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(df, A, B).count() == 0
    rows = alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B).collect()
    assert [tuple(r)[1:] for r in rows] == [(0, 0, 0, 0, 0, 0, "")] * 2
