"""The pipeline's stages, each held against a plain version on its own input."""

import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from test_dedup import fingerprint, plain_lines, roots

import corpus_pipeline
from eligo.llm import toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    stock, bad = [f"word{k}" for k in range(300)], ["vile", "scum", "rotten", "foul"]
    line = lambda n: " ".join(rng.choice(stock) for _ in range(n))
    docs, labels = [], []
    for i in range(240):
        text = "\n".join(line(rng.randrange(4, 12)) for _ in range(rng.randrange(1, 5)))
        if i % 6 == 0:
            text += "\n" + " ".join(rng.sample(bad, 3)) + " " + line(3)
        docs.append((i, text, "en", f"s{i % 5}", len(text)))
        if i % 10:
            labels.append((i, 1, int(i % 6 == 0)))
    for i in range(240, 300):  # copies, exact and with a change of one letter, and a line that many share
        text = docs[(i - 240) * 3 + 1][1]
        docs.append((i, text if i % 2 else text.replace("word1", "wordl", 1) + "\nthis line is shared by many documents", "en", "s9", len(text)))
    docs += [(900, None, None, None, None), (901, "", "en", "s1", 0), (902, "tiny", "en", None, 4)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


def test_stages(spark, folder, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "sentencepiece"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, tables[-1], folder)
        assert k == 4 or got.columns == docs.columns
        got.write.parquet(f"file://{tmp_path}/{k}")
        tables.append(spark.read.parquet(f"file://{tmp_path}/{k}"))
    start, clean, lines, heads, mixed, tokens = ([r for r in t.collect()] for t in tables)
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert {r.doc_id for r in clean} == {i for i, s in scores.items() if s < 0.3}
    assert {r.doc_id for r in start} - {r.doc_id for r in clean} <= {i for i in range(240) if i % 6 == 0} | set(range(240, 300))
    kept = plain_lines([(r.doc_id, r.text) for r in clean])
    want = {r.doc_id: kept[r.doc_id] for r in clean if kept[r.doc_id] == r.text or kept[r.doc_id].strip()}
    assert {r.doc_id: r.text for r in lines} == want and len(lines) < len(clean)
    codes = {r.doc_id: fingerprint(r.text) for r in lines}
    comp = roots(list(codes), lambda a, b: (codes[a] ^ codes[b]).bit_count() <= 2)
    assert sorted(r.doc_id for r in heads) == sorted(set(comp.values()))
    by = {r.doc_id: r for r in heads}
    assert all(tuple(r) == tuple(by[r.doc_id]) for r in mixed)
    taken, size = Counter(), Counter()
    for r in mixed:
        taken[r.source] += len((r.text or "").split())
    for r in heads:
        size[r.source] += len((r.text or "").split())
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3 and all(taken[s] <= 3 * size[s] for s in size)
    assert abs(sum(taken.values()) - sum(size.values())) < 0.05 * sum(size.values()) + 20
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert Counter((r.doc_id, tuple(r.tokens)) for r in tokens) == Counter((r.doc_id, tuple(sp.encode(r.text or ""))) for r in mixed)
    again = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, tuple(r.tokens)) for r in again) == Counter((r.doc_id, tuple(r.tokens)) for r in tokens)


def test_stages_on_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, folder)
        assert got.count() == 0 and (k == 4 or got.columns == docs.columns)
