"""Tokens against the library, archives through damage, mixtures by their invariants, neighbours by recall."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from eligo.llm import ann, mixing, pieces, warc

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_tokens_equal_the_library(library):
    rng = random.Random(1)
    enc = pieces.Encoder(pieces.load_model(MODEL))
    texts = ["", " ", "Hello  world\n\ttest é 😀 x ﬁ", "a" * 700 + " b", "   lead", "ab" * 5 + "\0zz", "((((( ===== " + "=" * 500, "日本語テキスト", "<s> <0x0A> </s>", "tail  ", "x\r\ny"]
    texts += ["".join(rng.choice("abcdeé \n.1") for _ in range(rng.randrange(1, 260))) for _ in range(300)]
    texts += ["".join(rng.choice("abet") for _ in range(rng.randrange(190, 400))) for _ in range(10)]
    flat, sizes = enc.encode(texts)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    raw = pieces.load_model(MODEL)["raw"]
    for k, t in enumerate(texts):
        ids = flat[ends[k] : ends[k + 1]].tolist()
        assert ids == library.encode(t), t
        assert pieces.decode_ids(ids, raw) == t


@pytest.mark.parametrize("top", [1, 3, 100, 255, 300, 5000, 1_100_000])
def test_suffixes_are_sorted_in_few_rounds(top):
    rng = np.random.default_rng(top)
    text = rng.integers(0, top + 1, 400)
    text[200:300] = text[100:200]  # long repeats
    text[-1] = 0
    got = pieces.Suffixes(text, top, 16)
    if top <= 255:
        assert len(got.levels) <= 2  # five sorts before
    wanted = np.zeros((60, 16), dtype=np.uint64)
    lengths = rng.integers(1, 17, 60)
    for k, (i, n) in enumerate(zip(rng.integers(0, 380, 60), lengths)):
        wanted[k, :n] = text[i : i + n]
        if k % 5 == 0 and top > 1:
            wanted[k, n - 1] = wanted[k, n - 1] % top + 1
    kept = [k for k in range(60) if (wanted[k, : lengths[k]] > 0).all()]
    at, many = got.occurrences(wanted[kept], lengths[kept])
    for k, found in zip(kept, np.split(at, np.cumsum(many)[:-1])):
        n = lengths[k]
        assert sorted(found.tolist()) == [i for i in range(401 - n) if (text[i : i + n] == wanted[k, :n]).all()]


def test_chunks_are_learned_in_slices(library, monkeypatch):
    """Tokens do not depend on what is learned together; tokens are sure to decode only where they do."""
    monkeypatch.setattr(pieces, "SLICE", 50)
    model = pieces.load_model(MODEL)
    enc = pieces.Encoder(model)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("aeinst,é日😀") for _ in range(rng.randrange(1, 14))) for _ in range(30)) for _ in range(40)]
    texts += ["", None, "one\n\ntwo \n three", " led", "two  gaps", "mark ▁ inside", "nul\0 in it", "z" * 90 + " " + "q" * 260]
    for _ in range(2):
        flat, sizes, sure = enc.encoded(texts)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for k, t in enumerate(texts):
            ids = flat[ends[k] : ends[k + 1]].tolist()
            assert ids == library.encode(t or "")
            assert sure[k] == (pieces.decode_ids(ids, model["raw"]) == (t or "")), t
    for t in texts:
        assert not t or pieces.split(t) == pieces.CHUNK.findall(pieces.MARK + t.replace(" ", pieces.MARK))


def test_encoding_holds_little_at_once(library):
    """Of a large batch only a part is held as strings, and few new chunks are learned together; rows, nulls and tokens stay as they are."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(6)
    enc = pieces.Encoder(pieces.load_model(MODEL))
    fresh = lambda n: list({"▁" + "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 14))) for _ in range(n)})
    words = fresh(3000)
    texts = [" ".join(w[1:] for w in rng.choices(words, k=600)) for _ in range(4500)]
    texts[7:9] = [None, ""]
    texts[20] = "one text of more than a part " * 50_000
    part = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    chunks, most = fresh(60_000), {}
    jobs = {"learn": lambda: enc.learn(chunks), "rows": lambda: [r.num_rows for r in pieces.encoded_rows(enc, part)]}
    for name, job in jobs.items():
        enc.reset()
        tracemalloc.start()
        try:
            job()
            most[name] = tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()
    assert most["learn"] < 40 and most["rows"] < 60, most  # 81 and 77 MB before
    enc.reset()
    got = [r for b in pieces.encoded_rows(enc, part) for r in b.to_pylist()]
    assert [r["doc_id"] for r in got] == list(range(len(texts))) and all(r["round_trip"] and r["n_tokens"] == len(r["tokens"]) for r in got)
    for k in (*range(0, 30), 2999, 4499):
        assert got[k]["tokens"] == library.encode(texts[k] or "")
    assert list(pieces.encoded_rows(enc, part.slice(0, 0))) == []


def test_encode_and_decode(spark):
    docs = [(1, "Some plain words."), (2, None), (3, ""), (None, "x"), (4, "mark ▁ inside"), (1, "Some plain words."), (5, "long " * 30_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    got = pieces.encode(df, MODEL)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(got.collect()) == len(docs)
    assert all(r.n_tokens == len(r.tokens) for r in rows.values()) and rows[2].tokens == [] and rows[3].n_tokens == 0
    assert [rows[k].round_trip for k in (1, 2, 3, 4, 5)] == [True, True, True, False, True]
    back = {r.doc_id: r.text for r in pieces.decode(got, MODEL).collect()}
    assert back[1] == docs[0][1] and back[4] == "mark   inside" and back[5] == docs[6][1]
    assert pieces.encode(df.limit(0), MODEL).count() == 0


def archive(n=6):
    records = [warc.record(i, f"http://h/{i}", f"<p>page {i}</p>".encode() * 40, None) for i in range(n)]
    return [warc.member(r) for r in records], records


def told(data, window=64):
    return list(warc.salvage(lambda at, n: data[at : at + n], len(data), window))


@pytest.mark.parametrize("window", [64, 1 << 20])
def test_salvage(window):
    members, plain = archive()
    whole = told(b"".join(members), window)
    assert [r["page_id"] for r in whole] == list(range(6)) and not [r for r in whole if r["kind"] == "gap"]
    assert [r["page_id"] for r in told(b"".join(plain), window)] == list(range(6))
    bad = bytearray(b"".join(members))
    at = len(members[0]) + len(members[1]) // 2
    bad[at] ^= 0xFF
    got = told(bytes(bad), window)
    assert [r["page_id"] for r in got if r["kind"] == "record"] == [0, 2, 3, 4, 5]
    gaps = [r for r in got if r["kind"] == "gap"]
    assert sum(g["length"] for g in gaps) == len(members[1]) and gaps[0]["at"] == len(members[0])
    torn = told(b"junk" + b"".join(members[:3]) + members[3][:40], window)
    assert [r["page_id"] for r in torn if r["kind"] == "record"] == [0, 1, 2]
    assert sum(r["length"] for r in torn) == 4 + sum(map(len, members[:3])) + 40
    changed = plain[1].replace(b"page 1", b"page X", 1)
    mixed = told(plain[0] + changed + members[2] + plain[3], window)
    assert [r["page_id"] for r in mixed if r["kind"] == "record"] == [0, 2, 3]


@pytest.mark.parametrize("window", [64, 1000, 1 << 20])
def test_salvage_of_members_of_many_records(window):
    rng = random.Random(3)
    records = [warc.record(i, f"http://h/{i}", rng.randbytes(900), None) for i in range(50)]
    hurt = lambda i: records[:i] + [records[i].replace(b"msgtype=response\r\nContent-Length: ", b"msgtype=response\r\nContent-Length: 9")] + records[i + 1 :]
    whole, other = warc.member(b"".join(records)), warc.member(warc.record(77, None, b"x", None))
    ids = lambda rows: [r["page_id"] for r in rows if r["kind"] == "record"]
    gaps = lambda rows: [(r["member"], r["inside"], r["span"]) for r in rows if r["kind"] == "gap" and "inside" in r]
    rows = told(whole + other, window)
    assert ids(rows) == [*range(50), 77] and not gaps(rows) and sum(r["length"] for r in rows) == len(whole + other)
    place = [sum(map(len, records[:i])) for i in range(51)]
    for i in (0, 25, 49):  # a record that does not fit, by its length
        rows = told(warc.member(b"".join(hurt(i))) + other, window)
        assert ids(rows) == [k for k in range(50) if k != i] + [77]
        assert gaps(rows) == [(0, place[i], len(hurt(i)[i]))]
    for at in (3000, len(whole) // 2, len(whole) - 1500):  # a byte that does not fit, in data that do not refer back
        bad = bytearray(whole)
        bad[at] ^= 1
        rows = told(bytes(bad) + other, window)
        assert len(ids(rows)) >= 49 and ids(rows)[-1] == 77 and gaps(rows)
        assert sum(r["length"] for r in rows) == len(whole + other)
    for torn in (500, 20_000):  # cut off, then another member
        rows = told(whole[:-torn] + other, window)
        n = len(ids(rows)) - 1
        assert ids(rows) == [*range(n), 77] and n >= 50 - torn // 900 - 3
        assert sum(r["length"] for r in rows) == len(whole) - torn + len(other)
    unsigned = [r.replace(b"WARC-Block-Digest", b"X-Block-Digest") for r in records[:3]]
    assert ids(told(warc.member(b"".join(unsigned)), window)) == [0, 1, 2]
    bad = bytearray(warc.member(b"".join(unsigned)))
    bad[-2] ^= 1
    assert ids(told(bytes(bad), window)) == []  # nothing vouches for them
    assert ids(told(b"".join([records[0], records[1].replace(b"\r\n\r\n", b"\r\n", 1), records[2]]), window)) in ([0, 2], [0, 1, 2])


def test_false_lengths_cost_no_reading():
    records = [warc.record(i, None, b"y" * 1000, None) for i in range(400)]
    data = records[0].replace(b"response\r\nContent-Length: ", b"response\r\nContent-Length: 9") + b"".join(records[1:])
    read = []
    rows = list(warc.salvage(lambda at, n: read.append(min(n, len(data) - at)) or data[at : at + n], len(data), 4096))
    assert [r["page_id"] for r in rows if r["kind"] == "record"] == list(range(1, 400)) and max(read) <= 4096
    huge = b"WARC/1.0\r\nContent-Length: 999999999999\r\n\r\n"
    assert [r["page_id"] for r in told(warc.member(huge + records[5]), 1000) if r["kind"] == "record"] == [5]


def test_a_gap_fails_the_query(spark, monkeypatch):
    df = spark.createDataFrame([(1, "u", "some text"), (2, "u", "more text")], "page_id long, url string, html string")
    listed = warc.archive(df)
    for r in listed.collect():
        path = r.path.removeprefix("file:").replace("//", "/")
        with open(path, "r+b") as f:
            f.seek(200)
            f.write(b"zzzz")
    assert warc.read(listed).where("kind = 'gap'").count() > 0
    monkeypatch.setattr(warc, "archive", lambda *_: listed)
    with pytest.raises(Exception, match="are lost"):
        warc.round_trip(df).collect()


def test_archives_round_trip(spark):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "http://a/\r\nX: y", ""), (5, "http://ü/ö", "é" * 50_000), (7, "u", "same"), (None, "u", "same"), (2, "again", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    got = sorted(warc.round_trip(df).collect(), key=lambda r: (r.page_id or 0, r.record_type))
    kinds = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got]
    assert kinds == [(None, "response", None, 4), (1, "revisit", 7, 4), (2, "revisit", 7, 4), (2, "revisit", 7, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 100_000), (7, "response", None, 4)]
    assert all(r.payload_digest == warc.digest(b"same") for r in got if r.payload_bytes == 4)
    assert warc.round_trip(df.limit(0)).count() == 0
    listed = warc.archive(df)
    full = warc.read(listed).where("page_id = 5").first()
    assert bytes(full.payload).decode() == "é" * 50_000
    few = warc.round_trip(df.where("page_id is not null"), least=5).where("payload_bytes < 5")
    assert {r.record_type for r in few.collect()} == {"response"}


def test_mixture(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").withColumn("copies", F.lit("clash"))
    more = spark.createDataFrame([(9001, None, "src1", "x"), (9002, "", None, "x"), (9003, "a b c", None, "x"), (9003, "a b c", None, "x"), (None, "w " * 5000, "src2", "x"), (9004, "word", "", "x")], docs.schema)
    df = docs.unionByName(more)
    got = mixing.taken(df)
    rows = got.collect()
    assert len(rows) == df.count()
    words = {}
    for r in df.collect():
        words.setdefault(r.source, []).append(len((r.text or "").split()))
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total = sum(map(sum, words.values()))
    target, capped = {}, set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sum(words[s]) for s in capped)
        target = {s: 3 * sum(words[s]) if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > 3 * sum(words[s])}
        if not over:
            break
        capped |= over
    by = {}
    source = {(r.doc_id, (r.text or "")): r.source for r in df.collect()}
    ids = {k[0]: s for k, s in source.items()}
    for r in rows:
        by.setdefault(ids[r.doc_id], []).append(r)
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 3 * r.size
    for s, own in by.items():
        assert own[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in own) - target[s]) <= max(0.03 * target[s], max(r.size for r in own) / 2 + 1)
    assert sum(target.values()) == pytest.approx(total)
    again = {(r.doc_id, r.size): r.taken for r in mixing.taken(df.repartition(5)).collect()}
    assert again == {(r.doc_id, r.size): r.taken for r in rows}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.taken(df.limit(0)).count() == 0


def test_mixture_of_a_large_source(spark):
    """A source of 6,000 documents and a row that comes 500 times: shards are equal, quotas exact, what is taken near its target."""
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', int(id % 40)) AS text", "'a' AS source")
    docs = docs.unionByName(spark.range(500).selectExpr("7L AS doc_id", "'same words here' AS text", "'b' AS source")).unionByName(spark.range(30).selectExpr("id + 9000 AS doc_id", "'few' AS text", "'c' AS source"))
    rows = mixing.taken(docs).collect()
    assert len(rows) == 6530
    for size, target in {(r.source_size, r.target) for r in rows}:
        own = [r for r in rows if r.source_size == size]
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own) / 2 + 1 and all(r.copies == len(r.shards) <= 3 for r in own)
    words = [0] * mixing.LEAST_SHARDS
    for r in rows:
        for s in r.shards:
            words[s] += r.size
    assert sum(words) == sum(r.taken for r in rows) and max(words) < 1.15 * min(words)
    same = [r.copies for r in rows if r.source_size == 1500]
    assert set(same) <= {2, 3} or len(set(same)) <= 2
    mixed = mixing.mix(docs)
    assert mixed.count() == sum(r.copies for r in rows)


def test_mixture_of_many_equal_rows(spark):
    """200,000 equal rows and 200,000 null ones: what equal rows have in common is held once, and a copy is a row."""
    docs = spark.range(200_000).selectExpr("7L AS doc_id", "'same words here' AS text", "'b' AS source").unionByName(spark.range(200_000).selectExpr("cast(null AS long) AS doc_id", "cast(null AS string) AS text", "cast(null AS string) AS source"))
    docs = docs.unionByName(spark.range(400).selectExpr("id AS doc_id", "repeat('w ', 900) AS text", "'a' AS source"))
    got = mixing.taken(docs).groupBy("source_size", "size", "copies").agg(F.count("*").alias("n"), F.sum("taken").alias("words"), F.first("target").alias("target")).collect()
    assert sum(r.n for r in got) == 400_400 and all(r.copies <= 3 for r in got)
    for size, target in {(r.source_size, r.target) for r in got}:
        assert abs(sum(r.words for r in got if r.source_size == size) - target) <= 450
    assert mixing.mix(docs).count() == sum(r.n * r.copies for r in got)


def test_blocks_are_drawn(spark):
    """A source's blocks go to the shards in seeded order, whatever their number."""
    docs = spark.range(4096).selectExpr("id AS doc_id", "'four words of text' AS text", "'a' AS source")
    known, copies = mixing.plan(docs)
    first = {r.shard: r.place for r in copies.join(known, mixing.UNIT).groupBy("shard").agg(F.avg(F.xxhash64(*mixing.UNIT, F.lit("order"))).alias("place")).collect()}
    places = [first[s] for s in sorted(first)]
    assert len(places) == mixing.LEAST_SHARDS and places != sorted(places) and places != sorted(places, reverse=True) and max(map(abs, places)) < 2**62


def test_tree_is_exact(spark):
    quotas = np.array([100, 0, 37, 5000, 12, 1, 900, 300])
    got = mixing.split(quotas, 4, 1)
    assert got.shape == (16, 8) and (got.sum(axis=0) == quotas).all() and (got >= 0).all()
    assert got.sum(axis=1).max() - got.sum(axis=1).min() <= 1
    share = [mixing.split(np.array([100, 900]), 1, node)[0, 0] for node in range(1, 400)]
    assert 48.5 < np.mean(share) < 51.5 and 3.8 < np.std(share) < 5.6
    sources = spark.createDataFrame(list(enumerate(quotas.tolist())), "index long, blocks long")
    dealt = mixing.deal(sources, 10).toPandas()  # more levels than one task takes
    assert dealt["shard"].min() >= 0 and dealt["shard"].max() < 1024 and set(dealt.groupby("shard")["blocks"].sum()) <= {6, 7}
    assert dealt.groupby("index")["blocks"].sum().to_dict() == {k: q for k, q in enumerate(quotas.tolist()) if q}


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[200:260] = x[200]  # a hot vector
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)] + [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (None, [1.0] * 24), (5060, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    d = x.astype(np.float64)
    recall, by = [], {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 1500, 20))
    for q, rs in by.items():
        rs = sorted(rs, key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, 21)) and q not in [r.vec_id for r in rs]
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        assert all(r.score == pytest.approx(d[q] @ d[r.vec_id], abs=1e-9) for r in rs)
        s = d @ d[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        recall.append(len(set(best.tolist()) & {r.vec_id for r in rs}) / 20)
    assert np.mean(recall) >= 0.9
    few = ann.nearest(df.where("vec_id < 10"), F.col("vec_id") % 20 == 0, part=1e-9).collect()
    assert sorted(r.vec_id for r in few) == list(range(1, 10))
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_vectors_at_the_ends_of_the_range(spark):
    rows = [(0, [1e-200, 1e-200]), (1, [2e-200, 1e-200]), (20, [1.0, 2.0]), (21, [1e308, 1e308]), (21, [1.0, 1.0]), (20, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect()}
    assert [got[20, k][0] for k in (1, 2, 3)] == [21, 1, 0] and got[0, 1][0] == 21 and len(got) == 6


def test_buckets_come_in_the_order_of_their_sums():
    rng = np.random.default_rng(3)
    place = rng.normal(size=(20, 9))
    got = ann.sequence(place, 100)
    for p, codes in zip(place, got):
        sums = sorted((sum(abs(p[h]) for h in range(9) if (c >> (8 - h) & 1) != (p[h] > 0)), c) for c in range(512))
        assert codes.tolist() == [c for _, c in sums[:100]]


def test_limits_stand_for_the_listed_buckets():
    """A query is sent with a limit for each table, not with its buckets; from it regions list just those of the least sums."""
    x = np.random.default_rng(5).standard_normal((60_000, 24))
    index = ann.Index(len(x), float(np.linalg.norm(x, axis=1).max()), 2, None)
    p = index.projected(x, False)
    index.centre[24], index.deviation[24] = p.mean(axis=0), p.std(axis=0)
    index.deviation[24][1, 5:7] = 0  # hashes that lose nothing
    queries = x[:15]
    place = index.projected(queries, True) * index.deviation[24]
    sent = 0
    for k, t, regions, limit in index.asked(queries):
        sent += len(regions) + 1
        got = []
        for r in regions.tolist():
            buckets, adds = index.within(queries, t, r)
            got.append((r << index.rest) + buckets.codes(k, limit - adds[k]))
        loss = ann.losses(place[k : k + 1, t])[0]
        away = (np.arange(2**index.hashes) ^ ann.sides(place[k, t]))[:, None] >> np.arange(index.hashes)[::-1] & 1
        assert sorted(np.concatenate(got).tolist()) == sorted(np.argsort(away @ loss, kind="stable")[: index.probes].tolist())
    assert index.lead and sent < index.probes  # thirty lists of as many buckets before


def test_ranks_are_of_double_precision(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=12) + 1e-11 * rng.normal(size=(300, 12))  # one vector in single precision
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 100 == 0, part=1.0).collect()
    for q in (0, 100, 200):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == np.lexsort((np.arange(300), -s))[:20].tolist()


def test_rows_are_looked_up_by_bucket():
    rng = np.random.default_rng(4)
    codes, wanted = rng.integers(0, 50, 300), np.sort(rng.choice(60, 12, replace=False))
    order = np.argsort(codes, kind="stable")
    assert sorted(ann.looked_up(codes[order], order, wanted)) == np.flatnonzero(np.isin(codes, wanted)).tolist()


def test_probes_are_selective():
    """Vectors without structure: the share of rows that a query ranks, all tables together, falls as rows grow in number, and the nearest are among them."""
    ranked = []
    for n in (500, 2000, 20_000, 50_000):
        x = np.random.default_rng(0).standard_normal((n, 64))
        index = ann.Index(n, float(np.linalg.norm(x, axis=1).max()), ann.TABLES, None)
        p = index.projected(x, False)
        index.centre[64], index.deviation[64] = p.mean(axis=0), p.std(axis=0)
        queries = np.arange(0, n, 20)[:100]
        s = x[queries] @ x.T
        s[np.arange(len(queries)), queries] = -np.inf
        top = np.argsort(-s, axis=1)[:, :20]
        codes, seen, total = index.codes(x), np.zeros(s.shape, dtype=bool), 0
        for t in range(ann.TABLES):
            for k, (regions, lists) in enumerate(index.visits(x[queries], t)):
                wanted = np.concatenate([(r << index.rest) + c for r, c in zip(regions, lists)])
                assert len(wanted) == index.probes
                hit = np.isin(codes[:, t], wanted)
                seen[k] |= hit
                total += hit.sum()
        assert np.mean([seen[k][top[k]].mean() for k in range(len(queries))]) >= 0.9, n
        ranked.append(total / s.size)
    assert ranked == sorted(ranked, reverse=True) and ranked[-1] < 0.3, ranked


def test_blocks_results_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(ann, "FAN", 2)
    monkeypatch.setattr(ann, "BLOCK", 40)
    x = np.random.default_rng(8).normal(size=(400, 12))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, part=1.0).collect()  # all buckets: exact
    for q in range(0, 400, 20):
        s = x @ x[q]
        s[q] = -np.inf
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == np.argsort(-s)[:20].tolist()
    assert {r.n_scored for r in got} == {399 * ann.TABLES}


def test_regions_come_in_order_of_success():
    place = np.array([[2.0, -0.1, 0.3, 0.5]])
    (goes,) = ann.regions_visited(place, 2, 0.2)
    rest = np.random.default_rng(1).choice(ann.MEANS, size=(200_000, 2), p=ann.CHANCES / ann.CHANCES.sum()) @ place[0, 2:]
    held = [c * (rest + s >= ann.bound(place, 0.2)[0]).mean() for c, s in zip(ann.region_chances(2), ann.region_scores(place, 2)[0], strict=True)]
    assert sum(held[g] for g in goes) > 0.9 * sum(held) and held[goes[0]] > 0.8 * max(held) and len(goes) < 16
    assert len(ann.regions_visited(place, 0, 0.2)[0]) == 1
