"""Classifiers on held-out documents, and personal data against plain patterns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eligo.llm import langid, pii, toxicity


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    stock = {"en": "the of and to in that is was for with".split(), "de": "der die und von das mit für nicht eine über".split(), "fr": "le la les des une est que dans pour être".split()}
    bad = ["vile", "scum", "rotten", "foul"]
    docs, labels = [], []
    for i in range(600):
        lang = rng.choice(list(stock))
        words = [rng.choice(stock[lang]) for _ in range(rng.randrange(8, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words), lang))
        if i % 10:
            labels.append((i, int(toxic)))
    docs += [(1000, None, None), (1001, "", "en"), (1002, "123 456", "de"), (None, "the vile scum", "en"), (1003, "und " * 40_000, "de"), (5, docs[5][1], docs[5][2])]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")), spark.createDataFrame(labels + [(7, None), (None, 1)], "doc_id long, toxic int")


def test_toxicity(spark, tables):
    docs, labels = tables
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert len(held) > 80
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    same = {r.score for r in got if r.doc_id in (1000, 1001)}
    assert len(same) == 1 and same.pop() < 0.3
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id % 6 = 0 and doc_id < 600").count() <= 2
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0
    assert {r.score for r in toxicity.toxicity(docs.limit(3), labels.limit(0)).collect()} == {0.5}


def test_scores_do_not_read_labels_of_held_out_rows(spark, tables):
    docs, labels = tables
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(2, 4), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted((r.doc_id or -1, round(r.score, 12)) for r in toxicity.toxicity(docs, x).collect()) for x in (labels, turned))
    assert one == two


def test_language(spark, tables):
    docs, _ = tables
    got = langid.identify(docs)
    rows = got.collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out and r.doc_id < 600]
    assert len(held) > 80 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert {r.doc_id: (r.lang_pred, r.score) for r in rows if r.doc_id in (1000, 1001, 1002)} == dict.fromkeys((1000, 1001, 1002), ("und", 0.0))
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == docs.count()
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_many_rows_of_one_id_and_a_rare_language(spark, tables):
    docs, labels = tables
    docs = docs.unionByName(spark.range(2000).selectExpr("3L AS doc_id", "'the vile scum in the of' AS text", "'en' AS lang", "'x' AS score"))
    rare = spark.createDataFrame([(5000 + i, f"zażółć gęślą jaźń {i} źdźbło łódź", "pl", "x") for i in range(12)], docs.schema)
    docs = docs.unionByName(rare)
    got = langid.identify(docs, limit=60).where("doc_id >= 5000 and held_out").collect()
    assert got and all(r.lang_pred == "pl" for r in got)
    scores = toxicity.toxicity(docs, labels).where("doc_id < 600 and held_out").collect()
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in scores) / len(scores) > 0.95


def test_ftrl_equals_the_plain_recursion():
    """Per-coordinate sums and the proximal step, written out for one example at a time."""
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(30, size=6, replace=False)), int(rng.random() < 0.4)) for _ in range(200)]
    a, b, l1, l2 = 0.3, 1.0, 0.5, 1.0
    z, n, bias, nb = {}, {}, 0.0, 0.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((b + n[i] ** 0.5) / a + l2)

    for _ in range(3):
        for x, y in rows:
            w = {int(i): weight(int(i)) for i in x}
            g = 1 / (1 + np.exp(-(sum(w.values()) + bias))) - y
            for i, wi in w.items():
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / a * wi
                n[i] = old + g * g
            nb += g * g
            bias -= a * g / (b + nb**0.5)
    at, w, intercept = toxicity.fit_ftrl(rows, a, b, l1, l2, epochs=3)
    assert {int(i): pytest.approx(x) for i, x in zip(at, w)} == {i: weight(i) for i in z if weight(i)} and intercept == pytest.approx(bias)


def plain_spans(text):
    """The four patterns, as given."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        s = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(d))))
        if 13 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a.b@c.d", "x@y", "@", "a@b.c@d.e.f", "1.2.3.4", "300.1.2.3", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (222) 555-0101", "+49.30.1234567", "+1+2", "é", " ", "..", "-", "+", "9" * 16, "0.0.0.0", "a%b+c@d-e.f"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "."]) for _ in range(rng.randrange(1, 7)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans(None) == [] and pii.base_spans("") == []
    assert len(pii.base_spans("9" * 100_000 + " a@b.c " + "x" * 100_000 + "." * 1000)) == 1


def test_personal_data(spark):
    rng, docs = random.Random(2), []
    for i in range(300):
        words = [rng.choice(["some", "words", "of", "text", "12", "1999"]) for _ in range(30)]
        words.insert(rng.randrange(30), rng.choice([f"u{i}.x@mail{i % 9}.example.com", f"10.{i % 256}.3.4", f"+1 ({200 + i}) 555-{1000 + i}", "4111111111111111", "4111111111111112", ""]))
        docs.append((i, " ".join(words)))
    docs += [(1000, None), (1001, ""), (None, "a@b.co"), (5, docs[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit(0))
    rows = pii.personal_data(df).collect()
    assert len(rows) == len(docs)
    by = {r.doc_id: r for r in rows}
    for i, t in docs:
        base, r = plain_spans(t or ""), by[i]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in base) for x in pii.KINDS]
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))
    assert pii.personal_data(df.limit(0)).count() == 0


def planted(rng, n):
    """Texts with one entity each, in the given ways, and as many with numbers that are none: (text, bounds)."""
    out = []
    for k in range(n):
        kind = rng.choice(pii.KINDS)
        a, b, c = rng.randrange(200, 999), rng.randrange(200, 999), rng.randrange(1000, 9999)
        base = {"email": f"u{k}.x@mail{k % 9}.example.com", "ip": f"10.{k % 256}.{a % 256}.{b % 256}", "phone": f"+1 ({a}) {b}-{c}", "card": ""}[kind]
        if kind == "card":
            digits = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
            base = next(digits + str(d) for d in range(10) if pii.luhn(digits + str(d)))
        out.append((f"{rng.choice(['call', 'see', 'note', 'with'])} {rng.choice(['me', 'us', 'it'])} at ", kind, base, f" or {rng.choice(['not', 'so', 'in ' + str(rng.randrange(1900, 2030)), 'by ' + str(rng.randrange(10, 999)) + ' of them'])} now"))
    return out


def test_the_field_adds_rewritten_spans():
    rng = random.Random(5)
    train = planted(rng, 900)
    examples = [pii.rewrite(a + base + b, k) for k, (a, _, base, b) in enumerate(train)]
    assert any(t != a + base + b for (t, _), (a, _, base, b) in zip(examples, train)) and all(pii.base_spans(t) or g for t, g in examples)
    examples += [(f"{rng.choice(['about', 'some', 'over'])} {rng.randrange(5, 90)} of {rng.randrange(1900, 2030)} {rng.choice(['cases', 'and'])} {rng.randrange(90, 900)} more", []) for _ in range(200)]
    field = pii.train(examples, epochs=3)
    right = wrong = lost = 0
    for k, (a, kind, base, b) in enumerate(planted(rng, 300)):
        said = pii.rewritten(kind, base, rng.randrange(100))
        text = a + said + b
        base_found = pii.base_spans(text)
        added = [x for x in pii.all_spans(text, base_found, field) if x not in base_found]
        hit = (kind, len(a), len(a) + len(said.rstrip(".)"))) in added
        right, wrong, lost = right + hit, wrong + len(added) - hit, lost + (not hit and not base_found)
    assert right / (right + wrong) > 0.9 and right / (right + lost) > 0.8, (right, wrong, lost)
    assert pii.all_spans("there were 12 of 1999 in 300 cases", [], field) == []
    text = "call me at +1 (222) 555-1234 or not"
    assert pii.all_spans(text, pii.base_spans(text), field) == pii.base_spans(text)


def test_decoding_equals_enumeration():
    rng = np.random.default_rng(4)
    for _ in range(60):
        field = pii.Field(rng.normal(size=(pii.PLACES, len(pii.KINDS))), rng.normal(size=(pii.OTHER + 1, pii.OTHER + 1)))
        text = " ".join(rng.choice(["a@b", "12", "word", "+3", "1.2", "(at)"], size=5))
        for tokens in pii.neighbourhoods(text):
            cands = pii.segments(text, tokens)

            def ways(i, label):
                if i == len(tokens):
                    yield 0.0, []
                    return
                for s, rest in ways(i + 1, pii.OTHER):
                    yield s + field.pairs[label, pii.OTHER], rest
                for first, j, a, b in cands:
                    if first == i:
                        for k in range(pii.OTHER):
                            own = field.pairs[label, k] + field.spans[pii.span_features(text, a, b), k].sum()
                            for s, rest in ways(j, k):
                                yield s + own, [(pii.KINDS[k], a, b), *rest]

            best = max(ways(0, pii.OTHER), key=lambda x: x[0])
            assert sorted(pii.decode(text, tokens, field)) == sorted(best[1])


def test_entities_anywhere_in_a_long_run():
    card, field = "4111 1111 1111 1111", pii.Field()
    field.spans[zlib.crc32(b"shape0 0 0 0") % pii.PLACES, pii.KINDS.index("card")] = 1
    for n in range(56, 140):
        text = "x1 " * n + card + " x1" * 80
        assert pii.all_spans(text, [], field) == [("card", 3 * n, 3 * n + len(card))]
