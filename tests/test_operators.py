"""Golden cases and properties of operators that SQL cannot express, or that read and write files."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eligo.functions import phrases as P
from eligo.functions.graph import components, spanning_forest
from eligo.functions.porter import stem
from eligo.operators import clusters as K
from eligo.operators import draft, mesh, metrics, parse, predict, trials
from eligo.plans.fixtures import view
from eligo.queries import codes, drafting, parsing
from eligo.sources import criteria as C


def test_golden_paragraphs(spark):
    text = "\n".join(
        [
            "Inclusion Criteria:", "Adults of any sex with a confirmed diagnosis of the disease under study and a signed consent form", "Patient characteristics: Age: 18 and over; not above 90",
            "Exclusion Criteria:", "a known allergy to the study drug (or its parts; any of them), e.g. A. Next sentence about pregnant participants", "* BMI ≥ 30", "abc",
        ]
    )
    got = parse.parse_criteria(spark.createDataFrame([("NCT1", text), ("NCT2", "only one plain line of text without keys"), ("NCT3", ""), ("NCT4", None)], "ct_path string, criteria_str string"))
    rows = {(r.ct_path, r.criterion_idx): r for r in got.collect()}
    one = [rows["NCT1", i] for i in range(len([k for k in rows if k[0] == "NCT1"]))]
    assert [r.criterion for r in one] == [
        "Adults of any sex with a confirmed diagnosis of the disease under study and a signed consent form", "18 and over", "not above 90",
        "a known allergy to the study drug (or its parts; any of them), e.g. A.", "Next sentence about pregnant participants", "BMI > or equal to 30",
    ]
    assert [r.category for r in one] == ["in", "in", "in", "ex", "ex", "ex"]
    assert one[1].context == "Patient characteristics" and one[1].subcontext == "Age"
    assert {r.complexity for r in one} == {"easy"}
    two = rows["NCT2", 0]
    assert (two.category, two.complexity) == ("?", "hard")
    assert not [k for k in rows if k[0] in ("NCT3", "NCT4")]


def test_queries_take_whole_texts(spark, tmp_path):
    lines = [f"a plain line with the number {i} of a long text" for i in range(30)]
    docs = [(1, "\n".join(lines)), (2, "\n".join(lines[:3])), (3, "short text"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = parsing.c12_parse_criteria(lambda name: view(spark, f"file://{tmp_path}", name)).collect()
    by = {i: [(r.category, r.criterion) for r in sorted(got, key=lambda r: r.criterion_idx) if r.ct_path == f"NCT{i}"] for i in range(1, 5)}
    assert by[1] == [("in" if k < 15 else "ex", x) for k, x in enumerate(lines)]
    assert by[2] == [("in", x) for x in lines[:3]] and by[3] == [("?", "short text")] and not by[4]
    words = [f"w{i}" for i in range(50)]
    turns = [("c", 0, "user", " ".join(words)), ("c", 1, "assistant", " ".join(words))]
    spark.createDataFrame(turns, "conv_id string, turn int, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    (r,) = drafting.r12_generation_results(lambda name: view(spark, f"file://{tmp_path}", name)).collect()
    assert r.Cluster_rouge1_recall == r.LLM_rouge1_recall == 1.0


def test_parser_is_its_single_steps(spark):
    """The fold within a row gives what the steps give one after the other, without a shuffle."""
    rng = random.Random(5)
    stock = [
        "Inclusion Criteria:", "Exclusion criteria", "Exclusion Critera", "Patients must not have diabetes", "Patient characteristics: Age: 18 and over; see disease characteristics", "those are not excluded", "a; b (c; d) ; * x ≥ 3",
        "Renal: ok. Hepatic: fine; abcdef", "MUST HAVE fever of long standing", "ſee excluſion of all", "see renal: x", "Prior concurrent therapy: Chemotherapy: none; Other: yes", "requıred by all of them", "", "   ", "x", "abc",
    ]
    docs = [(f"N{i}", "\n".join(rng.choice(stock) for _ in range(rng.randrange(0, 14)))) for i in range(300)] + [("A", None), ("B", ""), ("C", "\n")]
    trials_ = spark.createDataFrame(docs, "ct_path string, criteria_str string").repartition(3)
    rows = parse.split_sentences(parse.split_paragraphs(trials_))
    rows = parse.drop_titles(parse.carry_category(parse.title_similarity(parse.match_category_keys(rows))))
    rows = parse.drop_short(parse.split_semicolons(parse.carry_context(parse.flag_contexts(parse.split_on_context_keys(rows)))))
    want = parse.normalise_symbols(rows, "pos", "piece_no", "part_no").withColumnRenamed("text", "criterion")
    got = parse.parse_criteria(trials_.select("*"))
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect()) and got.count() > 300
    plan = parse.parse_criteria(spark.read.schema("ct_path string, criteria_str string").parquet("/root/testdata/sf0.001/documents.parquet"))
    assert "Exchange" not in plan._jdf.queryExecution().toString()


def test_phrases_found_by_stems_are_all(spark):
    rng = random.Random(2)
    words = ["Patients", "patient", "have", "NOT", "no", "be", "must", "eligible", "inelıgible", "excluſions", "included", "excluded", "Requİred", "had", "to", "allowed", "populations", "consisted", "criterion", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(800)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for phrases, end in ((P.INCLUSION, P.END), (P.EXCLUSION, P.END), (["not (be )?excluded"], "")):
        rows = df.select(P.holds(F.col("t"), P.plain_case(F.col("t")), phrases, end).alias("a"), F.col("t").rlike(P.alternation(phrases, end)).alias("b")).collect()
        assert all(r.a == r.b for r in rows) and any(r.b for r in rows)


def test_carry_is_the_fold(spark):
    rng, rows = random.Random(3), []
    for t in range(60):
        for pos in range(12):
            rows.append((f"T{t}", pos, rng.random() < 0.2, rng.random() < 0.3, rng.random() < 0.3))
    df = spark.createDataFrame(rows, "ct_path string, pos int, is_title boolean, found_in boolean, found_ex boolean")
    got = {(r.ct_path, r.pos): r.category for r in parse.carry_category(df).collect()}
    carried, titled = {}, set()
    for t, pos, title, fin, fex in sorted(rows):
        own = "ex" if fex else "in" if fin else None
        assert got[t, pos] == (own or carried.get(t, "?"))
        if own and (title or t not in titled):
            carried[t] = own
        if title:
            titled.add(t)


def test_pruning_keeps_all_hits():
    rng = random.Random(1)
    for _ in range(150):
        base = rng.choice(P.TITLES + P.CONTEXT)
        text = "".join(rng.choice([c, c, c, "x", ""]) for c in base) + "z" * rng.randrange(0, 60)
        if P.best_ratio(text or "q", P.TITLES) > P.TITLE_LEVEL:
            assert len(text) <= P.longest(P.TITLES, P.TITLE_LEVEL)


def test_batch_similarity_is_the_ratio():
    rng = random.Random(8)
    for phrases, level in ((P.TITLES, P.TITLE_LEVEL), (P.CONTEXT, P.CONTEXT_LEVEL), (P.SUBCONTEXT, P.SUBCONTEXT_LEVEL)):
        texts = ["", "é ß", *[rng.choice(phrases) for _ in range(30)]]
        texts += ["".join(c for c in rng.choice(phrases) + " of it" if rng.random() < 0.85) for _ in range(150)]
        assert list(P.similar_to(phrases, level)(texts)) == [P.best_ratio(t, phrases) > level for t in texts]
    assert not len(P.similar_to(P.TITLES, 0.6)([]))


def test_similarity_helper(spark):
    texts = ["Exclusion Criteria:", "Patients must not have diabetes", "a blue sky", "Inclusion criteria", "x"]
    got = {r.sentence: r.is_title for r in parse.title_similarity(spark.createDataFrame([(t,) for t in texts], "sentence string")).collect()}
    assert got == {t: P.best_ratio(t, P.TITLES) > 0.6 for t in texts}


def test_trials_from_json(spark, tmp_path):
    new = {"protocolSection": {"identificationModule": {"nctId": "NCT01"}, "statusModule": {"overallStatus": "COMPLETED"}, "designModule": {"studyType": "INTERVENTIONAL", "phases": ["PHASE1"]},
           "armsInterventionsModule": {"interventions": [{"type": "DRUG"}]}, "conditionsModule": {"conditions": ["flu"]}, "eligibilityModule": {"eligibilityCriteria": "x"}}}
    old = {"ProtocolSection": {"IdentificationModule": {"NctId": "NCT02"}, "StatusModule": {"OverallStatus": "Terminated"}, "DesignModule": {"StudyType": "Interventional", "PhaseList": {"Phase": ["Phase 2"]}},
           "ArmsInterventionsModule": {"InterventionList": {"Intervention": [{"InterventionType": "Drug"}]}}, "ConditionsModule": {"ConditionList": {"Condition": ["cold"]}}, "EligibilityModule": {"EligibilityCriteria": "y"}}}
    for name, text in (("a/NCT01", json.dumps(new)), ("b/NCT02", json.dumps(old)), ("b/empty", ""), ("c/broken", "{nope"), ("c/NCT09", json.dumps(new))):
        f = tmp_path / f"{name}.json"
        f.parent.mkdir(exist_ok=True)
        f.write_text(text)
    rows = C.read_trials(spark, str(tmp_path))
    assert rows.count() == 3
    good, bad = trials.check_trial_id(rows, F.col("path"))
    kept = {r.nct_id: r for r in trials.filter_trials(good).collect()}
    assert set(kept) == {"NCT01", "NCT02"} and kept["NCT02"].phases == ["Phase 2"] and kept["NCT02"].conditions == ["cold"]
    assert [r.nct_id for r in bad.collect()] == ["NCT01"]


def test_files_round_trip(spark, tmp_path):
    xml = "<Set><DescriptorRecord><DescriptorUI>D1</DescriptorUI><DescriptorName><String>Flu</String></DescriptorName><TreeNumberList><TreeNumber>C1.2</TreeNumber><TreeNumber>C3</TreeNumber></TreeNumberList></DescriptorRecord></Set>"
    (tmp_path / "m.xml").write_text(xml)
    assert [tuple(r) for r in C.read_mesh_xml(spark, str(tmp_path / "m.xml")).collect()] == [("D1", "Flu", ["C1.2", "C3"])]
    v = spark.createDataFrame([(1, [1.0, 2.0])], "member_id long, embedding array<float>")
    C.write_embeddings(v, str(tmp_path / "e"), "one")
    C.write_embeddings(v, str(tmp_path / "e"), "two")
    assert C.read_embeddings(spark, str(tmp_path / "e"), "two").collect() == v.collect()
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "k long, t string")
    assert C.append_new(rows.limit(4), str(tmp_path / "r"), "k", 6).count() == 4
    assert C.append_new(rows, str(tmp_path / "r"), "k", 6).count() == 6
    # a run that was lost after its rows, before its commit; then it is run again, and once more
    rows.where("k > 7").write.parquet(str(tmp_path / "r" / "rows-000002"))
    assert C.read_appended(spark, str(tmp_path / "r"), rows.schema).count() == 6
    for _ in range(2):
        assert sorted(C.append_new(rows, str(tmp_path / "r"), "k", 9).collect()) == rows.where("k < 9").collect()
    trials.write_by_prefix(rows.select(F.concat(F.lit("NCT0123"), "k").alias("ct_path"), "t"), str(tmp_path / "landed"))
    assert [p.name for p in (tmp_path / "landed").glob("prefix=*")] == ["prefix=NCT0123xxxx"]
    report = tmp_path / "reports"
    report.mkdir()
    (report / "Tphase-Imean-P1.csv").write_text("class,precision,recall,f1-score,support\nA,1,1,1,2\nmacro avg,0.5,0.5,0.25,4\n")
    assert [tuple(r) for r in C.read_result_csvs(spark, str(report)).collect()] == [("phase", "mean", "1", 0.25)]
    nested = spark.createDataFrame([(1, "t", 0.5, "x", 1, 1)], "cluster_id int, title string, prevalence double, criterion string, position int, rank int")
    C.write_cluster_list(nested, str(tmp_path / "l"))
    C.write_cluster_json(nested, str(tmp_path / "j"))
    C.write_report(nested, str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "l"), header=True).columns == ["cluster_id", "prevalence", "title", "criterion"]
    with pytest.raises(ValueError):
        C.read_parsed_criteria(rows)


def blobs(spark, n=20, centres=((0, 0), (10, 0), (0, 10))):
    rng = np.random.default_rng(0)
    rows = [(c * n + i, [float(x) for x in np.array(p) + rng.normal(0, 0.3, 2)], c) for c, p in enumerate(centres) for i in range(n)]
    return spark.createDataFrame(rows, "member_id long, embedding array<float>, cluster_id int")


def test_spanning_forest_weight(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    edges = [(i, j, float(d[i, j])) for i in range(30) for j in range(i + 1, 30)]
    got = spanning_forest(spark.createDataFrame(edges, "a long, b long, weight double")).collect()
    inside, total = {0}, 0.0
    while len(inside) < 30:
        w, j = min((d[i, j], j) for i in inside for j in set(range(30)) - inside)
        inside.add(j)
        total += w
    assert len(got) == 29 and abs(sum(r.weight for r in got) - total) < 1e-9


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_perfect_and_random_labels(spark):
    rows = spark.createDataFrame([(str(i % 4), i % 4, i % 3, i) for i in range(120)], "truth string, same int, other int, id long")
    cont = metrics.contingency(rows, "truth", "same")
    assert metrics.homogeneity_completeness_v(cont).first()[2] == pytest.approx(1)
    assert metrics.adjusted_rand(cont).first()[0] == pytest.approx(1)
    assert metrics.adjusted_mutual_information(cont).first()[0] == pytest.approx(1)
    noise = metrics.contingency(metrics.random_labels(rows, "id", 4, 1), "truth", "random")
    assert abs(metrics.adjusted_rand(noise).first()[0]) < 0.1


def test_smote_balances(spark):
    rows = blobs(spark, 12).withColumn("label", F.when(F.col("cluster_id") == 0, "few").otherwise("many"))
    got = predict.oversample_minority(rows, "label").collect()
    assert sum(r.label == "few" for r in got) == sum(r.label == "many" for r in got) == 24
    assert all(abs(x) < 2 for r in got if r.member_id < 0 for x in r.embedding)


def test_models(spark):
    rng = np.random.default_rng(2)
    rows = [(f"t{i}", [float(x) for x in rng.normal(i % 2 * 3, 1, 4)], i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "ct_path string, features array<double>, target int")
    for family in ("ridge", "elasticnet"):
        assert predict.macro_f1(predict.predict(predict.fit_linear(df, family), df)) > 0.9
    assert predict.macro_f1(predict.predict(predict.fit_other(df, "tree"), df)) > 0.9
    best, score = predict.search_model(df, df, 3, seed=1, folds=2)
    assert best["family"] and score > 0.8


def test_ridge_is_least_squares(spark):
    """Weights and folds' scores equal the closed form."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 5)) * [1, 2, 3, 0.1, 1] + 4
    y = (x[:, 0] + rng.normal(size=150) > 4).astype(int) + (x[:, 1] > 5)
    rows = [(f"t{i}", [float(v) for v in x[i]], int(y[i]), i % 5) for i in range(150)]
    df = spark.createDataFrame(rows, "ct_path string, features array<double>, target int, fold int").repartition(4)

    def weights(at, alpha):
        xc, t = x[at] - x[at].mean(axis=0), np.where(y[at][:, None] == np.arange(3), 1.0, -1.0)
        w = np.linalg.solve(xc.T @ xc + alpha * np.eye(5), xc.T @ (t - t.mean(axis=0)))
        return w, t.mean(axis=0) - x[at].mean(axis=0) @ w

    model = predict.fit_linear(df, "ridge", 0.7)
    w, b = weights(np.arange(150), 0.7)
    assert np.allclose(model.weights, np.vstack([w, b]))
    said = {r.ct_path: r.y_pred for r in predict.predict(model, df).collect()}
    assert [said[f"t{i}"] for i in range(150)] == (x @ w + b).argmax(axis=1).tolist()
    want = []
    for alpha in (0.01, 50.0):
        scores = []
        for f in range(5):
            out = np.arange(150) % 5 == f
            w, b = weights(np.flatnonzero(~out), alpha)
            p, t = (x[out] @ w + b).argmax(axis=1), y[out]
            scores.append(np.mean([2 * ((p == c) & (t == c)).sum() / ((p == c).sum() + (t == c).sum()) for c in sorted(set(p) | set(t))]))
        want.append(np.mean(scores))
    assert np.allclose(predict.ridge_scores(df, [0.01, 50.0], 5), want)


def test_text_scores(spark):
    words = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi",
             "relational": "relat", "conditional": "condit", "electriciti": "electr", "goodness": "good", "adjustable": "adjust", "controll": "control", "rate": "rate"}
    assert {w: stem(w) for w in words} == words
    rng = random.Random(4)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert draft.lcs(a, b) == t[-1][-1]


def test_t_test():
    assert draft.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert draft.t_two_sided(0.0, 5) == pytest.approx(1)
    assert draft.t_two_sided(12.706, 1) == pytest.approx(0.05, abs=1e-4)


def test_wrap_label():
    text = K.wrap_label("inclusion criterion - " + "word " * 30, 20, 3)
    assert text.startswith("IN - ") and text.count("<br>") == 2 and text.endswith("...")
    assert all(len(x) <= 23 for x in re.split("<br>", text))


def test_clustering_score(spark):
    rows = spark.createDataFrame([(-1,), (0,), (1,), (1,)], "cluster_id int")
    assert K.clustering_score(rows, 0.2) == pytest.approx(0.2 + 0.5 * 0.75)
    assert K.clustering_score(rows.where("cluster_id = 0"), 0.2) == -math.inf


def test_stream_reads_each_file_once(spark, tmp_path):
    from eligo.streaming import stream_criteria

    def land(name):
        doc = {"protocolSection": {"identificationModule": {"nctId": name}, "statusModule": {"overallStatus": "COMPLETED"}, "designModule": {"studyType": "INTERVENTIONAL", "phases": ["PHASE1"]},
               "armsInterventionsModule": {"interventions": [{"type": "DRUG"}]}, "conditionsModule": {"conditions": ["flu"]}, "eligibilityModule": {"eligibilityCriteria": f"a criterion of {name}; and another one"}}}
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps(doc))

    for name in ("NCT1", "NCT2"):
        land(name)
        stream_criteria(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.ct_path, r.criterion_idx) for r in got.collect()) == [("NCT1", 0), ("NCT1", 1), ("NCT2", 0), ("NCT2", 1)]


def test_similar_criteria_come_whole(spark):
    held = "array('phase1') AS phases, array('C01.101') AS condition_ids, array('D01.101') AS intervention_ids"
    views = {
        "fx_eval": spark.sql(f"SELECT 'NCT0' AS ct_path, {held}"),
        "fx_criteria": spark.sql(f"SELECT concat('NCT', 1 + id % 9) AS ct_path, cast(id AS int) AS criterion_idx, {held} FROM range(100001)"),
    }
    assert drafting.r2_similar_criteria(views.__getitem__).count() == 100_001
    assert draft.similar_criteria(views["fx_eval"], views["fx_criteria"], 1, 1, most=7).count() == 7


def test_tree_labels_of_an_id_that_recurs(spark):
    views = {
        "fx_descriptors": spark.sql("SELECT * FROM VALUES ('D1', array('C11.101.100')), ('D1', array('C12.101.100', 'C11.101')), ('D2', array('C31.1')) AS t(descriptor_id, tree_numbers)"),
        "fx_mesh_labels": spark.sql("SELECT * FROM VALUES ('C11.101', 'heading b'), ('C12.101', 'heading a') AS t(tree_number, label)"),
    }
    got = codes.m5_tree_labels(views.__getitem__).collect()
    assert sorted(map(tuple, got)) == [("D1", "heading a|heading a|heading b|heading b"), ("D2", "")]


def test_map_ids_of_keys_that_recur(spark):
    keys = [("D1", ["a"]), ("D1", ["c", "d"]), ("D1", ["a"]), ("D0001", ["b"]), ("D0001", ["e"]), ("D2", None), ("D2", ["g"]), ("D0002", ["f"]), ("D0002", None)]
    crosswalk = spark.createDataFrame(keys, "key string, tree_numbers array<string>")
    trials = spark.createDataFrame([("T1", ["X", "D0001", "D1"]), ("T2", ["D0002"]), ("T3", ["X"]), ("T4", ["D2", "D2"])], "ct_path string, ids array<string>")
    first = lambda i: i.replace("000", "", 1)
    want = {}
    for path, ids in trials.collect():
        pairs = [[a or b for a in [t for k, t in keys if k == first(i)] or [None] for b in [t for k, t in keys if k == i] or [None]] for i in ids]
        want[path] = [t for p in pairs for t in sorted(x for x in p if x)]
    got = mesh.map_ids(trials, crosswalk)
    assert {r.ct_path: r.tree_numbers for r in got.collect()} == want
    wide = spark.range(300).selectExpr("'D7' AS key", "array(concat('t', cast(id % 3 AS string))) AS tree_numbers")
    many = mesh.map_ids(spark.createDataFrame([("T5", ["D7"])], trials.schema), wide)
    assert many.selectExpr("size(tree_numbers)").first()[0] == 90_000
    assert _sent(many) < 1_000_000  # the 90,000 pairs are not sent


def _sent(df):
    """Bytes that go through the shuffles of a table."""
    df.collect()
    left, total = [df._jdf.queryExecution().executedPlan()], 0
    while left:
        p = left.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            left.append(p.executedPlan())
        elif p.nodeName().endswith("QueryStage"):
            left.append(p.plan())
        else:
            total += p.metrics().apply("dataSize").value() if p.nodeName() == "Exchange" else 0
            left += [p.children().apply(i) for i in range(p.children().size())]
    return total


def test_evaluation_reads_criteria_twice(spark):
    """Once for the number of clusters, once for the table of counts; the metrics themselves read only that."""
    rows = [(i, f"T{i % 9}", [f"p{i % 2}", "p7"], [f"c{i % 3}"], [f"d{i % 4}"], i % 5 - 1) for i in range(60)]
    rows = spark.createDataFrame(rows, "member_id long, ct_path string, phases array<string>, conditions array<string>, intervention_ids array<string>, cluster_id int")
    read = spark.sparkContext.accumulator(0)
    seen = rows.withColumn("cluster_id", F.udf(lambda c: read.add(1) or c, "int").asNondeterministic()("cluster_id"))
    points = rows.withColumn("embedding", F.array(F.rand(1), F.rand(2)))
    got = {(r.metric_group, r.metric): r.value for r in metrics.evaluate_clustering(points, seen, key="ct_path").collect()}
    assert read.value == 120
    assert got["counts", "n_samples"] == 48 and got["counts", "n_duplicated_samples"] == 96
    plain = metrics.label_metrics(metrics.label_combinations(rows), "combo", "cluster_id", "label_dept").collect()
    assert all(got["label_dept", r.metric] == pytest.approx(r.value, abs=1e-9) for r in plain)
