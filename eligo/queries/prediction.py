"""Queries of targets, features, splits, models and reports."""

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligo.operators import clusters as K
from eligo.operators import predict as P
from eligo.plans.fixtures import VIEWS
from eligo.queries import query
from eligo.queries.clusters import MEDOID
from eligo.sources.tables import cut

R = lambda c: F.round(c, 6)
J = lambda c: F.array_join(c, "|")
DATE = """CASE WHEN regexp_matches({c}, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN {c}::DATE WHEN regexp_matches({c}, '^[0-9]{4}-[0-9]{2}$') THEN ({c} || '-01')::DATE
  WHEN regexp_matches({c}, '^[0-9]{4}$') THEN ({c} || '-01-01')::DATE END"""
START, DONE = DATE.replace("{c}", "start_date"), DATE.replace("{c}", "completion_date")
MONTHS = f"CASE WHEN date_diff('day', {START}, {DONE}) > 0 THEN date_diff('day', {START}, {DONE}) / 30 END"



@query(f"SELECT ct_path, {START} AS start, {DONE} AS completion FROM {{fx_dates}}")
def g1_parse_partial_date(v):
    return v("fx_dates").select("ct_path", P.parse_partial_date(F.col("start_date")).alias("start"), P.parse_partial_date(F.col("completion_date")).alias("completion"))


@query("SELECT ct_path, CASE WHEN list_has_any(phases, ['PHASE1', 'PHASE2', 'PHASE3', 'PHASE4']) THEN phases[1] END AS phase FROM {fx_dates}")
def g2_target_phase(v):
    return v("fx_dates").select("ct_path", P.target_phase(F.col("phases")).alias("phase"))


@query("SELECT ct_path, coalesce(label, '') AS status FROM {fx_dates}")
def g3_target_status(v):
    return v("fx_dates").select("ct_path", P.target_status(F.col("label")).alias("status"))


@query(f"SELECT ct_path, round({MONTHS}, 6) AS months FROM {{fx_dates}}")
def g4_target_study_duration(v):
    return v("fx_dates").select("ct_path", R(P.target_study_duration(F.col("start_date"), F.col("completion_date"))).alias("months"))


@query("SELECT ct_path, nullif(enrollment::BIGINT, 0) AS enrolled FROM {fx_dates}")
def g5_target_enrollment_count(v):
    return v("fx_dates").select("ct_path", P.target_enrollment_count(F.col("enrollment")).alias("enrolled"))


@query(f"SELECT ct_path, round(nullif(enrollment::BIGINT, 0) / ({MONTHS}), 6) AS rate FROM {{fx_dates}}")
def g6_target_operational_rate(v):
    return v("fx_dates").select("ct_path", R(P.target_operational_rate(F.col("start_date"), F.col("completion_date"), F.col("enrollment"))).alias("rate"))


@query("SELECT ct_path FROM {fx_dates} WHERE list_has_any(phases, ['PHASE2', 'PHASE4'])")
def g7_phase_filter(v):
    return P.phase_filter(v("fx_dates"), ["PHASE2", "PHASE4"]).select("ct_path")


@query("""
WITH g AS (SELECT ct_path, unnest(range(10)) AS place FROM (SELECT DISTINCT ct_path FROM {fx_criteria})),
n AS (SELECT ct_path, CASE WHEN cluster_id < 0 THEN 9 ELSE cluster_id END AS place, count(*) AS n FROM {fx_criteria} GROUP BY ALL)
SELECT ct_path, place::INT AS place, coalesce(n, 0)::DOUBLE AS n FROM g LEFT JOIN n USING (ct_path, place)""")
def g8_cluster_count_features(v):
    return P.cluster_count_features(v("fx_criteria"), 9).select("ct_path", F.posexplode("cluster_counts").alias("place", "n"))


@query("WITH e AS (SELECT ct_path, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INT - 1 AS dim FROM {fx_vectors}) SELECT ct_path, dim, round(avg(x), 6) AS value FROM e GROUP BY ALL")
def g9_mean_embedding_features(v):
    return P.mean_embedding_features(v("fx_vectors")).select("ct_path", F.posexplode("mean_vector").alias("dim", "value")).withColumn("value", R("value"))


@query(
    MEDOID
    + """, e AS (SELECT v.ct_path, unnest(x.embedding)::DOUBLE AS x, generate_subscripts(x.embedding, 1)::INT - 1 AS dim FROM {fx_vectors} v JOIN medoid m ON m.cluster_id = v.cluster_id JOIN {fx_vectors} x ON x.member_id = m.member_id)
SELECT ct_path, dim, round(avg(x), 6) AS value FROM e GROUP BY ALL"""
)
def g10_mean_medoid_features(v):
    got = P.mean_medoid_features(v("fx_vectors"), K.cluster_medoid(v("fx_vectors")))
    return got.select("ct_path", F.posexplode("mean_vector").alias("dim", "value")).withColumn("value", R("value"))


def _complete(v):
    return P.complete_features(P.mean_embedding_features(v("fx_vectors")), P.cluster_count_features(v("fx_vectors"), 10))


COMPLETE = """
WITH e AS (SELECT ct_path, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INT - 1 AS place FROM {fx_vectors}),
g AS (SELECT ct_path, unnest(range(11)) AS c FROM (SELECT DISTINCT ct_path FROM {fx_vectors})),
n AS (SELECT ct_path, CASE WHEN cluster_id < 0 THEN 10 ELSE cluster_id END AS c, count(*) AS n FROM {fx_vectors} GROUP BY ALL)
SELECT ct_path, place, round(avg(x), 6) AS value FROM e GROUP BY ALL UNION ALL SELECT ct_path, (c + 64)::INT, coalesce(n, 0)::DOUBLE FROM g LEFT JOIN n USING (ct_path, c)"""


@query(COMPLETE)
def g11_complete_features(v):
    return _complete(v).select("ct_path", F.posexplode("features").alias("place", "value")).withColumn("value", R("value"))


@query("SELECT ct_path, place::INT AS place, ('0x' || substr(md5(ct_path || '/5/' || place), 1, 7))::INT / 268435456 AS value FROM (SELECT ct_path, unnest(range(8)) AS place FROM {fx_trials})")
def g12_random_features(v):
    return P.random_features(v("fx_trials"), 8, 5).select("ct_path", F.posexplode("features").alias("place", "value"))


@query("""
WITH t AS (SELECT ct_path, nullif(enrollment::BIGINT, 0) AS target FROM {fx_dates}),
s AS (SELECT target AS split FROM t WHERE target IS NOT NULL ORDER BY target LIMIT 1 OFFSET (SELECT floor(count(target) * 0.5)::BIGINT FROM t))
SELECT ct_path, target, target >= split AS high FROM t, s WHERE target IS NOT NULL""")
def g13_median_split(v):
    return P.median_split(v("fx_dates").select("ct_path", P.target_enrollment_count(F.col("enrollment")).alias("target")), "target")


# an eighth of the trials has no target
VIEWS["fx_targets"] = """
SELECT DISTINCT ct_path, CASE WHEN substr(md5(ct_path), 2, 1) IN ('0', '7') THEN NULL WHEN substr(md5(ct_path), 1, 1) IN ('0', '1', '2', '3', '4') THEN 1 ELSE 0 END AS target FROM {fx_vectors}"""


def _dataset(v):
    return P.prediction_dataset(_complete(v), v("fx_targets"))


@query(COMPLETE.replace("WITH e", "WITH f AS (WITH e") + ") SELECT ct_path, target, place, value FROM f JOIN {fx_targets} USING (ct_path) WHERE target IS NOT NULL")
def g14_prediction_dataset(v):
    return _dataset(v).select("ct_path", "target", F.posexplode("features").alias("place", "value")).withColumn("value", R("value"))


@query("""
SELECT ct_path, CASE WHEN place < 70 THEN 'train' WHEN place < 85 THEN 'val' ELSE 'test' END AS part FROM (SELECT ct_path, ('0x' || substr(md5(ct_path || '/3'), 1, 6))::INT % 100 AS place FROM {fx_trials})""")
def l1_split_train_val_test(v):
    return P.split_train_val_test(v("fx_trials").select("ct_path"), "ct_path", 3)


@query()
def l2_oversample_minority(v):
    rows = v("fx_vectors").select("member_id", "embedding", F.when(F.col("cluster_id") < 2, "few").otherwise("many").alias("label"))
    return P.oversample_minority(rows, "label").select("member_id", "label", F.size("embedding").alias("dims"))


@query("""
WITH e AS (SELECT member_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INT - 1 AS place FROM {fx_vectors}),
s AS (SELECT place, avg(x) AS m, stddev_pop(x) AS d FROM e WHERE member_id % 2 = 0 GROUP BY 1)
SELECT member_id, place, round((x - m) / d, 6) AS value FROM e JOIN s USING (place)""")
def l3_standardise(v):
    rows = v("fx_vectors").select("member_id", F.col("embedding").cast("array<double>").alias("features"))
    return P.standardise(rows.where("member_id % 2 = 0"), rows).select("member_id", F.posexplode("features").alias("place", "value")).withColumn("value", R("value"))


def _predictions(rows, families):
    """What a model of each family, fitted on the training part, says of the rest."""
    rows = cut(rows, "features")
    train, rest = rows.where("part = 'train'"), rows.where("part <> 'train'")
    return functools.reduce(DataFrame.unionByName, [P.predict(P.fit(train, f, **p), rest).withColumn("family", F.lit(f)) for f, p in families.items()])


@query()
def l4_fit_linear(v):
    rows = P.split_train_val_test(_dataset(v), "ct_path", 1)
    return _predictions(rows, {f: {} for f in P.LINEAR})


@query()
def l5_fit_other(v):
    rows = P.split_train_val_test(_dataset(v), "ct_path", 1)
    return _predictions(rows, {"svc": {}, "tree": {}, "forest": {"numTrees": 10}, "gbt": {"maxIter": 10}})


@query("""
WITH d AS (SELECT a.member_id, b.cluster_id AS label, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d, b.member_id AS n FROM {fx_vectors} a, {fx_vectors} b WHERE a.member_id % 4 = 0 AND b.member_id % 4 <> 0),
near AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY d, n) <= 5), votes AS (SELECT member_id, label, count(*) AS w FROM near GROUP BY ALL)
SELECT member_id, label AS y_pred FROM votes QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY w DESC, label) = 1""")
def l6_fit_knn(v):
    rows = v("fx_vectors").withColumnRenamed("cluster_id", "label")
    return P.fit_knn(rows.where("member_id % 4 <> 0"), rows.where("member_id % 4 = 0"), 5)


@query()
def l7_search_model(v):
    rows = cut(P.split_train_val_test(_dataset(v), "ct_path", 1), "features")
    best, score = P.search_model(rows.where("part = 'train'"), rows.where("part = 'val'"), 20, seed=1, families=["ridge", "ridge", "ridge", "tree"])
    return rows.agg(F.count("*").alias("n"), F.lit(best["family"]).alias("family"), F.lit(round(score, 6)).alias("macro_f1"))  # of 20 draws, with five folds of the validation part


REPORT = """
WITH t AS (SELECT y_true AS class, count(*) AS support, sum((y_true = y_pred)::INT) AS hit FROM {fx_predictions} GROUP BY 1), p AS (SELECT y_pred AS class, count(*) AS said FROM {fx_predictions} GROUP BY 1),
r AS (SELECT class, support, hit, hit / said AS precision, hit / support AS recall, 2 * hit / (said + support) AS f1 FROM t JOIN p USING (class)),
o AS (SELECT class, precision, recall, f1, support FROM r UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM r
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM r)"""


@query(REPORT + " SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM o")
def l8_classification_report(v):
    return P.classification_report(v("fx_predictions")).select("class", R("precision").alias("precision"), R("recall").alias("recall"), R("f1").alias("f1"), "support")


@query("SELECT y_true, y_pred, count(*) AS n FROM {fx_predictions} GROUP BY ALL")
def l9_confusion_matrix(v):
    return P.confusion_matrix(v("fx_predictions"))


@query("SELECT ct_path, round(ln(2 + enrollment::BIGINT), 6) AS scaled, round(enrollment::DOUBLE, 6) AS back FROM {fx_dates}")
def l10_log_scale(v):
    n = F.col("enrollment").cast("double")
    return v("fx_dates").select("ct_path", R(P.log_scale(n)).alias("scaled"), R(P.unlog_scale(P.log_scale(n))).alias("back"))
