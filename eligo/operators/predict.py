"""Outcome targets, trial features, splits, models and reports."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eligo.functions import blocks
from eligo.functions.ranks import numbered, running
from eligo.operators.clusters import cluster_centroid
from eligo.sources.tables import cut

PHASES = ["PHASE1", "PHASE2", "PHASE3", "PHASE4"]


def parse_partial_date(text: Column) -> Column:
    """Day, else month, else year; null for anything else."""
    form = lambda pattern, f: F.when(text.rlike(pattern), F.try_to_date(text, f))
    return F.coalesce(form(r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), form(r"^\d{4}-\d{2}$", "yyyy-MM"), form(r"^\d{4}$", "yyyy"))


def target_phase(phases: Column) -> Column:
    """The first phase if any is one of the four."""
    return F.when(F.arrays_overlap(phases, F.array(*map(F.lit, PHASES))), F.get(phases, F.lit(0)))


def target_status(status: Column) -> Column:
    """Overall status, empty if missing."""
    return F.coalesce(status, F.lit(""))


def target_study_duration(start: Column, completion: Column) -> Column:
    """Months of 30 days from start to completion, if more than none."""
    months = F.datediff(parse_partial_date(completion), parse_partial_date(start)) / 30
    return F.when(months > 0, months)


def target_enrollment_count(count: Column) -> Column:
    """The count if it is not zero."""
    n = count.try_cast("long")
    return F.when(n != 0, n)


def target_operational_rate(start: Column, completion: Column, count: Column) -> Column:
    """Enrolled people per month."""
    return target_enrollment_count(count) / target_study_duration(start, completion)


def phase_filter(trials: DataFrame, phases: list[str]) -> DataFrame:
    """Trials with any of the phases."""
    return trials.where(F.arrays_overlap("phases", F.array(*map(F.lit, phases))))


def cluster_counts(rows: DataFrame) -> DataFrame:
    """ct_path, cluster_id, n in long form."""
    return rows.groupBy("ct_path", "cluster_id").agg(F.count("*").alias("n"))


def cluster_count_features(rows: DataFrame, n_clusters: int) -> DataFrame:
    """ct_path, cluster_counts: criteria by cluster, noise in the last place."""
    own = cluster_counts(rows).groupBy("ct_path").agg(F.map_from_entries(F.collect_list(F.struct(F.when(F.col("cluster_id") < 0, n_clusters).otherwise(F.col("cluster_id")), "n"))).alias("m"))
    at = F.transform(F.sequence(F.lit(0), F.lit(n_clusters)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double"))
    return own.select("ct_path", at.alias("cluster_counts"))


def mean_embedding_features(vectors: DataFrame) -> DataFrame:
    """ct_path, mean vector of its criteria."""
    return cluster_centroid(vectors, "ct_path").withColumnRenamed("centroid", "mean_vector")


def mean_medoid_features(vectors: DataFrame, medoids: DataFrame) -> DataFrame:
    """ct_path, mean of the medoids of its criteria's clusters, one per criterion."""
    centre = medoids.join(vectors.select("member_id", "embedding"), "member_id").select("cluster_id", "embedding")
    return mean_embedding_features(vectors.select("ct_path", "cluster_id").join(centre, "cluster_id"))


def complete_features(means: DataFrame, counts: DataFrame) -> DataFrame:
    """ct_path, features: mean vector and then cluster counts."""
    return means.join(counts, "ct_path").select("ct_path", F.concat("mean_vector", "cluster_counts").alias("features"))


def random_features(trials: DataFrame, width: int, seed: int) -> DataFrame:
    """ct_path, features: numbers from [0, 1) that depend on the trial and the seed only."""
    digest = lambda i: F.md5(F.concat("ct_path", F.lit(f"/{seed}/"), i.cast("string")).cast("binary"))
    draw = lambda i: F.conv(F.substring(digest(i), 1, 7), 16, 10).cast("int") / (1 << 28)
    return trials.select("ct_path", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), draw).alias("features"))


def median_split(rows: DataFrame, target: str) -> DataFrame:
    """With `high`: is the target at or above the one at place int(n / 2) of the sorted targets?

    The place is found by running counts of distinct values, combined before the shuffle and summed by ranges.
    """
    counts = running(rows.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n")), [F.col(target)], F.col("n"), "upto")
    counts = cut(counts, "values")
    want = int((counts.agg(F.max("upto")).first()[0] or 0) * 0.5)
    split = counts.where(F.col("upto") > want).agg(F.min(target).alias("__split"))
    return rows.where(F.col(target).isNotNull()).crossJoin(F.broadcast(split)).withColumn("high", F.col(target) >= F.col("__split")).drop("__split")  # one row


def prediction_dataset(features: DataFrame, targets: DataFrame) -> DataFrame:
    """ct_path, features, target; trials without a target go."""
    return features.join(targets.where("target is not null"), "ct_path")


def split_train_val_test(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """With `part`: about 70, 15 and 15 of a hundred by a hash of the key, the same on every run and for every partitioning."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}")).cast("binary"))
    at = F.conv(F.substring(digest, 1, 6), 16, 10).cast("int") % 100
    return rows.withColumn("part", F.when(at < 70, "train").when(at < 85, "val").otherwise("test"))


def oversample_minority(rows: DataFrame, label: str, k: int = 5, seed: int = 3) -> DataFrame:
    """(member_id, embedding, label) -> with new rows on lines between a row and one of its k nearest of the same class, until classes are equal.

    New rows have negative ids. Only counts per class reach the driver.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    most, out = max(counts.values(), default=0), rows.select("member_id", "embedding", label)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        if n in (most, 1):
            continue
        own = rows.where(F.col(label) == value).select(F.col("member_id").cast("long").alias("id"), F.col("embedding").alias("v"))

        def near(x: pd.DataFrame, y: pd.DataFrame, same: bool) -> pd.DataFrame:
            d, a, b = blocks.distances(x["v"], y["v"]), x["id"].to_numpy(), y["id"].to_numpy()
            one = blocks.least_k(a, b, d, k, True)
            return one if same else pd.concat([one, blocks.least_k(b, a, d.T, k, True)])

        found = blocks.self_pairs(own, [], near, "member_id long, neighbour_id long, distance double")
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("member_id").orderBy("distance", "neighbour_id")) - 1).where(F.col("r") < k)
        ranked = numbered(own.select("id"), [F.xxhash64("id", F.lit(seed)), F.col("id")], "place").join(own, "id")
        want = ranked.select("*", F.explode(F.sequence(F.lit(0), F.lit(-(-(most - n) // n) - 1))).alias("lap")).withColumn("i", F.col("lap") * n + F.col("place")).where(F.col("i") < most - n)
        draw = lambda salt: F.pmod(F.xxhash64("i", F.lit(seed), F.lit(salt)), F.lit(1 << 20))
        want = want.withColumn("r", F.pmod(draw("n"), F.lit(min(k, n - 1))).cast("int")).withColumn("t", draw("t") / (1 << 20))
        mates = found.select(F.col("member_id").alias("id"), "r", "neighbour_id").join(own.select(F.col("id").alias("neighbour_id"), F.col("v").alias("w")), "neighbour_id")
        made = want.join(mates, ["id", "r"]).withColumn("x", F.zip_with("v", "w", lambda a, b: (a + (b - a) * F.col("t")).cast("float")))
        new = made.select((-1 - F.col("i")).cast("long").alias("member_id"), F.col("x").alias("embedding"), F.lit(value).alias(label))
        out = out.unionByName(new)
    return out


def standardise(train: DataFrame, other: DataFrame, column: str = "features") -> DataFrame:
    """other with its vectors at mean 0 and population deviation 1 by train's statistics; constant places become 0."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = array_to_vector(F.col(column).cast("array<double>"))
    got = train.select(v.alias("v")).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s"))
    got = got.select(vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("var"), F.col("s.count").alias("n"))
    rows = other.crossJoin(F.broadcast(got))  # one row
    deviation = F.transform("var", lambda x: F.sqrt(x * (F.col("n") - 1) / F.col("n")))
    centred = F.zip_with(F.col(column), F.col("mean"), lambda x, m: x - m)
    return rows.withColumn(column, F.zip_with(centred, deviation, lambda x, d: F.when(d > 0, x / d).otherwise(0.0))).drop("mean", "var", "n")


def _vectors(rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("features", array_to_vector(F.col("features").cast("array<double>"))).withColumn("label", F.col("target").cast("double"))


def products(rows: DataFrame, n_classes: int, by: str | None = None) -> dict[int, np.ndarray]:
    """Sums of products of all pairs of columns (features, 1, and for each class 1 or -1), in one pass: a matrix for each value of `by`.

    A task holds and gives one matrix for each value; the driver gets as many numbers as the features squared, whatever the number of rows.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for key, g in b.groupby("by"):
                x = blocks.stacked(g["features"])
                y = np.where(g["target"].to_numpy()[:, None] == np.arange(n_classes), 1.0, -1.0)
                z = np.column_stack([x, np.ones(len(x)), y])
                total[key] = total.get(key, 0.0) + z.T @ z
        for key, m in total.items():
            yield pd.DataFrame({"by": key, "row": np.arange(len(m), dtype=np.int32), "sums": list(m)})

    each = rows.select((F.col(by) if by else F.lit(0)).cast("int").alias("by"), F.col("features").cast("array<double>").alias("features"), F.col("target").cast("int").alias("target"))
    each = each.mapInPandas(run, "by int, row int, sums array<double>").select("by", "row", array_to_vector("sums").alias("sums"))
    got = each.groupBy("by", "row").agg(vector_to_array(Summarizer.sum(F.col("sums"))).alias("sums")).toPandas()
    return {int(k): np.stack(g.sort_values("row")["sums"].to_numpy()) for k, g in got.groupby("by")}


def solved(total: np.ndarray, n_classes: int, alpha: float) -> np.ndarray:
    """Least squares on 1 and -1 with a penalty of alpha on the squared weights but not on the intercept: (features + 1) x classes, the intercept last."""
    p = len(total) - n_classes - 1
    n, mean, centre = total[p, p], total[p, :p] / total[p, p], total[p, p + 1 :] / total[p, p]
    gram = total[:p, :p] - n * np.outer(mean, mean) + alpha * np.eye(p)
    w = np.linalg.lstsq(gram, total[:p, p + 1 :] - n * np.outer(mean, centre), rcond=None)[0]
    return np.vstack([w, centre - mean @ w])


class Ridge:
    """Weights of each class against the rest; the class of the greatest value is predicted, the lesser one of equals."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def transform(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        weights = self.weights

        @F.pandas_udf("double")
        def best(x: pd.Series) -> pd.Series:
            return pd.Series((blocks.stacked(x) @ weights[:-1] + weights[-1]).argmax(axis=1).astype(float) if len(x) else [])

        return rows.withColumn("prediction", best(vector_to_array("features")))


def n_classes_of(rows: DataFrame) -> int:
    """Classes are numbered from 0."""
    return (rows.agg(F.max(F.col("target").cast("int"))).first()[0] or 0) + 1


def fit_linear(train: DataFrame, family: str, strength: float = 0.01, mix: float = 0.5):
    """ridge, lasso or elasticnet on rows (features, target); target is a class from 0.

    ridge is least squares on 1 and -1, each class against the rest, by the normal equations; the others are logistic regressions.
    """
    from pyspark.ml.classification import LogisticRegression

    if family == "ridge":
        n = n_classes_of(train)
        return Ridge(solved(products(train, n)[0], n, strength))
    share = {"lasso": 1.0, "elasticnet": mix}[family]
    return LogisticRegression(regParam=strength, elasticNetParam=share, maxIter=50).fit(_vectors(train))


def fit_other(train: DataFrame, family: str, **params):
    """svc, tree, forest or gbt (two classes)."""
    from pyspark.ml import classification as C

    model = {"svc": lambda: C.OneVsRest(classifier=C.LinearSVC(**params)), "tree": lambda: C.DecisionTreeClassifier(**params), "forest": lambda: C.RandomForestClassifier(seed=1, **params), "gbt": lambda: C.GBTClassifier(seed=1, **params)}
    return model[family]().fit(_vectors(train))


def predict(model, rows: DataFrame) -> DataFrame:
    """Rows with y_true and y_pred."""
    return model.transform(_vectors(rows)).select("ct_path", F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))


def fit_knn(train: DataFrame, test: DataFrame, k: int, weights: str = "uniform") -> DataFrame:
    """(member_id, embedding, label) twice -> member_id, y_pred by a vote of the k nearest; ties go to the lesser label."""
    near = lambda x, y: blocks.nearest(x["id"].to_numpy(), blocks.stacked(x["v"]), y["id"].to_numpy(), blocks.stacked(y["v"]), k, skip_self=False)
    form = lambda df: df.select(F.col("member_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    block = max(blocks.BLOCK, min(16_384, math.ceil(train.count() / 12)))  # a row is sent once for each block
    found = blocks.cross_pairs(form(test), form(train), near, "member_id long, neighbour_id long, distance double", block)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("member_id").orderBy("distance", "neighbour_id"))).where(F.col("rank") <= k)
    say = F.lit(1.0) if weights == "uniform" else 1 / F.greatest("distance", F.lit(1e-12))
    votes = found.join(train.select(F.col("member_id").alias("neighbour_id"), "label"), "neighbour_id").groupBy("member_id", "label").agg(F.sum(say).alias("w"))
    return votes.groupBy("member_id").agg(F.min_by("label", F.struct(-F.round("w", 9), "label")).alias("y_pred"))


def classification_report(pred: DataFrame) -> DataFrame:
    """class, precision, recall, f1, support; and accuracy, macro avg, weighted avg rows."""
    t = pred.groupBy(F.col("y_true").cast("string").alias("class")).agg(F.count("*").alias("support"), F.sum((F.col("y_true") == F.col("y_pred")).cast("long")).alias("hit"))
    p = pred.groupBy(F.col("y_pred").cast("string").alias("class")).agg(F.count("*").alias("said"))
    rows = t.join(p, "class", "full").na.fill(0)
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    rows = rows.withColumn("precision", part("hit", "said")).withColumn("recall", part("hit", "support"))
    both = F.col("precision") + F.col("recall")
    rows = rows.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))
    names = ["precision", "recall", "f1"]
    total = F.sum("support").alias("support")
    macro = rows.agg(*[F.avg(c).alias(c) for c in names], total).withColumn("class", F.lit("macro avg"))
    weighted = rows.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names], total).withColumn("class", F.lit("weighted avg"))
    exact = rows.agg((F.sum("hit") / F.sum("support")).alias("f1"), total).select(F.lit("accuracy").alias("class"), F.col("f1").alias("precision"), F.col("f1").alias("recall"), "f1", "support")
    out = ["class", *names, "support"]
    return rows.select(out).unionByName(exact.select(out)).unionByName(macro.select(out)).unionByName(weighted.select(out))


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """y_true, y_pred, n in long form."""
    return pred.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def macro_f1(pred: DataFrame) -> float:
    """The macro average of a report."""
    return classification_report(pred).where("class = 'macro avg'").first()["f1"] or 0.0


LINEAR, OTHER = ["ridge", "lasso", "elasticnet"], ["svc", "tree", "forest", "gbt"]


def fit(train: DataFrame, family: str, **params):
    """A model of any family."""
    return fit_linear(train, family, **params) if family in LINEAR else fit_other(train, family, **params)


def draw_params(rng: np.random.Generator, families: list[str]) -> dict:
    """A random family and its parameters."""
    family = str(rng.choice(families))
    if family == "ridge":
        return {"family": family, "strength": float(rng.uniform(0.01, 10))}
    if family in LINEAR:
        return {"family": family, "strength": float(10 ** rng.uniform(-4, 0)), "mix": float(rng.uniform(0.1, 0.9))}
    if family == "svc":
        return {"family": family, "regParam": float(10 ** rng.uniform(-4, 0)), "maxIter": 30}
    depth = {"family": family, "maxDepth": int(rng.integers(2, 9))}
    return depth | {"tree": {}, "forest": {"numTrees": int(rng.integers(10, 60))}, "gbt": {"maxIter": int(rng.integers(5, 30))}}[family]


def ridge_scores(rows: DataFrame, alphas: list[float], folds: int) -> list[float]:
    """Mean macro F1 over folds (column `fold`) for each alpha: one pass for the products of every fold, of which all fits are made, and one that predicts every row by all fits of the other folds."""
    n = n_classes_of(rows)
    each = products(rows, n, "fold")
    weights = {f: [solved(sum(m for k, m in each.items() if k != f), n, a) for a in alphas] for f in each if len(each) > 1}

    def run(batches):
        for b in batches:
            for f, g in b.groupby("fold"):
                x, y = blocks.stacked(g["features"]), g["target"].to_numpy()
                for k, w in enumerate(weights.get(int(f), [])):
                    pairs, many = np.unique(np.stack([y, (x @ w[:-1] + w[-1]).argmax(axis=1)]), axis=1, return_counts=True)
                    yield pd.DataFrame({"k": k, "fold": f, "y": pairs[0], "said": pairs[1], "n": many})

    told = rows.select(F.col("fold").cast("int").alias("fold"), F.col("features").cast("array<double>").alias("features"), F.col("target").cast("int").alias("target"))
    got = told.mapInPandas(run, "k int, fold int, y int, said int, n long").groupBy("k", "fold", "y", "said").agg(F.sum("n").alias("n")).toPandas()  # fits x classes x classes
    scores: list[list[float]] = [[] for _ in alphas]
    for (k, _), g in got.groupby(["k", "fold"]):
        both = sorted(set(g["y"]) | set(g["said"]))
        hit, truth, said = (np.array([g.loc[m(c), "n"].sum() for c in both]) for m in (lambda c: (g["y"] == c) & (g["said"] == c), lambda c: g["y"] == c, lambda c: g["said"] == c))  # noqa: B023
        scores[k].append(float(np.mean(2 * hit / (truth + said))))
    return [float(np.mean(x)) if x else 0.0 for x in scores]


def search_model(train: DataFrame, val: DataFrame, n_trials: int, seed: int, folds: int = 5, families: list[str] | None = None) -> tuple[dict, float]:
    """Best of random draws of family (any, if none are named; gbt needs two classes) and parameters: mean macro F1 of folds of the validation part, each predicted by a fit on the rest.

    All draws of ridge share two passes over the rows; the other families' fits are Spark ML's, one for each draw and fold.
    """
    rng, best = np.random.default_rng(seed), ({}, -1.0)
    rows = cut(val.withColumn("fold", F.pmod(F.xxhash64("ct_path", F.lit(seed)), F.lit(folds))), "folds")
    drawn = [draw_params(rng, families or LINEAR + OTHER) for _ in range(n_trials)]
    ridge = [p for p in drawn if p["family"] == "ridge"]
    done = list(zip(ridge, ridge_scores(rows, [p["strength"] for p in ridge], folds), strict=True)) if ridge else []
    for p in drawn:
        if p["family"] != "ridge":
            scores = [macro_f1(predict(fit(rows.where(F.col("fold") != f), **p), rows.where(F.col("fold") == f))) for f in range(folds)]
            done.append((p, float(np.mean(scores))))
    for one in done:
        best = max(best, one, key=lambda b: b[1])
    return best


def log_scale(x: Column) -> Column:
    """log1p(1 + x)."""
    return F.log1p(1 + x)


def unlog_scale(x: Column) -> Column:
    """expm1(x) - 1, the inverse of log_scale."""
    return F.expm1(x) - 1
