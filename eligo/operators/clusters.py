"""Clusters: neighbours, density cuts, sizes, prevalence, medoids and report order. Noise has id -1."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eligo.functions import blocks, condense, forest, space
from eligo.functions.graph import components
from eligo.sources.tables import cut

NOISE_TITLE = "Sample with unidentified cluster"
MEMBERS = 1000  # of a cluster in one row of a report


def _rows(vectors: DataFrame, *more: Column) -> DataFrame:
    """Vectors as one group of rows (grp, id, v)."""
    return vectors.select(F.lit(0).cast("long").alias("grp"), F.col("member_id").cast("long").alias("id"), F.col("embedding").alias("v"), *more)


def knn(vectors: DataFrame, k: int, cell: int = space.CELL) -> DataFrame:
    """(member_id, embedding) -> member_id, neighbour_id, distance, rank: the k nearest others, exactly.

    Rows lie in cells around sampled pivots; a row meets its own cell, and those others that by the triangle inequality may hold a nearer row than the k-th found.
    """
    return space.knn(_rows(vectors), k, cell).drop("grp")


def knn_lsh(vectors: DataFrame, k: int, reach: float, bucket: float = 2.0, tables: int = 4) -> DataFrame:
    """The approximate form for many rows: neighbours within `reach` that share a bucket."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(F.col("member_id").alias("id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=1).fit(rows)
    near = model.approxSimilarityJoin(rows, rows, reach, "distance").select(F.col("datasetA.id").alias("member_id"), F.col("datasetB.id").alias("neighbour_id"), "distance")
    order = Window.partitionBy("member_id").orderBy("distance", "neighbour_id")
    return near.where("member_id <> neighbour_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mutual_reachability(neighbours: DataFrame, min_samples: int, alpha: float = 1.0) -> DataFrame:
    """kNN rows -> edges (a < b, weight): the greatest of both core distances and distance / alpha."""
    core = neighbours.where(F.col("rank") == min_samples).select(F.col("member_id").alias("m"), F.col("distance").alias("core"))
    pairs = neighbours.select(F.least("member_id", "neighbour_id").alias("a"), F.greatest("member_id", "neighbour_id").alias("b"), "distance").distinct()
    one, two = core.select(F.col("m").alias("a"), F.col("core").alias("ca")), core.select(F.col("m").alias("b"), F.col("core").alias("cb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", F.greatest("ca", "cb", F.col("distance") / alpha).alias("weight"))


def density_cut(members: DataFrame, edges: DataFrame, eps: float, min_size: int) -> DataFrame:
    """member_id, cluster_id: components of the edges up to eps, named by their least member; small ones are noise."""
    comp = components(edges.where(F.col("weight") <= eps).select("a", "b"))
    rows = members.select("member_id").join(comp.withColumnRenamed("node", "member_id"), "member_id", "left").withColumn("component", F.coalesce("component", "member_id"))
    sizes = rows.groupBy("component").agg(F.count("*").alias("n"))
    return rows.join(sizes, "component").select("member_id", F.when(F.col("n") >= min_size, F.col("component")).otherwise(-1).alias("cluster_id"))


def reachability_forest(vectors: DataFrame, min_samples: int, alpha: float = 1.0, local: int = forest.LOCAL, cell: int = space.CELL) -> DataFrame:
    """(a, b, weight): a least spanning tree of the whole mutual-reachability graph, in which every two rows are joined; empty where there are no min_samples others."""
    rows = _rows(vectors, F.lit(min_samples).alias("samples"), F.lit(alpha).alias("alpha"))
    return forest.reachability_forest(rows, local, cell).drop("grp")


def density_clusters(members: DataFrame, edges: DataFrame, min_size: int, selection: str = "eom", max_size: int | None = None, allow_single: bool = False, most: int = condense.MOST) -> DataFrame:
    """member_id, cluster_id: clusters of the condensed tree of a weighted graph, at every height; all others are noise (-1).

    The graph is a spanning forest of the mutual-reachability graph, or any other. See `condense.clusters` for what is taken; a cluster's id is its least member.
    """
    found = condense.clusters(edges.withColumn("grp", F.lit(0).cast("long")), _settings(members.sparkSession, [(0, min_size, selection, max_size, allow_single)]), most)
    rows = members.select("member_id").join(found.drop("grp"), "member_id", "left")
    return rows.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)).cast("long"))


def _settings(spark, rows: list[tuple]) -> DataFrame:
    """(grp, min_size, selection, max_size, single) -> what `condense.clusters` asks for."""
    return spark.createDataFrame([(g, m, s == "eom", x, one) for g, m, s, x, one in rows], "grp long, min_size int, eom boolean, max_size int, single boolean")


def scale_params(sizes: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """With counts for fractions of `n`: cluster sizes within [100, n - 1], [10, n - 1], and samples within [10, 128]."""
    n = F.col("n")
    at = lambda name: F.floor(n * fractions[name])
    return sizes.withColumns(
        {
            "max_cluster_size": F.greatest(F.lit(100), F.least(at("max_cluster_size"), n - 1)).cast("long"),
            "min_cluster_size": F.greatest(F.lit(10), F.least(at("min_cluster_size"), n - 1)).cast("long"),
            "min_samples": F.greatest(F.lit(10), F.least(at("min_samples"), F.lit(128))).cast("long"),
        }
    )


def subcluster(vectors: DataFrame, share: float = 0.1, k: int = 5, min_size: int = 5, selection: str = "eom", max_size: int | None = None, allow_single: bool = False, local: int = forest.LOCAL) -> DataFrame:
    """member_id, cluster_id after cutting the largest clusters (noise ranked too, then left out) again, all of them at once: one forest and one tree, keyed by cluster.

    The largest part keeps the id, the others get new ids from the number of clusters upward; what is noise inside a part joins the first. A cluster of one part stays as it is.
    """
    sizes = vectors.groupBy("cluster_id").agg(F.count("*").alias("n"))
    n = sizes.count()
    big = cut(sizes.orderBy(F.desc("n"), "cluster_id").limit(math.ceil(share * n)).where("cluster_id <> -1").select(F.col("cluster_id").cast("long").alias("grp")), "large")
    rows = vectors.select(F.col("cluster_id").cast("long").alias("grp"), F.col("member_id").cast("long").alias("id"), F.col("embedding").alias("v"), F.lit(k).alias("samples"), F.lit(1.0).alias("alpha")).join(big, "grp")
    edges = cut(forest.reachability_forest(rows, local=local), "forest")
    settings = big.select("grp", F.lit(min_size).alias("min_size"), F.lit(selection == "eom").alias("eom"), F.lit(max_size).cast("int").alias("max_size"), F.lit(allow_single).alias("single"))
    found = cut(condense.clusters(edges, settings), "parts")
    parts = found.groupBy("grp", "cluster_id").agg(F.count("*").alias("size"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("size"), "cluster_id"))
    parts = parts.withColumn("place", place)  # a row for each new cluster
    top = (vectors.agg(F.max("cluster_id")).first()[0] or 0) + 1
    fresh = parts.where("place > 1").withColumn("new", F.row_number().over(Window.orderBy("grp", "place")) - 1 + top).select("grp", "cluster_id", "new")
    named = found.join(fresh, ["grp", "cluster_id"]).select("member_id", F.col("grp").alias("cluster_id"), "new")  # what is in no other part keeps its id
    rows = vectors.select("member_id", F.col("cluster_id").cast("long").alias("cluster_id"))
    return rows.join(named, ["member_id", "cluster_id"], "left").select("member_id", F.coalesce("new", "cluster_id").cast("long").alias("cluster_id"))


def relabel_by_size(assignments: DataFrame) -> DataFrame:
    """Ids from 0 in falling order of size; noise stays."""
    sizes = assignments.where("cluster_id <> -1").groupBy("cluster_id").agg(F.count("*").alias("n"))
    named = sizes.withColumn("new", F.row_number().over(Window.orderBy(F.desc("n"), "cluster_id")) - 1).drop("n")  # a row per cluster
    return assignments.join(named, "cluster_id", "left").withColumn("cluster_id", F.coalesce("new", F.lit(-1))).drop("new")


def cluster_prevalence(rows: DataFrame) -> DataFrame:
    """cluster_id, n_samples, prevalence: distinct trials of the cluster among all."""
    total = rows.agg(F.countDistinct("ct_path").alias("total"))
    return rows.groupBy("cluster_id").agg(F.count("*").alias("n_samples"), F.countDistinct("ct_path").alias("n")).crossJoin(F.broadcast(total)).select("cluster_id", "n_samples", (F.col("n") / F.col("total")).alias("prevalence"))


MEDOID_PIVOTS, MEDOID_ROUNDS = 8, 3  # members of a cluster whose sums are known after each round


def cluster_medoid(vectors: DataFrame, pivots: int = MEDOID_PIVOTS, rounds: int = MEDOID_ROUNDS, block: int = 1024) -> DataFrame:
    """cluster_id, member_id of the member with the least sum of distances to its cluster, ties to the least id.

    A few members' sums are worked out at a time, those that may be least first. By the triangle inequality no member's sum is under what a known one's differs from its distance times the
    cluster's size; members that by that bound cannot be least are never summed. Those that are left are summed in blocks, so that a big cluster spreads over many tasks.
    """
    rows = cut(vectors.select("cluster_id", F.col("member_id").cast("long").alias("id"), F.col("embedding").alias("v")), "members")
    sizes = rows.groupBy("cluster_id").agg(F.count("*").alias("n"))
    if rows.count() <= block:  # a block or two is summed at once
        return _least(_sums(rows, rows, block))
    left = cut(rows.join(sizes, "cluster_id").withColumn("low", F.lit(0.0)).withColumn("known", F.lit(None).cast("double")), "members")
    for _ in range(rounds):
        next_ = Window.partitionBy("cluster_id", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy("low", F.xxhash64("id"))  # the first of 32 parts, so that no task ranks a whole cluster
        some = left.where("known is null").withColumn("r", F.row_number().over(next_)).where(F.col("r") <= pivots)
        last = Window.partitionBy("cluster_id").orderBy("low", F.xxhash64("id"))
        some = cut(some.withColumn("r", F.row_number().over(last)).where(F.col("r") <= pivots).select("cluster_id", "id", "v"), "pivots")
        far = cut(_distances(rows, some, block), "far")  # a few rows for each member
        sums = far.groupBy("cluster_id", "pivot").agg(F.sum("d").alias("s"))
        best = sums.groupBy("cluster_id").agg(F.min("s").alias("best"))
        bound = far.join(sums, ["cluster_id", "pivot"]).join(sizes, "cluster_id").groupBy("cluster_id", "id").agg(F.max(F.abs(F.col("s") - F.col("n") * F.col("d"))).alias("bound"))
        named = sums.select("cluster_id", F.col("pivot").alias("id"), "s")
        left = left.join(bound, ["cluster_id", "id"], "left").join(named, ["cluster_id", "id"], "left").withColumn("low", F.greatest("low", F.coalesce("bound", F.lit(0.0)))).withColumn("known", F.coalesce("known", "s")).drop("bound", "s")
        least = left.groupBy("cluster_id").agg(F.min("known").alias("least"))
        left = left.join(least, "cluster_id").where(F.col("low") <= F.col("least") * (1 + 1e-9) + 1e-9).drop("least")
        left = cut(left, "members")
    asked = left.where("known is null").select("cluster_id", "id", "v")
    known = left.where("known is not null").select("cluster_id", F.col("id").alias("member_id"), F.col("known").alias("s"))
    return _least(_sums(rows, cut(asked, "asked"), block).unionByName(known))


def _least(sums: DataFrame) -> DataFrame:
    return sums.groupBy("cluster_id").agg(F.min_by("member_id", F.struct(F.round("s", 9), "member_id")).alias("member_id"))


def _sums(rows: DataFrame, asked: DataFrame, block: int) -> DataFrame:
    """cluster_id, member_id, s: sums of distances of asked members to all of their cluster."""

    def run(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(asked):
            return pd.DataFrame(columns=["cluster_id", "member_id", "s"])
        d = blocks.distances(asked["v"], held["v"])
        return pd.DataFrame({"cluster_id": asked["cluster_id"].to_numpy(), "member_id": asked["id"].to_numpy(), "s": d.sum(axis=1)})

    each = blocks.keyed_pairs(rows, asked.select(*rows.columns), ["cluster_id"], run, "cluster_id int, member_id long, s double", block)
    return each.groupBy("cluster_id", "member_id").agg(F.sum("s").alias("s"))


def _distances(rows: DataFrame, pivots: DataFrame, block: int) -> DataFrame:
    """cluster_id, id, pivot, d of each member and each pivot of its cluster."""

    def run(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(asked):
            return pd.DataFrame(columns=["cluster_id", "id", "pivot", "d"])
        d = blocks.distances(held["v"], asked["v"])
        return pd.DataFrame({"cluster_id": held["cluster_id"].iloc[0], "id": np.repeat(held["id"].to_numpy(), len(asked)), "pivot": np.tile(asked["id"].to_numpy(), len(held)), "d": d.ravel()})

    return blocks.keyed_pairs(rows, pivots.select(*rows.columns), ["cluster_id"], run, "cluster_id int, id long, pivot long, d double", block)


def cluster_centroid(vectors: DataFrame, by: str = "cluster_id") -> DataFrame:
    """Mean vector by group."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = vectors.select(by, array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return rows.groupBy(by).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("centroid"))


def distance(a, b):
    """Euclidean distance of two array columns."""
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def rank_members(vectors: DataFrame, medoids: DataFrame) -> DataFrame:
    """cluster_id, member_id, distance to the medoid (not a number counts as 0), rank."""
    centre = medoids.select("cluster_id", F.col("member_id").alias("medoid_id")).join(vectors.select(F.col("member_id").alias("medoid_id"), F.col("embedding").alias("medoid")), "medoid_id")
    rows = vectors.join(centre, "cluster_id").withColumn("distance", F.nanvl(distance(F.col("embedding"), F.col("medoid")), F.lit(0.0)))
    order = Window.partitionBy("cluster_id").orderBy(F.round("distance", 9), "member_id")
    return rows.withColumn("rank", F.row_number().over(order)).select("cluster_id", "member_id", "distance", "rank")


def order_clusters(clusters: DataFrame, by: str = "size", k: int | None = None) -> DataFrame:
    """Largest (or most prevalent) first, noise last; the first k if given."""
    column = {"size": "n_samples", "prevalence": "prevalence"}[by]
    rows = clusters.orderBy(F.col("cluster_id") == -1, F.desc(column), "cluster_id")
    return rows.limit(k) if k else rows


def cluster_instances(vectors: DataFrame, titles: DataFrame, prevalence: DataFrame, medoids: DataFrame, texts: DataFrame) -> DataFrame:
    """Nested rows of title, size, prevalence, medoid and ranked members. A cluster has a row (part 0, 1, …) for each MEMBERS members, so that none outgrows a task."""
    ranked = rank_members(vectors, medoids).join(texts, "member_id").join(vectors.select("member_id", "ct_path"), "member_id")
    ranked = ranked.withColumn("part", F.floor((F.col("rank") - 1) / MEMBERS).cast("int"))
    lists = ranked.groupBy("cluster_id", "part").agg(F.array_sort(F.collect_list(F.struct("rank", "ct_path", "member_id", "raw_text"))).alias("ec_list"))
    centre = medoids.join(vectors.select("member_id", F.col("embedding").cast("array<double>").alias("medoid")), "member_id").select("cluster_id", "medoid")
    return prevalence.join(titles, "cluster_id").join(centre, "cluster_id").join(lists, "cluster_id")


def trial_cluster_matrix(rows: DataFrame, column: str, value: str, has: bool = True, least: int = 10) -> DataFrame:
    """Long form of the 0/1 matrix: (ct_path, cluster_id) of trials with (or without) a value; empty if there are `least` trials or fewer."""
    hit = F.coalesce(F.array_contains(column, value), F.lit(False))
    chosen = rows.where(hit if has else ~hit)
    enough = chosen.agg((F.countDistinct("ct_path") > least).alias("enough"))
    return chosen.select("ct_path", "cluster_id").distinct().crossJoin(F.broadcast(enough)).where("enough").drop("enough")


def wrap_label(text: str, max_length: int = 70, max_lines: int = 5) -> str:
    """Words in lines of at most max_length joined by <br>, with short names for the categories; `...` where lines run out."""
    for long, short in (("inclusion criterion", "IN"), ("exclusion criterion", "EX")):
        text = text.replace(long, short)
    lines, line = [], ""
    for word in text.split():
        if line and len(line) + 1 + len(word) > max_length:
            lines.append(line)
            line = word
        else:
            line = f"{line} {word}".strip()
    lines.append(line)
    return "<br>".join(lines) if len(lines) <= max_lines else "<br>".join(lines[:max_lines]) + "..."


def wrapped(column: str, max_length: int = 70, max_lines: int = 5):
    """wrap_label over a column, in Arrow batches."""
    return F.pandas_udf(lambda s: s.map(lambda t: wrap_label(t, max_length, max_lines)), "string")(column)


def plot_table(members: DataFrame, clusters: DataFrame, k: int = 20) -> DataFrame:
    """Members (with coordinates) of the k largest clusters, with label and colour index by rank; noise is grey (-1)."""
    top = order_clusters(clusters, k=k).withColumn("colour", F.row_number().over(Window.orderBy(F.col("cluster_id") == -1, F.desc("n_samples"), "cluster_id")) - 1)
    top = top.withColumn("colour", F.when(F.col("cluster_id") == -1, -1).otherwise(F.col("colour")))
    return members.join(F.broadcast(top.select("cluster_id", "title", "colour")), "cluster_id").withColumn("label", wrapped("title"))  # k rows


def clustering_score(assignments: DataFrame, silhouette: float) -> float:
    """Silhouette and half the share that is not noise; minus infinity unless 1 < clusters < 1000."""
    n, noise = assignments.agg(F.countDistinct("cluster_id"), F.avg((F.col("cluster_id") == -1).cast("double"))).first()
    return silhouette + 0.5 * (1 - noise) if 1 < n < 1000 else -math.inf


# What the search draws from, shares of the number of rows, selections, and divisors of distances.
RANGES = {"max_cluster_size": (0.01, 0.05), "min_cluster_size": (0.0001, 0.001), "min_samples": (0.0, 0.001), "selection": ("eom", "leaf"), "alpha": (0.1, 3.0)}


def draw_settings(n: int, n_trials: int, seed: int, ranges: dict | None = None) -> list[dict]:
    """Parameter sets: shares become counts as in `scale_params`. Alpha is drawn on a grid of tenths; trials of equal alpha and min_samples share a forest."""
    rng, out = np.random.default_rng(seed), []
    ranges = RANGES | (ranges or {})
    for trial in range(n_trials):
        share = {k: rng.uniform(*ranges[k]) for k in ("max_cluster_size", "min_cluster_size", "min_samples")}
        bound = lambda k, low, high: max(low, min(int(n * share[k]), high))  # noqa: E731, B023
        out.append({
            "trial": trial, "max_cluster_size": bound("max_cluster_size", 100, n - 1), "min_cluster_size": bound("min_cluster_size", 10, n - 1), "min_samples": bound("min_samples", 10, 128),
            "selection": str(rng.choice(ranges["selection"])), "alpha": round(float(rng.uniform(*ranges["alpha"])), 1),
        })
    return out


def search_clustering(vectors: DataFrame, settings: list[dict], allow_single: bool = True) -> DataFrame:
    """One row for each setting: its parameters, n_clusters, noise (share of rows), silhouette (null without two clusters) and score; the best has the highest score.

    All settings go through one pass: a forest for each min_samples and alpha, one keyed run of condensed trees, and one pass over pairs of rows for all silhouettes.
    """
    from eligo.operators.metrics import silhouettes

    spark, n = vectors.sparkSession, vectors.count()
    pairs = sorted({(s["min_samples"], s["alpha"]) for s in settings})
    kinds = spark.createDataFrame([(k, *pair) for k, pair in enumerate(pairs)], "grp long, samples int, alpha double")
    rows = _rows(vectors).drop("grp").crossJoin(F.broadcast(kinds))  # a row for each pair of values
    of = spark.createDataFrame([(s["trial"], pairs.index((s["min_samples"], s["alpha"]))) for s in settings], "trial long, grp long")
    edges = forest.reachability_forest(rows).join(F.broadcast(of), "grp").select(F.col("trial").alias("grp"), "a", "b", "weight")
    asked = _settings(spark, [(s["trial"], s["min_cluster_size"], s["selection"], s["max_cluster_size"], allow_single) for s in settings])
    found = cut(condense.clusters(cut(edges, "forests"), asked), "found")
    told = found.groupBy("grp").agg(F.countDistinct("cluster_id").alias("n_clusters"), (1 - F.count("*") / n).alias("noise"))
    scores = silhouettes(vectors, found, [s["trial"] for s in settings])
    drawn = spark.createDataFrame([tuple(s.values()) for s in settings], "trial long, max_cluster_size long, min_cluster_size long, min_samples long, selection string, alpha double")
    out = drawn.join(told.withColumnRenamed("grp", "trial"), "trial", "left").join(scores.withColumnRenamed("grp", "trial"), "trial", "left")
    out = out.withColumn("n_clusters", F.coalesce("n_clusters", F.lit(0))).withColumn("noise", F.coalesce("noise", F.lit(1.0)))
    labels = F.col("n_clusters") + F.when(F.col("noise") > 0, 1).otherwise(0)  # noise counts as one
    score = F.when((labels > 1) & (labels < 1000), F.coalesce("silhouette", F.lit(0.0)) + 0.5 * (1 - F.col("noise"))).otherwise(F.lit(-math.inf))
    return out.withColumn("score", score)
