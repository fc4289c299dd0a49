"""Connected components and spanning forests by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligo.sources.tables import cut


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b), both long: rows (node, component), component the least node.

    Alternates the large-star and small-star steps: each round is two group-mins and two joins,
    which Spark combines before the shuffle and splits when a hub is skewed. A round's edges are
    written to the shared folder, so a lost executor costs one round at most.
    """
    spark = edges.sparkSession
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        nxt = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = cut(nxt.where("a <> b").distinct(), "edges")
        seen = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.hash("a", "b").cast("long")), F.lit(0))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    if not mark[0]:
        return spark.createDataFrame([], "node long, component long")
    roots = now.select(F.col("b").alias("node")).distinct()
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.unionByName(roots.select("node", F.col("node").alias("component")))


def spanning_forest(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Least spanning forest of edges (a, b, weight) by Boruvka rounds; ties go to the smaller pair of ids."""
    norm = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").where("a <> b")
    norm = cut(norm.groupBy("a", "b").agg(F.min("weight").alias("weight")), "graph")
    live, tree = norm.select("a", "b", "weight", F.col("a").alias("ca"), F.col("b").alias("cb")), None
    for _ in range(max_rounds):
        ends = live.select(F.col("ca").alias("c"), "weight", "a", "b").unionByName(live.select(F.col("cb").alias("c"), "weight", "a", "b"))
        best = cut(ends.groupBy("c").agg(F.min(F.struct("weight", "a", "b")).alias("e")).select("e.*").distinct(), "forest")
        if best.isEmpty():
            break
        tree = best if tree is None else tree.unionByName(best)
        comp = cut(components(tree.select("a", "b")), "labels")
        label = lambda k: comp.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
        live = norm.join(label("a"), "a").join(label("b"), "b").where("ca <> cb").select("a", "b", "weight", "ca", "cb")
        live = cut(live, "graph")
    return tree.select("a", "b", "weight").distinct() if tree is not None else norm
