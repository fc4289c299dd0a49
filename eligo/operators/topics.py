"""Names of clusters from their words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eligo.operators.clusters import NOISE_TITLE

# The English stop words of Spark ML.
ENGLISH = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those
am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below
to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just
don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't
don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's would"""
#: As the words of a text are cut: at apostrophes, with two letters or more.
STOP_WORDS = sorted({part for word in ENGLISH.split() for part in word.split("'") if len(part) > 1})


def cluster_term_counts(rows: DataFrame) -> DataFrame:
    """(cluster_id, text) -> cluster_id, term, n: lower-case words of two or more letters that are not stop words."""
    terms = rows.select("cluster_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\b\w\w+\b"), F.lit(0))).alias("term"))
    return terms.where(~F.col("term").isin(STOP_WORDS)).groupBy("cluster_id", "term").agg(F.count("*").alias("n"))


def class_tfidf(counts: DataFrame) -> DataFrame:
    """With weight: share within the cluster times ln(1 + mean words per cluster / uses of the term)."""
    own = counts.groupBy("cluster_id").agg(F.sum("n").alias("words"))
    mean = own.agg(F.avg("words").alias("mean"))
    uses = counts.groupBy("term").agg(F.sum("n").alias("uses"))
    rows = counts.join(own, "cluster_id").join(uses, "term").crossJoin(F.broadcast(mean))  # one row
    return rows.select("cluster_id", "term", "n", (F.col("n") / F.col("words") * F.log(1 + F.col("mean") / F.col("uses"))).alias("weight"))


def top_terms(weights: DataFrame, k: int = 5) -> DataFrame:
    """The k best terms of each cluster with their rank."""
    order = Window.partitionBy("cluster_id").orderBy(F.desc(F.round("weight", 9)), "term")
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("cluster_id", "rank", "term", "weight")


def cluster_title(terms: DataFrame) -> DataFrame:
    """cluster_id, title: terms joined by hyphens; noise has its own."""
    lists = terms.where("term <> ''").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("l"))
    title = F.array_join(F.transform("l", lambda x: x["term"]), "-")
    return lists.select("cluster_id", F.when(F.col("cluster_id") == -1, NOISE_TITLE).otherwise(title).alias("title"))
