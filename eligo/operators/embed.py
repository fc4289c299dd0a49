"""Vectors of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embed_text(corpus: DataFrame, encoder: Callable[[list[str]], object] | None = None, size: int = 256, batch: int = 64) -> DataFrame:
    """(member_id, input_text) -> with embedding. An encoder maps a list of texts to rows of floats and is called in batches;
    without one, hashed word counts weighed by their rarity and brought to length 1."""
    if encoder is None:
        from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
        from pyspark.ml.functions import vector_to_array

        rows = corpus
        for stage in (RegexTokenizer(inputCol="input_text", outputCol="__w", pattern=r"\W+"), HashingTF(inputCol="__w", outputCol="__tf", numFeatures=size)):
            rows = stage.transform(rows)
        rows = IDF(inputCol="__tf", outputCol="__idf").fit(rows).transform(rows)
        rows = Normalizer(inputCol="__idf", outputCol="__v").transform(rows)
        return rows.select(*corpus.columns, vector_to_array("__v", "float32").alias("embedding"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for s in range(0, len(p), batch):
                some = p.iloc[s : s + batch]
                yield some.assign(embedding=[list(map(float, x)) for x in encoder(some["input_text"].tolist())])

    fields = ", ".join(f"`{n}` {t}" for n, t in corpus.dtypes)
    return corpus.mapInPandas(run, f"{fields}, embedding array<float>")


def masked_mean_pool(tokens: DataFrame, key: str) -> DataFrame:
    """(key, mask, embedding) rows of tokens -> key, pooled: sum of mask * token over the mask's sum (1e-9 at least)."""
    rows = tokens.select(key, F.col("mask").cast("double").alias("mask"), F.posexplode("embedding").alias("dim", "x"))
    sums = rows.groupBy(key, "dim").agg(F.sum(F.col("mask") * F.col("x").cast("double")).alias("s"), F.sum("mask").alias("m"))
    lists = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", (F.col("s") / F.greatest(F.col("m"), F.lit(1e-9))).alias("v")))).alias("l"))
    return lists.select(key, F.transform("l", lambda x: x["v"]).alias("pooled"))


def token_windows(rows: DataFrame, key: str, size: int = 512, overlap: int = 256) -> DataFrame:
    """(key, tokens) -> key, window_no, tokens: windows that overlap; the last one ends with the text."""
    step, n = size - overlap, F.size("tokens")
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("tokens", i * step + 1, F.lit(size)))
    return rows.where(n > 0).select(key, F.posexplode(starts).alias("window_no", "tokens"))


def reduce_pca(vectors: DataFrame, k: int | None) -> DataFrame:
    """With `reduced`, the first k principal components; unchanged if k is None."""
    if k is None:
        return vectors
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.withColumn("__v", array_to_vector(F.col("embedding").cast("array<double>")))
    return PCA(k=k, inputCol="__v", outputCol="__p").fit(rows).transform(rows).select(*vectors.columns, vector_to_array("__p").alias("reduced"))
