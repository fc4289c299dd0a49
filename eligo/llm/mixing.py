"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, ...; they share all words, a
target stops at `most` times its source's words, and the excess is shared anew by weight.

The documents of a source stand in permuted order, over and over, up to `most` times; what the mixture takes is the
beginning of that sequence, up to the target: whole documents, the last one if more than half of it is within. The
sequence is cut into blocks of equal words. The number of blocks of each source is its quota, exactly;
a binary tree deals the quotas to the output shards: every node gives half of its blocks to its left child, drawn over all
sources at once from the multivariate hypergeometric law, so that shards are equal in blocks and the quotas of all sources add
up exactly. The tree's depth is set by the number of shards. A shard then draws its blocks: those of a source are permuted, and each shard has a stretch of
them to itself. A shard is shuffled locally.

Sums over the permuted order are made in range partitions, so a hot source has as many tasks as it needs; the tree works on a
row per source and node, LEVELS levels in a task at a time, each node alone. All draws
are seeded by keys, so reruns agree and a lost task is repeated alike.

Defined cases: null text has size 0, and such a document is taken where the sequence reaches its place; of rows equal in id, text and source
as many are taken as fit, each with at most `most` copies; a
source of size 0 has target 0; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eligo.llm.common import KEY, WORD, cut, document_key

MOST = 3
SHARD_DOCS = 1 << 16
LEAST_SHARDS = 16
SHARD_BLOCKS = 32
LEVELS = 8
SEED = 17
ROWS = 1 << 12  # equal rows that are listed at once
UNIT = [*KEY, "__k_source"]


def running(df: DataFrame, order: list, sums: dict) -> DataFrame:
    """df with, for each name in `sums`, the sum of its column over all rows before in the given order, without bringing all rows to one task."""
    parts = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "running")
    totals = sorted(parts.groupBy("__part").agg(*[F.sum(c).alias(n) for n, c in sums.items()]).collect())  # a row for each partition
    starts, now = [], [0] * len(sums)
    for part, *more in totals:
        starts.append((part, *now))
        now = [a + b for a, b in zip(now, more, strict=True)]
    kinds = ", ".join(["__part int", *(f"__start_{n} {'double' if any(isinstance(t[k + 1], float) for t in totals) else 'long'}" for k, n in enumerate(sums))])
    starts = df.sparkSession.createDataFrame(starts, kinds)
    before = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__sum_{n}") for n, c in sums.items()])
    out = local.join(starts, "__part").select(*df.columns, *[(F.col(f"__start_{n}") + F.col(f"__sum_{n}")).alias(n) for n in sums])
    return out


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with `index`, weight `w` and `target` words.

    Sources are capped from the smallest cap a weight upwards; the level at which the rest share is the first one that no cap left is under.
    """
    weighed = running(sources, [F.col("source").asc_nulls_last()], {"index": F.lit(1)}).withColumn("w", F.col("index") % 3 + 1)
    weighed = weighed.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("w"))
    weighed = cut(running(weighed, [F.col("ratio"), F.col("index")], {"caps": F.col("cap"), "ws": F.col("w")}), "sources")
    total, w = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    shared = (total - F.col("caps")) / (w - F.col("ws"))
    level = weighed.where(F.col("ratio") >= shared).agg(F.min(F.struct("ratio", "index", shared.alias("level"))).alias("m")).first()[0]
    target = F.col("cap").cast("double") if level is None else F.least(F.col("w") * F.lit(float(level["level"])), F.col("cap").cast("double"))
    return weighed.select(*sources.columns, "index", "w", target.alias("target"))


def split(quotas: np.ndarray, levels: int, node: int) -> np.ndarray:
    """Quotas of blocks by source -> 2 ** levels rows of quotas. Left children get half of a node's blocks; the seed is the node's number in the tree."""
    rows = quotas[None, :]
    for level in range(levels):
        out = np.empty((2 * len(rows), rows.shape[1]), dtype=np.int64)
        for k, row in enumerate(rows):
            rng = np.random.default_rng([SEED, (node << level) + k])
            out[2 * k] = rng.multivariate_hypergeometric(row, int(row.sum()) // 2, method="marginals")
            out[2 * k + 1] = row - out[2 * k]
        rows = out
    return rows


def _children(levels: int):
    """One node's quotas -> those of its descendants so many levels down."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, node = rows.sort_values("index"), int(rows["node"].iloc[0])
        got = split(rows["blocks"].to_numpy(), levels, node)
        child, source = np.nonzero(got)
        return pd.DataFrame({"index": rows["index"].to_numpy()[source], "node": (node << levels) + child, "blocks": got[child, source]})

    return run


def deal(sources: DataFrame, bits: int) -> DataFrame:
    """(index, blocks) of each source -> (index, shard, blocks): how many of its blocks each of 2 ** bits shards gets (none: no row)."""
    nodes = sources.where("blocks > 0").select("index", F.lit(1).cast("long").alias("node"), "blocks")  # the root is node 1
    while bits > 0:
        nodes = cut(nodes.groupBy("node").applyInPandas(_children(min(bits, LEVELS)), "index long, node long, blocks long"), "quotas")
        bits -= LEVELS
    return nodes.select("index", (F.col("node") - F.pow(F.lit(2), F.length(F.bin("node")) - 1)).cast("long").alias("shard"), "blocks")


def counted(df: DataFrame, n: str, name: str) -> DataFrame:
    """Every row n times, numbered from 1, ROWS at a time; none for 0."""
    many = df.where(F.col(n) > 0).withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(ROWS).cast("long"))))
    each = F.explode(F.sequence(F.col("__from") + 1, F.least(F.col("__from") + ROWS, F.col(n))))
    return many.withColumn(name, each).drop("__from")


def plan(docs: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(UNIT keys, doc_id, size, n_rows, source_size, target), a row per distinct document and source; and (UNIT keys, row, turn, shard), a row per copy that the mixture takes."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(*document_key(), F.xxhash64("source").alias(UNIT[3]), F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"))
    rows = cut(rows.groupBy(*UNIT, "doc_id", "source", "size").agg(F.count("*").alias("n_rows")), "sizes")
    words = F.col("size") * F.col("n_rows")
    known = cut(targets(rows.groupBy("source").agg(F.sum(words).alias("source_size")), most), "targets")
    n, total = rows.count(), known.agg(F.sum("target")).first()[0] or 0
    bits = max(LEAST_SHARDS.bit_length() - 1, (n // SHARD_DOCS).bit_length())
    block = max(1, int(total) // (SHARD_BLOCKS << bits))  # words
    known = cut(known.withColumn("blocks", F.ceil(F.col("target") / block).cast("long")), "targets")
    # stretches of a source's blocks in seeded order go to the shards in turn
    own = Window.partitionBy("index").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    dealt = deal(known, bits).withColumn("from", F.coalesce(F.sum("blocks").over(own), F.lit(0)))
    dealt = dealt.select("index", "shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("blocks") - 1)).alias("place"))
    drawn = Window.partitionBy("index").orderBy(F.xxhash64("index", "block", F.lit(SEED)), "block")
    permuted = known.where("blocks > 0").select("index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    permuted = permuted.withColumn("place", (F.row_number().over(drawn) - 1).cast("long"))  # SHARD_BLOCKS for each shard, over all sources
    dealt = cut(dealt.join(permuted, ["index", "place"]).select("index", "shard", "block"), "blocks")
    # words before each document in its source's permuted order
    joined = rows.join(known.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s", "w")
    start = running(known.select("index", "source_size"), [F.col("index")], {"start": F.col("source_size")}).select("index", "start")
    ordered = running(joined.withColumn("order", F.xxhash64(*UNIT, F.lit("order"))), [F.col("index"), F.col("order"), *map(F.col, UNIT)], {"words": words})
    ordered = ordered.join(start, "index").withColumn("words", F.col("words") - F.col("start"))
    # how many of a document's rows a turn over the source takes: those of which more than half is within the target
    turn = lambda r: F.when(
        F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("n_rows"), F.floor((F.col("target") - r * F.col("source_size") - F.col("words")) / F.col("size") + 0.5).cast("long")))
    ).otherwise(F.when(F.col("target") > r * F.col("source_size") + F.col("words"), F.col("n_rows")).otherwise(0))
    turns = F.array(*[F.struct(F.lit(r).alias("turn"), turn(F.lit(r)).alias("n")) for r in range(most)])
    each = ordered.select("index", *UNIT, "size", "words", "source_size", "blocks", F.explode(turns).alias("t")).where("t.n > 0")
    each = counted(each.select("index", *UNIT, "size", "words", "source_size", "blocks", "t.turn", F.col("t.n").alias("n")), "n", "row")
    offset = F.col("turn") * F.col("source_size") + F.col("words") + (F.col("row") - 1) * F.col("size")
    each = each.withColumn("block", F.least(F.floor(offset / block), F.col("blocks") - 1))
    copies = each.join(dealt, ["index", "block"]).select(*UNIT, "row", "turn", F.col("shard").cast("int").alias("shard"))
    return ordered.select(*UNIT, "doc_id", "size", "n_rows", "source_size", "target"), copies


def taken(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), copies, shards (of each copy): a row per document row."""
    known, copies = plan(docs, most)
    copies = copies.groupBy(*UNIT, "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "shard"))), lambda c: c.shard).alias("shards"))  # `most` of a row
    rows = counted(known, "n_rows", "row").join(copies, [*UNIT, "row"], "left").withColumn("shards", F.coalesce("shards", F.array().cast("array<int>")))
    n = F.size("shards")
    return rows.select("doc_id", "size", "source_size", "target", (n * F.col("size")).cast("long").alias("taken"), n.alias("copies"), "shards")


def mix(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The mixture itself: the documents' own columns, a row per copy, by shard and in the shard's shuffled order."""
    chosen = plan(docs, most)[1].select(*UNIT, F.struct("row", "turn", "shard").alias("__copy"))
    keyed = docs.select("*", *document_key(), F.xxhash64("source").alias(UNIT[3])).dropDuplicates(UNIT)  # equal rows: `row` counts them
    rows = keyed.join(chosen, UNIT)
    rows = rows.repartition("__copy.shard").sortWithinPartitions("__copy.shard", F.xxhash64(*UNIT, "__copy", F.lit("mix")))
    return rows.select(*docs.columns)
