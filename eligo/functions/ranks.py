"""Ranks and running sums over all rows, without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eligo.sources.tables import cut


def running(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with `name`, the sum of a whole-number value over the rows up to this one in a total order.

    Rows are dealt by ranges of the order; the driver sees a sum for each range.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    start, starts = 0, []
    for part, n in sorted(parts.groupBy("__part").agg(F.sum(value)).collect()):
        starts.append((part, start))
        start += n
    starts = df.sparkSession.createDataFrame(starts, "__part int, __start long")
    local = parts.withColumn("__sum", F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return local.join(F.broadcast(starts), "__part").select(*df.columns, (F.col("__start") + F.col("__sum")).alias(name))  # a row for each range


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with `name`, the place of the row in a total order, from 0."""
    return running(df, order, F.lit(1).cast("long"), "__place").withColumn(name, F.col("__place") - 1).drop("__place")
