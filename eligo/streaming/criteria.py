"""New trial files to parsed criteria, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eligo.operators.parse import parse_criteria
from eligo.operators.trials import filter_trials
from eligo.sources.criteria import project_trials


def stream_criteria(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Parse what has landed in a folder since the last run and stop; a run that is repeated starts from the checkpoint.

    Each batch has a folder of its own under `out`, which a repeated batch overwrites, so no trial is written twice.
    """
    files = spark.readStream.schema("value string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    docs = files.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc")).where("doc is not null")

    def add(batch: DataFrame, number: int) -> None:
        trials = filter_trials(project_trials(batch)).select(F.col("nct_id").alias("ct_path"), "criteria_str")
        parse_criteria(trials).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
