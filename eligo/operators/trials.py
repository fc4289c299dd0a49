"""Trial projection and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("completed", "terminated")


def filter_trials(trials: DataFrame) -> DataFrame:
    """Finished interventional drug trials with phases, conditions and criteria."""
    drug = F.exists("intervention_types", lambda x: F.lower(x) == "drug")
    there = F.col("phases").isNotNull() & F.col("criteria_str").isNotNull() & F.col("conditions").isNotNull()
    return trials.where(F.lower("label").isin(*STATUSES) & (F.lower("study_type") == "interventional") & drug & there)


def check_trial_id(trials: DataFrame, file_name: Column, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(those whose nct_id is their file's name, the rejects). strict raises instead."""
    same = F.coalesce(F.regexp_extract(file_name, r"([^/]+)\.json$", 1) == F.col("nct_id"), F.lit(False))
    if strict:
        return trials.where(F.when(same, True).otherwise(F.raise_error(F.lit("trial id differs from its file name")))), trials.limit(0)
    return trials.where(same), trials.where(~same)


def normalise_phases(phases: Column) -> Column:
    """Lower case, no spaces."""
    return F.transform(phases, lambda p: F.lower(F.replace(p, F.lit(" "), F.lit(""))))


def land_by_prefix(trials: DataFrame) -> DataFrame:
    """With the folder of each trial: the first seven letters of its id and xxxx."""
    return trials.withColumn("prefix", F.concat(F.substring("ct_path", 1, 7), F.lit("xxxx")))


def write_by_prefix(trials: DataFrame, path: str) -> None:
    """Trials as Parquet, a folder for each prefix; a prefix of any size is written by all the tasks that hold some of it."""
    land_by_prefix(trials).write.mode("overwrite").partitionBy("prefix").parquet(path)
