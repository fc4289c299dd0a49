"""Readers and writers of trials, criteria and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eligo.functions.ranks import numbered
from eligo.operators.mesh import map_names
from eligo.sources.tables import commit, commits

REQUIRED = ["ct_path", "label", "phases", "conditions", "condition_ids", "intervention_ids", "category", "criterion", "criterion_idx"]


def read_trials_json(spark: SparkSession, path: str) -> DataFrame:
    """path, doc (variant) of each *.json below a folder; files that are empty or not JSON are left out."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc")).where("doc is not null")


def trial_field(doc: str, *paths: str, kind: str = "string") -> Column:
    """The first of several paths that is there, in camel or Pascal case."""
    pascal = lambda p: ".".join(x[:1].upper() + x[1:] for x in p.split("."))
    return F.coalesce(*[F.try_variant_get(doc, f"$.{q}", kind) for p in paths for q in (p, pascal(p))])


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Trial records below a folder as typed columns."""
    return project_trials(read_trials_json(spark, path))


def project_trials(raw: DataFrame) -> DataFrame:
    """(path, doc) records of either layout as typed columns."""
    p = "protocolSection."
    many = "array<string>"
    return raw.select(
        "path", trial_field("doc", p + "identificationModule.nctId").alias("nct_id"), trial_field("doc", p + "statusModule.overallStatus").alias("label"),
        trial_field("doc", p + "designModule.studyType").alias("study_type"),
        trial_field("doc", p + "designModule.phases", p + "designModule.phaseList.phase", kind=many).alias("phases"),
        F.transform(
            trial_field("doc", p + "armsInterventionsModule.interventions", p + "armsInterventionsModule.interventionList.intervention", kind="array<variant>"),
            lambda x: F.coalesce(F.try_variant_get(x, "$.type", "string"), F.try_variant_get(x, "$.Type", "string"), F.try_variant_get(x, "$.InterventionType", "string")),
        ).alias("intervention_types"),
        trial_field("doc", p + "conditionsModule.conditions", p + "conditionsModule.conditionList.condition", kind=many).alias("conditions"),
        trial_field("doc", p + "eligibilityModule.eligibilityCriteria").alias("criteria_str"),
        F.transform(trial_field("doc", "derivedSection.conditionBrowseModule.meshes", kind="array<variant>"), lambda x: F.try_variant_get(x, "$.id", "string")).alias("condition_mesh"),
        trial_field("doc", p + "statusModule.startDateStruct.date", "protocolSection.statusModule.startDate").alias("start_date"),
        trial_field("doc", p + "statusModule.completionDateStruct.date", "protocolSection.statusModule.completionDate").alias("completion_date"),
        trial_field("doc", p + "designModule.enrollmentInfo.count").alias("enrollment"),
    )


def read_trials_sheet(sheet: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Flat sheet -> ct_path, label, phases, conditions, criteria_str and tree numbers of conditions."""
    rows = sheet.na.fill("")
    trials = rows.select(
        F.col("trialid").alias("ct_path"), F.col("recruitmentStatusNorm").alias("label"), F.split("phaseNorm", "; ").alias("phases"), F.split("conditions", "; ").alias("conditions"),
        F.split("interventions", "; ").alias("interventions"), F.concat("inclusionCriteriaNorm", F.lit("\n\n"), "exclusionCriteriaNorm").alias("criteria_str"),
    )
    found = map_names(trials.select("ct_path", F.col("conditions").alias("names")), crosswalk)
    return trials.join(found.withColumnRenamed("tree_numbers", "condition_ids"), "ct_path", "left")


def read_labelled_sentences(df: DataFrame) -> DataFrame:
    """(trialid, cluster, sentence, sentence_preprocessed) -> criteria with the cluster as label and the preprocessed text as only condition id."""
    empty = F.lit("")
    return df.select(
        F.col("trialid").alias("ct_path"), F.col("cluster").alias("label"), F.array(F.array("sentence_preprocessed")).alias("condition_ids"),
        empty.alias("category"), empty.alias("context"), empty.alias("subcontext"), F.trim("sentence").alias("criterion"),
    )


def read_parsed_criteria(df: DataFrame) -> DataFrame:
    """Checks that the needed columns are there, and reads list literals in string columns as arrays."""
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    text = {c for c, t in df.dtypes if t == "string"}
    for c in ("phases", "conditions", "condition_ids", "intervention_ids"):
        if c in text:
            kind = "array<array<string>>" if c.endswith("ids") else "array<string>"
            value = F.from_json(F.replace(F.col(c), F.lit("'"), F.lit('"')), kind)
            df = df.withColumn(c, F.flatten(value) if c.endswith("ids") else value)
    return df


def criteria_sheet(criteria: DataFrame) -> DataFrame:
    """What write_parsed_criteria writes: paragraph and complexity on a trial's first row only."""
    first = F.col("criterion_idx") == 0
    return criteria.withColumn("criteria_str", F.when(first, F.col("criteria_str")).otherwise("")).withColumn("complexity", F.when(first, F.col("complexity")).otherwise(""))


def write_parsed_criteria(criteria: DataFrame, path: str) -> None:
    """Parsed criteria as Parquet."""
    criteria_sheet(criteria).write.mode("overwrite").parquet(path)


def write_embeddings(df: DataFrame, path: str, model_id: str) -> None:
    """Vectors with their texts, in the model's partition."""
    df.withColumn("model_id", F.lit(model_id)).write.mode("append").partitionBy("model_id").parquet(path)


def read_embeddings(spark: SparkSession, path: str, model_id: str) -> DataFrame:
    """One model's vectors; other partitions are not read."""
    return spark.read.parquet(path).where(F.col("model_id") == model_id).drop("model_id")


def write_cluster_list(rows: DataFrame, path: str) -> None:
    """Members of clusters in report order, as CSV."""
    rows.orderBy("position", "rank").select("cluster_id", "prevalence", "title", "criterion").write.mode("overwrite").csv(path, header=True)


def write_cluster_json(instances: DataFrame, path: str) -> None:
    """A nested document per cluster."""
    instances.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as CSV."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows in key order, from as many tasks as hold them."""
    return numbered(df, [F.col(key)], "__place").where(F.col("__place") < n).drop("__place")


def new_rows(df: DataFrame, done: DataFrame, key: str, most: int) -> DataFrame:
    """Rows whose key is not done yet, in key order, so many that all together are at most `most`."""
    left = max(0, most - done.count())
    return first_rows(df.join(done.select(key), key, "left_anti"), key, left)


def read_appended(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all committed batches at a path; what a lost run left behind is not read."""
    batches = [f"{path}/{name}" for name in commits(spark, path)]
    return spark.read.schema(schema).parquet(*batches) if batches else spark.createDataFrame([], schema)


def append_new(df: DataFrame, path: str, key: str, most: int) -> DataFrame:
    """Append what is new to the result table at a path, and give the table.

    A batch has a folder of its own, named by the number of batches committed before, and counts once it is whole and committed: a run that is lost
    half-way is written over by the next one, and a run that is repeated finds its keys done, so rows are neither doubled nor dropped.
    """
    spark = df.sparkSession
    done = read_appended(spark, path, df.schema)
    batch = f"rows-{len(commits(spark, path)):06d}"
    new_rows(df, done, key, most).write.mode("overwrite").parquet(f"{path}/{batch}")
    commit(spark, path, batch)
    return read_appended(spark, path, df.schema)


def read_mesh_xml(spark: SparkSession, path: str) -> DataFrame:
    """descriptor_id, descriptor_name, tree_numbers of each DescriptorRecord."""
    schema = "DescriptorUI string, DescriptorName struct<String: string>, TreeNumberList struct<TreeNumber: array<string>>"
    rows = spark.read.format("xml").option("rowTag", "DescriptorRecord").schema(schema).load(path)
    return rows.select(
        F.col("DescriptorUI").alias("descriptor_id"), F.col("DescriptorName.String").alias("descriptor_name"), F.coalesce("TreeNumberList.TreeNumber", F.array().cast("array<string>")).alias("tree_numbers")
    )


def read_result_csvs(spark: SparkSession, path: str) -> DataFrame:
    """target, input_type, phases and macro F1 of many reports; T…-I…-P….csv names a report's file, or the folder of it."""
    rows = spark.read.option("recursiveFileLookup", True).csv(path, header=True).select(F.col("_metadata.file_path").alias("file"), "*")
    part = lambda k: F.regexp_extract("file", r"[/=]T([^-/]*)-I([^-/]*)-P([^/]*)\.csv(?:/|$)", k)
    first = rows.columns[1]
    rows = rows.where(F.col(first) == "macro avg")
    return rows.select(part(1).alias("target"), part(2).alias("input_type"), part(3).alias("phases"), F.col("`f1-score`").cast("double").alias("macro_f1"))
