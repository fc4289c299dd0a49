"""Filters, projection and distinct texts of the criteria corpus."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligo.functions.ranks import numbered
from eligo.operators.mesh import tree_labels


@dataclass(frozen=True)
class Choice:
    """What to keep; an empty list keeps everything, a level of None names no label."""

    phases: list[str] = field(default_factory=list)
    statuses: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    condition_prefixes: list[str] = field(default_factory=list)
    intervention_prefixes: list[str] = field(default_factory=list)
    condition_level: int | None = None
    intervention_level: int | None = None


def filter_corpus(criteria: DataFrame, choice: Choice, labels: DataFrame) -> DataFrame:
    """Criteria that meet all of a choice, with condition_labels and intervention_labels."""
    rows = criteria
    if choice.phases:
        rows = rows.where(F.arrays_overlap("phases", F.array(*map(F.lit, choice.phases))))
    if choice.statuses:
        rows = rows.where(F.lower("label").isin([s.lower() for s in choice.statuses]))
    if choice.categories:
        rows = rows.where(F.col("category").isin(choice.categories))
    for kind, prefixes, level in (("condition", choice.condition_prefixes, choice.condition_level), ("intervention", choice.intervention_prefixes, choice.intervention_level)):
        if level is None:
            rows = rows.withColumn(f"{kind}_labels", F.array(F.lit("N/A")))
            continue
        # labels depend on the list of ids only, so they are looked up once for each distinct list
        lists = rows.select(F.col(f"{kind}_ids").alias("ids")).distinct().withColumn("row_id", F.array_join("ids", "|"))
        named = tree_labels(lists, labels, prefixes, level).where(F.size("labels") > 0)
        named = named.select(F.col("row_id").alias("__ids"), F.col("labels").alias(f"{kind}_labels"))
        rows = rows.join(named, F.array_join(f"{kind}_ids", "|") == F.col("__ids")).drop("__ids")
    return rows


def exclude_values(rows: DataFrame, values: dict) -> DataFrame:
    """Without rows whose column equals the given value."""
    for column, value in values.items():
        rows = rows.where(~F.col(column).eqNullSafe(F.lit(value)))
    return rows


def combo_label(phases: Column, conditions: Column, interventions: Column) -> Column:
    """Each list sorted and joined by ` - `, the three joined by ` --- `."""
    return F.concat_ws(" --- ", *[F.array_join(F.array_sort(x), " - ") for x in (phases, conditions, interventions)])


def build_input_text(category: Column, text: Column) -> Column:
    """Lower-case text with its category in front, unless that is unclear."""
    return F.lower(F.when(category != "?", F.concat(category, F.lit("clusion criterion - "), text)).otherwise(text))


def dedup_first(criteria: DataFrame) -> DataFrame:
    """The first row of each input_text by (ct_path, criterion_idx); combined before the shuffle, so common texts do not pile up."""
    others = [c for c in criteria.columns if c != "input_text"]
    first = criteria.groupBy("input_text").agg(F.min_by(F.struct(*others), F.struct("ct_path", "criterion_idx")).alias("r"))
    return first.select("input_text", "r.*").select(*criteria.columns)


def cap_samples(criteria: DataFrame, n: int) -> DataFrame:
    """The first n rows in corpus order."""
    rest = [F.col(c) for c in ("ct_path", "criterion_idx")]
    return numbered(criteria, rest, "__place").where(F.col("__place") < n).drop("__place")


def sweep_corpus(criteria: DataFrame, settings: DataFrame) -> DataFrame:
    """All settings (config_id, phase, prefix) in one pass: a criterion row for each setting it meets, distinct by text within it.

    Phases and prefixes (of the few lengths that settings use) are exploded and joined on equality. The
    settings are a grid of tens of rows, so they are broadcast.
    """
    lengths = [r[0] for r in settings.select(F.length("prefix")).distinct().collect()]
    starts = F.flatten(F.transform("condition_ids", lambda x: F.array(*[F.substring(x, 1, n) for n in lengths])))
    text = build_input_text(F.col("category"), F.col("criterion")).alias("input_text")
    rows = criteria.select("ct_path", "criterion_idx", text, F.array_distinct(starts).alias("starts"), F.explode(F.array_distinct("phases")).alias("phase"))
    rows = rows.withColumn("prefix", F.explode("starts")).join(F.broadcast(settings), ["phase", "prefix"])
    first = rows.groupBy("config_id", "input_text").agg(F.min(F.struct("ct_path", "criterion_idx")).alias("r"))
    return first.select("config_id", "input_text", "r.*")


def corpus_summary(clusters: DataFrame, *group: str) -> DataFrame:
    """Distinct trials, criteria and clusters (noise counts as one)."""
    return clusters.groupBy(*group).agg(F.countDistinct("ct_path").alias("n_trials"), F.count("*").alias("n_criteria"), F.countDistinct("cluster_id").alias("n_clusters"))
