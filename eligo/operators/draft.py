"""Drafting of criteria sections, text scores and experiment statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eligo.functions.porter import stem
from eligo.functions.ranks import numbered
from eligo.sources.tables import cut

PREFIX = r"(?i)^(in|ex)clusion criterion - "


def sample_eval_trials(trials: DataFrame, done: DataFrame, n: int, seed: int) -> DataFrame:
    """Trials not done yet in a seeded order, so many that all together are n."""
    left = max(0, n - done.count())
    order = F.md5(F.concat("ct_path", F.lit(f"/{seed}")).cast("binary"))
    return trials.join(done.select("ct_path"), "ct_path", "left_anti").orderBy(order, "ct_path").limit(left)


def similar_criteria(eval_trials: DataFrame, criteria: DataFrame, condition_level: int, intervention_level: int, most: int | None = 100_000) -> DataFrame:
    """eval_path, ct_path, criterion_idx: criteria of other trials that share a phase and, at the given levels, a condition
    and an intervention prefix; at most `most` for each evaluated trial (a limit that the job states; None: all), in corpus order.

    Prefixes are exploded and joined on equality, not compared pair by pair.
    """
    cut = lambda ids, level: F.array_distinct(F.transform(ids, lambda x: F.substring_index(x, ".", level)))
    keys = lambda df: df.withColumn("c", F.explode(cut("condition_ids", condition_level))).withColumn("i", F.explode(cut("intervention_ids", intervention_level))).withColumn("p", F.explode("phases"))
    asked = keys(eval_trials.select(F.col("ct_path").alias("eval_path"), "condition_ids", "intervention_ids", "phases")).select("eval_path", "c", "i", "p").distinct()
    held = keys(criteria.select("ct_path", "criterion_idx", "condition_ids", "intervention_ids", "phases")).select("ct_path", "criterion_idx", "c", "i", "p")
    found = held.join(asked, ["c", "i", "p"]).where("ct_path <> eval_path").select("eval_path", "ct_path", "criterion_idx").distinct()
    if most is None:
        return found
    rank = F.row_number().over(Window.partitionBy("eval_path").orderBy("ct_path", "criterion_idx"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def draft_section(clusters: DataFrame, members: DataFrame, k: int = 15) -> DataFrame:
    """place, cluster_id, text: the first-ranked member of each of the k most prevalent clusters, noise left out."""
    order = Window.orderBy(F.desc(F.round("prevalence", 9)), F.desc("n_samples"), "cluster_id")  # a row per cluster
    top = clusters.where("cluster_id <> -1").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return top.join(members.where("rank = 1").select("cluster_id", "text"), "cluster_id").select("place", "cluster_id", "text")


def format_section(lines: DataFrame, key: str) -> DataFrame:
    """(key, place, text) -> key, section: lines under their headings, without prefix; those without one are inclusions."""
    out = F.lower("text").startswith("exclusion criterion")
    rows = lines.select(key, "place", out.alias("ex"), F.regexp_replace("text", PREFIX, "").alias("line"))
    lists = rows.groupBy(key).agg(*[F.array_sort(F.collect_list(F.when(F.col("ex") == ex, F.struct("place", "line")))).alias(f"l{int(ex)}") for ex in (False, True)])
    part = lambda name, c: F.concat(F.lit(name), F.array_join(F.transform(c, lambda x: F.concat(F.lit("\n"), x["line"])), ""))
    return lists.select(key, F.concat(part("Inclusion criteria:", "l0"), F.lit("\n\n"), part("Exclusion criteria:", "l1")).alias("section"))


def tokens(text: Column) -> Column:
    """Runs of lower-case letters and digits."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), "")


def stem_tokens(rows: DataFrame, key: list[str], column: str) -> DataFrame:
    """key, column as array with words over 3 letters stemmed; each distinct word is stemmed once."""
    stems = F.pandas_udf(lambda s: s.map(lambda w: stem(w) if len(w) > 3 else w), "string")
    each = rows.select(*key, F.posexplode(column).alias("at", "word"))
    words = each.select("word").distinct().withColumn("stem", stems("word"))
    lists = each.join(words, "word").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "stem"))).alias("l"))
    got = lists.select(*key, F.transform("l", lambda x: x["stem"]).alias(column))
    return rows.drop(column).join(got, key, "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))


def _scores(hit: Column, n_pred: Column, n_ref: Column) -> list[Column]:
    p, r = F.when(n_pred > 0, hit / n_pred).otherwise(0.0), F.when(n_ref > 0, hit / n_ref).otherwise(0.0)
    return [r.alias("recall"), p.alias("precision"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f")]


def rouge_n(pairs: DataFrame, key: list[str], n: int) -> DataFrame:
    """(key, prediction, reference as token arrays) -> key, recall, precision, f of clipped n-grams."""

    def grams(c: str, name: str) -> DataFrame:
        g = F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, n), " "))
        return pairs.where(F.size(c) >= n).select(*key, F.explode(g).alias("g")).groupBy(*key, "g").agg(F.count("*").alias(name))

    hits = grams("prediction", "a").join(grams("reference", "b"), [*key, "g"]).groupBy(*key).agg(F.sum(F.least("a", "b")).alias("hit"))
    size = lambda c: F.greatest(F.size(c) - n + 1, F.lit(0))
    rows = pairs.select(*key, size("prediction").alias("np"), size("reference").alias("nr")).join(hits, key, "left")
    return rows.select(*key, *_scores(F.coalesce("hit", F.lit(0)), F.col("np"), F.col("nr")))


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence: a row of the table is the bits of one number, 0 where it grows."""
    places: dict = {}
    for k, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << k
    every = (1 << len(b)) - 1
    row = every
    for w in a:
        at = row & places.get(w, 0)
        row = (row + at | row - at) & every
    return len(b) - row.bit_count()


def rouge_l(pairs: DataFrame, key: list[str]) -> DataFrame:
    """key, recall, precision, f of the longest common subsequence."""
    length = F.pandas_udf(lambda a, b: pd.Series([lcs(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int64"), "long")
    rows = pairs.select(*key, length("prediction", "reference").alias("hit"), F.size("prediction").alias("np"), F.size("reference").alias("nr"))
    return rows.select(*key, *_scores(F.col("hit"), F.col("np"), F.col("nr")))


def rouge_average(scores: DataFrame) -> DataFrame:
    """With means of the three scores (columns <name>_<score> for rouge1, rouge2, rougeL)."""
    mean = lambda s: sum(F.col(f"{m}_{s}") for m in ("rouge1", "rouge2", "rougeL")) / 3
    return scores.withColumns({f"average_{s}": mean(s) for s in ("recall", "precision", "f")})


def greedy_match_score(token_rows: DataFrame, key: str) -> DataFrame:
    """(key, side 0 or 1, window_no, token_no, embedding) -> key, precision, recall, f by each token's best cosine on the other side.

    Scores are means over windows that both sides have; surplus windows of the longer text are left out.
    """
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = token_rows.withColumn("norm", norm)
    a, b = (rows.where(F.col("side") == s).select(key, "window_no", *[F.col(c).alias(f"{c}{s}") for c in ("token_no", "embedding", "norm")]) for s in (0, 1))
    dot = F.aggregate(F.zip_with("embedding0", "embedding1", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    pairs = a.join(b, [key, "window_no"]).withColumn("cos", dot / (F.col("norm0") * F.col("norm1")))
    best = lambda t, name: pairs.groupBy(key, "window_no", t).agg(F.max("cos").alias("c")).groupBy(key, "window_no").agg(F.avg("c").alias(name))
    per = best("token_no0", "p").join(best("token_no1", "r"), [key, "window_no"]).withColumn("f1", 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
    return per.groupBy(key).agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f1").alias("f"))


def best_method(a: Column, b: Column, names: tuple[str, str] = ("Cluster", "LLM")) -> Column:
    """Name of the better score; the first wins ties."""
    return F.when(a >= b, names[0]).otherwise(names[1])


def shuffled_pairs(pairs: DataFrame, key: str, seed: int) -> DataFrame:
    """Each prediction with the reference of the next row in a seeded order (the last with the first)."""
    ranked = cut(numbered(pairs.select(key), [F.xxhash64(key, F.lit(seed)), F.col(key)], "__r"), "order")  # keys only
    n = max(1, ranked.count())
    after = ranked.select(F.col(key).alias("__key"), F.pmod(F.col("__r") - 1, F.lit(n)).alias("__r"))
    other = pairs.select(F.col(key).alias("__key"), F.col("reference").alias("__ref"))
    rows = pairs.select(key, "prediction").join(ranked.join(after, "__r").select(key, "__key"), key).join(other, "__key")
    return rows.select(key, "prediction", F.col("__ref").alias("reference"))


def rouge_table(pairs: DataFrame, key: list[str]) -> DataFrame:
    """key and all ROUGE scores of token pairs."""
    out = pairs.select(*key)
    for name, rows in (("rouge1", rouge_n(pairs, key, 1)), ("rouge2", rouge_n(pairs, key, 2)), ("rougeL", rouge_l(pairs, key))):
        out = out.join(rows.select(*key, *[F.col(s).alias(f"{name}_{s}") for s in ("recall", "precision", "f")]), key)
    return rouge_average(out)


def generation_results(methods: dict[str, DataFrame], key: str) -> DataFrame:
    """{name: pairs of token arrays} for two methods -> their scores side by side and the better one's name."""
    (n1, a), (n2, b) = methods.items()
    tables = [rouge_table(p, [key]) for p in (a, b)]
    named = [t.select(key, *[F.col(c).alias(f"{n}_{c}") for c in t.columns if c != key]) for n, t in zip((n1, n2), tables, strict=True)]
    return named[0].join(named[1], key).withColumn("best", best_method(F.col(f"{n1}_average_f"), F.col(f"{n2}_average_f"), (n1, n2)))


def mean_stderr(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, mean, stderr (0 for a single value), n."""
    n = F.count(value)
    return rows.groupBy(*group).agg(F.avg(value).alias("mean"), F.when(n > 1, F.stddev_samp(value) / F.sqrt(n)).otherwise(0.0).alias("stderr"), n.alias("n"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    x = df / (df + t * t)
    if x >= 1:
        return 1.0
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def paired_t_test(rows: DataFrame, a: str, b: str, group: list[str] | None = None) -> DataFrame:
    """group, n, t, p of the paired differences."""
    d = F.col(a) - F.col(b)
    got = rows.groupBy(*(group or [])).agg(F.count(d).alias("n"), (F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))).alias("t"))
    p = F.pandas_udf(lambda t, n: pd.Series([t_two_sided(x, m - 1) if m > 1 and math.isfinite(x) else float("nan") for x, m in zip(t, n, strict=True)]), "double")
    return got.withColumn("p", p("t", "n"))


def significance(p: Column, n_comparisons: int = 1, level: float = 0.05) -> Column:
    """`*` under level / n_comparisons, `n.s.` otherwise."""
    return F.when(p < level / n_comparisons, "*").otherwise("n.s.")


def converging_only(results: DataFrame) -> DataFrame:
    """Rows of a quality other than -1, each with the kept share of all."""
    share = results.agg(F.avg((F.col("quality") != -1).cast("double")).alias("kept_share"))
    return results.where("quality <> -1").crossJoin(F.broadcast(share))


def relative_performance(means: DataFrame) -> DataFrame:
    """cluster, llm, cluster_shuffled, llm_shuffled -> ratio and gains in percent."""
    gain = lambda a, b: (F.col(a) - F.col(b)) / F.col(b) * 100
    rows = means.withColumn("ratio", F.col("cluster") / F.col("llm") * 100).withColumn("cluster_gain", gain("cluster", "cluster_shuffled")).withColumn("llm_gain", gain("llm", "llm_shuffled"))
    return rows.withColumn("gain_ratio", F.col("cluster_gain") / F.col("llm_gain") * 100)


def percent_of_total(rows: DataFrame, by: str, value: str) -> DataFrame:
    """With percent of the group's total."""
    return rows.withColumn("percent", F.col(value) * 100 / F.sum(value).over(Window.partitionBy(by)))
