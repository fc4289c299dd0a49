"""Fixed values of the criteria rules, and matching with them."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that name exclusion and inclusion sections; each is followed by an optional colon and period.
END = r"\:?\.?"
EXCLUSION = [
    "exclusion criteria", "exclusion criterion", "exclusions?", "excluded", "ineligible", "not eligible", "not allowed", "must not have", "must not be",
    "patients? have no ", "patients? have not ", "patients? had no ", "patients? had not ", "patients? must not ", "no patients?",
]
INCLUSION = [
    "inclusion criteria", "inclusion criterion", "inclusions?", "included", "eligible", "allowed", "must have", "must be", "patients? have ", "patients? had ",
    "had to have", "required", "populations? consisted", "not excluded", "not be excluded",
]
# Context and subcontext headings.
CONTEXT = [
    "prior medications?", "prior treatments?", "concurrent medications?", "weight restrictions?", "social habits?", "medications?", "concurrent treatments?",
    "co-existing conditions?", "risk behaviors?", "prior concurrent therapy", "prior concurrent therapies", "recommended", "medical complications?",
    "obstetrical complications?", "group a", "group b", "part a", "part b", "phase a", "phase b", "phase i", "phase ii", "phase iii", "phase iv", "discouraged",
    "avoid", "patients?", "patient characteristics", "disease characteristics", "elevated psa criteria", "psa criteria", "initial doses?", "additional doses?",
]
SUBCONTEXT = [
    "infants?", "allowed for infants?", "women", "allowed for women", "allowed for pregnant women", "life expectancy", "hematopoietic", "hematologic", "hepatic",
    "renal", "cardiovascular", "cardiac", "pulmonary", "systemic", "biologic therapy", "chemotherapy", "endocrine therapy", "radiotherapy", "surgery", "other",
    "performance status", "age", "sex", "definitive local therapy", "previous hormonal therapy or other treatments?", "other treatments?",
    "previous hormonal therapy", "in either eyes?", "in study eyes?", "one of the following", "body mass index", "bmi", "eligible subtypes?",
    "hormone receptor status", "menopausal status", "at least 1 of the following factors", "serology", "chemistry",
]
TITLES = [k + END for k in INCLUSION + EXCLUSION]
TITLE_LEVEL, CONTEXT_LEVEL, SUBCONTEXT_LEVEL = 0.6, 0.9, 0.8


def alternation(phrases: list[str], end: str = "") -> str:
    """One pattern that finds any of the phrases, whatever their case."""
    return "(?iu)(" + "|".join(p + end for p in phrases) + ")"


def longest(phrases: list[str], level: float) -> int:
    """No text longer than this can be more similar than `level` to a phrase: a ratio is at most 2 min / (sum of lengths)."""
    return int(max(map(len, phrases)) * (2 - level) / level)


def best_ratio(text: str, phrases: list[str]) -> float:
    """Greatest difflib ratio of the lower-cased text to a phrase as written."""
    low = text.lower()
    return max(SequenceMatcher(None, low, p).ratio() for p in phrases)


def similar_to(phrases: list[str], level: float):
    """A test of a batch of lower-cased texts, as an array: is one more similar than `level` to a phrase?

    The ratio is at most what the counts of characters allow; those are compared for the whole batch, and
    the ratio itself is worked out only where they reach the level.
    """
    alphabet = np.array(sorted({ord(c) for p in phrases for c in p}), dtype=np.uint32)

    def counts(texts: list[str]) -> np.ndarray:
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        at = np.searchsorted(alphabet, codes).clip(max=len(alphabet) - 1)
        known = alphabet[at] == codes
        flat = np.bincount(row[known] * len(alphabet) + at[known], minlength=len(texts) * len(alphabet))
        return flat.reshape(len(texts), len(alphabet))

    own = counts(phrases)

    def test(texts: list[str]) -> np.ndarray:
        hit, n, bags = np.zeros(len(texts), dtype=bool), np.array([len(t) for t in texts], dtype=np.int64), counts(texts)
        for p, bag in zip(phrases, own, strict=True):
            m = SequenceMatcher(None, "", p)
            for k in np.flatnonzero(~hit & (2 * np.minimum(bags, bag).sum(axis=1) > level * (n + len(p)) - 1e-9)):
                m.set_seq1(texts[k])
                hit[k] = m.ratio() > level
        return hit

    return test


def with_similarity(df: DataFrame, column: str, phrases: list[str], level: float, name: str) -> DataFrame:
    """df with a boolean `name`: is the text more similar than `level` to a phrase? No rows move.

    Only texts that are short enough to reach the level leave the JVM, and those that a batch repeats are tested once.
    """

    @F.pandas_udf("boolean")
    def similar(s: pd.Series) -> pd.Series:
        texts = s.dropna().unique()
        hits = similar_to(phrases, level)([t.lower() for t in texts])
        return s.isin(texts[hits])

    return df.withColumn(name, similar(F.when(F.length(column) <= longest(phrases, level), F.col(column))))


def similar_in(texts: str | Column, levels: list[tuple[list[str], float]]) -> Column:
    """For an array of texts, an array of whole numbers: 1 where a text is more similar than the level to a phrase of the first list, else 2 of the second, and so on, else 0; 0 for null texts.

    As in `with_similarity`, only short texts leave the JVM.
    """

    @F.pandas_udf("array<int>")
    def similar(s: pd.Series) -> pd.Series:
        texts = sorted({t for row in s for t in row if t is not None})
        kind = dict.fromkeys(texts, 0)
        for k, (phrases, level) in reversed([*enumerate(levels, 1)]):
            for t, hit in zip(texts, similar_to(phrases, level)([t.lower() for t in texts]), strict=True):
                kind[t] = k if hit else kind[t]
        return pd.Series([[0 if t is None else kind[t] for t in row] for row in s])

    most = max(longest(*x) for x in levels)
    return similar(F.transform(texts, lambda t: F.when(F.length(t) <= most, t)))


def stem(phrase: str) -> str:
    """Letters and spaces that a text must hold to match a phrase: its longest run without a pattern sign or an optional letter."""
    runs = re.split(r"[^a-z ]", re.sub(r"\([^)]*\)\??|.\?", "\n", phrase))
    return max(runs, key=len)


def plain_case(text: Column) -> Column:
    """Lower case, with ſ, ı, İ and the Kelvin sign as the letters that they are to a pattern that takes no notice of case."""
    for letter, plain in zip("ſıİ\u212a", "siik", strict=True):
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.lower(text)


def holds(text: Column, low: Column, phrases: list[str], end: str = "") -> Column:
    """Does the text hold one of the phrases, whatever their case? `low` is its `plain_case`. Texts without any phrase's stem, nearly all, are told by plain searches, and only the others by the pattern."""
    needed = {stem(p) for p in phrases}
    needed = sorted(x for x in needed if not any(y != x and y in x for y in needed))
    some = low.contains(needed[0])
    for x in needed[1:]:
        some = some | low.contains(x)
    return F.when(some, text.rlike(alternation(phrases, end))).when(text.isNotNull(), False)


def strip(text: Column) -> Column:
    """Without white space at either end; the pattern goes over texts that have some there only."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)
