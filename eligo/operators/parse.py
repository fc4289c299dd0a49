"""Criteria paragraphs to single criteria with category and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eligo.functions import phrases as P

# Forms whose period does not end a sentence, and words that a period may follow inside a sentence.
PROTECTED = [("e.g.", "e_g_"), ("i.e.", "i_e_"), ("etc.", "etc_")]
ABBREVIATIONS = ["Dr", "vs", "Fig", "approx"]
MARK = "\u0001"
QUOTED = r"\([^)]*\)|\[[^\]]*\]|\"[^\"]*\"|\*[^*]*\*|'[^']*'"


def split_paragraphs(trials: DataFrame) -> DataFrame:
    """(ct_path, criteria_str) -> ct_path, pos, paragraph: lines that are not blank, in order."""
    lines = F.filter(F.transform(F.split("criteria_str", "\n", -1), P.strip), lambda x: x != "")
    return trials.select("ct_path", F.posexplode(lines).alias("pos", "paragraph"))


def _ends_marked(text: Column, blank: str) -> Column:
    """Text with MARK for the space after a sentence's end, and one space for each run of blanks."""
    for long, short in PROTECTED:
        text = F.replace(text, F.lit(long), F.lit(short))
    text = F.regexp_replace(F.regexp_replace(text, r"<br(/| /|/ )?>", " "), blank, " ")
    guard = "".join(rf"(?<!\b{a}\.)" for a in ABBREVIATIONS)
    text = F.regexp_replace(text, rf"([.?!]['\")\]]*){guard} (?=[A-Z0-9(\[])", f"$1{MARK}")
    for long, short in PROTECTED:
        text = F.replace(text, F.lit(short), F.lit(long))
    return text


def _stripped(texts: Column) -> Column:
    return F.filter(F.transform(texts, P.strip), lambda x: x != "")


def sentences_of(text: Column) -> Column:
    """Array of the sentences of a paragraph. A sentence ends at a period, question or exclamation mark
    before a space and a capital, digit or opening bracket, but not after a listed abbreviation."""
    return _stripped(F.split(_ends_marked(text, r"(?U)\s+"), MARK, -1))


def sentences_of_lines(text: Column) -> Column:
    """Array of the sentences of all lines, each line a paragraph: what `sentences_of` gives line by line, in one go over the text."""
    return _stripped(F.split(_ends_marked(text, r"(?U)[^\S\n]+"), f"[\n{MARK}]", -1))


def split_sentences(paragraphs: DataFrame) -> DataFrame:
    """(ct_path, pos, paragraph) -> ct_path, pos (over the trial), sentence."""
    rows = paragraphs.select("ct_path", F.col("pos").alias("p"), F.posexplode(sentences_of(F.col("paragraph"))).alias("s", "sentence"))
    order = Window.partitionBy("ct_path").orderBy("p", "s")
    return rows.select("ct_path", (F.row_number().over(order) - 1).alias("pos"), "sentence")


def found_in(sentence: Column, low: Column) -> Column:
    return P.holds(sentence, low, P.INCLUSION, P.END)


def found_ex(sentence: Column, low: Column) -> Column:
    """`not (be) excluded` is no exclusion."""
    return P.holds(sentence, low, P.EXCLUSION, P.END) & ~P.holds(sentence, low, ["not (be )?excluded"])


def match_category_keys(sentences: DataFrame) -> DataFrame:
    """With found_in and found_ex."""
    low = P.plain_case(F.col("sentence"))
    return sentences.withColumn("found_in", found_in(F.col("sentence"), low)).withColumn("found_ex", found_ex(F.col("sentence"), low))


def title_similarity(sentences: DataFrame) -> DataFrame:
    """With is_title: is the sentence a section title?"""
    return P.with_similarity(sentences, "sentence", P.TITLES, P.TITLE_LEVEL, "is_title")


def carry_category(sentences: DataFrame) -> DataFrame:
    """With category: the sentence's own match (ex before in), or else the carried one, at first `?`.

    Until the first title every match is carried on; from then on only titles are.
    """
    before = Window.partitionBy("ct_path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("found_ex"), "ex").when(F.col("found_in"), "in")
    rows = sentences.withColumn("__own", own).withColumn("__later", F.coalesce(F.max("is_title").over(before), F.lit(False)))
    rows = rows.withColumn("__update", F.when(F.col("is_title") | ~F.col("__later"), F.col("__own")))
    carried = F.coalesce(F.last("__update", ignorenulls=True).over(before), F.lit("?"))
    return rows.withColumn("category", F.coalesce("__own", carried)).drop("__own", "__later", "__update")


def drop_titles(sentences: DataFrame) -> DataFrame:
    """Without title rows; complexity is `easy` where the trial had any."""
    easy = F.max("is_title").over(Window.partitionBy("ct_path"))
    return sentences.withColumn("complexity", F.when(easy, "easy").otherwise("hard")).where(~F.col("is_title"))


def context_pieces(text: Column) -> Column:
    """Text cut around each context key that stands before a colon; the keys are sought in texts with a colon only."""
    keys = "|".join(P.CONTEXT + P.SUBCONTEXT)
    marked = F.when(text.contains(":"), F.regexp_replace(text, f"(?iu)({keys})(?=:)", f"{MARK}$1{MARK}")).otherwise(text)
    return F.split(marked, MARK, -1)


def split_on_context_keys(sentences: DataFrame) -> DataFrame:
    """Rows (…, pos, piece_no, piece) in place of sentence."""
    return sentences.select("*", F.posexplode(context_pieces(F.col("sentence"))).alias("piece_no", "piece")).drop("sentence")


def flag_contexts(pieces: DataFrame) -> DataFrame:
    """With is_context and is_subcontext; pieces with `see ` are neither."""
    seen = F.lower("piece").contains("see ")
    rows = P.with_similarity(pieces, "piece", P.CONTEXT, P.CONTEXT_LEVEL, "is_context")
    rows = P.with_similarity(rows, "piece", P.SUBCONTEXT, P.SUBCONTEXT_LEVEL, "is_subcontext")
    return rows.withColumn("is_context", F.col("is_context") & ~seen).withColumn("is_subcontext", F.col("is_subcontext") & ~seen & ~F.col("is_context"))


def carry_context(pieces: DataFrame) -> DataFrame:
    """Flagged pieces -> criteria with the context and subcontext in force; a new context clears the subcontext."""
    upto = Window.partitionBy("ct_path").orderBy("pos", "piece_no").rowsBetween(Window.unboundedPreceding, 0)
    value = F.btrim("piece", F.lit(":"))
    rows = pieces.withColumn("context", F.coalesce(F.last(F.when(F.col("is_context"), value), ignorenulls=True).over(upto), F.lit("")))
    rows = rows.withColumn("__part", F.sum(F.col("is_context").cast("int")).over(upto))
    inside = Window.partitionBy("ct_path", "__part").orderBy("pos", "piece_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("subcontext", F.coalesce(F.last(F.when(F.col("is_subcontext"), value), ignorenulls=True).over(inside), F.lit("")))
    rows = rows.where(~F.col("is_context") & ~F.col("is_subcontext"))
    return rows.withColumn("text", F.btrim("piece", F.lit("\n\t :"))).drop("piece", "is_context", "is_subcontext", "__part")


def semicolon_parts(text: Column, placeholder: str = "*") -> Column:
    """Parts between semicolons that are not inside brackets or quotes."""
    plain, quoted = F.split(text, QUOTED, -1), F.regexp_extract_all(text, F.lit(QUOTED), F.lit(0))
    hidden = F.zip_with(plain, quoted, lambda a, b: F.concat(a, F.coalesce(F.replace(b, F.lit(";"), F.lit(placeholder)), F.lit(""))))
    whole = F.when(text.contains(";"), F.array_join(hidden, "")).otherwise(text)  # quotes are sought where there is something to hide
    whole = F.when(text.contains("<br>"), F.regexp_replace(whole, r"<br>\d+\)?\s*", "")).otherwise(whole)
    return F.transform(F.split(whole, ";", -1), lambda x: F.btrim(F.replace(x, F.lit(placeholder), F.lit(";")), F.lit("\n; ")))


def split_semicolons(criteria: DataFrame) -> DataFrame:
    """A row (part_no, text) per part."""
    cols = [c for c in criteria.columns if c != "text"]
    return criteria.select(*cols, F.posexplode(semicolon_parts(F.col("text"))).alias("part_no", "text"))


def drop_short(criteria: DataFrame, least: int = 5) -> DataFrame:
    """Without texts under `least` characters."""
    return criteria.where(F.length("text") >= least)


def plain_symbols(text: Column) -> Column:
    """Comparison signs in words, without hyphens and spaces at the ends."""
    text = F.replace(F.replace(text, F.lit("≥"), F.lit("> or equal to")), F.lit("≤"), F.lit("< or equal to"))
    return F.btrim(text, F.lit("- "))


def normalise_symbols(criteria: DataFrame, *order: str) -> DataFrame:
    """With plain text and criterion_idx from 0 per trial in the given order."""
    at = F.row_number().over(Window.partitionBy("ct_path").orderBy(*order)) - 1
    return criteria.withColumn("text", plain_symbols(F.col("text"))).withColumn("criterion_idx", at)


def filled(values: Column, first: str) -> Column:
    """An array with each null as the last value before it, at the beginning as `first`: a run for each value, so that the work is linear. `values` is a plain column, as it is read more than once."""
    at = F.filter(F.transform(values, lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())
    ends = F.slice(F.concat(F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), F.array(F.size(values))), 1, F.size(at))
    runs = F.zip_with(at, ends, lambda i, j: F.array_repeat(F.get(values, i), j - i))
    return F.flatten(F.concat(F.array(F.array_repeat(F.lit(first), F.coalesce(F.get(at, F.lit(0)), F.size(values)))), runs))


def before(values: Column) -> Column:
    """An array moved on by one place, with null at the beginning."""
    return F.when(F.size(values) > 0, F.concat(F.array(F.lit(None).cast("string")), F.slice(values, 1, F.size(values) - 1))).otherwise(values)


def _once(rows: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """Kept and new columns, each worked out once a row: an optimizer that merges selections would else repeat an array's making for each of its uses, also for each of its elements."""
    return rows.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def parse_criteria(trials: DataFrame) -> DataFrame:
    """(ct_path, criteria_str) -> ct_path, criterion_idx, complexity, category, context, subcontext, criterion.

    A trial is one row until its criteria are told: sentences and pieces are arrays, what is carried from one to the next fills runs of an array, so
    nothing is shuffled, sorted or joined. A null text gives no rows. Gives the rows of the single steps above, one after the other.
    """
    rows = _once(trials.where("criteria_str is not null"), "ct_path", sentences=sentences_of_lines(F.col("criteria_str")))
    rows = rows.withColumn("titles", P.similar_in("sentences", [(P.TITLES, P.TITLE_LEVEL)]))
    rows = _once(rows, "ct_path", "sentences", "titles", lows=F.transform("sentences", P.plain_case), title=F.array_position("titles", 1))  # of the first, from 1; 0: none
    own = F.zip_with("sentences", "lows", lambda s, low: F.when(found_ex(s, low), "ex").when(found_in(s, low), "in"))
    rows = _once(rows, "ct_path", "sentences", "titles", "title", own=own)
    on = F.transform("titles", lambda t, i: (t == 1) | (F.col("title") == 0) | (i < F.col("title")))
    rows = _once(rows, "ct_path", "sentences", "titles", "own", "title", carried=F.zip_with("own", on, lambda own, on: F.when(on, own)))
    rows = _once(rows, "ct_path", "sentences", "titles", "own", "title", carried=before(F.col("carried")))
    rows = _once(rows, "ct_path", "sentences", "titles", "title", category=F.zip_with("own", filled(F.col("carried"), "?"), lambda own, last: F.coalesce(own, last)))
    kept = F.filter(F.arrays_zip("sentences", "titles", "category"), lambda s: s.titles == 0)
    pieces = F.flatten(F.transform(kept, lambda s: F.transform(context_pieces(s.sentences), lambda piece: F.struct(piece.alias("piece"), s.category.alias("category")))))
    rows = _once(rows, "ct_path", complexity=F.when(F.col("title") > 0, "easy").otherwise("hard"), pieces=pieces)
    rows = _once(rows, "ct_path", "complexity", "pieces", texts=F.transform("pieces", lambda p: F.when(~F.lower(p.piece).contains("see "), p.piece)))
    rows = rows.withColumn("kinds", P.similar_in("texts", [(P.CONTEXT, P.CONTEXT_LEVEL), (P.SUBCONTEXT, P.SUBCONTEXT_LEVEL)])).drop("texts")
    value = lambda name: F.btrim(name, F.lit(":"))
    contexts = F.zip_with("pieces", "kinds", lambda p, k: F.when(k == 1, value(p.piece)))
    subcontexts = F.zip_with("pieces", "kinds", lambda p, k: F.when(k == 1, "").when(k == 2, value(p.piece)))
    rows = _once(rows, "ct_path", "complexity", "pieces", "kinds", contexts=contexts, subcontexts=subcontexts)
    rows = _once(rows, "ct_path", "complexity", "pieces", "kinds", context=filled(F.col("contexts"), ""), subcontext=filled(F.col("subcontexts"), ""))
    kept = F.filter(F.arrays_zip("pieces", "kinds", "context", "subcontext"), lambda p: p.kinds == 0)
    texts = F.transform(kept, lambda p: F.struct(p.pieces.category.alias("category"), p.context.alias("context"), p.subcontext.alias("subcontext"), F.btrim(p.pieces.piece, F.lit("\n\t :")).alias("text")))
    rows = _once(rows, "ct_path", "complexity", texts=texts)
    named = lambda p: lambda t: F.struct(p.category, p.context, p.subcontext, plain_symbols(t).alias("criterion"))
    parts = F.flatten(F.transform("texts", lambda p: F.transform(F.filter(semicolon_parts(p.text), lambda t: F.length(t) >= 5), named(p))))
    rows = rows.select("ct_path", "complexity", F.posexplode(parts).alias("criterion_idx", "x"))
    return rows.select("ct_path", "criterion_idx", "complexity", "x.category", "x.context", "x.subcontext", "x.criterion")
