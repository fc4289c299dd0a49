"""Queries of the criteria parser."""

from pyspark.sql import functions as F

from eligo.functions import phrases as P
from eligo.operators import parse
from eligo.plans.fixtures import VIEWS
from eligo.queries import query

# whole texts behind a lead that makes a line too long for a title or heading, so that what is one is plain SQL here
LEAD = "'What follows is written just as it stood at the place from which it came, word for word, '"
assert len(LEAD) - 2 > max(P.longest(P.TITLES, P.TITLE_LEVEL), P.longest(P.CONTEXT, P.CONTEXT_LEVEL), P.longest(P.SUBCONTEXT, P.SUBCONTEXT_LEVEL))
TRIAL, TEXT = "concat('NCT', cast(doc_id AS string)) AS ct_path", "replace(coalesce(text, ''), chr(10), ' ')"
VIEWS["fx_titled"] = f"""
SELECT ct_path, pos, sentence, sentence IN ('Inclusion Criteria:', 'Exclusion Criteria:') AS is_title FROM (
  SELECT {TRIAL}, 0 AS pos, CASE WHEN doc_id % 3 <> 0 THEN 'Inclusion Criteria:' ELSE concat({LEAD}, lang) END AS sentence FROM {{documents}}
  UNION ALL SELECT {TRIAL}, 1, concat({LEAD}, {TEXT}) FROM {{documents}}
  UNION ALL SELECT {TRIAL}, 2, concat({LEAD}, CASE WHEN doc_id % 5 = 0 THEN 'This person must not have ' ELSE 'Seen at ' END, source) FROM {{documents}}
  UNION ALL SELECT {TRIAL}, 3, CASE WHEN doc_id % 2 = 0 THEN 'Exclusion Criteria:' ELSE concat({LEAD}, source) END FROM {{documents}}
  UNION ALL SELECT {TRIAL}, 4, concat({LEAD}, CASE WHEN doc_id % 7 = 0 THEN 'Those are not excluded that ' ELSE 'As before ' END, {TEXT}) FROM {{documents}}) t"""
VIEWS["fx_context"] = f"""
SELECT {TRIAL}, cast(doc_id % 4 AS int) AS pos,
  concat(CASE WHEN doc_id % 3 = 0 THEN 'Patient characteristics:' ELSE '' END, {LEAD}, {TEXT}, ' age: ', {LEAD}, coalesce(source, ''),
    CASE WHEN doc_id % 2 = 0 THEN ' Renal:' ELSE ' see renal' END, {LEAD}, coalesce(lang, '')) AS sentence
FROM {{documents}}"""
VIEWS["fx_semicolons"] = f"""
SELECT {TRIAL},
  concat(replace({TEXT}, '. ', '; '), ' (a; b) "c; d" *', coalesce(source, ''), '; ', CAST(doc_id AS string), '* >= 5; - ≥ 3 - ; x') AS text
FROM {{documents}}"""

IN_KEYS, EX_KEYS = ("|".join(k + P.END for k in keys).replace("\\:", ":") for keys in (P.INCLUSION, P.EXCLUSION))
FLAGS = f"""regexp_matches(sentence, '(?i)({IN_KEYS})') AS found_in,
  regexp_matches(sentence, '(?i)({EX_KEYS})') AND NOT regexp_matches(sentence, '(?i)not (be )?excluded') AS found_ex"""


def _trials(v):
    return v("documents").select(F.concat(F.lit("NCT"), F.col("doc_id").cast("string")).alias("ct_path"), F.col("text").alias("criteria_str"))


LINES = r"""SELECT 'NCT' || doc_id AS ct_path, unnest(lines) AS paragraph, generate_subscripts(lines, 1) - 1 AS pos FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines FROM documents)"""


@query(f"SELECT ct_path, pos::INT AS pos, paragraph FROM ({LINES})")
def c1_split_paragraphs(v):
    return parse.split_paragraphs(_trials(v))


@query(rf"""
WITH p AS ({LINES}),
s AS (SELECT ct_path, pos, string_split(replace(replace(replace(regexp_replace(regexp_replace(replace(replace(replace(paragraph, 'e.g.', 'e_g_'), 'i.e.', 'i_e_'), 'etc.', 'etc_'),
    '\s+', ' ', 'g'), '([.?!][''")\]]*) ([A-Z0-9(\[])', '\1' || chr(1) || '\2', 'g'), 'e_g_', 'e.g.'), 'i_e_', 'i.e.'), 'etc_', 'etc.'), chr(1)) AS parts FROM p),
e AS (SELECT ct_path, pos AS p, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS k FROM s)
SELECT ct_path, (row_number() OVER (PARTITION BY ct_path ORDER BY p, k) - 1)::INT AS pos, trim(sentence) AS sentence FROM e WHERE trim(sentence) <> ''""")
def c2_split_sentences(v):
    return parse.split_sentences(parse.split_paragraphs(_trials(v)))


@query(f"SELECT ct_path, pos, {FLAGS} FROM {{fx_titled}}")
def c3_match_category_keys(v):
    return parse.match_category_keys(v("fx_titled")).select("ct_path", "pos", "found_in", "found_ex")


@query("SELECT ct_path, pos, is_title FROM {fx_titled}")
def c4_title_similarity(v):
    return parse.title_similarity(v("fx_titled").drop("is_title")).select("ct_path", "pos", "is_title")


CARRIED = f"""
WITH f AS (SELECT *, {FLAGS} FROM {{fx_titled}}),
o AS (SELECT *, CASE WHEN found_ex THEN 'ex' WHEN found_in THEN 'in' END AS own,
  coalesce(max(is_title::INT) OVER (PARTITION BY ct_path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM f),
c AS (SELECT *, coalesce(own, last_value(CASE WHEN is_title OR later = 0 THEN own END IGNORE NULLS)
  OVER (PARTITION BY ct_path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '?') AS category FROM o)"""


@query(CARRIED + " SELECT ct_path, pos, category FROM c")
def c5_carry_category(v):
    return parse.carry_category(parse.match_category_keys(v("fx_titled"))).select("ct_path", "pos", "category")


@query(CARRIED + ", d AS (SELECT *, CASE WHEN max(is_title) OVER (PARTITION BY ct_path) THEN 'easy' ELSE 'hard' END AS complexity FROM c) SELECT ct_path, pos, category, complexity FROM d WHERE NOT is_title")
def c6_drop_titles(v):
    return parse.drop_titles(parse.carry_category(parse.match_category_keys(v("fx_titled")))).select("ct_path", "pos", "category", "complexity")


PIECES = f"""
WITH p AS (SELECT ct_path, pos, string_split(regexp_replace(sentence, '(?i)({"|".join(P.CONTEXT + P.SUBCONTEXT)}):', chr(1) || '\\1' || chr(1) || ':', 'g'), chr(1)) AS parts FROM {{fx_context}}),
e AS (SELECT ct_path, pos, unnest(parts) AS piece, generate_subscripts(parts, 1)::INT - 1 AS piece_no FROM p)"""


@query(PIECES + " SELECT * FROM e")
def c7_split_on_context_keys(v):
    return parse.split_on_context_keys(v("fx_context"))


@query(
    PIECES
    + """, g AS (SELECT *, lower(piece) = 'patient characteristics' AS is_c, lower(piece) IN ('age', 'renal') AS is_s FROM e),
h AS (SELECT *, coalesce(last_value(CASE WHEN is_c THEN piece END IGNORE NULLS) OVER w, '') AS context, sum(is_c::INT) OVER w AS part FROM g WINDOW w AS (PARTITION BY ct_path ORDER BY pos, piece_no)),
i AS (SELECT *, coalesce(last_value(CASE WHEN is_s THEN piece END IGNORE NULLS) OVER (PARTITION BY ct_path, part ORDER BY pos, piece_no), '') AS subcontext FROM h)
SELECT ct_path, pos, piece_no, context, subcontext, trim(piece, chr(10) || chr(9) || ' :') AS text FROM i WHERE NOT is_c AND NOT is_s"""
)
def c8_carry_context(v):
    return parse.carry_context(parse.flag_contexts(parse.split_on_context_keys(v("fx_context"))))


QUOTES = r"""\([^)]*\)|\[[^\]]*\]|"[^"]*"|\*[^*]*\*|''[^'']*''"""
PARTS = rf"""
WITH q AS (SELECT ct_path, string_split(regexp_replace(text, '({QUOTES})', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS x FROM {{fx_semicolons}}),
h AS (SELECT ct_path, array_to_string(list_transform(x, lambda y, i: CASE WHEN i % 2 = 0 THEN replace(y, ';', '*') ELSE y END), '') AS hidden FROM q),
s AS (SELECT ct_path, string_split(regexp_replace(hidden, '<br>\d+\)?\s*', '', 'g'), ';') AS parts FROM h),
e AS (SELECT ct_path, generate_subscripts(parts, 1)::INT - 1 AS part_no, unnest(list_transform(parts, lambda y: trim(replace(y, '*', ';'), chr(10) || '; '))) AS text FROM s)"""


@query(PARTS + " SELECT * FROM e")
def c9_split_semicolons(v):
    return parse.split_semicolons(v("fx_semicolons"))


@query(PARTS + " SELECT * FROM e WHERE length(text) >= 5")
def c10_drop_short(v):
    return parse.drop_short(parse.split_semicolons(v("fx_semicolons")))


@query(PARTS + ", n AS (SELECT *, trim(replace(replace(text, '≥', '> or equal to'), '≤', '< or equal to'), '- ') AS t FROM e) SELECT ct_path, part_no, t AS text, (row_number() OVER (PARTITION BY ct_path ORDER BY part_no) - 1)::INT AS criterion_idx FROM n")
def c11_normalise_symbols(v):
    return parse.normalise_symbols(parse.split_semicolons(v("fx_semicolons")), "part_no")


@query()
def c12_parse_criteria(v):
    """Whole documents, with a title before the first line and another in their middle for some ids."""
    lines = F.split("text", "\n", -1)
    half = F.ceil(F.size(lines) / 2).cast("int")
    titles = [F.when(F.col("doc_id") % k != 0, F.array(F.lit(t))).otherwise(F.array().cast("array<string>")) for k, t in ((3, "Inclusion Criteria:"), (2, "Exclusion Criteria:"))]
    whole = F.concat(titles[0], F.slice(lines, 1, half), titles[1], F.slice(lines, half + 1, F.size(lines)))
    return parse.parse_criteria(v("documents").select(F.concat(F.lit("NCT"), F.col("doc_id").cast("string")).alias("ct_path"), F.array_join(whole, "\n").alias("criteria_str")))
