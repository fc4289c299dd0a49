"""Queries of the corpus filters, sources and sinks."""

from pyspark.sql import functions as F

from eligo.operators import corpus, trials
from eligo.operators import clusters as K
from eligo.plans.fixtures import VIEWS
from eligo.queries import query
from eligo.sources import criteria as C
from eligo.sources.tables import fresh_path

J = lambda c: F.array_join(c, "|")
CHOICE = corpus.Choice(phases=["phase1", "phase2"], statuses=["completed"], categories=["in", "ex"], condition_prefixes=["C1", "C2"], condition_level=2)

VIEWS["fx_sheet"] = """
SELECT ct_path AS trialid, label AS recruitmentStatusNorm, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'Phase 1; Phase 2' END AS phaseNorm,
  concat('D', lpad(cast(1 + o_orderkey % 500 AS string), 6, '0'), '; Drug: D', lpad(cast(1 + o_orderkey % 300 AS string), 6, '0')) AS conditions,
  'Drug: x; Device: y' AS interventions, criteria_str AS inclusionCriteriaNorm, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'none' END AS exclusionCriteriaNorm
FROM {fx_trials}"""
VIEWS["fx_parsed"] = """
SELECT ct_path, criterion_idx, label, phases, conditions, category, criterion, concat('paragraph of ', ct_path) AS criteria_str, 'easy' AS complexity,
  concat('[[''C', cast(l_partkey AS string), ''', ''C1''], [''D', cast(l_suppkey AS string), ''']]') AS condition_ids, '[]' AS intervention_ids
FROM {fx_criteria}"""


@query("""
WITH e AS (SELECT trialid, unnest(c) AS id, generate_subscripts(c, 1) AS pos FROM (SELECT trialid, list_transform(string_split(conditions, '; '), lambda x: replace(x, 'Drug: ', '')) AS c FROM {fx_sheet})),
m AS (SELECT trialid, string_agg(array_to_string(coalesce(a.tree_numbers, b.tree_numbers), '|'), ';' ORDER BY pos) FILTER (WHERE coalesce(a.tree_numbers, b.tree_numbers) IS NOT NULL) AS t FROM e
  LEFT JOIN {fx_crosswalk} a ON a.key = CASE WHEN instr(id, '000') > 0 THEN substr(id, 1, instr(id, '000') - 1) || substr(id, instr(id, '000') + 3) ELSE id END
  LEFT JOIN {fx_crosswalk} b ON b.key = e.id GROUP BY trialid)
SELECT s.trialid AS ct_path, replace(coalesce(phaseNorm, ''), '; ', '|') AS phases, coalesce(inclusionCriteriaNorm, '') || chr(10) || chr(10) || coalesce(exclusionCriteriaNorm, '') AS criteria_str, coalesce(t, '') AS condition_ids
FROM {fx_sheet} s LEFT JOIN m USING (trialid)""")
def s3_read_trials_sheet(v):
    rows = C.read_trials_sheet(v("fx_sheet"), v("fx_crosswalk"))
    return rows.select("ct_path", J("phases").alias("phases"), "criteria_str", F.array_join(F.transform("condition_ids", J), ";").alias("condition_ids"))


@query("SELECT doc_id::VARCHAR AS ct_path, source AS label, lang AS condition_ids, '' AS category, trim(text, ' ') AS criterion FROM documents")
def s4_read_labelled_sentences(v):
    named = v("documents").select(F.col("doc_id").cast("string").alias("trialid"), F.col("source").alias("cluster"), F.col("text").alias("sentence"), F.col("lang").alias("sentence_preprocessed"))
    return C.read_labelled_sentences(named).select("ct_path", "label", J(F.flatten("condition_ids")).alias("condition_ids"), "category", "criterion")


@query("SELECT ct_path, criterion_idx, 'C' || l_partkey || '|C1|D' || l_suppkey AS condition_ids, '' AS intervention_ids FROM {fx_criteria}")
def s5_read_parsed_criteria(v):
    rows = C.read_parsed_criteria(v("fx_parsed"))
    return rows.select("ct_path", "criterion_idx", J("condition_ids").alias("condition_ids"), J("intervention_ids").alias("intervention_ids"))


@query("SELECT ct_path, criterion_idx, CASE WHEN criterion_idx = 0 THEN 'paragraph of ' || ct_path ELSE '' END AS criteria_str, CASE WHEN criterion_idx = 0 THEN 'easy' ELSE '' END AS complexity FROM {fx_criteria}")
def s6_write_parsed_criteria(v):
    rows = v("fx_parsed")
    path = _scratch(rows, "parsed")
    C.write_parsed_criteria(rows, path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select("ct_path", "criterion_idx", "criteria_str", "complexity")


@query("""
WITH done AS (SELECT ct_path FROM {fx_trials} WHERE o_orderkey % 3 = 0)
SELECT ct_path, label FROM {fx_trials} WHERE o_orderkey % 3 = 0
UNION ALL (SELECT ct_path, label FROM {fx_trials} WHERE ct_path NOT IN (SELECT ct_path FROM done) ORDER BY ct_path LIMIT (SELECT greatest(0, 9000 - count(*)) FROM done))""")
def s11_append_new(v):
    """One run with a third of the trials, and a second one with all, to 9,000 in total."""
    rows = v("fx_trials").select("ct_path", "label", "o_orderkey")
    path = _scratch(rows, "results")
    C.append_new(rows.where("o_orderkey % 3 = 0").drop("o_orderkey"), path, "ct_path", 10**12)
    return C.append_new(rows.drop("o_orderkey"), path, "ct_path", 9000)


FILTERED = """
SELECT c.* FROM {fx_criteria} c WHERE (list_contains(phases, 'phase1') OR list_contains(phases, 'phase2')) AND label = 'COMPLETED' AND category IN ('in', 'ex')
  AND EXISTS (SELECT 1 FROM {fx_mesh_labels} m WHERE m.tree_number = substr(c.condition_ids[1], 1, 7) AND (c.condition_ids[1] LIKE 'C1%' OR c.condition_ids[1] LIKE 'C2%')
    AND length(regexp_replace(m.label, '[^0-9]', '', 'g')) + 1 <> length(m.label))"""


@query(f"SELECT ct_path, criterion_idx, criterion FROM ({FILTERED})")
def f1_filter_corpus(v):
    return corpus.filter_corpus(v("fx_criteria"), CHOICE, v("fx_mesh_labels")).select("ct_path", "criterion_idx", "criterion")


@query("SELECT ct_path, criterion_idx FROM {fx_criteria} WHERE label <> 'RECRUITING' AND category <> '?'")
def f2_exclude_values(v):
    return corpus.exclude_values(v("fx_criteria"), {"label": "RECRUITING", "category": "?"}).select("ct_path", "criterion_idx")


@query("""SELECT ct_path, criterion_idx, array_to_string(list_sort(phases), ' - ') || ' --- ' || array_to_string(list_sort(conditions), ' - ') || ' --- ' || array_to_string(list_sort(intervention_ids), ' - ') AS combo FROM {fx_criteria}""")
def f3_combo_label(v):
    return v("fx_criteria").select("ct_path", "criterion_idx", corpus.combo_label(F.col("phases"), F.col("conditions"), F.col("intervention_ids")).alias("combo"))


TEXT = "lower(CASE WHEN category <> '?' THEN category || 'clusion criterion - ' || criterion ELSE criterion END)"


def _texts(v):
    return v("fx_criteria").withColumn("input_text", corpus.build_input_text(F.col("category"), F.col("criterion")))


@query(f"SELECT ct_path, criterion_idx, {TEXT} AS input_text FROM {{fx_criteria}}")
def f4_build_input_text(v):
    return _texts(v).select("ct_path", "criterion_idx", "input_text")


@query(f"SELECT ct_path, criterion_idx, input_text FROM (SELECT *, {TEXT} AS input_text FROM {{fx_criteria}}) QUALIFY row_number() OVER (PARTITION BY input_text ORDER BY ct_path, criterion_idx) = 1")
def f5_dedup_first(v):
    return corpus.dedup_first(_texts(v)).select("ct_path", "criterion_idx", "input_text")


@query("SELECT ct_path, criterion_idx, criterion FROM {fx_criteria} ORDER BY ct_path, criterion_idx LIMIT 5000")
def f6_cap_samples(v):
    return corpus.cap_samples(v("fx_criteria"), 5000).select("ct_path", "criterion_idx", "criterion")


VIEWS["fx_settings"] = """
SELECT concat(phase, '/', prefix) AS config_id, phase, prefix FROM (
  SELECT DISTINCT concat('phase', substr(o_orderpriority, 1, 1)) AS phase FROM {orders}) a CROSS JOIN (SELECT DISTINCT substr(tree_number, 1, 2) AS prefix FROM {fx_tree}) b"""


@query(f"""
SELECT config_id, input_text, ct_path, criterion_idx FROM (SELECT c.*, s.config_id, {TEXT} AS input_text FROM {{fx_criteria}} c JOIN {{fx_settings}} s ON list_contains(c.phases, s.phase)
  AND starts_with(c.condition_ids[1], s.prefix)) QUALIFY row_number() OVER (PARTITION BY config_id, input_text ORDER BY ct_path, criterion_idx) = 1""")
def f7_sweep_corpus(v):
    return corpus.sweep_corpus(v("fx_criteria"), v("fx_settings"))


@query("SELECT conditions[1] AS condition, count(DISTINCT ct_path) AS n_trials, count(*) AS n_criteria, count(DISTINCT cluster_id) AS n_clusters FROM {fx_criteria} GROUP BY 1")
def f8_corpus_summary(v):
    return corpus.corpus_summary(v("fx_criteria").withColumn("condition", F.element_at("conditions", 1)), "condition")


@query("""
WITH chosen AS (SELECT ct_path FROM {fx_trials} WHERE lower(label) IN ('completed', 'terminated') AND lower(study_type) = 'interventional' AND phases IS NOT NULL AND criteria_str IS NOT NULL
  AND conditions IS NOT NULL AND len(list_filter(intervention_types, lambda x: lower(x) = 'drug')) > 0),
kept AS (SELECT ct_path, cluster_id FROM (SELECT c.*, """ + TEXT + """ AS input_text FROM {fx_criteria} c JOIN chosen USING (ct_path)
    WHERE EXISTS (SELECT 1 FROM {fx_mesh_labels} m WHERE m.tree_number = substr(c.condition_ids[1], 1, 7) AND length(regexp_replace(m.label, '[^0-9]', '', 'g')) + 1 <> length(m.label)))
  QUALIFY row_number() OVER (PARTITION BY input_text ORDER BY ct_path, criterion_idx) = 1)
SELECT cluster_id, count(*) AS n_samples, round(count(DISTINCT ct_path) / (SELECT count(DISTINCT ct_path) FROM kept), 6) AS prevalence FROM kept GROUP BY cluster_id
ORDER BY cluster_id = -1, prevalence DESC, cluster_id LIMIT 20""")
def entry_prevalent_clusters(v):
    chosen = trials.filter_trials(v("fx_trials")).select("ct_path")
    rows = corpus.filter_corpus(v("fx_criteria").join(chosen, "ct_path", "left_semi"), corpus.Choice(condition_level=2), v("fx_mesh_labels"))
    rows = corpus.dedup_first(rows.withColumn("input_text", corpus.build_input_text(F.col("category"), F.col("criterion"))))
    return K.order_clusters(K.cluster_prevalence(rows), by="prevalence", k=20).select("cluster_id", "n_samples", F.round("prevalence", 6).alias("prevalence"))


def _scratch(df, name):
    """A new path in the shared folder."""
    return fresh_path(df.sparkSession, name)


@query("SELECT member_id, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM {fx_vectors}")
def s7_write_embeddings(v):
    rows = v("fx_vectors").select("member_id", "embedding")
    path = _scratch(rows, "embeddings")
    C.write_embeddings(rows, path, "one")
    back = C.read_embeddings(rows.sparkSession, path, "one")
    return back.select("member_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query("SELECT cluster_id, count(*) AS n, min(ct_path) AS first FROM {fx_criteria} GROUP BY cluster_id")
def s9_write_cluster_json(v):
    rows = v("fx_criteria").groupBy("cluster_id").agg(F.struct(F.count("*").alias("n"), F.min("ct_path").alias("first")).alias("size"))
    path = _scratch(rows, "clusters")
    C.write_cluster_json(rows, path)
    return rows.sparkSession.read.schema("cluster_id int, size struct<n: bigint, first: string>").json(path).select("cluster_id", "size.n", "size.first")


# a supplier as a trial record, in either layout of field names
VIEWS["fx_records"] = """
SELECT concat('NCT', cast(s_suppkey AS string)) AS ct_path, s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'COMPLETED' ELSE 'WITHDRAWN' END AS status, s_name AS criteria FROM {supplier}"""


def _json(rows):
    """ct_path, record: the record as JSON text."""
    part = lambda name, c: F.struct(c.alias(name))
    modules = lambda *n: F.struct(part(n[1], F.col("ct_path")).alias(n[0]), part(n[3], F.col("status")).alias(n[2]), part(n[5], F.col("criteria")).alias(n[4]))
    new = part("protocolSection", modules("identificationModule", "nctId", "statusModule", "overallStatus", "eligibilityModule", "eligibilityCriteria"))
    old = part("ProtocolSection", modules("IdentificationModule", "NctId", "StatusModule", "OverallStatus", "EligibilityModule", "EligibilityCriteria"))
    return rows.select("ct_path", F.when(F.col("s_suppkey") % 2 == 0, F.to_json(new)).otherwise(F.to_json(old)).alias("record"))


@query("SELECT ct_path AS folder, ct_path, status FROM {fx_records}")
def s1_read_trials_json(v):
    """A file for each record, in a folder of its own."""
    rows = _json(v("fx_records"))
    path = _scratch(rows, "trials")
    files = rows.select(F.col("ct_path").alias("folder"), "record").repartition("folder")
    for k in ("protocolSection", "ProtocolSection"):
        section = F.try_variant_get(F.parse_json("record"), f"$.{k}", "variant")
        files.select("folder", section.alias(k)).where(F.col(k).isNotNull()).write.mode("append").partitionBy("folder").json(path)
    got = C.read_trials_json(rows.sparkSession, path)
    field = lambda *p: C.trial_field("doc", *p)
    return got.select(F.regexp_extract("path", "folder=([^/]*)", 1).alias("folder"), field("protocolSection.identificationModule.nctId").alias("ct_path"), field("protocolSection.statusModule.overallStatus").alias("status"))


@query("SELECT ct_path, status, criteria, status AS second, NULL::VARCHAR AS absent FROM {fx_records}")
def s2_trial_field(v):
    rows = _json(v("fx_records")).withColumn("doc", F.try_parse_json("record"))
    status = "protocolSection.statusModule.overallStatus"
    names = {"status": [status], "criteria": ["protocolSection.eligibilityModule.eligibilityCriteria"], "second": ["protocolSection.nothing", status], "absent": ["protocolSection.nothing"]}
    return rows.select("ct_path", *[C.trial_field("doc", *p).alias(n) for n, p in names.items()])


@query("""
SELECT 'T' || p_type AS target, 'B' || substr(p_brand, 7) AS input_type, 'phase ' || length(p_brand) AS phases, round(avg(p_size), 4) AS macro_f1
FROM {part} GROUP BY p_type, p_brand""")
def s14_read_result_csvs(v):
    """A report for each type and brand, in a folder that names them."""
    rows = v("part").groupBy(F.col("p_type").alias("m"), F.substring("p_brand", 7, 99).alias("b"), F.length("p_brand").alias("k")).agg(F.round(F.avg("p_size"), 4).alias("f1-score"))
    report = F.concat(F.lit("TT"), "m", F.lit("-IB"), "b", F.lit("-Pphase "), "k", F.lit(".csv"))
    path = _scratch(rows, "reports")
    lines = rows.select(report.alias("report"), F.explode(F.array(F.lit("0"), F.lit("macro avg"))).alias("class"), "`f1-score`")
    lines.repartition("report").write.partitionBy("report").csv(path, header=True)
    return C.read_result_csvs(rows.sparkSession, path).select("target", "input_type", F.replace("phases", F.lit("%20"), F.lit(" ")).alias("phases"), "macro_f1")


@query("SELECT label, count(*) AS support FROM {fx_trials} GROUP BY label")
def s10_write_report(v):
    rows = v("fx_trials").groupBy("label").agg(F.count("*").alias("support"))
    path = _scratch(rows, "report")
    C.write_report(rows, path)
    return rows.sparkSession.read.schema("label string, support long").csv(path, header=True)


@query("SELECT descriptor_id, descriptor_name, array_to_string(tree_numbers, '|') AS tree_numbers FROM {fx_descriptors}")
def s13_read_mesh_xml(v):
    rows = v("fx_descriptors").select(F.col("descriptor_id").alias("DescriptorUI"), F.struct(F.col("descriptor_name").alias("String")).alias("DescriptorName"), F.struct(F.col("tree_numbers").alias("TreeNumber")).alias("TreeNumberList"))
    path = _scratch(rows, "mesh")
    rows.write.format("xml").option("rowTag", "DescriptorRecord").option("rootTag", "DescriptorRecordSet").save(path)
    return C.read_mesh_xml(rows.sparkSession, path).select("descriptor_id", "descriptor_name", J("tree_numbers").alias("tree_numbers"))


@query("""
SELECT ct_path, label, array_to_string(phases, '|') AS phases, CASE WHEN phases IS NOT NULL AND criteria_str IS NOT NULL AND conditions IS NOT NULL AND lower(label) IN ('completed', 'terminated')
  AND lower(study_type) = 'interventional' AND len(list_filter(intervention_types, lambda x: lower(x) = 'drug')) > 0 THEN 1 ELSE 0 END AS kept FROM {fx_trials}""")
def t4_project_trials(v):
    """Records as JSON text of either layout, read back field by field."""
    t = v("fx_trials")
    part = lambda **f: F.struct(*[c.alias(n) for n, c in f.items()])
    kinds = F.transform("intervention_types", lambda x: part(type=x))
    new = part(protocolSection=part(
        identificationModule=part(nctId=F.col("ct_path")), statusModule=part(overallStatus=F.col("label")), designModule=part(studyType=F.col("study_type"), phases=F.col("phases")),
        armsInterventionsModule=part(interventions=kinds), conditionsModule=part(conditions=F.col("conditions")), eligibilityModule=part(eligibilityCriteria=F.col("criteria_str"))))
    old = part(ProtocolSection=part(
        IdentificationModule=part(NctId=F.col("ct_path")), StatusModule=part(OverallStatus=F.col("label")), DesignModule=part(StudyType=F.col("study_type"), PhaseList=part(Phase=F.col("phases"))),
        ArmsInterventionsModule=part(InterventionList=part(Intervention=F.transform("intervention_types", lambda x: part(InterventionType=x)))),
        ConditionsModule=part(ConditionList=part(Condition=F.col("conditions"))), EligibilityModule=part(EligibilityCriteria=F.col("criteria_str"))))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.to_json(new)).otherwise(F.to_json(old))
    raw = t.select(F.col("ct_path").alias("path"), F.try_parse_json(text).alias("doc"))
    rows = C.project_trials(raw)
    kept = trials.filter_trials(rows).select("path", F.lit(1).alias("kept"))
    return rows.join(kept, "path", "left").select(F.col("nct_id").alias("ct_path"), "label", J("phases").alias("phases"), F.coalesce("kept", F.lit(0)).alias("kept"))
