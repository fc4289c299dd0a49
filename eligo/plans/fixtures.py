"""Domain tables made from the driver's tables, in SQL that Spark and DuckDB both run.

ARR( and ALL( stand for each engine's array constructor and ordered collection.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from eligo.sources import table

VIEWS = {
    "fx_trials": """
SELECT concat('NCT', lpad(cast(o_orderkey AS string), 8, '0')) AS ct_path, o_orderkey,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'TERMINATED' ELSE 'RECRUITING' END AS label,
  CASE WHEN o_orderkey % 20 = 0 THEN 'OBSERVATIONAL' ELSE 'INTERVENTIONAL' END AS study_type,
  CASE WHEN o_orderkey % 5 = 0 THEN ARR('DEVICE') WHEN o_orderkey % 3 = 0 THEN ARR('BEHAVIORAL', 'Drug') ELSE ARR('DRUG') END AS intervention_types,
  CASE WHEN substr(o_orderpriority, 1, 1) = '5' THEN NULL
    WHEN o_orderkey % 7 = 0 THEN ARR(concat('PHASE ', substr(o_orderpriority, 1, 1)), 'Phase 4')
    ELSE ARR(concat('PHASE ', substr(o_orderpriority, 1, 1))) END AS phases,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('Criteria of ', cast(o_custkey AS string)) END AS criteria_str,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE ARR(concat('condition ', cast(o_custkey % 10 AS string))) END AS conditions
FROM {orders}""",
    "fx_descriptors": """
SELECT concat('D', lpad(cast(p_partkey AS string), 6, '0')) AS descriptor_id,
  concat(p_name, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE concat(' ', cast(p_partkey AS string)) END) AS descriptor_name, p_partkey AS position,
  CASE WHEN p_partkey % 3 = 0 THEN ARR(
      concat('C', lpad(replace(p_brand, 'Brand#', ''), 2, '0'), '.', cast(100 + p_size AS string), '.', cast(100 + p_partkey % 7 AS string)),
      concat('C', cast(1 + p_partkey % 25 AS string), '.', cast(200 + p_size AS string)))
    ELSE ARR(concat('C', lpad(replace(p_brand, 'Brand#', ''), 2, '0'), '.', cast(100 + p_size AS string), '.', cast(100 + p_partkey % 7 AS string))) END AS tree_numbers
FROM {part}""",
    "fx_crosswalk": "SELECT descriptor_id AS key, tree_numbers FROM {fx_descriptors}",
    "fx_tree": "SELECT DISTINCT tree_number FROM (SELECT EXPLODE(tree_numbers) AS tree_number FROM {fx_descriptors}) t",
    "fx_mesh_labels": """
SELECT DISTINCT tree_number, CASE WHEN cast(substr(tree_number, 2, 2) AS int) % 10 = 0 THEN concat('D0', substr(tree_number, 2, 2)) ELSE concat('heading ', tree_number) END AS label
FROM (SELECT substr(tree_number, 1, 3) AS tree_number FROM {fx_tree} UNION ALL SELECT substr(tree_number, 1, 7) FROM {fx_tree}
  UNION ALL SELECT tree_number FROM {fx_tree}) t WHERE tree_number LIKE 'C__%' AND substr(tree_number, 3, 1) <> '.'""",
    "fx_trial_ids": """
SELECT concat('NCT', lpad(cast(l_orderkey AS string), 8, '0')) AS ct_path, ALL(id) AS ids
FROM (SELECT DISTINCT l_orderkey, CASE WHEN l_partkey % 4 = 0 THEN concat('D000', lpad(cast(l_partkey AS string), 6, '0'))
    WHEN l_partkey % 31 = 0 THEN concat('X', cast(l_partkey AS string)) ELSE concat('D', lpad(cast(l_partkey AS string), 6, '0')) END AS id FROM {lineitem}) t
GROUP BY l_orderkey""",
    "fx_criteria": """
SELECT concat('NCT', lpad(cast(l_orderkey AS string), 8, '0')) AS ct_path, l_orderkey,
  cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS int) AS criterion_idx,
  CASE l_returnflag WHEN 'A' THEN 'in' WHEN 'R' THEN 'ex' ELSE '?' END AS category,
  concat(p_name, ' ', p_type, ' level ', cast(cast(l_quantity AS bigint) % 10 AS string)) AS criterion,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'TERMINATED' ELSE 'RECRUITING' END AS label,
  CASE WHEN o_orderkey % 7 = 0 THEN ARR(concat('phase', substr(o_orderpriority, 1, 1)), 'phase4') ELSE ARR(concat('phase', substr(o_orderpriority, 1, 1))) END AS phases,
  ARR(concat('condition ', cast(o_custkey % 10 AS string))) AS conditions,
  ARR(concat('C', lpad(replace(p_brand, 'Brand#', ''), 2, '0'), '.', cast(100 + p_size AS string), '.', cast(100 + p_partkey % 7 AS string))) AS condition_ids,
  ARR(concat('D', lpad(cast(l_suppkey % 25 AS string), 2, '0'), '.', cast(100 + l_suppkey % 10 AS string))) AS intervention_ids,
  CASE WHEN l_suppkey % 10 = 0 THEN -1 ELSE cast(l_suppkey % 9 AS int) END AS cluster_id,
  l_suppkey, l_partkey, l_returnflag
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {orders} ON l_orderkey = o_orderkey""",
    "fx_dates": """
SELECT ct_path, o_orderkey, phases, label,
  CASE o_orderkey % 4 WHEN 0 THEN substr(s, 1, 10) WHEN 1 THEN substr(s, 1, 7) WHEN 2 THEN substr(s, 1, 4) ELSE concat('about ', substr(s, 1, 4)) END AS start_date,
  CASE o_orderkey % 3 WHEN 0 THEN substr(c, 1, 10) WHEN 1 THEN substr(c, 1, 7) ELSE substr(c, 1, 4) END AS completion_date, enrollment
FROM (SELECT concat('NCT', lpad(cast(o_orderkey AS string), 8, '0')) AS ct_path, o_orderkey,
    CASE WHEN o_orderkey % 7 = 0 THEN ARR(concat('PHASE', substr(o_orderpriority, 1, 1)), 'PHASE4') ELSE ARR(concat('PHASE', substr(o_orderpriority, 1, 1))) END AS phases,
    CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'TERMINATED' ELSE NULL END AS label,
    cast(max(o_orderdate) AS string) AS s, cast(max(l_shipdate) AS string) AS c, CASE WHEN o_orderkey % 17 = 0 THEN '0' ELSE cast(cast(sum(l_quantity) AS bigint) AS string) END AS enrollment
  FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderstatus) t""",
    "fx_vectors": """
SELECT vec_id AS member_id, concat('NCT', cast(vec_id % 97 AS string)) AS ct_path, embedding, CASE WHEN vec_id % 11 = 0 THEN -1 ELSE label END AS cluster_id
FROM {embeddings}""",
    "fx_predictions": """
SELECT l_orderkey, l_returnflag AS y_true, CASE WHEN l_partkey % 4 <> 0 THEN l_returnflag WHEN l_returnflag = 'A' THEN 'N' WHEN l_returnflag = 'N' THEN 'R' ELSE 'A' END AS y_pred
FROM {lineitem}""",
    "fx_sections": """
SELECT c.conv_id AS pair_id, c.turn AS turn, c.text AS reference, d.text AS prediction
FROM {conversations} c JOIN {conversations} d ON c.conv_id = d.conv_id AND d.turn = c.turn + 1 WHERE c.role = 'user' AND d.role = 'assistant'""",
    "fx_scores": """
SELECT ct_path, concat('T', cast(l_suppkey % 3 AS string)) AS target, concat('I', cast(l_partkey % 4 AS string)) AS input_type,
  cast(l_orderkey AS bigint) AS run, avg(cast(criterion_idx + l_suppkey % 7 AS double)) / 10 AS score, avg(cast(l_partkey % 13 AS double)) / 13 AS other,
  CASE WHEN l_orderkey % 10 = 0 THEN -1.0 ELSE 0.5 END AS quality
FROM {fx_criteria} GROUP BY ct_path, l_suppkey % 3, l_partkey % 4, l_orderkey""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _spark_sql(text: str) -> str:
    text = re.sub(r"\bALL\((\w+)\)", r"array_sort(collect_list(\1))", text)
    return re.sub(r"\bARR\(", "array(", text)


def _duck_sql(text: str) -> str:
    text = re.sub(r"\bALL\((\w+)\)", r"list(\1 ORDER BY \1)", text).replace("EXPLODE(", "unnest(")
    return re.sub(r"\bARR\(", "list_value(", text)


def needs(text: str) -> list[str]:
    """The views and tables that a text names in braces."""
    return list(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", text)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table or a view of this module."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    return spark.sql(_spark_sql(VIEWS[name]), **{n: view(spark, sf_dir, n) for n in needs(VIEWS[name])})


def duck(body: str) -> str:
    """DuckDB SQL for a body that names views in braces: the views become common table expressions."""
    chain: list[str] = []

    def add(text: str) -> None:
        for n in needs(text):
            if n in VIEWS and n not in chain:
                add(VIEWS[n])
                chain.append(n)

    add(body)
    plain = lambda text: re.sub(r"\{([a-z]\w*)\}", r"\1", _duck_sql(text))
    if not chain:
        return plain(body)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({plain(VIEWS[n])})" for n in chain)
    body = plain(body).strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n" + body[15:]
    return f"WITH {ctes}" + (",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body)
