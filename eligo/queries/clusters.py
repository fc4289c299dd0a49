"""Queries of embeddings, clusters, titles and cluster statistics."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eligo.operators import clusters as K
from eligo.operators import embed, metrics, topics
from eligo.plans.fixtures import VIEWS
from eligo.queries import query
from eligo.queries.metrics import SILHOUETTE
from eligo.sources import criteria as C
from eligo.sources.tables import cut, fresh_path

R = lambda c: F.round(c, 6)
J = lambda c: F.array_join(c, "|")
VIEWS["fx_tokens"] = "SELECT CAST(floor(vec_id / 20) AS bigint) AS pair_id, CASE WHEN vec_id % 3 <> 0 THEN 1 ELSE 0 END AS mask, vec_id, embedding FROM {embeddings}"
VIEWS["fx_cluster_text"] = "SELECT cluster_id, criterion AS text, ct_path, phases, conditions FROM {fx_criteria}"


@query()
def e1_embed_text(v):
    rows = v("fx_criteria").select(F.xxhash64("ct_path", "criterion_idx").alias("member_id"), F.lower("criterion").alias("input_text"))
    return embed.embed_text(rows, size=64).select("member_id", F.size("embedding").alias("dims"), R(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("square"))


@query("""
WITH e AS (SELECT pair_id, mask, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM {fx_tokens})
SELECT pair_id, dim::INT AS dim, round(sum(mask * x) / greatest(sum(mask), 1e-9), 6) AS pooled FROM e GROUP BY ALL""")
def e2_masked_mean_pool(v):
    rows = embed.masked_mean_pool(v("fx_tokens"), "pair_id")
    return rows.select("pair_id", F.posexplode("pooled").alias("dim", "pooled")).withColumn("pooled", R("pooled"))


@query("""
WITH t AS (SELECT doc_id, string_split(text, ' ') AS tokens FROM documents),
w AS (SELECT doc_id, tokens, unnest(range(0, greatest(0, ceil((len(tokens) - 512) / 256))::BIGINT + 1)) AS window_no FROM t WHERE len(tokens) > 0)
SELECT doc_id, window_no::INT AS window_no, len(tokens[window_no * 256 + 1 : window_no * 256 + 512])::INT AS n, tokens[window_no * 256 + 1] AS first FROM w""")
def e3_token_windows(v):
    rows = embed.token_windows(v("documents").select("doc_id", F.split("text", " ", -1).alias("tokens")), "doc_id")
    return rows.select("doc_id", "window_no", F.size("tokens").alias("n"), F.element_at("tokens", 1).alias("first"))


@query()
def e4_reduce_pca(v):
    return embed.reduce_pca(v("fx_vectors"), 5).select("member_id", F.size("reduced").alias("dims"))


NEAR = """
SELECT a.member_id, b.member_id AS neighbour_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance FROM {fx_vectors} a JOIN {fx_vectors} b ON a.member_id <> b.member_id
QUALIFY row_number() OVER (PARTITION BY a.member_id ORDER BY distance, b.member_id) <= 5"""
REACH = f"""
WITH near AS MATERIALIZED ({NEAR}), core AS (SELECT member_id, max(distance) AS core FROM near GROUP BY 1),
edges AS MATERIALIZED (SELECT DISTINCT least(n.member_id, neighbour_id) AS a, greatest(n.member_id, neighbour_id) AS b, greatest(x.core, y.core, distance) AS weight
  FROM near n JOIN core x ON x.member_id = n.member_id JOIN core y ON y.member_id = n.neighbour_id)"""


@query(f"SELECT member_id, neighbour_id, round(distance, 6) AS distance FROM ({NEAR})")
def k1_knn(v):
    return K.knn(v("fx_vectors"), 5).select("member_id", "neighbour_id", R("distance").alias("distance"))


@query(REACH + " SELECT DISTINCT a, b, round(weight, 6) AS weight FROM edges")
def k2_mutual_reachability(v):
    return K.mutual_reachability(K.knn(v("fx_vectors"), 5), 5).select("a", "b", R("weight").alias("weight")).distinct()


@query()
def k3_density_clusters(v):
    rows = v("fx_vectors")
    return K.density_clusters(rows, K.reachability_forest(rows, 5), 5)


@query(
    REACH.replace("\nWITH near", "WITH RECURSIVE near")
    + """, near_edges AS (SELECT a, b FROM edges WHERE weight <= 1.1 UNION SELECT b, a FROM edges WHERE weight <= 1.1),
reach AS (SELECT member_id AS node, member_id AS other FROM {fx_vectors} UNION SELECT r.node, e.b FROM reach r JOIN near_edges e ON e.a = r.other),
c AS (SELECT node AS member_id, min(other) AS component FROM reach GROUP BY node)
SELECT member_id, CASE WHEN count(*) OVER (PARTITION BY component) >= 3 THEN component ELSE -1 END AS cluster_id FROM c"""
)
def k4_density_cut(v):
    rows = v("fx_vectors")
    return K.density_cut(rows, K.mutual_reachability(K.knn(rows, 5), 5), 1.1, 3)


@query("""
SELECT label, count(*) AS n, greatest(100, least(floor(count(*) * 0.5), count(*) - 1))::BIGINT AS max_cluster_size, greatest(10, least(floor(count(*) * 0.1), count(*) - 1))::BIGINT AS min_cluster_size,
  greatest(10, least(floor(count(*) * 0.02), 128))::BIGINT AS min_samples FROM {fx_criteria} GROUP BY label""")
def k5_scale_params(v):
    sizes = v("fx_criteria").groupBy("label").agg(F.count("*").alias("n"))
    return K.scale_params(sizes, {"max_cluster_size": 0.5, "min_cluster_size": 0.1, "min_samples": 0.02})


@query()
def k6_subcluster(v):
    return K.subcluster(v("fx_vectors"), 0.1)


@query(f"SELECT (SELECT count(*) FROM {{fx_vectors}}) AS n, round(silhouette + 0.5 * (SELECT 1 - avg((cluster_id = -1)::INT) FROM {{fx_vectors}}), 6) AS score FROM ({SILHOUETTE.replace('round(', '(').replace(', 6) AS silhouette', ') AS silhouette')})")
def k7_clustering_score(v):
    rows = v("fx_vectors")
    score = K.clustering_score(rows, metrics.silhouette(rows).first()[0])
    return rows.agg(F.count("*").alias("n"), F.lit(round(score, 6)).alias("score"))


@query()
def k8_search_clustering(v):
    rows = v("fx_vectors").drop("cluster_id")
    return K.search_clustering(rows, K.draw_settings(rows.count(), 24, 5))


@query("""
WITH s AS (SELECT cluster_id, row_number() OVER (ORDER BY count(*) DESC, cluster_id) - 1 AS r FROM {fx_criteria} WHERE cluster_id <> -1 GROUP BY cluster_id)
SELECT c.ct_path, c.criterion_idx, coalesce(s.r, -1)::INT AS cluster_id FROM {fx_criteria} c LEFT JOIN s USING (cluster_id)""")
def k9_relabel_by_size(v):
    return K.relabel_by_size(v("fx_criteria").select("ct_path", "criterion_idx", "cluster_id"))


STOPS = ", ".join(f"'{w}'" for w in topics.STOP_WORDS)
COUNTS = f"""
WITH t AS (SELECT cluster_id, unnest(regexp_extract_all(lower(text), '\\b\\w\\w+\\b')) AS term FROM {{fx_cluster_text}}),
counts AS (SELECT cluster_id, term, count(*) AS n FROM t WHERE term NOT IN ({STOPS}) GROUP BY ALL)"""
TFIDF = COUNTS + """, own AS (SELECT cluster_id, sum(n) AS words FROM counts GROUP BY 1), uses AS (SELECT term, sum(n) AS uses FROM counts GROUP BY 1),
w AS (SELECT c.cluster_id, c.term, c.n, c.n / words * ln(1 + (SELECT avg(words) FROM own) / uses) AS weight FROM counts c JOIN own USING (cluster_id) JOIN uses USING (term)),
top AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(weight, 9) DESC, term)::INT AS rank FROM w QUALIFY rank <= 5)"""


def _weights(v):
    return topics.class_tfidf(topics.cluster_term_counts(v("fx_cluster_text")))


@query(COUNTS + " SELECT * FROM counts")
def p1_cluster_term_counts(v):
    return topics.cluster_term_counts(v("fx_cluster_text"))


@query(TFIDF + " SELECT cluster_id, term, n, round(weight, 6) AS weight FROM w")
def p2_class_tfidf(v):
    return _weights(v).withColumn("weight", R("weight"))


@query(TFIDF + " SELECT cluster_id, rank, term, round(weight, 6) AS weight FROM top")
def p3_top_terms(v):
    return topics.top_terms(_weights(v)).withColumn("weight", R("weight"))


@query(TFIDF + " SELECT cluster_id, CASE WHEN cluster_id = -1 THEN 'Sample with unidentified cluster' ELSE string_agg(term, '-' ORDER BY rank) END AS title FROM top GROUP BY cluster_id")
def p4_cluster_title(v):
    return topics.cluster_title(topics.top_terms(_weights(v)))


# words joined to the last line while it holds them
WRAPPED = """
WITH w AS (SELECT ct_path, criterion_idx, string_split(criterion, ' ') AS w FROM {fx_criteria}),
l AS (SELECT ct_path, criterion_idx, string_split(list_reduce(w, lambda s, x: s || CASE WHEN length(string_split(s, '<br>')[-1]) + 1 + length(x) > 20 THEN '<br>' ELSE ' ' END || x), '<br>') AS l FROM w)
SELECT ct_path, criterion_idx, CASE WHEN len(l) <= 2 THEN array_to_string(l, '<br>') ELSE array_to_string(l[:2], '<br>') || '...' END AS label FROM l"""


@query(WRAPPED)
def p5_wrap_label(v):
    return v("fx_criteria").select("ct_path", "criterion_idx", K.wrapped("criterion", 20, 2).alias("label"))


PREVALENCE = "SELECT cluster_id, count(*) AS n_samples, round(count(DISTINCT ct_path) / (SELECT count(DISTINCT ct_path) FROM {fx_criteria}), 6) AS prevalence FROM {fx_criteria} GROUP BY 1"


@query(PREVALENCE)
def q1_cluster_prevalence(v):
    return K.cluster_prevalence(v("fx_criteria")).withColumn("prevalence", R("prevalence"))


MEDOID = """
WITH d AS (SELECT a.cluster_id, a.member_id, sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s FROM {fx_vectors} a JOIN {fx_vectors} b USING (cluster_id) GROUP BY ALL),
medoid AS (SELECT cluster_id, member_id FROM d QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY round(s, 9), member_id) = 1)"""


@query(MEDOID + " SELECT * FROM medoid")
def q2_cluster_medoid(v):
    return K.cluster_medoid(v("fx_vectors"))


@query("WITH e AS (SELECT cluster_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INT - 1 AS dim FROM {fx_vectors}) SELECT cluster_id, dim, round(avg(x), 6) AS value FROM e GROUP BY ALL")
def q3_cluster_centroid(v):
    return K.cluster_centroid(v("fx_vectors")).select("cluster_id", F.posexplode("centroid").alias("dim", "value")).withColumn("value", R("value"))


RANKED = MEDOID + """, m AS (SELECT d.cluster_id, x.embedding AS medoid FROM medoid d JOIN {fx_vectors} x USING (member_id)),
ranked AS (SELECT x.cluster_id, x.member_id, list_distance(x.embedding::DOUBLE[], m.medoid::DOUBLE[]) AS distance FROM {fx_vectors} x JOIN m USING (cluster_id))"""


@query(RANKED + " SELECT cluster_id, member_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY cluster_id ORDER BY round(distance, 9), member_id)::INT AS rank FROM ranked")
def q4_rank_members(v):
    return K.rank_members(v("fx_vectors"), K.cluster_medoid(v("fx_vectors"))).withColumn("distance", R("distance"))


@query(f"SELECT * FROM ({PREVALENCE}) ORDER BY cluster_id = -1, n_samples DESC, cluster_id LIMIT 5")
def q5_order_clusters(v):
    return K.order_clusters(K.cluster_prevalence(v("fx_criteria")), k=5).withColumn("prevalence", R("prevalence"))


@query(RANKED + """, p AS (SELECT cluster_id, count(*) AS n_samples, round(count(DISTINCT ct_path) / (SELECT count(DISTINCT ct_path) FROM {fx_vectors}), 6) AS prevalence FROM {fx_vectors} GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(distance, 9), member_id)::INT AS rank FROM ranked)
SELECT r.cluster_id, 'c' || r.cluster_id AS title, n_samples, prevalence, medoid.member_id AS medoid_id, ((rank - 1) // 1000)::INT AS part, rank, x.ct_path, r.member_id, 'text ' || r.member_id AS raw_text
FROM r JOIN p USING (cluster_id) JOIN medoid USING (cluster_id) JOIN {fx_vectors} x ON x.member_id = r.member_id""")
def q6_cluster_instances(v):
    rows = v("fx_vectors")
    titles = rows.select("cluster_id").distinct().withColumn("title", F.concat(F.lit("c"), "cluster_id"))
    texts = rows.select("member_id", F.concat(F.lit("text "), "member_id").alias("raw_text"))
    medoids = cut(K.cluster_medoid(rows), "medoids")
    got = K.cluster_instances(rows, titles, K.cluster_prevalence(rows), medoids, texts).join(medoids.withColumnRenamed("member_id", "medoid_id"), "cluster_id")
    return got.select("cluster_id", "title", "n_samples", R("prevalence").alias("prevalence"), "medoid_id", "part", F.inline("ec_list"))


@query("SELECT DISTINCT ct_path, cluster_id FROM {fx_criteria} WHERE list_contains(conditions, 'condition 3')")
def q7_trial_cluster_matrix(v):
    return K.trial_cluster_matrix(v("fx_criteria"), "conditions", "condition 3")


@query("""
WITH top AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id = -1, count(*) DESC, cluster_id) - 1 AS place FROM {fx_vectors} GROUP BY cluster_id)
SELECT member_id, cluster_id, CASE WHEN cluster_id = -1 THEN -1 ELSE place END::INT AS colour, 'cluster ' || cluster_id AS label FROM {fx_vectors} JOIN top USING (cluster_id) WHERE place < 6""")
def q8_plot_table(v):
    rows = embed.reduce_pca(v("fx_vectors"), 2)
    sizes = K.cluster_prevalence(rows).withColumn("title", F.concat(F.lit("cluster "), "cluster_id"))
    return K.plot_table(rows.select("member_id", "cluster_id", "reduced"), sizes, 6).select("member_id", "cluster_id", "colour", "label")


@query("""
SELECT cluster_id, round(prevalence, 6) AS prevalence, 'c' || cluster_id AS title, 'text ' || member_id AS criterion FROM {fx_vectors}
JOIN (SELECT cluster_id, count(DISTINCT ct_path) / (SELECT count(DISTINCT ct_path) FROM {fx_vectors}) AS prevalence FROM {fx_vectors} GROUP BY 1) USING (cluster_id)""")
def s8_write_cluster_list(v):
    rows = v("fx_vectors")
    order = Window.orderBy(F.col("cluster_id") == -1, F.desc("n_samples"), "cluster_id")
    sizes = K.cluster_prevalence(rows).withColumn("position", F.row_number().over(order)).withColumn("title", F.concat(F.lit("c"), "cluster_id"))  # a row for each cluster
    listed = K.rank_members(rows, K.cluster_medoid(rows)).join(sizes, "cluster_id").withColumn("criterion", F.concat(F.lit("text "), "member_id"))
    path = fresh_path(rows.sparkSession, "list")
    C.write_cluster_list(listed, path)
    back = rows.sparkSession.read.schema("cluster_id int, prevalence double, title string, criterion string").csv(path, header=True)
    return back.withColumn("prevalence", R("prevalence"))
