"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from eligo.llm import alignment, ann, importance, langid, linededup, mixing, pieces, pii, simhash, toxicity, vecdedup, warc, wrappers
from eligo.sources import table


def model_path() -> str:
    """The public tokenizer model that the queries use; it is read on the driver and not copied."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_mixing(spark, sf_dir):
    """What the mixture takes of each document: doc_id, size, source_size, target, taken, copies, shards."""
    return mixing.taken(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark, sf_dir):
    """Each document without its repeated lines: doc_id, text, n_lines, n_dropped."""
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op3_toxicity(spark, sf_dir):
    """doc_id, held_out, score, predicted of each document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash_near_dedup(spark, sf_dir):
    """doc_id, fingerprint, component_id of each document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark, sf_dir):
    """doc_id, n_tokens, tokens, round_trip of each document."""
    return pieces.encode(table(spark, sf_dir, "documents"), model_path())


def op6_pii(spark, sf_dir):
    """doc_id, counts and digest of base spans, and all spans of each document."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark, sf_dir):
    """vec_id, n_links, component_id, kept of each vector."""
    return vecdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_warc(spark, sf_dir):
    """Pages as read back from their archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_language_id(spark, sf_dir):
    """doc_id, held_out, lang_pred, score of each document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark, sf_dir):
    """query_id, rank, vec_id, score of the 20 nearest found of each query."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_importance_resampling(spark, sf_dir):
    """doc_id, n_features, weight, score, rank of each document; the benchmark's texts are the target."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_html_extraction(spark, sf_dir):
    """page_id, url, text, n_chars of each page."""
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op13_tokenizer_alignment(spark, sf_dir):
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document; the tasks read the models' files."""
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), model_path())


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_line_dedup, op3_toxicity, op4_simhash_near_dedup, op5_sentencepiece, op6_pii, op7_embedding_near_dedup, op8_warc, op9_language_id, op10_nearest_neighbours,
        op11_importance_resampling, op12_html_extraction, op13_tokenizer_alignment,
    )
}

ORACLES = {
    "op2_line_dedup": r"""
WITH each AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
firsts AS (
  SELECT line, min(struct_pack(d := doc_id, k := k)) AS f, length(line) AS n FROM each WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line),
halves AS (
  SELECT line, f, n, c, unnest([hash('h', c, substr(line, 1, c // 2)), hash('t', c, right(line, c - c // 2))]) AS half
  FROM (SELECT *, unnest([n, n - 1]) AS c FROM firsts WHERE n >= 16)),
pairs AS (
  SELECT DISTINCT a.line AS line, b.line AS other, a.n AS n, b.n AS m
  FROM halves a JOIN halves b USING (half) WHERE b.f < a.f AND abs(a.n - b.n) <= 1),
spelled AS (
  SELECT *, string_split(line, '') AS x, string_split(other, '') AS y FROM pairs),
ends AS (
  SELECT line, n, m,
    coalesce(list_min(list_filter(range(1, least(n, m) + 1), lambda i: x[i] <> y[i])) - 1, least(n, m)) AS ahead,
    coalesce(list_min(list_filter(range(1, least(n, m) + 1), lambda i: x[n + 1 - i] <> y[m + 1 - i])) - 1, least(n, m)) AS behind
  FROM spelled),
near AS (SELECT DISTINCT line FROM ends WHERE greatest(n, m) - ahead - least(behind, least(n, m) - ahead) <= 1),
kept AS (
  SELECT e.doc_id, e.k, e.line FROM each e LEFT JOIN firsts f ON e.line = f.line
  WHERE NOT regexp_matches(e.line, '[^\x20\x09-\x0D]') OR (f.f = struct_pack(d := e.doc_id, k := e.k) AND e.line NOT IN (SELECT line FROM near)))
SELECT d.doc_id, coalesce(string_agg(kept.line, chr(10) ORDER BY kept.k), '') AS text,
  len(string_split(any_value(d.text), chr(10)))::BIGINT AS n_lines,
  (len(string_split(any_value(d.text), chr(10))) - count(kept.k))::BIGINT AS n_dropped
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id GROUP BY d.doc_id
""",
    "op8_warc": r"""
WITH each AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
named AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS sha FROM each),
heads AS (SELECT sha, payload_bytes, max(page_id) AS head FROM named GROUP BY ALL)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(sha, 5 * (i // 4)::INT + 1, 5))::INT >> (5 * (3 - i % 4))::INT) % 32), 1)), '') AS payload_digest,
  CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < head THEN head END AS refers_to
FROM named JOIN heads USING (sha, payload_bytes)
""",
    "op11_importance_resampling": r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc),
texts AS (
  SELECT row_number() OVER () AS k, doc_id, text FROM documents UNION ALL SELECT -1, NULL, text FROM benchmark),
split AS (
  SELECT k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
each AS (
  SELECT k, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM split),
used AS (SELECT k, feature, count(*) AS n FROM each GROUP BY ALL),
spelled AS (SELECT feature, hex(encode(feature)) AS x FROM (SELECT DISTINCT feature FROM used)),
hashed AS (
  SELECT feature, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1]))) % 10000 AS bucket FROM spelled, crc),
placed AS (SELECT k, bucket, sum(n) AS n FROM used JOIN hashed USING (feature) GROUP BY ALL),
held AS (SELECT bucket, coalesce(sum(n) FILTER (k > 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (k < 0), 0)::DOUBLE AS t FROM placed GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM held),
worth AS (SELECT bucket, floor(1000 * ln(((t + 1) * (all_s + 10000)) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM held, total),
weighed AS (SELECT k, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM placed JOIN worth USING (bucket) WHERE k > 0 GROUP BY k),
scored AS (
  SELECT k, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM split LEFT JOIN weighed USING (k) WHERE k > 0),
placed_rows AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS place, (25 * count(*) OVER ()) // 100 AS drawn FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN placed_rows USING (k)
""",
    # knows the markup of the given pages only: one article of headings and paragraphs, some of them not closed
    "op12_html_extraction": r"""
WITH inner_html AS (SELECT row_number() OVER () AS k, page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS x FROM pages),
blocks AS (SELECT k, unnest(b) AS b, generate_subscripts(b, 1) AS i FROM (SELECT k, string_split(regexp_replace(x, '</?(p|h1)>', chr(1), 'g'), chr(1)) AS b FROM inner_html)),
plain AS (
  SELECT k, i, trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(b, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t FROM blocks),
whole AS (SELECT k, string_agg(t, chr(10) ORDER BY i) AS text FROM plain WHERE t <> '' GROUP BY k)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM inner_html LEFT JOIN whole USING (k)
""",
}
