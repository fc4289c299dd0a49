"""SimHash near-duplicates by multi-index hashing.

Fingerprints are 64 bits from 3-word shingles. Two halves of 32 bits index them. A pair at
distance 2 or less differs by at most 1 bit in the low half, or not at all in the high half
(the refined pigeonhole rule for radius 2 over two segments), so the small ball of radius 1 is
enumerated for the low segment and the ball of radius 0 for the high one. Table matches are
kept only after their whole distance is verified.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other;
texts under three words have one shingle, the whole sequence; rows equal in id and text are one
document, and all have its result; a null id never names a component unless all its members have none (then null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligo.llm.common import GAP, KEY, components, cut, document_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKET = 64
PAIR = 0x0000000100000001


def fingerprints(docs: DataFrame) -> DataFrame:
    """(key columns, doc_id, n_rows, fp long) for each document.

    A text's words and hashes are held as two arrays; hashes are counted bit by bit in 32 sums of two packed 32-bit counters each,
    and one row per document and task is shuffled. Rows of one document add up alike in all counts, so they do not change its bits.
    """
    words = F.array_remove(F.split(F.translate("text", UPPER, LOWER), GAP), "")
    rows = docs.select(*document_key(), F.col("doc_id").cast("long").alias("doc_id"), words.alias("w"))
    shingle = lambda i: F.xxhash64(F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    hashes = (
        F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), shingle))
        .when(F.size("w") > 0, F.array(F.xxhash64(F.concat_ws(" ", "w"))))
    )
    each = rows.select(*KEY, "doc_id", F.posexplode_outer(hashes).alias("k", "h"))
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(PAIR))).alias(f"s{i}") for i in range(32)]
    got = each.groupBy(*KEY, "doc_id").agg(F.count("h").alias("n"), F.count_if(F.coalesce("k", F.lit(0)) == 0).alias("n_rows"), *sums)
    fp = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"s{i}", 32)
        fp = fp.bitwiseOR(F.when(low * 2 > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        top = (1 << (i + 32)) - (1 << 64 if i == 31 else 0)
        fp = fp.bitwiseOR(F.when(high * 2 > F.col("n"), F.lit(top)).otherwise(F.lit(0)).cast("long"))
    return got.select(*KEY, "doc_id", "n_rows", F.coalesce(fp, F.lit(0).cast("long")).alias("fp"))


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that join all pairs at 2 or fewer differing bits.

    Buckets of more than `bucket` entries are not paired: everything that probes one goes
    through the ball of radius 1 over the whole code instead, where two codes meet if and only if
    they are within distance 2; each meeting point (of at most 65 codes) gives a star of edges.
    """
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    entry = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("t"), low.alias("v")), F.struct(F.lit(1).alias("t"), high.alias("v")))).alias("e")).select("fp", "e.t", "e.v")
    # a one-bit difference is met from the side whose bit is 0, so each pair is met once
    flips = F.filter(F.array(*[F.lit(1 << i).cast("long") for i in range(32)]), lambda m: low.bitwiseAND(m) == 0)
    ball = F.concat(F.array(low), F.transform(flips, lambda m: low.bitwiseOR(m)))
    probe = fps.select("fp", F.lit(0).alias("t"), F.explode(ball).alias("v")).unionByName(fps.select("fp", F.lit(1).alias("t"), high.alias("v")))
    heavy = cut(entry.groupBy("t", "v").count().where(F.col("count") > bucket).select("t", "v"), "heavy")
    p, e = probe.withColumnRenamed("fp", "a"), entry.withColumnRenamed("fp", "b")
    some = not heavy.isEmpty()
    if some:
        e = e.join(heavy, ["t", "v"], "left_anti")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = p.join(e, ["t", "v"]).where((F.col("a") != F.col("b")) & (near <= 2)).select("a", "b")
    if not some:
        return pairs
    rest = probe.join(heavy, ["t", "v"], "left_semi").select("fp").distinct()
    masks = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)])
    met = rest.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("v"))
    stars = met.groupBy("v").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    stars = stars.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")
    return pairs.unionByName(stars)


def groups(docs: DataFrame) -> DataFrame:
    """(key columns, doc_id, fp, component_id, head): head marks the one document that stays for its group."""
    each = cut(fingerprints(docs), "fingerprints")
    codes = each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct(*KEY)).alias("first"))
    codes = cut(codes, "codes")
    comp = cut(components(links(codes.select("fp"))), "components")
    labelled = codes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"), F.min("first").alias("chosen"))
    named = labelled.select("fp", "component").join(ids, "component").select("fp", "component_id", "chosen")
    return each.join(named, "fp").select(*KEY, "doc_id", "n_rows", "fp", "component_id", (F.struct(*KEY) == F.col("chosen")).alias("head"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each document row."""
    rows = groups(docs).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, with their own columns, less all but the first (least id) of each group."""
    heads = groups(docs).where("head").select(*KEY)
    keyed = docs.select("*", *document_key())
    return keyed.join(heads, KEY, "left_semi").dropDuplicates(KEY).select(*docs.columns)
