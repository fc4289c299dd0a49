"""Corpus pipeline: documents -> less toxic ones -> less repeated lines -> one of each near-duplicate group -> mixed -> tokens.

A stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of
documents. The stages are DataFrame to DataFrame, so a stage that is lost is run again from its
predecessor's table alone.
"""

from eligo.llm import linededup, mixing, pieces, simhash, toxicity
from eligo.llm.common import cut
from eligo.llm.queries import model_path
from eligo.sources import table
from eligo.sources.tables import scratch

# The model, the hash-dealt mixture and the tokens have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def reject_toxic(spark, docs, sf_dir):
    """Documents that the model scores under the threshold; null and empty texts are scored as such and stay. An empty table stays empty."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark, docs, sf_dir):
    """Documents less lines that an earlier one has, exactly or within one edit; whole copies go. Null, empty and blank texts lose nothing and stay; of rows equal in id and text one stays."""
    return linededup.drop_repeated_lines(docs)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of linked fingerprints: the least id, nulls last. Null, empty and blank texts share fingerprint zero, so one of them stays."""
    return simhash.keep_one(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mixture takes them, shuffled by shard. Null sources are a source; texts without words are taken where the sequence reaches them."""
    return mixing.mix(docs)


def encode(spark, docs, sf_dir):
    """doc_id, n_tokens, tokens, round_trip of each row; null texts have no tokens."""
    return pieces.encode(docs, model_path())


STAGES = [("toxicity", reject_toxic), ("line_dedup", drop_lines), ("simhash", drop_near_copies), ("mixing", mix_sources), ("sentencepiece", encode)]


def run(spark, sf_dir):
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage wrote on its way goes as soon as its result is there
            docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
