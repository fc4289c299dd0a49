"""What the operators of this subpackage share: document keys and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligo.functions.graph import components
from eligo.sources.tables import cut, shared_dir

__all__ = ["GAP", "KEY", "WORD", "bounded_sample", "components", "cut", "document_key", "shared_dir"]

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
KEY = ["__k_null", "__k_id", "__k_text"]


def document_key() -> list[Column]:
    """Key of a document row: its id, nulls last, and a hash of its text.

    Rows equal in id and text are one document.
    """
    return [
        F.col("doc_id").isNull().alias(KEY[0]),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(KEY[1]),
        F.xxhash64(F.col("text")).alias(KEY[2]),
    ]


def bounded_sample(df: DataFrame, key: Column, limit: int) -> DataFrame:
    """At most about `limit` rows, chosen by a hash of the key: the same rows on every run."""
    count = df.count()
    if count <= limit:
        return df
    share = int(2**31 * limit / count)
    return df.where(F.shiftrightunsigned(F.xxhash64(key, F.lit("sample")), 33) < share)
