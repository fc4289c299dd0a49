"""The driver's Parquet tables, and tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scratch: ContextVar[list[str] | None] = ContextVar("_scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "eligo-shared")


def _store(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Spark itself sees them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what it then holds is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    store, at = _store(spark, path)
    store.mkdirs(at)  # only what is there can be marked
    store.deleteOnExit(at)
    return f"{path}/{name}"


def commits(spark: SparkSession, path: str) -> list[str]:
    """Names that were committed at a path."""
    store, at = _store(spark, f"{path}/commits")
    return sorted(f.getPath().getName() for f in store.listStatus(at)) if store.exists(at) else []


def commit(spark: SparkSession, path: str, name: str) -> None:
    """Mark a name as whole; it fails if another run was there first."""
    store, at = _store(spark, f"{path}/commits/{name}")
    if not store.createNewFile(at):
        raise RuntimeError(f"{name} was committed by another run")


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back, so that later steps do not depend on lost executors.

    It is deleted with the `scratch` around it, unless it is to keep, and else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = _scratch.get()
    if made is not None and not keep:
        made.append(path)
    else:
        store, at = _store(spark, path)
        store.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut within are deleted at the end: what is needed later must be written by then, and kept."""
    made: list[str] = []
    token = _scratch.set(made)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in made:
            store, at = _store(spark, path)
            store.delete(at, True)
