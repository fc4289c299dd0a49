"""What the two vector operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, FloatType


def usable(embedding: Column) -> Column:
    """True for vectors that have a component other than zero and none that is null or not finite."""
    big = float("inf")
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < big))
    return F.coalesce(embedding.isNotNull() & fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def as_floats(embedding: Column, kind: DataType) -> Column:
    """The vector as it is where its components are floats, else in doubles."""
    floats = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    return embedding if floats else embedding.cast("array<double>")


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows brought to a largest component of 0.5 to 1 by powers of two, which change no digit: norms then neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
