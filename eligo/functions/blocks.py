"""Work on pairs of rows in blocks: vectors of a group are dealt into blocks of bounded size, and pairs of blocks are grouped.

A group of any size spreads over many tasks; each task holds two blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512


def self_pairs(df: DataFrame, keys: list[str], fn: Callable, schema: str, block: int = BLOCK) -> DataFrame:
    """df has keys, id, v and may have more. fn(left, right, same) gets two frames of a group and returns rows of the schema.

    Each unordered pair of blocks is handed over once; a block meets itself with same=True.
    """
    sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("__n")) if keys else df.agg(F.ceil(F.count("*") / block).cast("int").alias("__n"))
    rows = df.join(sizes, keys) if keys else df.crossJoin(F.broadcast(sizes))  # one row
    rows = rows.withColumn("__b", F.pmod(F.xxhash64("id", F.lit("block")), F.col("__n")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda o: F.struct(F.least(o, F.col("__b")).alias("i"), F.greatest(o, F.col("__b")).alias("j"), (o < F.col("__b")).alias("right")))
    rows = rows.select(*df.columns, F.explode(pairs).alias("__p")).select(*df.columns, F.col("__p.i").alias("__i"), F.col("__p.j").alias("__j"), F.col("__p.right").alias("__right"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        if g["__i"].iloc[0] == g["__j"].iloc[0]:
            return fn(g, g, True)
        return fn(g[~g["__right"]], g[g["__right"]], False)

    return rows.groupBy(*keys, "__i", "__j").applyInPandas(run, schema)


def cross_pairs(left: DataFrame, right: DataFrame, fn: Callable, schema: str, block: int = BLOCK) -> DataFrame:
    """Every block of left (id, v, …) with every block of right (same columns): fn(left, right) -> rows of the schema."""
    sizes = [max(1, -(-x.count() // block)) for x in (left, right)]
    spot = [F.pmod(F.xxhash64("id", F.lit("block")), F.lit(n)).cast("int") for n in sizes]
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in sizes]
    both = left.select("*", spot[0].alias("__i"), every[1].alias("__j"), F.lit(False).alias("__right")).unionByName(
        right.select("*", spot[1].alias("__j"), every[0].alias("__i"), F.lit(True).alias("__right"))
    )

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        return fn(g[~g["__right"]], g[g["__right"]])

    return both.groupBy("__i", "__j").applyInPandas(run, schema)


def keyed_pairs(held: DataFrame, asked: DataFrame, keys: list[str], fn: Callable, schema: str, block: int = BLOCK) -> DataFrame:
    """Every block of held rows (keys, id, v, ...) with every block of asked rows of the same keys (named like the first ones): fn(held, asked) -> rows of the schema."""
    count = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = count(held, "__nh").join(count(asked, "__na"), keys)
    spot = lambda n: F.pmod(F.xxhash64("id", F.lit("block")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = [c for c in held.columns if c not in keys]
    left = held.join(sizes, keys).select(*keys, *own, spot("__nh").alias("__i"), every("__na").alias("__j"), F.lit(False).alias("__right"))
    right = asked.join(sizes, keys).select(*keys, *own, every("__nh").alias("__i"), spot("__na").alias("__j"), F.lit(True).alias("__right"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        return fn(g[~g["__right"]], g[g["__right"]])

    return left.unionByName(right).groupBy(*keys, "__i", "__j").applyInPandas(run, schema)


def stacked(v: pd.Series) -> np.ndarray:
    """A column of vectors as a matrix of doubles."""
    return np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, 1))


def squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by one product of matrices, and a bound of their rounding error."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    error = 1e-11 * (xx.max(initial=0.0) + yy.max(initial=0.0))
    return np.maximum(xx[:, None] + yy[None, :] - 2 * (x @ y.T), 0.0), float(error)


def exact(x: np.ndarray, y: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Distances of chosen pairs, by differences."""
    out = np.empty(len(rows))
    for s in range(0, len(rows), 8192):
        out[s : s + 8192] = np.sqrt(((x[rows[s : s + 8192]] - y[cols[s : s + 8192]]) ** 2).sum(axis=1))
    return out


def exact_all(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all pairs, by differences."""
    out = np.empty((len(x), len(y)))
    for s in range(0, len(x), 64):
        out[s : s + 64] = np.sqrt(((x[s : s + 64, None, :] - y[None, :, :]) ** 2).sum(axis=2))
    return out


def roots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all pairs by one product of matrices; those small against the vectors' lengths, which would lose digits, by differences."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    out = x @ (-2 * y.T)
    out += xx[:, None]
    out += yy[None, :]
    low = 1e-5 * (xx.max(initial=0.0) + yy.max(initial=0.0))
    near = np.nonzero(out <= low) if out.min(initial=np.inf) <= low else ((), ())
    np.sqrt(np.maximum(out, 0.0, out=out), out=out)
    for s in range(0, len(near[0]), 1 << 16):
        rows, cols = (c[s : s + (1 << 16)] for c in near)
        out[rows, cols] = exact(x, y, rows, cols)
    return out


def sums_by_label(x: np.ndarray, y: np.ndarray, mine: list[np.ndarray], theirs: list[np.ndarray], same: bool, tile: int = 512) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Labels and sums of distances of each row of x to the rows of y with each label, for each labelling of y; and those of y to x, unless they are the same. Distances are made once, a tile at a time."""

    def cut(labels: list[np.ndarray]) -> list:
        """For each labelling its names, and the names of each tile with the places of its rows among them as 0 and 1."""
        out = []
        for c in labels:
            names, where = np.unique(c, return_inverse=True)
            parts = [np.unique(where[s : s + tile], return_inverse=True) for s in range(0, len(c), tile)]
            out.append((names, [(some, np.eye(len(some))[at]) for some, at in parts]))
        return out

    own, other = cut(mine), cut(theirs)
    to = [(n, np.zeros((len(x), len(n)))) for n, _ in other]
    back = [(n, np.zeros((len(y), len(n)))) for n, _ in own]
    for i in range(0, len(x), tile):
        for j in range(0, len(y), tile):
            d = roots(x[i : i + tile], y[j : j + tile])
            for (_, total), (_, parts) in zip(to, other, strict=True):
                total[i : i + tile, parts[j // tile][0]] += d @ parts[j // tile][1]
            for (_, total), (_, parts) in zip(back, () if same else own, strict=not same):
                total[j : j + tile, parts[i // tile][0]] += d.T @ parts[i // tile][1]
    return [to] if same else [to, back]


def _quick(x: np.ndarray, y: np.ndarray) -> tuple[Callable, float]:
    """A function of a stretch of x and one of y that gives squared distances, in single precision where the vectors' lengths allow, and a bound of their error."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    most = xx.max(initial=0.0) + yy.max(initial=0.0)
    single = 1e-20 < most < 1e20
    kind = np.float32 if single else np.float64
    x, y, xx, yy = x.astype(kind), (-2 * y.T).astype(kind), xx.astype(kind), yy.astype(kind)

    def far(rows: slice, cols: slice) -> np.ndarray:
        out = x[rows] @ y[:, cols]
        out += xx[rows, None]
        out += yy[None, cols]
        return out

    return far, float(most * (2e-7 * (x.shape[1] + 8) if single else 1e-11))


def nearest(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int, reach: np.ndarray | None = None, skip_self: bool = True, tile: tuple[int, int] = (256, 2048)) -> pd.DataFrame:
    """The k nearest others of each id (not itself), ties to the smaller id, of those within its reach: chosen by a product of matrices, decided by exact distances.

    A row's k-th distance so far is its reach for the next tile of others.
    """
    if not len(ids) or not len(others):
        return pd.DataFrame({"member_id": [], "neighbour_id": [], "distance": []})
    quick, error = _quick(x, y)
    common = skip_self and bool(np.isin(ids, others).any())
    out = []
    for s in range(0, len(ids), tile[0]):
        own, part = ids[s : s + tile[0]], x[s : s + tile[0]]
        limit = np.full(len(part), np.inf) if reach is None else reach[s : s + tile[0]] ** 2 * (1 + 1e-9)
        rows, cols, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for t in range(0, len(others), tile[1]):
            far = quick(slice(s, s + tile[0]), slice(t, t + tile[1]))
            if common:
                far[own[:, None] == others[None, t : t + tile[1]]] = np.inf
            free = np.flatnonzero(np.isinf(limit))
            bound = limit + 2 * error
            if len(free) and far.shape[1] > k:
                bound[free] = np.partition(far[free], k - 1, axis=1)[:, k - 1].astype(np.float64) + 4 * error
            r, c = np.nonzero((far <= bound.astype(far.dtype)[:, None] * far.dtype.type(1 + 1e-6)) & (far < np.inf))
            if not len(r):
                continue
            rows, cols, d = np.concatenate([rows, r]), np.concatenate([cols, c + t]), np.concatenate([d, exact(part, y, r, c + t)])
            by = np.lexsort((others[cols], d, rows))
            rows, cols, d = rows[by], cols[by], d[by]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, cols, d, place = rows[place < k], cols[place < k], d[place < k], place[place < k]
            last = place == k - 1
            limit[rows[last]] = np.minimum(limit[rows[last]], d[last] ** 2 * (1 + 1e-9))
        if reach is not None:
            keep = d <= reach[s : s + tile[0]][rows] * (1 + 1e-9)
            rows, cols, d = rows[keep], cols[keep], d[keep]
        out.append(pd.DataFrame({"member_id": own[rows], "neighbour_id": others[cols], "distance": d}))
    return pd.concat(out)


def distances(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Euclidean distances of two columns of vectors."""
    x, y = stacked(a), stacked(b)
    return exact_all(x, y) if len(x) and len(y) else np.zeros((len(x), len(y)))


def least_k(ids: np.ndarray, others: np.ndarray, d: np.ndarray, k: int, skip_self: bool) -> pd.DataFrame:
    """The k nearest others of each id, ties to the smaller id."""
    out = []
    for i, row in zip(ids, d, strict=True):
        at = np.flatnonzero(others != i) if skip_self else np.arange(len(others))
        if len(at) > k:
            kth = np.partition(row[at], k - 1)[k - 1]
            at = at[row[at] <= kth]
        top = at[np.lexsort((others[at], row[at]))][:k]
        out.append(pd.DataFrame({"member_id": i, "neighbour_id": others[top], "distance": row[top]}))
    return pd.concat(out) if out else pd.DataFrame({"member_id": [], "neighbour_id": [], "distance": []})
