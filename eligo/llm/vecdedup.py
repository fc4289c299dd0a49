"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors of a label (by two hashes) are one representative. Unit vectors are rotated to their principal
axes, so that leading coordinates carry most of a product. Vectors at cosine t or more differ
by at most sqrt(2 - 2 t) in any coordinate, so bands of that width along the first axis need only
meet themselves and the next band. Bands are dealt into tiles of about `tile` vectors by hash, and
pairs of tiles are compared: products are accumulated a few axes at a time, the rest is bounded
by the product of the suffix norms, and pairs that cannot reach the threshold are dropped. What is
left is verified as cosine of the original vectors in double precision.

A pair of tiles returns a row per linked vector (its number of links there and one member of its
local component), never the pairs, so a group of thousands of near copies stays linear in output.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows without
a label, link with nothing; vectors of different lengths do not link; repeated rows are vectors
of their own and link; kept is false where the id or the component is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligo.llm.common import components, cut
from eligo.llm.vectors import as_floats, scaled, usable

THRESHOLD = 0.98
TILE = 4096
SLICE = 256
STEP = 8
SLACK = 1e-9


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of products of the components of unit vectors, by length."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for d, group in b.groupby(b["v"].map(len)):
            x = scaled(np.stack(group["v"].to_numpy()).astype(np.float64))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            sums[d] = sums.get(d, 0) + x.T @ x
    for d, s in sums.items():
        i, j = np.meshgrid(np.arange(d), np.arange(d), indexing="ij")
        yield pd.DataFrame({"d": d, "i": i.ravel(), "j": j.ravel(), "s": s.ravel()})


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By vector length: axes as columns, strongest first. Only d * d sums for each length reach the driver."""
    rows = vectors.select("v").mapInPandas(_moments, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    axes = {}
    for d, g in rows.groupby("d"):
        m = np.zeros((d, d))
        m[g["i"], g["j"]] = g["s"]
        axes[int(d)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return axes


def linked(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into x and y) with cosine at or above the threshold; i < j where both are the same tile."""
    x = scaled(x)
    y = x if same else scaled(y)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    a, b = (x / nx[:, None]) @ axes, (y / ny[:, None]) @ axes
    left = lambda m: np.sqrt(np.maximum(0, np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1]))  # noqa: E731  suffix norms
    ra, rb, d, pairs = left(a), left(b), a.shape[1], []
    for s in range(0, len(a), SLICE):  # so that a tile's products are never all held at once
        some = a[s : s + SLICE]
        total = np.zeros((len(some), len(b)))
        alive = np.arange(len(b)) > np.arange(s, s + len(some))[:, None] if same else np.ones(total.shape, dtype=bool)
        for k in range(0, d, STEP):
            total += some[:, k : k + STEP] @ b[:, k : k + STEP].T
            rest = np.outer(ra[s : s + SLICE, k + STEP], rb[:, k + STEP]) if k + STEP < d else 0.0
            alive &= total + rest >= threshold - SLACK
            if not alive.any():
                break
        i, j = np.nonzero(alive)
        for c in range(0, len(i), 100_000):
            p, q = i[c : c + 100_000] + s, j[c : c + 100_000]
            ok = (x[p] * y[q]).sum(axis=1) / (nx[p] * ny[q]) >= threshold
            pairs.append((p[ok], q[ok]))
    if not pairs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([p for p, _ in pairs]), np.concatenate([q for _, q in pairs])


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that links reach, for each of n."""
    root = np.arange(n)
    while len(i):
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _tiled(reps: DataFrame, axes: dict[int, np.ndarray], threshold: float, tile: int) -> DataFrame:
    """rep, v, n with the pairs of tiles that it takes part in."""
    width = float(np.sqrt(2 - 2 * threshold) + 1e-6)
    lead = reps.sparkSession.sparkContext.broadcast({d: m[:, 0] for d, m in axes.items()})

    @F.pandas_udf("int")
    def band(v: pd.Series) -> pd.Series:
        out = []
        for x in v:
            (x,) = scaled(np.asarray(x, dtype=np.float64)[None])
            out.append(int(np.floor(float(x @ lead.value[len(x)]) / float(np.linalg.norm(x)) / width)))
        return pd.Series(out, dtype="int32")

    rows = cut(reps.withColumn("d", F.size("v")).withColumn("band", band("v")), "banded")
    parts = cut(rows.groupBy("label", "d", "band").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "bands")
    at = lambda k, name: parts.select("label", "d", (F.col("band") - k).alias("band"), F.col("tiles").alias(name))
    rows = rows.join(parts, ["label", "d", "band"]).join(at(1, "above"), ["label", "d", "band"], "left").join(at(-1, "below"), ["label", "d", "band"], "left")
    rows = rows.withColumn("t", F.pmod(F.xxhash64("rep", F.lit("tile")), F.col("tiles")).cast("int"))
    pair = lambda b1, t1, b2, t2, side: F.struct(b1.alias("b1"), t1.alias("t1"), b2.alias("b2"), t2.alias("t2"), F.lit(side).alias("side"))
    b, t = F.col("band"), F.col("t")
    some = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array())
    here = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.when(o >= t, pair(b, t, b, o, 0)).otherwise(pair(b, o, b, t, 1)))
    up = F.when(F.col("above") > 0, F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda o: pair(b, t, b + 1, o, 0)))
    down = F.when(F.col("below") > 0, F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda o: pair(b - 1, o, b, t, 1)))
    meets = F.flatten(F.filter(F.array(here, up, down), lambda x: x.isNotNull()))
    return rows.select("label", "d", "rep", "n", "v", F.explode(meets).alias("p")).select("label", "d", "rep", "n", "v", "p.*")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding, label)."""
    v = as_floats(F.col("embedding"), vectors.schema["embedding"].dataType)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), "label")
    good = usable(F.col("v")) & F.col("label").isNotNull()
    name = [F.when(good, F.xxhash64(*more, "label", "v")).alias(f"h{k}") for k, more in enumerate(([], [F.lit("b")]))]
    rows = cut(rows.select("vec_id", *name, F.when(good, F.col("v")).alias("v"), F.when(good, F.col("label")).alias("label")), "vectors")
    reps = rows.where("h0 is not null").groupBy("h0", "h1").agg(F.first("v").alias("v"), F.first("label").alias("label"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    reps = cut(reps.withColumn("rep", F.monotonically_increasing_id()), "representatives")  # numbers that the written table keeps
    axes = principal_axes(reps)
    shared = rows.sparkSession.sparkContext.broadcast(axes)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        same = (rows["b1"].iloc[0], rows["t1"].iloc[0]) == (rows["b2"].iloc[0], rows["t2"].iloc[0])
        left = rows[rows["side"] == 0].sort_values("rep")
        right = left if same else rows[rows["side"] == 1].sort_values("rep")
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        x = np.stack(left["v"].to_numpy()).astype(np.float64)
        y = x if same else np.stack(right["v"].to_numpy()).astype(np.float64)
        i, j = linked(x, y, shared.value[x.shape[1]], threshold, same)
        ids = left["rep"].to_numpy() if same else np.concatenate([left["rep"], right["rep"]])
        n = left["n"].to_numpy() if same else np.concatenate([left["n"], right["n"]])
        j = j if same else j + len(left)
        links = np.bincount(i, weights=n[j], minlength=len(ids)) + np.bincount(j, weights=n[i], minlength=len(ids))
        root = local_roots(len(ids), i, j)
        some = np.flatnonzero(links)
        return pd.DataFrame({"rep": ids[some], "links": links[some].astype("int64"), "root": ids[root[some]]})

    found = _tiled(reps, axes, threshold, tile).withColumn("pair", F.concat_ws(",", "label", "d", "b1", "t1", "b2", "t2")).groupBy("pair").applyInPandas(compare, "rep long, links long, root long")
    found = cut(found, "links")
    comp = cut(components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))), "components")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = reps.join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("h0", "h1", "rep", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    heads = named.groupBy("component").agg(F.min("least").alias("head"))
    named = named.join(heads, "component").select("h0", "h1", (F.col("links") + F.col("n") - 1).alias("n_links"), "head")
    out = rows.select("vec_id", "h0", "h1").join(named, ["h0", "h1"], "left")
    component = F.when(F.col("h0").isNull(), F.col("vec_id")).otherwise(F.col("head"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
