"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner products become least distances by one more coordinate, sqrt(M * M - |x| * |x|) with
M the largest norm (0 for queries). Each of `tables` tables hashes a vector by bits(n) projections on
Gaussian directions, made orthogonal within a frame (which tells neighbours better apart than independent ones). A projection is
cut into cells so wide that only the boundary at the mean is in use; a bucket is the cells of all of a table's hashes, and holds a row or so.

A query's perturbed buckets are those that differ in some cells. Each hash adds to a bucket what the query's projection loses there, and the buckets of the
least sums, which are the likeliest to hold neighbours, are listed, share(n) of all. The share falls as rows grow in number, since
neighbours come nearer. Sums over the two halves of the hashes are tabled; by them the limit is found below which the listed buckets lie, and the buckets
below it, without a look at others. Only rows in listed buckets are looked up; they are found by their bucket's code and ranked by the
inner product of the original vectors in double precision; single precision, with its bound of error, only tells which cannot be among the k best. What all tables found is merged.

The first bits of a code name a region of about REGION rows, by which rows are dealt; a query goes to the regions in which it has listed buckets, with its
limit, from which they are listed there.
Regions of any size are taken whole: their rows and the queries that visit them are dealt
into blocks, and a block returns the k best for each query, so output grows with the queries and
not with the square of a region; blocks' results are merged FAN at a time. A query that finds fewer than k rows is compared with every row,
in blocks. Nothing is fitted but the mean and deviation of the projections, over all rows.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part;
only vectors of equal length are compared; rows with the query's own id are not candidates; ties
go to the smaller id; of rows of one id the best counts, and as a query the one whose vector comes last in array order; null ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eligo.llm.common import cut
from eligo.llm.vectors import as_floats, scaled, usable

TABLES = 4
REGION = 16_384
BLOCK = 32_768
HELD = 1 << 21  # components of a block's rows
ASKED = 2048
SENT = 1024  # queries whose limits a task finds
FAN = 64
SEED = 11
MOST = 1 << 21  # sums of half-buckets that are held at once


def share(n: int) -> float:
    """Part of a table's buckets that a query visits among n rows; set for a recall of 0.95 on vectors without any structure."""
    return min(0.3, 0.065 * (51_282 / max(n, 1)) ** 0.28)


def bits(n: int) -> int:
    """Hashes of a table: about as many buckets as rows."""
    return max(4, min(40, round(np.log2(max(n, 2)))))


def directions(d: int, tables: int, hashes: int) -> np.ndarray:
    """tables x hashes directions of d + 1 coordinates: Gaussian ones, orthogonal within each frame of d + 1; the same wherever they are drawn."""
    rng, frames, need = np.random.default_rng([SEED, d]), [], tables * hashes
    while need > 0:
        frames.append(np.linalg.qr(rng.standard_normal((d + 1, d + 1)))[0][:, :need])
        need -= d + 1
    return np.concatenate(frames, axis=1).T.reshape(tables, hashes, d + 1)


def extended(x: np.ndarray, most: float, queries: bool) -> np.ndarray:
    """Vectors in units of the largest norm, with the coordinate that turns products into distances."""
    x = x / most
    return np.column_stack([x, np.zeros(len(x)) if queries else np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))])


def losses(place: np.ndarray) -> np.ndarray:
    """What a projection of queries (queries x hashes) loses on the other side. Where it loses nothing, powers of two far below the rest keep the sums apart."""
    loss, width = np.abs(place), place.shape[1]
    top = loss.max(axis=1, initial=0, keepdims=True)
    return np.where(loss > 0, loss, np.where(top > 0, top, 1) * np.ldexp(1.0, np.arange(width) - width - 16))


def sums(loss: np.ndarray) -> np.ndarray:
    """Sums of all choices of hashes, by the code that has a one for each chosen hash: queries x codes."""
    out = np.zeros((len(loss), 1))
    for h in range(loss.shape[1])[::-1]:
        out = np.concatenate([out, out + loss[:, h : h + 1]], axis=1)
    return out


class Buckets:
    """Buckets of some queries over some hashes by their sums over the first and over the last half of the hashes.

    A bucket's sum is over the hashes in which it lies on the other side than the query.
    """

    def __init__(self, loss: np.ndarray, own: np.ndarray):
        self.own, self.low = own, loss.shape[1] // 2
        cut_at = loss.shape[1] - self.low
        self.first, last = sums(loss[:, :cut_at]), sums(loss[:, cut_at:])
        self.order = np.argsort(last, axis=1, kind="stable")
        self.last = np.take_along_axis(last, self.order, axis=1)

    def upto(self, k: int, limit: float) -> np.ndarray:
        """For each code of the first half, how many of the last half keep query k's sum within the limit."""
        return np.searchsorted(self.last[k], limit - self.first[k], side="right")

    def limit(self, k: int, most: int) -> float:
        """A limit within which query k has its `most` least sums: halved until few sums lie between its bounds, which are then sorted."""
        below, above = 0.0, float(self.first[k].max() + self.last[k, -1])
        if most >= self.first.shape[1] * self.last.shape[1]:
            return np.inf
        few, many = np.zeros(self.first.shape[1], dtype=np.int64), np.full(self.first.shape[1], self.last.shape[1])
        for _ in range(64):
            if many.sum() - few.sum() <= 256:
                break
            middle = (below + above) / 2
            n = self.upto(k, middle)
            if n.sum() <= most:
                below, few = middle, n
            else:
                above, many = middle, n
        between = np.sort(np.repeat(self.first[k], many - few) + self.last[k, runs(few, many - few)])
        need = most - few.sum()
        return float(((between[need - 1] if need else below) + between[need]) / 2)

    def codes(self, k: int, limit: float) -> np.ndarray:
        """Buckets of query k whose sums are within the limit."""
        many = self.upto(k, limit)
        return (np.repeat(np.arange(len(many)) << self.low, many) | self.order[k, runs(np.zeros_like(many), many)]) ^ self.own[k]


def runs(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every run, `many` each, end to end."""
    return np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())


def sides(place: np.ndarray) -> np.ndarray:
    """The codes of the buckets in which projections lie."""
    return (place > 0) @ (1 << np.arange(place.shape[-1], dtype=np.int64)[::-1])


def sequence(place: np.ndarray, most: int) -> np.ndarray:
    """Projections of queries (queries x hashes) -> the codes of the `most` buckets of the least sums, in that order: queries x most."""
    loss, out = losses(place), []
    buckets, bits_ = Buckets(loss, sides(place)), np.arange(place.shape[1])[::-1]
    for k in range(len(place)):
        codes = buckets.codes(k, buckets.limit(k, most))
        flipped = (codes ^ buckets.own[k])[:, None] >> bits_ & 1
        out.append(codes[np.argsort(flipped @ loss[k], kind="stable")[:most]])
    return np.array(out)


class Index:
    """What every task knows: directions, centres and deviations by vector length, the largest norm, and how deep regions go."""

    def __init__(self, n: int, most: float, tables: int, part: float | None):
        self.most, self.tables, self.hashes = most, tables, bits(n)
        self.probes = max(1, round((share(n) if part is None else part) * 2**self.hashes))
        self.lead = min(self.hashes, max(0, int(np.log2(max(n, 1) / REGION))))
        self.rest = self.hashes - self.lead  # bits within a region
        self.centre: dict[int, np.ndarray] = {}
        self.deviation: dict[int, np.ndarray] = {}
        self.drawn: dict[int, np.ndarray] = {}

    def projected(self, x: np.ndarray, queries: bool) -> np.ndarray:
        """rows x tables x hashes."""
        d = x.shape[1]
        if d not in self.drawn:
            self.drawn[d] = directions(d, self.tables, self.hashes)
        return np.einsum("nd,thd->nth", extended(x, self.most, queries), self.drawn[d])

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Rows' buckets: rows x tables."""
        return sides(self.projected(x, False) - self.centre[x.shape[1]])

    def asked(self, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, float]]:
        """Query, table, the regions in which the query has listed buckets, and the limit of these buckets' sums."""
        places, step = self.projected(x, True) * self.deviation[x.shape[1]], max(1, MOST >> (self.hashes + 1) // 2)
        for t in range(self.tables):
            for s in range(0, len(x), step):
                place = places[s : s + step, t]
                loss, own = losses(place), sides(place)
                every, lead = Buckets(loss, own), Buckets(loss[:, : self.lead], own >> self.rest)
                for k in range(len(place)):
                    limit = every.limit(k, self.probes)
                    yield s + k, t, lead.codes(k, limit), limit

    def within(self, x: np.ndarray, table: int, region: int) -> tuple[Buckets, np.ndarray]:
        """The queries' buckets in a region, by their codes there, and what the region itself adds to their sums."""
        place = (self.projected(x, True) * self.deviation[x.shape[1]])[:, table]
        loss, own = losses(place), sides(place)
        away = ((own >> self.rest) ^ region)[:, None] >> np.arange(self.lead)[::-1] & 1
        return Buckets(loss[:, self.lead :], own & ((1 << self.rest) - 1)), (away * loss[:, : self.lead]).sum(axis=1)

    def visits(self, x: np.ndarray, table: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        """By query: regions, and the listed buckets in each, by their codes within the region."""
        out = []
        for k, t, regions, limit in self.asked(x):
            if t == table:
                there = [self.within(x[k : k + 1], t, r) for r in regions.tolist()]
                out.append((regions, [b.codes(0, limit - adds[0]) for b, adds in there]))
        return out


def stacked(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64)


def fitted(rows: DataFrame, tables: int, part: float | None) -> Index:
    """The index of rows (id, v, d): counts and sums only reach the driver, a row for each vector length, table and hash."""

    def norms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, g in batch.groupby("d"):
                x = stacked(g["v"])
                with np.errstate(over="ignore"):
                    yield pd.DataFrame({"n": [len(x)], "most": [float((np.abs(x).max(axis=1) / np.abs(scaled(x)).max(axis=1) * np.linalg.norm(scaled(x), axis=1)).max())]})

    n, most = rows.select("v", "d").mapInPandas(norms, "n long, most double").agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("most")).first()
    index = Index(n, most or 1.0, tables, part)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, g in batch.groupby("d"):
                p = index.projected(stacked(g["v"]), False).reshape(len(g), -1)
                yield pd.DataFrame({"d": np.int32(d), "k": np.arange(p.shape[1], dtype=np.int32), "n": len(g), "s": p.sum(axis=0), "ss": (p * p).sum(axis=0)})

    got = rows.mapInPandas(sums, "d int, k int, n long, s double, ss double").groupBy("d", "k").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss"))).toPandas()
    for d, g in got.sort_values("k").groupby("d"):
        mean = (g["s"] / g["n"]).to_numpy()
        index.centre[d] = mean.reshape(tables, -1)
        index.deviation[d] = np.sqrt(np.maximum(0, (g["ss"] / g["n"]).to_numpy() - mean * mean)).reshape(tables, -1)
    return index


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, part: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among the other rows; n_scored: how many rows were ranked for it, over all tables."""
    v = as_floats(F.col("embedding"), vectors.schema["embedding"].dataType)
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v"), is_query.alias("q")).where(usable(F.col("v"))).where("id is not null")
    rows = cut(rows.select("id", "v", F.size("v").alias("d"), F.coalesce("q", F.lit(False)).alias("q")), "vectors")
    asked = cut(rows.where("q").groupBy("id").agg(F.max("v").alias("v")).select("id", "v", F.size("v").alias("d")), "queries")
    rows = rows.select("id", "v", "d")
    index = fitted(rows, tables, part)
    repeats = tables * (rows.groupBy("id").count().agg(F.max("count")).first()[0] or 1)
    kind = rows.schema["v"].dataType.simpleString()

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, g in batch.groupby("d"):
                yield pd.DataFrame({"d": np.int32(d), "id": g["id"].to_numpy(), "v": g["v"].to_numpy(), "codes": list(index.codes(stacked(g["v"])))})

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, g in batch.groupby("d"):
                at, t, regions, limits = zip(*index.asked(stacked(g["v"])), strict=True)
                some = g.iloc[list(at)]
                yield pd.DataFrame({"t": np.array(t, dtype=np.int32), "d": np.int32(d), "id": some["id"].to_numpy(), "v": some["v"].to_numpy(), "regions": list(regions), "reach": limits})

    stored = cut(rows.mapInPandas(held, f"d int, id long, v {kind}, codes array<long>"), "held")
    stored = stored.select("d", "id", "v", F.posexplode("codes").alias("t", "code")).withColumn("b", F.shiftright("code", index.rest))
    sends = cut(asked.repartition(max(1, -(-asked.count() // SENT))).mapInPandas(sent, f"t int, d int, id long, v {kind}, regions array<long>, reach double"), "asked")
    found = cut(_ranked(stored, sends.withColumn("b", F.explode("regions")), k, repeats, index, True), "neighbours")
    # those that found fewer than k meet every row, in blocks
    have = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = cut(asked.join(have, "id", "left_anti"), "short")
    if not short.isEmpty():
        everywhere = F.lit(0).alias("t"), F.lit(0).cast("long").alias("b"), "d", "id", "v", F.lit(0).cast("long").alias("code"), F.lit(0.0).alias("reach")
        more = _ranked(rows.select(*everywhere), short.select(*everywhere), k, repeats, index, False)
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(more)
    return found


def best_of(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query, ties to the smaller id, each id once."""
    top = np.lexsort((ids, -score))
    return top[np.sort(np.unique(ids[top], return_index=True)[1])[:k]]


def begins(codes: np.ndarray, n: int) -> np.ndarray:
    """Where the rows of each of n codes begin, and the end; codes are sorted."""
    return np.searchsorted(codes, np.arange(n + 1))


def looked_up(codes: np.ndarray, order: np.ndarray, wanted: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
    """Places of the rows in the wanted buckets; codes are sorted, order has the rows' places. begin: where codes begin, if known."""
    if begin is None:
        begin = begins(codes, int(wanted.max(initial=0)) + 1)
    low = begin[wanted]
    many = begin[wanted + 1] - low
    return order[runs(low, many)]


def _ranked(held: DataFrame, asked: DataFrame, k: int, repeats: int, index: Index, by_code: bool) -> DataFrame:
    """Rows (with code) and queries (with reach) that share a region (t, b, d) -> query_id, rank, vec_id, score of the k best of each query. Without by_code all rows of a region are visited."""
    blocks = lambda df, name, n: df.groupBy("t", "b", "d").agg(F.count("*").alias("n")).select("t", "b", "d", F.ceil(F.col("n") / n).cast("int").alias(name))
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(HELD) / F.col("d"))))
    sizes = cut(blocks(held, "nh", room).join(blocks(asked, "nq", ASKED), ["t", "b", "d"]), "blocks")
    pick = lambda n: F.pmod(F.xxhash64("id", F.lit("block")), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    key = ["t", "b", "d", "id", "v"]
    left = held.join(sizes, ["t", "b", "d"]).select(*key, "code", F.lit(0.0).alias("reach"), pick(F.col("nh")).alias("h"), upto(F.col("nq")).alias("q"), F.lit(0).alias("side"))
    right = asked.join(sizes, ["t", "b", "d"]).select(*key, F.lit(0).cast("long").alias("code"), "reach", upto(F.col("nh")).alias("h"), pick(F.col("nq")).alias("q"), F.lit(1).alias("side"))

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        x, q = rows[rows["side"] == 0], rows[rows["side"] == 1]
        none = pd.DataFrame({"query_id": [], "ids": [], "scores": [], "n_scored": []}, dtype=object)
        if not len(x) or not len(q):
            return none
        t, b, d = map(int, rows["block"].iloc[0].split(",")[:3])
        codes = x["code"].to_numpy() & ((1 << index.rest) - 1)
        by = np.argsort(codes, kind="stable")
        codes, ids, a, asked_by = codes[by], x["id"].to_numpy()[by], stacked(x["v"])[by], stacked(q["v"])
        places, keep, out = np.arange(len(ids)), k * int(np.unique(ids, return_counts=True)[1].max()), []
        if by_code:
            begin = begins(codes, 1 << index.rest)
            buckets, adds = index.within(asked_by, t, b)
            reach = q["reach"].to_numpy() - adds
        # norms are at most 1, so single precision errs by less than d + 2 halves of its last digit
        single, unit, errs = (a / index.most).astype(np.float32), scaled(asked_by), (d + 8) * 2.0**-22
        unit = (unit / np.linalg.norm(unit, axis=1)[:, None]).astype(np.float32)
        for j, qid in enumerate(q["id"].to_numpy()):
            at = looked_up(codes, places, buckets.codes(j, reach[j]), begin) if by_code else places
            at = at[ids[at] != qid]
            n = len(at)
            if not n:
                continue
            if n > keep:
                about = single.take(at, axis=0) @ unit[j]
                at = at[about >= np.partition(about, n - keep)[n - keep] - errs]
            score = (a[at] * asked_by[j]).sum(axis=1)  # one order of sums for every block, so that equal vectors tie
            top = best_of(ids[at], score, k)
            out.append((qid, ids[at][top], score[top], n))
        return pd.DataFrame(out, columns=["query_id", "ids", "scores", "n_scored"]) if out else none

    # one key, so that Spark deals blocks and not the regions that some of them come from
    both = left.unionByName(right).withColumn("block", F.concat_ws(",", "t", "b", "d", "h", "q"))
    each = both.select("block", "id", "v", "code", "reach", "side").groupBy("block").applyInPandas(best, "query_id long, ids array<long>, scores array<double>, n_scored long")
    pairs = F.zip_with("ids", "scores", lambda i, x: F.struct((-x).alias("minus"), i.alias("vec_id")))
    each = cut(each.select("query_id", pairs.alias("found"), "n_scored"), "found")
    # an id comes at most `repeats` times, so k * repeats entries hold k ids; a query's lists come together FAN at a time
    merged = F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k * repeats).alias("found"), F.sum("n_scored").alias("n_scored")
    while (most := each.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0) > FAN:
        salt = F.pmod(F.xxhash64("query_id", "found"), F.lit(-(-most // FAN))).alias("salt")
        each = cut(each.groupBy("query_id", salt).agg(*merged).drop("salt"), "found")
    each = each.groupBy("query_id").agg(*merged)
    each = each.select("query_id", "n_scored", F.explode("found").alias("e")).groupBy("query_id", "n_scored", "e.vec_id").agg((-F.min("e.minus")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_scored")
