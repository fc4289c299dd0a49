"""Neighbours, forests and condensed trees against plain versions, in one task and spread over many."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eligo.functions import blocks, condense, forest, space
from eligo.operators import clusters as K
from eligo.operators import metrics


@pytest.fixture(scope="module")
def points():
    """Blobs of unlike density, rows at one place, and a grid full of ties."""
    rng = np.random.default_rng(3)
    parts = [rng.normal(c, s, (n, 3)) for c, s, n in (((0, 0, 0), 0.3, 80), ((5, 0, 0), 0.05, 60), ((5.5, 1, 0), 0.5, 60), ((-4, 9, 2), 1.0, 60))]
    return np.concatenate([*parts, np.tile([[1.0, 2, 3]], (25, 1)), rng.integers(0, 3, (40, 3)).astype(float)])


def far(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "member_id long, embedding array<double>")


@pytest.mark.parametrize("cell", [1024, 20])
def test_knn_by_pivots(spark, points, cell):
    d, got = far(points), {}
    for r in K.knn(vectors(spark, points), 5, cell=cell).collect():
        got.setdefault(r.member_id, []).append((r["rank"], r.neighbour_id, r.distance))
    for i in range(len(points)):
        want = sorted((d[i, j], j) for j in range(len(points)) if j != i)[:5]
        assert [n for _, n, _ in sorted(got[i])] == [j for _, j in want] and [round(x, 9) for *_, x in sorted(got[i])] == [round(x, 9) for x, _ in want]


def test_pivots_spare_pairs(spark):
    """On blobs most cells are never visited."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.5, (200, 4)) for c in rng.normal(0, 20, (10, 4))])
    rows = vectors(spark, x).select(F.lit(0).cast("long").alias("grp"), F.col("member_id").alias("id"), F.col("embedding").alias("v"))
    placed, cells = space.celled(rows, 100)
    visits = space.visits(placed.withColumn("reach", F.lit(0.5)), cells).count()
    assert visits < 0.2 * len(x) * len(cells.ids)


def grown(x, samples, alpha=1.0):
    """Weights of a least spanning tree of the whole mutual-reachability graph."""
    d = far(x)
    core = np.sort(d, axis=1)[:, samples]
    d = np.maximum(np.maximum(core[:, None], core[None]), d / alpha)
    best, live, out = d[0].copy(), np.ones(len(x), dtype=bool), []
    live[0] = False
    for _ in range(len(x) - 1):
        k = np.where(live, best, np.inf).argmin()
        out.append(best[k])
        live[k], best = False, np.minimum(best, d[k])
    return np.sort(out)


@pytest.mark.parametrize("local", [2048, 10])
def test_forest_of_the_whole_graph(spark, points, local):
    kinds = {0: (points, 5, 1.0), 1: (points[::2], 3, 2.5)}
    rows = [(g, i, [float(v) for v in p], s, a) for g, (x, s, a) in kinds.items() for i, p in enumerate(x)]
    df = spark.createDataFrame([*rows, (7, 1, [1.0, 2.0, 3.0], 3, 1.0)], "grp long, id long, v array<double>, samples int, alpha double")
    got = forest.reachability_forest(df, local=local, cell=20).toPandas()
    assert set(got["grp"]) == {0, 1}
    for g, (x, s, a) in kinds.items():
        assert np.allclose(np.sort(got[got["grp"] == g]["weight"].to_numpy()), grown(x, s, a))


def plain_clusters(n, edges, m, eom, most, single):
    """The condensed tree, looked at from above at every height."""
    heights = sorted({w for *_, w in edges})
    least = min((h for h in heights if h > 0), default=1.0)

    def parts(nodes, h):
        """Components of the nodes by edges under h."""
        near = {x: [] for x in nodes}
        for a, b, w in edges:
            if a in near and b in near and w < h:
                near[a].append(b)
                near[b].append(a)
        out, seen = [], set()
        for x in nodes:
            todo, one = [x], set()
            while todo:
                y = todo.pop()
                if y not in seen:
                    seen.add(y)
                    one.add(y)
                    todo += near[y]
            out += [one] if one else []
        return out

    def node(members, birth):
        now, stability = set(members), 0.0
        for h in reversed(heights):
            inner = parts(now, h)
            if len(inner) > 1:
                big = [p for p in inner if len(p) >= m]
                stability += (len(now) - (len(big[0]) if len(big) == 1 else 0)) * (1 / max(h, least) - birth)
                if len(big) != 1:
                    return set(members), stability, [node(p, 1 / max(h, least)) for p in big]
                now = big[0]
        raise AssertionError

    def pick(members, stability, kids, root):
        inner = [pick(*k, False) for k in kids]
        total = sum(v for v, _ in inner)
        if (single or not root) and (not kids or eom and (most is None or len(members) <= most) and stability >= total):
            return stability, [members]
        return total, [x for _, found in inner for x in found]

    tops = [c for c in parts(set(range(n)), math.inf) if len(c) >= m]
    return {i: min(c) for t in tops for c in pick(*node(t, 0.0), len(tops) == 1)[1] for i in c}


@pytest.mark.parametrize("most", [500_000, 6])
def test_condensed_trees_at_every_height(spark, most):
    rng, rows, settings, want = np.random.default_rng(5), [], [], {}
    for g in range(20):
        n, edges = int(rng.integers(5, 70)), []
        order = rng.permutation(n)
        for k in range(1, n):
            if g % 5 < 4 or rng.random() > 0.1:  # some have several roots
                w = float(rng.choice([rng.random() * 10, rng.integers(0, 4), rng.exponential(1.0)]))
                edges.append((int(order[k]), int(order[rng.integers(max(0, k - 6), k)]), w))
        one = (int(rng.integers(2, 7)), bool(rng.random() < 0.7), None if rng.random() < 0.6 else int(rng.integers(5, 30)), g % 4 == 3)
        rows += [(g, *e) for e in edges]
        settings.append((g, *one))
        want[g] = plain_clusters(n, edges, *one)
    got = {}
    asked = spark.createDataFrame(settings, "grp long, min_size int, eom boolean, max_size int, single boolean")
    for r in condense.clusters(spark.createDataFrame(rows, "grp long, a long, b long, weight double"), asked, most).collect():
        got.setdefault(r.grp, {})[r.member_id] = r.cluster_id
    assert {g: got.get(g, {}) for g in want} == want and sum(len(set(w.values())) for w in want.values()) > 50


@pytest.mark.parametrize(("selection", "max_size"), [("eom", None), ("leaf", None), ("eom", 40)])
def test_density_clusters(spark, selection, max_size):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, s, (n, 2)) for c, s, n in (((0, 0), 0.1, 120), ((3, 0), 1.0, 150), ((3.4, 0.2), 0.1, 60), ((9, 9), 2.5, 170))])
    rows = vectors(spark, x)
    edges = K.reachability_forest(rows, 5)
    got = {r.member_id: r.cluster_id for r in K.density_clusters(rows, edges, 8, selection, max_size).collect()}
    want = plain_clusters(500, [tuple(r) for r in edges.select("a", "b", "weight").collect()], 8, selection == "eom", max_size, False)
    assert got == {i: want.get(i, -1) for i in range(500)} and len(set(want.values())) > 1


def test_clusters_of_nothing(spark):
    rows = spark.createDataFrame([(1,), (2,)], "member_id long")
    edges = spark.createDataFrame([], "a long, b long, weight double")
    assert {r.cluster_id for r in K.density_clusters(rows, edges, 2).collect()} == {-1}
    few = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "member_id long, embedding array<double>")
    assert K.reachability_forest(few, 5).count() == 0 and K.knn(few.limit(0), 3).count() == 0
    assert [(r.member_id, r.neighbour_id) for r in K.knn(few, 3).orderBy("member_id").collect()] == [(1, 2), (2, 1)]


def test_subclusters_are_those_of_each_alone(spark, points):
    label = [0] * 140 + [4] * 120 + [-1] * 25 + [2] * 40
    rows = vectors(spark, points).join(spark.createDataFrame(list(enumerate(label)), "member_id long, cluster_id int"), "member_id")
    got = {r.member_id: r.cluster_id for r in K.subcluster(rows, 0.5, 4, 6).collect()}
    new = 5
    for c in (0, 4):
        own = rows.where(F.col("cluster_id") == c)
        alone = {r.member_id: r.cluster_id for r in K.density_clusters(own, K.reachability_forest(own, 4), 6).collect()}
        names = sorted(set(alone.values()) - {-1}, key=lambda k: (-sum(v == k for v in alone.values()), k))
        known = {k: c if p == 0 else new + p - 1 for p, k in enumerate(names)}
        new += max(0, len(names) - 1)
        assert {i: known.get(k, c) for i, k in alone.items()} == {i: got[i] for i in alone} and len(names) > 1
    assert all(got[i] == c for i, c in enumerate(label) if c in (-1, 2))


def test_search_shares_its_work(spark, points):
    from eligo.operators import metrics

    rows = vectors(spark, points)
    settings = K.draw_settings(len(points), 20, 1, {"min_cluster_size": (0.02, 0.1), "max_cluster_size": (0.3, 0.9)})
    got = {r.trial: r for r in K.search_clustering(rows, settings, allow_single=False).collect()}
    assert len(got) == 20 and max(r.score for r in got.values()) > 0.5
    for s in settings[:3]:
        edges = K.reachability_forest(rows, s["min_samples"], s["alpha"])
        one = K.density_clusters(rows, edges, s["min_cluster_size"], s["selection"], s["max_cluster_size"])
        score = metrics.silhouette(rows.join(one.withColumn("cluster_id", F.col("cluster_id").cast("int")), "member_id")).first()[0]
        assert got[s["trial"]].score == pytest.approx(K.clustering_score(one, score))


def test_medoids_by_bounds(spark, points, monkeypatch):
    """Least sums as by all pairs; on clusters with a core two fifths of the members are never summed."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 1, (300, 3)) * rng.exponential(2, (300, 1)), rng.normal(20, 1, (200, 3)), np.tile([[5.0, 5, 5]], (9, 1)), [[1.0, 2, 3]]])
    label = [0] * 300 + [-1] * 200 + [3] * 9 + [4]
    rows = spark.createDataFrame([(i, c, [float(v) for v in p]) for i, (c, p) in enumerate(zip(label, x))], "member_id long, cluster_id int, embedding array<double>")
    asked = []
    sums = K._sums
    monkeypatch.setattr(K, "_sums", lambda rows, some, block: (asked.append(some.count()), sums(rows, some, block))[1])
    got = {r.cluster_id: r.member_id for r in K.cluster_medoid(rows, block=64).collect()}
    d, want = far(x), {}
    for c in set(label):
        own = [i for i, k in enumerate(label) if k == c]
        want[c] = min(own, key=lambda i: (round(d[i, own].sum(), 9), i))
    assert got == want and asked[-1] < 0.6 * len(x)
    assert {r.cluster_id: r.member_id for r in K.cluster_medoid(rows).collect()} == want
    assert K.cluster_medoid(rows.limit(0)).count() == 0


def test_silhouette_sends_a_row_a_dozen_times(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 6))
    x[100:140] = x[7]  # equal rows
    label = rng.integers(-1, 4, size=900)
    rows = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))], "member_id long, embedding array<double>, cluster_id int")
    d = blocks.exact_all(x, x)
    want = []
    for i in range(900):
        near = {c: d[i, label == c].sum() / ((label == c).sum() - (c == label[i])) for c in set(label.tolist())}
        a, b = near.pop(label[i]), min(near.values())
        want.append((b - a) / max(a, b))
    monkeypatch.setattr(blocks, "BLOCK", 16)
    seen, pairs = [], blocks.self_pairs
    monkeypatch.setattr(blocks, "self_pairs", lambda df, keys, fn, schema, block=blocks.BLOCK: seen.append(block) or pairs(df, keys, fn, schema, block))
    assert metrics.silhouette(rows).first()[0] == pytest.approx(np.mean(want), abs=1e-12)
    many = rows.selectExpr("5L AS grp", "member_id", "cast(cluster_id AS long) AS cluster_id")
    assert metrics.silhouettes(rows, many.where("cluster_id <> -1"), [5]).first()["silhouette"] == pytest.approx(np.mean(want), abs=1e-12)
    assert seen == [75, 75]  # and not 16


def test_nearest_orders_nothing_beyond_its_reach(monkeypatch):
    """A row with a reach needs no selection among all others; results are those of all distances, ties to the smaller id."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(700, 8)), rng.integers(0, 2, (300, 8))])
    ids = rng.permutation(1000)
    d = blocks.exact_all(x, x)
    d[np.arange(1000), np.arange(1000)] = np.inf
    for scale in (1.0, 1e-15, 1e15):
        want = {int(ids[i]): [int(ids[j]) for j in np.lexsort((ids, d[i] * scale))[:5]] for i in range(1000)}
        got = blocks.nearest(ids, x * scale, ids, x * scale, 5, tile=(256, 300))
        assert got.groupby("member_id")["neighbour_id"].agg(list).to_dict() == want
    assert blocks.nearest(ids, x, ids, x, 1, skip_self=False)["distance"].max() == 0
    reach = np.sort(d, axis=1)[:, 4]
    want = blocks.nearest(ids, x, ids, x, 5)
    monkeypatch.setattr(np, "partition", None)
    got = blocks.nearest(ids, x, ids, x, 5, reach)
    assert got.sort_values(["member_id", "neighbour_id"]).to_numpy().tolist() == want.sort_values(["member_id", "neighbour_id"]).to_numpy().tolist()
