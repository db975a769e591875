"""Model operators against brute force, planted cases and repartitioned inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.functions.components import component_of
from millwright.operators import forecast as fc
from millwright.operators.ml import cluster, dbscan, forest, iforest
from millwright.sources import testdata as td


# --- forest

def _brute_split(x, y, w, leaf):
    """(gain, feature, bin) of the best split of one node."""
    best = (1e-12, -1, 0)
    base = (w * y).sum() ** 2 / w.sum()
    for f in range(x.shape[1]):
        for b in range(forest.BINS - 1):
            left = x[:, f] <= b
            if w[left].sum() >= leaf and w[~left].sum() >= leaf:
                gain = (w * y)[left].sum() ** 2 / w[left].sum() + (w * y)[~left].sum() ** 2 / w[~left].sum() - base
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, f, b)
    return best


def test_trees_by_brute_force():
    rng = np.random.default_rng(3)
    for leaf in (1, 3):
        x, y, w = rng.integers(0, 12, (80, 3)).astype(np.uint8), rng.normal(size=80), rng.integers(1, 4, 80).astype(float)
        y += (x[:, 1] > 5) * 2
        feature, cut, value, gain = forest.grow(x, y, w, 4, leaf)
        rows = {0: np.arange(80)}
        for node in range(15):
            mine = rows.get(node)
            if mine is None:
                continue
            assert value[node] == pytest.approx(np.average(y[mine], weights=w[mine]))
            found, f, b = _brute_split(x[mine], y[mine], w[mine], leaf)
            assert feature[node] == f
            if f >= 0:
                assert cut[node] == b
                left = x[mine, f] <= b
                rows[2 * node + 1], rows[2 * node + 2] = mine[left], mine[~left]
        assert (feature[15:] == -1).all()


@pytest.fixture(scope="module")
def feat(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 3))
    y = np.where(x[:, 0] > 0.3, 2.0, 0.0) + x[:, 1] ** 2 + 0.1 * rng.normal(size=3000)
    return spark.createDataFrame([(f"M{i % 7}", i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "m string, i int, a double, b double, c double, y double").cache()


def test_forest_learns_and_is_the_same_for_any_partitioning(feat):
    train, test = feat.where("i % 4 > 0"), feat.where("i % 4 = 0")
    errors = set()
    for parts in (1, 7):
        model = forest.fit(train.repartition(parts), ["a", "b", "c"], "y", ["m", "i"], (30, 6, 2))
        errors.add(forest.mean_error(model.transform(test), "y"))
    assert len(errors) == 1
    mean = train.agg(F.avg("y")).first()[0]
    assert errors.pop() < 0.4 * forest.mean_error(test.withColumn("p", F.lit(mean)), "y", "p")
    shares = dict(model.importances())
    assert sum(shares.values()) == pytest.approx(1) and shares["c"] < 0.1 < min(shares["a"], shares["b"])


def test_search_is_fitting_one_by_one(feat):
    part, fold = feat.where("i % 4 > 0"), feat.where("i % 4 = 0")
    settings = [(5, 2, 1), (12, 6, 1), (12, 3, 4), (3, 8, 4)]
    found = forest.search(part, fold, ["a", "b", "c"], "y", ["m", "i"], settings)
    again = forest.search(part.repartition(5), fold.repartition(3), ["a", "b", "c"], "y", ["m", "i"], settings)
    assert found == again
    for s, e in zip(settings, found):
        model = forest.fit(part, ["a", "b", "c"], "y", ["m", "i"], s)
        assert e == pytest.approx(forest.mean_error(model.transform(fold), "y"), abs=2e-9)


def test_bags_are_poisson_and_bounded(feat, monkeypatch):
    bags = forest._bags(feat, ["a"], "y", ["m", "i"], 20, 1).groupBy("tree").agg(F.sum("w").alias("w"), F.max("w").alias("m")).collect()
    assert len(bags) == 20 and all(abs(r["w"] - 3000) < 5 * 3000**0.5 and r["m"] <= 12 for r in bags)
    monkeypatch.setattr(forest, "ROWS_PER_TREE", 500)
    bags = forest._bags(feat, ["a"], "y", ["m", "i"], 20, 1).groupBy("tree").agg(F.sum("w").alias("w")).collect()
    assert all(abs(r["w"] - 500) < 5 * 500**0.5 for r in bags)


def test_rate_queries(spark, sf):
    """Tuning: distinct settings, the best one fitted; better than the mean; forecasts for every machine."""
    p = td.plant_rows(spark, sf)
    feat = fc.rate_features(p)
    model, mae, rows = fc.rate_tuning(feat, n_trials=4)
    assert len({r[:3] for r in rows}) == 4 and all(np.isfinite(r[3]) for r in rows)
    train, test = fc._split(feat)
    mean = train.agg(F.avg("target")).first()[0]
    assert mae < 1.05 * forest.mean_error(test.withColumn("p", F.lit(mean)), "target", "p")
    assert sum(v for _, v in fc.feature_importance(model, top=99)) == pytest.approx(1)
    assert fc.tuning_settings(10) == fc.tuning_settings(10) and len(fc.tuning_settings(10**6)) == 121 * 10 * 6
    _, again, same = fc.rate_tuning(feat.repartition(9), n_trials=4)
    assert again == mae and same == rows


# --- isolation forest

def test_planted_outliers_rank_first(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(1500)] + [(2000 + i, 9.0 + i, -9.0, 9.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    scored = iforest.fit_score(df, ["a", "b", "c"], ["id"]).orderBy(F.desc("anomaly_score")).limit(5).collect()
    assert {r["id"] for r in scored} == {2000, 2001, 2002, 2003, 2004} and all(r["anomaly"] for r in scored)
    again = iforest.fit_score(df.repartition(7), ["a", "b", "c"], ["id"]).orderBy(F.desc("anomaly_score")).limit(5).collect()
    assert [(r["id"], r["anomaly_score"]) for r in again] == [(r["id"], r["anomaly_score"]) for r in scored]


def test_one_sampling_scheme_at_every_size(spark):
    """Around the size where disjoint samples once began, two rows more change next to nothing; trees hold psi rows each."""
    big = spark.range(25601).select(F.col("id"), F.sin("id").alias("a"))
    sets = []
    for n in (25599, 25601):
        got = iforest.tree_samples(big.where(f"id < {n}"), ["a"], ["id"], n).collect()
        by = {}
        for r in got:
            by.setdefault(r["_tree"], set()).add(r["a"])
        assert len(by) == 100 and len(got) == 25600
        sets.append(by)
    shared = sum(len(sets[0][t] & sets[1][t]) for t in range(100))
    assert shared > 0.99 * 25600


def test_equal_rows_are_bounded_in_a_window(spark):
    """A third of all rows alike: a tree gets at most psi rows, equal ones with their multiplicity."""
    df = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(-1)).otherwise(F.col("id")).alias("id"), F.when(F.col("id") < 1000, 7.0).otherwise(F.col("id") / 1.0).alias("a"))
    got = iforest.tree_samples(df, ["a"], ["id"], 3000, n_trees=60, m=64).groupBy("_tree").agg(F.count(F.lit(1)).alias("n")).collect()
    assert all(r["n"] <= 64 for r in got) and len(got) == 60


# --- KMeans

def test_kmeans_by_definition_and_any_partitioning(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 2)), rng.normal(size=(300, 2)) + 8, rng.normal(size=(50, 2)) + [0, 15], [[40.0, 40.0]]])
    df = spark.createDataFrame([(float(a), float(b), 3.0) for a, b in x] + [(None, 1.0, 3.0)], "a double, b double, flat double")
    results = {tuple(cluster.kmeans_far(df.repartition(n), ["a", "b", "flat"]).first()) for n in (1, 3, 8)}
    assert len(results) == 1
    rows, k, far, ok = results.pop()
    assert (rows, k, ok) == (651, 3, True)
    num = df.select(*[F.col(c).alias(f"x{i}") for i, c in enumerate(["a", "b", "flat"])]).dropna()
    z = cluster._units(num, ["x0", "x1", "x2"])
    centers = np.array(cluster.lloyd(z, 3, cluster.seed_centers(z, 3, 3)), float)
    pts = np.array([[r["c0"], r["c1"], r["c2"]] for r in z.collect()], float)
    d = ((pts[:, None] - centers[None]) ** 2).sum(axis=2)
    near = d.argmin(axis=1)
    for j in range(3):  # a fixed point: every center is the mean of its rows
        assert np.allclose(pts[near == j].mean(axis=0), centers[j], atol=1.0)
    dist = np.sqrt(d.min(axis=1))
    assert far == (dist > dist.mean() + 2 * dist.std()).sum() > 0


def test_kmeans_equal_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 40, "a double, b double")
    assert tuple(cluster.kmeans_far(df, ["a", "b"]).first()) == (40, 3, 0, True)
    assert cluster.kmeans_far(df.limit(5), ["a", "b"]).first()["ok"] is False


def test_pca_drift_by_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4))
    x[200:, 1] = 3 * x[200:, 0]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "o int, a double, b double, c double, d double")
    r = cluster.pca_drift(df, ["a", "b", "c", "d"], "o").first()
    want = []
    for half in (x[:200], x[200:]):
        ev = np.sort(np.linalg.eigvalsh(np.corrcoef(half.T)))[::-1]
        want.append(ev[:3].sum() / ev.sum())
    assert r["pca_var_early"] == pytest.approx(want[0]) and r["pca_var_late"] == pytest.approx(want[1]) and r["drift_score"] == pytest.approx(abs(want[0] - want[1]))


# --- DBSCAN

def _brute_dbscan(pts, eps, least):
    """(core, border, noise, clusters)."""
    x = np.array(pts, float)
    sd = x.std(axis=0)
    z = np.where(sd > 0, (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1), 0)
    near = ((z[:, None] - z[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    seen, n = np.zeros(len(x), bool), 0
    for i in np.flatnonzero(core):
        if not seen[i]:
            n, stack, seen[i] = n + 1, [i], True
            while stack:
                more = np.flatnonzero(near[stack.pop()] & core & ~seen)
                seen[more] = True
                stack += more.tolist()
    border = ~core & near[:, core].any(axis=1)
    return int(core.sum()), int(border.sum()), int((~core & ~border).sum()), n


def _scatter(seed):
    rng = np.random.default_rng(seed)
    wave = np.linspace(-8, 8, 300)
    parts = [rng.normal(size=(150, 2)), rng.normal(size=(200, 2)) * 0.05 + 3, np.repeat([[5.0, 5.0]], 40, 0), rng.uniform(-8, 8, size=(150, 2)), np.stack([wave, np.sin(wave) * 3 + 6], 1)]
    return np.concatenate(parts)


@pytest.mark.parametrize("seed,eps", [(0, 0.03), (1, 0.08), (2, 0.15)])
def test_dbscan_by_brute_force(spark, seed, eps):
    pts = _scatter(seed)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts] + [(None, 1.0), (float("nan"), 2.0), (3.0, float("inf"))], "a double, b double")
    got = dbscan.summary(df, "a", "b", eps).first()
    assert tuple(got) == (len(pts), *_brute_dbscan(pts, eps, 5), True)


def test_dbscan_hot_cell_is_cut(spark, monkeypatch):
    """One cell with a third of all distinct points: many parts, the same result."""
    monkeypatch.setattr(dbscan, "PART_POINTS", 16)
    rng = np.random.default_rng(7)
    pts = np.concatenate([rng.uniform(0, 0.05, size=(400, 2)) + 0.1, rng.uniform(-6, 6, size=(800, 2))])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "a double, b double")
    points = dbscan.points_of(df, "a", "b", 0.08)
    assert points.groupBy("cx", "cy").count().agg(F.max("count")).first()[0] >= 400
    assert tuple(dbscan.summary(df, "a", "b", 0.08).first())[1:5] == _brute_dbscan(pts, 0.08, 5)


def test_dbscan_edges(spark):
    schema = "a double, b double"
    assert tuple(dbscan.summary(spark.createDataFrame([], schema), "a", "b").first()) == (0, None, None, None, None, False)
    same = spark.createDataFrame([(1.0, 1.0)] * 30, schema)
    assert tuple(dbscan.summary(same, "a", "b").first()) == (30, 30, 0, 0, 1, True)
    apart = spark.createDataFrame([(float(i), float(i * i)) for i in range(25)], schema)
    assert tuple(dbscan.summary(apart, "a", "b", eps=0.001).first()) == (25, 0, 0, 25, 0, True)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 300) if i % 100 != 99] + [(1000, 5), (7, 7), (2000, 2001)]
    got = {r["node"]: r["root"] for r in component_of(spark.createDataFrame(edges, "u int, v int").repartition(4)).collect()}
    want = {i: i // 100 * 100 for i in range(301) if i % 100} | {1000: 0, 2001: 2000}
    assert got == want
