"""Model steps rewritten for large tables: against plain forms of the same work."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.functions import quantiles, ranks
from millwright.operators import dq
from millwright.operators.ml import cluster, forest, iforest


def test_iforest_levels_are_the_trees():
    """Rows going down all trees at once meet the leaves that a walk node by node meets."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 3))
    x[7, 1], x[8, 2] = np.nan, np.inf
    trees = []
    for _ in range(9):
        feat, thr, left, right, size = iforest._grow(rng.normal(size=(64, 3)), rng, 6)
        trees.append((feat, thr, left, right, [iforest.c_factor(s) for s in size]))
    want = np.zeros(len(x))
    for feat, thr, left, right, c in trees:
        for i, row in enumerate(x):
            node = depth = 0
            while feat[node] >= 0:
                node, depth = left[node] if row[feat[node]] < thr[node] else right[node], depth + 1
            want[i] += depth + c[node]
    assert np.allclose(iforest._path_lengths(x.T, *iforest._levels(trees, 6)), want / 9, rtol=1e-12)


def test_iforest_keeps_the_named_columns(spark):
    df = spark.range(300).select("id", F.concat(F.lit("M"), F.col("id") % 3).alias("m"), F.sin("id").alias("a"), F.when(F.col("id") % 7 > 0, F.cos("id")).alias("b"))
    whole = {r["id"]: r["anomaly_score"] for r in iforest.fit_score(df, ["a", "b"], ["id"]).collect()}
    named = iforest.fit_score(df, ["a", "b"], ["id"], keep=["m", "id"])
    assert named.columns == ["m", "id", "anomaly_score", "anomaly"]
    assert {r["id"]: r["anomaly_score"] for r in named.collect()} == whole
    assert iforest.fit_score(df.where("id < 0"), ["a", "b"], ["id"], keep=["m"]).columns == ["m", "anomaly_score", "anomaly"]


def test_forest_sums_are_the_trees():
    """Sums by number of trees and depth against walking every tree."""
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, forest.BINS, size=(900, 3)).astype(np.uint8), rng.normal(size=900)
    made = [forest.grow(x, y, rng.integers(1, 3, size=900).astype(float), 5, 2) for _ in range(7)]
    trees = forest.Trees(*(np.stack([m[k] for m in made]) for k in range(4)))

    def walk(t, row, depth):
        node = 0
        for _ in range(depth):
            if trees.feature[t, node] < 0:
                break
            node = 2 * node + 1 + (row[trees.feature[t, node]] > trees.bin[t, node])
        return trees.value[t, node]

    for (n, depth), got in forest.tree_sums(trees.levels(), x, {(7, 5), (3, 5), (4, 2), (1, 0)}).items():
        assert np.allclose(got, [sum(walk(t, row, depth) for t in range(n)) for row in x])


@pytest.fixture(scope="module")
def numbers(spark):
    """Rows with a lone large label, equal values and few values in a column."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 3))
    x[:, 2] = np.round(x[:, 2])
    x[::7, 1] = 0.25
    y = np.where(x[:, 0] > 0.3, 2.0, 0.0) + x[:, 1] + 0.1 * rng.normal(size=6000)
    y[17] = 1e7
    return spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "i int, a double, b double, c double, y double").cache()


def test_forest_draws_from_every_row(spark):
    """A tree draws as many rows as there are, also above 65,536 rows."""
    bags = forest._bags(spark.range(80_000).withColumn("y", F.lit(0.0)), [], "y", ["id"], 3, 1).groupBy("tree").agg(F.sum("w").alias("w")).collect()
    assert len(bags) == 3 and all(abs(r["w"] - 80_000) < 5 * 80_000**0.5 for r in bags)


def test_forest_cuts_are_of_all_rows(numbers, monkeypatch):
    """Cut points are order statistics of the whole table, however often a gap is divided."""
    features = ["a", "b", "c"]
    x = np.array([[r[f] for f in features] for r in numbers.collect()])
    want = np.quantile(x, np.arange(1, 64) / 64, axis=0, method="inverted_cdf").T
    for few, parts, held in ((1 << 13, 1 << 12, 1 << 20), (5, 16, 700), (0, 3, 100)):
        for name, value in (("FEW", few), ("PARTS", parts), ("HELD", held)):
            monkeypatch.setattr(ranks, name, value)
        assert (forest.cut_points(numbers.repartition(5), features, 6000) == want).all()
    odd = np.array([-np.inf, -2.0, -1e-300, 0.0, 5e-324, 3.0, np.inf])
    assert (np.diff(ranks.places(odd).astype(object)) > 0).all() and (ranks.doubles(ranks.places(odd)) == odd).all() and ranks.places(np.array([-0.0])) == ranks.places(np.array([0.0]))


def test_forest_weights_are_the_bags(spark):
    """The weights drawn block by block are those of Spark's own hash."""
    df = spark.range(400).select((F.col("id") * 7919 - 900).alias("id"), F.lit(1.0).alias("y"))
    h = np.array([r[0] for r in df.select(F.xxhash64(F.lit(5), "id")).collect()])
    draws = forest._Draws(400, 5)
    want = {(r["tree"], r["h"]): r["w"] for r in forest._bags(df, [], "y", ["id"], 30, 5).collect()}
    assert {(t, int(h[i])): w for t in range(30) for i, w in zip(*draws.weights(draws.block(h), t))} == want


def test_forest_grown_by_counts_is_the_forest(numbers, monkeypatch):
    """Nodes split from counts of all tasks, and the rest in tasks, give the trees that one task a bag gives, for any partitioning."""
    features, wanted = ["a", "b", "c"], {1: (4, 6), 2: (3, 5), 40: (5, 4)}
    whole, cuts = forest._grown(numbers, features, "y", ["i"], wanted, 3)
    for local, nodes, sent, block, parts in ((1500, 1 << 13, 1 << 27, 1 << 15, 3), (300, 7, 2000, 1000, 5), (0, 1 << 13, 1, 400, 2)):
        for name, value in (("LOCAL_ROWS", local), ("HELD_NODES", nodes), ("SENT_ROWS", sent), ("BLOCK_ROWS", block)):
            monkeypatch.setattr(forest, name, value)
        found, again = forest._grown(numbers.repartition(parts), features, "y", ["i"], wanted, 3)
        assert (again == cuts).all()
        for leaf, (trees, depth) in wanted.items():
            a, b = whole[leaf], found[leaf]
            assert a.feature.shape == b.feature.shape == (trees, (1 << depth + 1) - 1)
            assert (a.feature == b.feature).all() and (a.bin == b.bin)[a.feature >= 0].all()
            assert np.allclose(a.value, b.value, rtol=1e-9, atol=1e-9) and np.allclose(a.gain, b.gain, rtol=1e-6)
    monkeypatch.setattr(forest, "LOCAL_ROWS", 900)
    one, two = (forest._grown(numbers.repartition(k), features, "y", ["i"], wanted, 3)[0] for k in (1, 6))
    assert all((getattr(one[leaf], c) == getattr(two[leaf], c)).all() for leaf in wanted for c in ("feature", "bin", "value", "gain"))


def test_forest_of_few_rows(spark):
    """No tree is without rows: one whose bag is empty takes each row once."""
    df = spark.createDataFrame([(1, 0.5, 4.0), (2, 1.5, 4.0)], "i int, a double, y double")
    trees = forest._grown(df, ["a"], "y", ["i"], {1: (60, 3)}, 1)[0][1]
    assert trees.value[:, 0].tolist() == [4.0] * 60
    with pytest.raises(ValueError, match="no rows"):
        forest.fit(df.where("i > 5"), ["a"], "y", ["i"], (3, 2, 1))


def test_kmeans_blocks_hold_the_rows(spark, monkeypatch):
    """Blocks of any size give the sums of the rows themselves."""
    df = spark.range(500).select(F.sin("id").alias("x0"), (F.col("id") % 11).cast("double").alias("x1"))
    z = cluster._units(df, ["x0", "x1"])
    want = tuple(z.agg(F.sum("c0"), F.sum("c1"), F.count("c0")).first())
    for size in (7, 2048):
        monkeypatch.setattr(cluster, "BLOCK_ROWS", size)
        blocks = cluster._blocks(z, 2)
        assert cluster._blocks(blocks, 2) is blocks
        got = cluster._passed(blocks, 2, lambda x: {(0, i): v for i, v in enumerate((*x.sum(axis=0), len(x)))})
        assert (got[0, 0], got[0, 1], got[0, 2]) == want
        u = [v for r in blocks.collect() for v in np.frombuffer(r["u"]).reshape(cluster.SEED_ROUNDS, -1).T.tolist()]
        assert len(u) == 500 and all(0 <= v < 1 for row in u for v in row)


def test_pca_moments_are_those_of_the_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 3)) * [1, 100, 1e-3] + [5, -1e6, 0]
    df = spark.createDataFrame([(int(i % 3 == 0), *map(float, r)) for i, r in enumerate(x)], "_half int, a double, b double, c double").repartition(5)
    got = cluster._moments(df, ["a", "b", "c"])
    for h in (0, 1):
        mine = x[[i for i in range(600) if (i % 3 == 0) == h]]
        n, mean, products = got[h]
        assert n == len(mine) and np.allclose(mean, mine.mean(axis=0)) and np.allclose(products / n, np.cov(mine.T, bias=True), rtol=1e-9, atol=1e-9)


def test_quantiles_read_on_only_the_open_gaps(spark, monkeypatch):
    """After the first counts the search reads a table of the values in the gaps, and finds the same."""
    tables = []
    monkeypatch.setattr(quantiles, "written", lambda df, name: tables.append(df.cache()) or tables[-1])
    df = spark.range(4000).select((F.xxhash64("id") % 1000003).cast("double").alias("v"), (F.col("id") % 3).cast("double").alias("w"))
    x = np.array([tuple(r) for r in df.collect()])
    got = quantiles.exact_quantiles(df, {"v": F.col("v"), "w": F.col("w")}, [0.1, 0.5, 0.93], accuracy=50)
    for i, n in enumerate("vw"):
        assert got[n] == pytest.approx(list(np.quantile(x[:, i], [0.1, 0.5, 0.93])), rel=1e-12)
    assert len(tables) == 1 and tables[0].count() < 2000


def test_report_searches_quantiles_once(spark, monkeypatch):
    rows = [(f"M{i % 3}", f"2020-01-{1 + i % 28:02d}", "AB"[i % 2], 100.0 + i % 7, 5.0 + i % 5, 80.0 + i * i % 13, i) for i in range(200)]
    df = spark.createDataFrame(rows, "machine_id string, shift_date string, shift string, total_count double, reject_count double, temp_c double, k long")
    df = df.withColumn("shift_date", F.to_date("shift_date")).withColumn("good_count", F.col("total_count") - F.col("reject_count"))
    asked = []
    whole = dq.exact_quantiles
    monkeypatch.setattr(dq, "exact_quantiles", lambda *a, **k: asked.append(a[2]) or whole(*a, **k))
    report = {r["check"]: r["detail"] for r in dq.report(df, ["shift_date", "shift", "k"], ["k"]).collect()}
    assert asked == [[0.25, 0.75, 0.9]]
    frame = df.drop("k")
    assert report["IQR OUTLIER"] == f"{dq.iqr(frame).agg(F.sum('hits')).first()[0]} hits"
    assert report["ASSOCIATION RULE MINING"].startswith(f"{dq.assoc_rules(frame).count()} rules")
