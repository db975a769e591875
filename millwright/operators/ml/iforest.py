"""Isolation forest (Liu, Ting, Zhou 2008) on Spark.

* Sampling, the same at every size: tree t takes the psi rows of least hash of (t, row).
  Only hashes below about 3 psi / n leave a row at all, so a tree's window sees some
  hundred rows however many there are; rows that are equal in key and features
  share their hash and are one row with a count from the map side on.
* Fitting: ``groupBy(tree).applyInPandas`` grows one small tree per group
  (psi rows, height limit ceil(log2 psi)).
* Scoring: the forest (<= trees x (2 psi - 1) nodes, a fixed bound) is
  broadcast, laid out level by level, and rows go down all trees at once in blocks
  of Arrow batches (``mapInArrow``); other columns pass through as they are.
* The anomaly cut is the exact (1 - contamination) quantile of the scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Optional

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.functions.common import ensure_parallel
from millwright.functions.quantiles import exact_quantiles
from millwright.session import written

N_TREES = 100
PSI = 256
CONTAMINATION = 0.08
SEED = 42
EULER = 0.5772156649015329
BLOCK = 512  # rows that go down all trees at once
FEW_ROWS = 10_000  # scored by one task


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int):
    """Grow one isolation tree; returns flat arrays (feature, threshold, left, right, size)."""
    feat, thr, left, right, size = [], [], [], [], []

    def node(idx: np.ndarray, depth: int) -> int:
        me = len(feat)
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(len(idx))
        if depth >= limit or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            return me
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        mask = sub[:, f] < t
        feat[me], thr[me] = f, t
        left[me] = node(idx[mask], depth + 1)
        right[me] = node(idx[~mask], depth + 1)
        return me

    node(np.arange(len(x)), 0)
    return feat, thr, left, right, size


def _levels(forest: list, limit: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The trees' nodes level by level, as ``limit`` pairs (feature, threshold) of (tree, place), and the path length by (tree, place) at the bottom.

    Below the node of place p are the places 2p (right) and 2p + 1 (left); what lies below a leaf has its path length.
    """
    levels = [(np.zeros((len(forest), 1 << k), np.int64), np.zeros((len(forest), 1 << k))) for k in range(limit)]
    lengths = np.zeros((len(forest), 1 << limit))
    for t, (feat, thr, left, right, leaf_c) in enumerate(forest):
        todo = [(0, 0, 0)]
        while todo:
            node, k, place = todo.pop()
            if feat[node] < 0:
                lengths[t, place << limit - k : place + 1 << limit - k] = k + leaf_c[node]
                continue
            levels[k][0][t, place], levels[k][1][t, place] = feat[node], thr[node]
            todo += [(left[node], k + 1, 2 * place + 1), (right[node], k + 1, 2 * place)]
    return levels, lengths


def _path_lengths(x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], lengths: np.ndarray) -> np.ndarray:
    """Mean path length over all trees of each row of ``x``, given as (feature, row)."""
    n_trees, n = len(lengths), x.shape[1]
    out = np.empty(n)
    for at in range(0, n, BLOCK):
        block = np.ascontiguousarray(x[:, at : at + BLOCK])
        rows = np.arange(block.shape[1])
        flat, place = block.ravel(), np.repeat(np.arange(n_trees)[:, None], len(rows), axis=1)
        for feat, thr in levels:
            value = (feat * len(rows)).ravel().take(place)
            value += rows
            less = flat.take(value) < thr.ravel().take(place)
            place += place
            place += less
        out[at : at + BLOCK] = np.mean(lengths.ravel().take(place), axis=0)
    return out


def tree_samples(base: DataFrame, features: list[str], key: list[str], n: int, n_trees: int = N_TREES, m: int = PSI, seed: int = SEED) -> DataFrame:
    """(_tree, features): of each tree the ``m`` rows of least hash of (tree, row) among the ``n`` rows of ``base``.

    A row's identity is its key and feature values, so rows that share a key still hash apart and equal rows
    are interchangeable: they come as one row with a count, of which a tree takes as many copies as it has room for.
    """
    keep = min(1.0, 3.0 * m / n)
    ident = F.xxhash64(F.lit(seed), *[F.col(k).cast("string") for k in key], *[F.col(f) for f in features])
    draw = lambda t: F.pmod(F.xxhash64(F.lit(seed + 1), t, F.col("_id")), F.lit(1 << 52)) / float(1 << 52)
    rows = base.select(ident.alias("_id"), *features)
    # generated, hashed and filtered in one compiled loop: no (tree, row) but the few below leaves it
    cand = rows.select(F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("_tree"), "_id", *features).where(draw(F.col("_tree")) < keep)
    cand = cand.groupBy("_tree", draw(F.col("_tree")).alias("_u"), *features).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("_tree").orderBy("_u", *features).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cand = cand.withColumn("_room", F.lit(m) - (F.sum("_c").over(w) - F.col("_c"))).where(F.col("_room") > 0)
    copies = F.explode(F.sequence(F.lit(1), F.least("_c", "_room").cast("int")))
    return cand.select(F.col("_tree").cast("long").alias("_tree"), *features, copies.alias("_copy")).drop("_copy")


def fit_score(df: DataFrame, features: list[str], key: list[str], n_trees: int = N_TREES, psi: int = PSI,
              contamination: float = CONTAMINATION, seed: int = SEED, fill: Optional[dict] = None,
              keep: Optional[list[str]] = None) -> DataFrame:
    """Score every row: adds ``anomaly_score`` (higher = more anomalous) and ``anomaly`` to its columns (or those in ``keep``).

    Rows whose features are all NULL are dropped; remaining NULLs are filled
    with the exact column median (as the reference does before fitting).
    """
    spark = df.sparkSession
    feats = [F.col(f).cast("double") for f in features]
    any_present = feats[0].isNotNull()
    for f in feats[1:]:
        any_present = any_present | f.isNotNull()
    base = df.where(any_present)
    rows, *nulls = base.agg(F.count(F.lit(1)), *[F.count(F.when(f.isNull(), 1)) for f in feats]).first()
    if fill is None:
        need = [n for n, c in zip(features, nulls) if c]
        fill = {}
        if need:
            med = exact_quantiles(base, {n: F.col(n) for n in need}, [0.5])
            fill = {n: med[n][0] for n in need}
    base = base.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(fill.get(f) or 0.0)) for f in features})
    carried = base.columns if keep is None else keep
    if rows == 0:
        return base.select(*carried, F.lit(None).cast("double").alias("anomaly_score"), F.lit(None).cast("boolean").alias("anomaly"))
    m = min(psi, rows)
    limit = int(math.ceil(math.log2(max(m, 2))))
    sample = tree_samples(base, features, key, rows, n_trees, m, seed)

    schema = T.StructType([
        T.StructField("_tree", T.LongType()), T.StructField("feature", T.ArrayType(T.IntegerType())),
        T.StructField("threshold", T.ArrayType(T.DoubleType())), T.StructField("left", T.ArrayType(T.IntegerType())),
        T.StructField("right", T.ArrayType(T.IntegerType())), T.StructField("size", T.ArrayType(T.LongType())),
    ])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["_tree"].iloc[0])
        rng = np.random.default_rng([seed, t])
        x = pdf[features].to_numpy(dtype=np.float64)
        x = x[np.lexsort(x.T[::-1])]  # rows of a group come in any order
        f, th, l, r, s = _grow(x, rng, limit)
        return pd.DataFrame({"_tree": [t], "feature": [f], "threshold": [th], "left": [l], "right": [r], "size": [s]})

    forest_rows = sample.groupBy("_tree").applyInPandas(build, schema).collect()
    forest = [(np.asarray(r["feature"], dtype=np.int64), np.asarray(r["threshold"], dtype=np.float64),
               np.asarray(r["left"], dtype=np.int64), np.asarray(r["right"], dtype=np.int64),
               np.asarray([c_factor(v) for v in r["size"]], dtype=np.float64))
              for r in sorted(forest_rows, key=lambda r: r["_tree"])]
    held = spark.sparkContext.broadcast(_levels(forest, limit))
    cn = c_factor(m)
    inner = base.select(*dict.fromkeys([*carried, *features, *(key if rows <= FEW_ROWS else [])]))
    out_schema = T.StructType([inner.schema[c] for c in carried] + [T.StructField("anomaly_score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, lengths = held.value
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features])
            scores = np.power(2.0, -_path_lengths(x, levels, lengths) / cn) if cn > 0 else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(scores)], [*carried, "anomaly_score"])

    # Python scoring is the costly stage: make sure it runs on every core even when the
    # input arrived in fewer splits than the cluster's parallelism (no-op at scale); few rows are one file, by key
    spread = inner.coalesce(1).sortWithinPartitions(*key) if rows <= FEW_ROWS else ensure_parallel(inner)
    scored = written(spread.mapInArrow(score, out_schema), "iforest-scores")  # read by the cut and the output
    cut = exact_quantiles(scored, {"score": F.col("anomaly_score")}, [1.0 - contamination])["score"][0]
    return scored.withColumn("anomaly", F.col("anomaly_score") > F.lit(cut))
