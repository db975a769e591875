"""Rate forecast: target, lagged features, random forest, tuning, next-period forecast.

The model works at (machine, day) grain: the target is the day's scrap rate
(rejects / total, else downtime / planned), features are the previous day's
values for that machine (so no target ingredient leaks in), and the forecast
is the model applied to each machine's latest day to predict the next one.
The forest is ``ml/forest.py``; split, folds and bags are hashes of the key, so everything
is the same for any partitioning.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.common import num
from millwright.functions.resolve import find_col
from millwright.operators.ml import forest
from millwright.session import written

# Fixed values from the reference: forest defaults and search ranges.
DEFAULT_TREES, DEFAULT_DEPTH, DEFAULT_LEAF = 80, 6, 2
SEARCH = {"trees": (40, 160), "depth": (3, 12), "leaf": (1, 6)}
N_TRIALS = 20
SEED = 42
KEY = ["machine_id", "shift_date"]


def rate_target(df: DataFrame) -> DataFrame:
    """target = scrap_rate, else rejects / total, else downtime / planned (zero denominators NULL)."""
    cols = df.columns
    scrap = find_col(cols, "scrap_rate", exact_only=True)
    rej = find_col(cols, "reject_count", "rejects", "scrap_count")
    tot = find_col(cols, "total_count", "total_units", "produced_count")
    down = find_col(cols, "downtime_minutes", "downtime_min")
    plan = find_col(cols, "planned_time_min", "planned_minutes")
    if scrap:
        t = num(scrap)
    elif rej and tot:
        t = F.try_divide(num(rej), F.when(num(tot) != 0, num(tot)))
    elif down and plan:
        t = F.try_divide(num(down), F.when(num(plan) != 0, num(plan)))
    else:
        raise ValueError("no columns to build a rate target")
    return df.withColumn("target", t)


FEATURES = ["prev_target", "prev_planned", "prev_downtime", "prev_total", "prev_ideal", "prev_vibration", "prev_temp",
            "prev_current", "prev_rows"]


def rate_features(df: DataFrame) -> DataFrame:
    """(machine, day) grain target with the previous day's values as features; complete rows only."""
    daily = df.groupBy("machine_id", "shift_date").agg(
        F.try_divide(F.sum("reject_count"), F.when(F.sum("total_count") != 0, F.sum("total_count"))).alias("target"),
        F.sum("planned_time_min").alias("planned"), F.sum("downtime_minutes").alias("downtime"),
        F.sum("total_count").alias("total"), F.avg("ideal_rate").alias("ideal"), F.avg("vibration_rms").alias("vibration"),
        F.avg("temp_c").alias("temp"), F.avg("motor_current_a").alias("current"), F.count(F.lit(1)).cast("double").alias("rows"),
    )
    # window on the (machine, day) aggregate: a machine has at most one row per day here
    w = Window.partitionBy("machine_id").orderBy("shift_date")
    lagged = daily.select(
        "machine_id", "shift_date", "target",
        *[F.lag(c).over(w).alias(f"prev_{c}") for c in ("target", "planned", "downtime", "total", "ideal", "vibration", "temp", "current", "rows")],
    )
    return lagged.dropna(subset=["target", *FEATURES])


def _materialize(feat: DataFrame) -> DataFrame:
    """The feature table is read by every pass of a fit: compute it once (shared checkpoint dir)."""
    return written(feat, "rate-features")


def _split(df: DataFrame, train_pct: int = 75, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Rows dealt by a hash of their key: the same parts for any partitioning."""
    h = F.pmod(F.xxhash64(F.lit(seed), F.col("machine_id"), F.col("shift_date").cast("string")), F.lit(100))
    d = df.withColumn("_h", h)
    return d.where(F.col("_h") < train_pct).drop("_h"), d.where(F.col("_h") >= train_pct).drop("_h")


def _fit(df: DataFrame, setting: forest.Setting) -> forest.Forest:
    return forest.fit(df, FEATURES, "target", KEY, setting, SEED)


def rate_model(feat: DataFrame, trees: int = DEFAULT_TREES, depth: int = DEFAULT_DEPTH, leaf: int = DEFAULT_LEAF):
    """Random forest on the 75 % hash split; returns (model, test MAE)."""
    train, test = _split(_materialize(feat))
    model = _fit(train, (trees, depth, leaf))
    return model, forest.mean_error(model.transform(test), "target")


def tuning_settings(n_trials: int = N_TRIALS) -> list[forest.Setting]:
    """Distinct settings drawn with a fixed seed; as many as there are if fewer."""
    rng = random.Random(SEED)
    there = 1
    for lo, hi in SEARCH.values():
        there *= hi - lo + 1
    trials: set[forest.Setting] = set()
    while len(trials) < min(n_trials, there):
        trials.add((rng.randint(*SEARCH["trees"]), rng.randint(*SEARCH["depth"]), rng.randint(*SEARCH["leaf"])))
    return sorted(trials)


def rate_tuning(feat: DataFrame, n_trials: int = N_TRIALS):
    """Seeded random search over trees / depth / leaf: ``n_trials`` distinct settings, each judged on a
    key-hash fold of the training part; the best one is fitted on the whole part."""
    train, test = _split(_materialize(feat))
    part, fold = _split(train, seed=SEED + 1)
    settings = tuning_settings(n_trials)
    errors = forest.search(part, fold, FEATURES, "target", KEY, settings, SEED)
    best = _fit(train, min(zip(errors, settings))[1])
    return best, forest.mean_error(best.transform(test), "target"), [(*s, float(e)) for s, e in zip(settings, errors)]


def rate_forecast(feat_latest: DataFrame, daily_targets: DataFrame, model) -> DataFrame:
    """P5: per machine, prediction for the day after the latest one, mean of the last 5 targets, difference.

    Every machine has a row; one whose latest day lacks a feature has no forecast and a ``reason``.
    """
    whole = F.lit(True)
    for c in FEATURES:
        whole = whole & F.col(c).isNotNull()
    last_date, reason = F.col("shift_date").alias("last_date"), F.lit("latest day is incomplete")
    pred = model.transform(feat_latest.where(whole)).select(
        "machine_id", last_date, F.col("prediction").alias("forecast"), F.lit(None).cast("string").alias("reason"))
    pred = pred.unionByName(feat_latest.where(~whole).select(
        "machine_id", last_date, F.lit(None).cast("double").alias("forecast"), reason.alias("reason")))
    w = Window.partitionBy("machine_id").orderBy(F.col("shift_date").desc())
    recent = daily_targets.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 5).groupBy("machine_id").agg(
        F.avg("target").alias("recent_mean"))
    return pred.join(recent, "machine_id", "left").withColumn("delta", F.col("forecast") - F.col("recent_mean"))


def latest_features(df: DataFrame) -> DataFrame:
    """Features for predicting the next day: each machine's latest day values as the 'previous' ones."""
    daily = df.groupBy("machine_id", "shift_date").agg(
        F.try_divide(F.sum("reject_count"), F.when(F.sum("total_count") != 0, F.sum("total_count"))).alias("prev_target"),
        F.sum("planned_time_min").alias("prev_planned"), F.sum("downtime_minutes").alias("prev_downtime"),
        F.sum("total_count").alias("prev_total"), F.avg("ideal_rate").alias("prev_ideal"),
        F.avg("vibration_rms").alias("prev_vibration"), F.avg("temp_c").alias("prev_temp"),
        F.avg("motor_current_a").alias("prev_current"), F.count(F.lit(1)).cast("double").alias("prev_rows"),
    )
    last = daily.groupBy("machine_id").agg(F.max_by(F.struct(*[c for c in daily.columns if c != "machine_id"]),
                                                     F.col("shift_date")).alias("s"))
    return last.select("machine_id", "s.*")


def feature_importance(model: forest.Forest, top: int = 8) -> list[tuple[str, float]]:
    """Top feature importances of the fitted forest."""
    return model.importances()[:top]
