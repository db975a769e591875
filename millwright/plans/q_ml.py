"""Model-backed queries: isolation forest, KMeans, PCA drift, rate forecast (rows-only checks),
plus the rate target and lagged features (SQL-checked)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.operators import forecast as fc
from millwright.operators import maintenance as mt
from millwright.operators.ml import cluster, iforest
from millwright.plans.catalog import register
from millwright.plans.q_dq import NUMS
from millwright.plans.sqlparts import PLANT, r4, with_
from millwright.session import written
from millwright.sources import testdata as td

ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "total_count"]  # unique per lineitem row


def _sensor_scores(spark, sf, keep=None):
    """Scored sensor rows with the columns ``keep`` (unnamed: those of the rate per machine), and the sensor columns."""
    p = td.plant_rows(spark, sf)
    feats = mt.sensor_columns(p)
    rows = p.select(*ROW_KEY, "machine_id", "line_id", *feats)
    return iforest.fit_score(rows, feats, ROW_KEY, keep=keep or feats[:1] + ["machine_id"]), feats


@register("sensor_iforest")
def sensor_iforest(spark, sf):
    """Isolation forest (100 trees, psi 256, contamination 0.08) on sensor columns, per row."""
    scored, _ = _sensor_scores(spark, sf, [*ROW_KEY, "machine_id", "line_id"])
    return scored.select(*ROW_KEY, "machine_id", "line_id", "anomaly_score", "anomaly")


@register("sensor_by_asset")
def sensor_by_asset(spark, sf):
    """X11: sensor anomaly rate per machine."""
    scored, feats = _sensor_scores(spark, sf)
    return mt.sensor_anomaly_by_asset(scored, feats)


@register("remaining_risk_sensors")
def remaining_risk_sensors(spark, sf):
    """X13 with the sensor boost: min(1.5 x anomaly rate, 25) added to the rule score."""
    scored, feats = _sensor_scores(spark, sf)
    sensors = mt.sensor_anomaly_by_asset(scored, feats)
    return mt.remaining_risk(td.downtime(spark, sf), sensor_by_asset=sensors)


@register("dq_iforest")
def dq_iforest(spark, sf):
    """V7: isolation forest over all numeric columns (complete rows): anomaly count and rate."""
    p = td.plant_rows(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", *NUMS).dropna()
    scored = iforest.fit_score(p, NUMS, ["l_orderkey", "l_linenumber", "l_partkey"], keep=[])
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("anomaly"), 1)).alias("anomalies")).withColumn(
        "rate_pct", F.col("anomalies") / F.greatest(F.col("rows"), F.lit(1)) * 100.0)


@register("dq_kmeans")
def dq_kmeans(spark, sf):
    """V9: KMeans distance outliers on standardised numeric columns."""
    return cluster.kmeans_far(td.plant_rows(spark, sf), NUMS)


@register("dq_pca_drift")
def dq_pca_drift(spark, sf):
    """PCA explained-variance drift between the early and late halves (by shift date)."""
    return cluster.pca_drift(td.plant_rows(spark, sf), NUMS, "shift_date")


@register("rate_target", with_(PLANT) + f"""SELECT l_orderkey, l_linenumber,
  {r4('reject_count / nullif(total_count, 0)')} AS target FROM plant""")
def rate_target(spark, sf):
    """Scrap-rate target per row (rejects / total, NULL on a zero total)."""
    return fc.rate_target(td.plant_rows(spark, sf)).select("l_orderkey", "l_linenumber", "target")


_DAILY = """daily AS (SELECT machine_id, shift_date, sum(reject_count) / nullif(sum(total_count), 0) AS target,
   sum(planned_time_min) AS planned, sum(downtime_minutes) AS downtime, sum(total_count) AS total, avg(ideal_rate) AS ideal,
   avg(vibration_rms) AS vibration, avg(temp_c) AS temp, avg(motor_current_a) AS current, CAST(count(*) AS DOUBLE) AS rows
  FROM plant GROUP BY machine_id, shift_date)"""
_LAGS = ", ".join(f"{r4(f'lag({c}) OVER (PARTITION BY machine_id ORDER BY shift_date)')} AS prev_{c}"
                  for c in ("target", "planned", "downtime", "total", "ideal", "vibration", "temp", "current", "rows"))


@register("rate_features", with_(PLANT, _DAILY) + f"""SELECT * FROM (SELECT machine_id, shift_date, {r4('target')} AS target, {_LAGS}
FROM daily) WHERE target IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in fc.FEATURES)}""")
def rate_features(spark, sf):
    """(machine, day) target with the previous day's values as features."""
    return fc.rate_features(td.plant_rows(spark, sf))


@register("rate_model")
def rate_model(spark, sf):
    """Random forest (80 trees, depth 6, min leaf 2) with test MAE."""
    feat = fc.rate_features(td.plant_rows(spark, sf))
    _, mae = fc.rate_model(feat)
    return spark.range(1).select(F.lit(fc.DEFAULT_TREES).alias("trees"), F.lit(fc.DEFAULT_DEPTH).alias("depth"),
                                 F.lit(fc.DEFAULT_LEAF).alias("leaf"), F.lit(mae).alias("test_mae"))


@register("rate_tuning")
def rate_tuning(spark, sf):
    """Random search over forest size, depth and leaf size; validation MAE per trial."""
    feat = fc.rate_features(td.plant_rows(spark, sf))
    _, test_mae, rows = fc.rate_tuning(feat)
    df = spark.createDataFrame(rows, "trees int, depth int, leaf int, validation_mae double")
    return df.withColumn("best_test_mae", F.lit(test_mae))


@register("rate_forecast")
def rate_forecast(spark, sf):
    """P5: next-day scrap-rate forecast per machine vs the mean of its last 5 days."""
    p = td.plant_rows(spark, sf)
    feat = fc.rate_features(p)
    model, _ = fc.rate_model(feat)
    daily = feat.select("machine_id", "shift_date", "target")
    return fc.rate_forecast(fc.latest_features(p), daily, model)


@register("rate_anomalies")
def rate_anomalies(spark, sf):
    """One-feature isolation forest on the daily scrap rate."""
    feat = written(fc.rate_features(td.plant_rows(spark, sf)).select("machine_id", "shift_date", "target"), "rate-targets")
    scored = iforest.fit_score(feat, ["target"], ["machine_id", "shift_date"])
    return scored.select("machine_id", "shift_date", "target", "anomaly_score", "anomaly")


@register("feature_importance")
def feature_importance(spark, sf):
    """Top 8 feature importances of the rate model."""
    feat = fc.rate_features(td.plant_rows(spark, sf))
    model, _ = fc.rate_model(feat)
    return spark.createDataFrame(fc.feature_importance(model), "feature string, importance double")
