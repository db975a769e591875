"""OEE: per-row pillars, weighted group aggregates, plant rollup and extremes.

Group OEE is computed from sums (planned, downtime, total, good) and the mean
ideal rate, never as a mean of row OEE.  Everything is a projection or a
single hash aggregate with map-side partial aggregation; the rollup is one
Expand + aggregate over GROUPING SETS instead of four scans.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.common import num, num0
from millwright.functions.oee import (
    DEFAULT_DOWNTIME_MIN,
    DEFAULT_IDEAL_RATE,
    DEFAULT_PLANNED_MIN,
    WORLD_CLASS_OEE,
    losses,
    pillars,
)
from millwright.functions.resolve import find_col

GROUP_DEFAULT = ["line_id", "machine_id", "shift", "shift_date"]
METRICS = ["run_time_min", "availability", "performance", "quality", "oee"]


def prepare(df: DataFrame) -> DataFrame:
    """O1: resolve inputs by alias, fill defaults, coerce, derive total/good.

    Adds canonical columns planned_time_min, downtime_minutes, ideal_rate,
    total_count, good_count (double, NULL -> 0).
    """
    cols = df.columns
    planned = find_col(cols, "planned_time_min", "planned_minutes", "available_time_min", "shift_minutes")
    down = find_col(cols, "downtime_minutes", "downtime_min", "unplanned_downtime_min")
    ideal = find_col(cols, "ideal_rate", "ideal_rate_per_min", "design_rate", "target_rate")
    total = find_col(cols, "total_count", "total_units", "produced_count", "output_count")
    good = find_col(cols, "good_count", "good_units", "good_output")
    rejects = find_col(cols, "reject_count", "rejects", "scrap_count")

    planned_c = num0(planned) if planned else F.lit(DEFAULT_PLANNED_MIN)
    down_c = num0(down) if down else F.lit(DEFAULT_DOWNTIME_MIN)
    ideal_c = num0(ideal) if ideal else F.lit(DEFAULT_IDEAL_RATE)
    if total:
        total_c = num0(total)
    elif good and rejects:
        total_c = num0(good) + num0(rejects)
    else:
        total_c = F.lit(0.0)
    if good:
        good_c = num0(good)
    elif rejects:
        good_c = F.greatest(total_c - num0(rejects), F.lit(0.0))
    else:
        good_c = total_c
    return df.withColumns(
        {
            "planned_time_min": planned_c,
            "downtime_minutes": down_c,
            "ideal_rate": ideal_c,
            "total_count": total_c,
            "good_count": good_c,
        }
    )


def rows(df: DataFrame) -> DataFrame:
    """O2 + O3: row-level run time, pillars, OEE and the three losses."""
    w = prepare(df)
    m = pillars(F.col("planned_time_min"), F.col("downtime_minutes"), F.col("ideal_rate"),
                F.col("total_count"), F.col("good_count"))
    w = w.withColumns(m)
    return w.withColumns(losses(F.col("availability"), F.col("performance"), F.col("quality")))


def _agg_exprs():
    return [
        F.sum("planned_time_min").alias("_p"),
        F.sum("downtime_minutes").alias("_d"),
        F.avg("ideal_rate").alias("_i"),
        F.sum("total_count").alias("_t"),
        F.sum("good_count").alias("_g"),
        F.count(F.lit(1)).alias("shifts"),
    ]


def _finish(g: DataFrame, keys: list[str]) -> DataFrame:
    m = pillars(F.col("_p"), F.col("_d"), F.col("_i"), F.col("_t"), F.col("_g"))
    return g.select(
        *keys,
        *[m[k].alias(k) for k in METRICS],
        F.col("shifts"),
        F.coalesce(F.col("_t"), F.lit(0.0)).alias("total_count"),
        F.coalesce(F.col("_g"), F.lit(0.0)).alias("good_count"),
        F.coalesce(F.col("_d"), F.lit(0.0)).alias("downtime_minutes"),
    )


def aggregate(df: DataFrame, group_cols: Optional[list[str]] = None, prepared: bool = False) -> DataFrame:
    """Weighted OEE per group (null groups kept, like ``dropna=False``)."""
    w = df if prepared else prepare(df)
    keys = group_cols or [c for c in GROUP_DEFAULT if c in w.columns]
    return _finish(w.groupBy(*keys).agg(*_agg_exprs()), keys)


def plant(df: DataFrame, prepared: bool = False) -> DataFrame:
    """The true plant total (one row)."""
    w = df if prepared else prepare(df)
    out = _finish(w.agg(*_agg_exprs()), [])
    return out.select(F.lit("plant").alias("scope"), *METRICS, "shifts", "total_count", "good_count", "downtime_minutes")


def worst_cell(df: DataFrame) -> DataFrame:
    """Lowest-OEE (line, machine, shift, date) cell, ties broken by the keys."""
    cell = aggregate(df, GROUP_DEFAULT)
    return cell.orderBy(F.col("oee").asc(), *[F.col(k).asc_nulls_last() for k in GROUP_DEFAULT]).limit(1)


def gap(df: DataFrame) -> DataFrame:
    """World-class gap = max(0.85 - plant OEE, 0)."""
    p = plant(df)
    return p.select("oee", F.greatest(F.lit(WORLD_CLASS_OEE) - F.col("oee"), F.lit(0.0)).alias("world_class_gap"))


def loss_mean(df: DataFrame) -> DataFrame:
    """Mean of the three losses and of OEE over rows, as (metric, value) rows."""
    r = rows(df)
    wide = r.agg(
        F.avg("loss_availability").alias("loss_availability"),
        F.avg("loss_performance").alias("loss_performance"),
        F.avg("loss_quality").alias("loss_quality"),
        F.avg("oee").alias("oee"),
    )
    return wide.unpivot([], ["loss_availability", "loss_performance", "loss_quality", "oee"], "metric", "value")


def rollup(df: DataFrame) -> DataFrame:
    """Plant, per line, per machine, per shift in one aggregate (GROUPING SETS)."""
    w = prepare(df)
    dims = ["line_id", "machine_id", "shift"]
    g = w.groupingSets([[], ["line_id"], ["machine_id"], ["shift"]], *dims).agg(
        *_agg_exprs(), F.grouping_id(*dims).alias("_gid")
    )
    scope = (
        F.when(F.col("_gid") == 7, "plant")
        .when(F.col("_gid") == 3, "line")
        .when(F.col("_gid") == 5, "machine")
        .otherwise("shift")
    )
    key = F.when(F.col("_gid") == 3, F.col("line_id")).when(F.col("_gid") == 5, F.col("machine_id")).when(
        F.col("_gid") == 6, F.col("shift")
    )
    g = g.withColumns({"scope": scope, "key": key})
    return _finish(g, ["scope", "key"])


def extremes(df: DataFrame) -> DataFrame:
    """Weakest pillar of the plant; worst/best line, worst machine, worst/best shift.

    One scan: the grouping-sets rollup, then one aggregate over its ~100 rows.
    """
    r = rollup(df)
    sc = F.col("scope")

    def pick(scope: str, value: Column):
        """Key of the scope's row with the smallest value; ties go to the smaller key."""
        return F.min_by("key", F.when((sc == scope) & value.isNotNull(), F.struct(value.alias("v"), F.col("key"))))

    def plant_val(c: str):
        return F.first(F.when(sc == "plant", F.col(c)), ignorenulls=True)

    a, p, q = plant_val("availability"), plant_val("performance"), plant_val("quality")
    g = r.agg(
        a.alias("_a"), p.alias("_p"), q.alias("_q"),
        pick("line", F.col("oee")).alias("worst_line"), F.min(F.when(sc == "line", F.col("oee"))).alias("worst_line_oee"),
        pick("line", -F.col("oee")).alias("best_line"), F.max(F.when(sc == "line", F.col("oee"))).alias("best_line_oee"),
        pick("machine", F.col("oee")).alias("worst_machine"),
        F.min(F.when(sc == "machine", F.col("oee"))).alias("worst_machine_oee"),
        pick("shift", F.col("oee")).alias("worst_shift"), F.min(F.when(sc == "shift", F.col("oee"))).alias("worst_shift_oee"),
        pick("shift", -F.col("oee")).alias("best_shift"), F.max(F.when(sc == "shift", F.col("oee"))).alias("best_shift_oee"),
    )
    weakest = (
        F.when((F.col("_a") <= F.col("_p")) & (F.col("_a") <= F.col("_q")), "Availability")
        .when(F.col("_p") <= F.col("_q"), "Performance")
        .otherwise("Quality")
    )
    return g.select(
        weakest.alias("weakest_pillar"), F.least("_a", "_p", "_q").alias("weakest_value"),
        "worst_line", "worst_line_oee", "best_line", "best_line_oee", "worst_machine", "worst_machine_oee",
        "worst_shift", "worst_shift_oee", "best_shift", "best_shift_oee",
    )
