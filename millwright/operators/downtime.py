"""Downtime Pareto, MTTR / MTBF and per-dimension downtime.

Pareto shares and running sums are windows over the *aggregated* cause table
(one row per cause), never over event rows.  MTBF needs the mean gap between
consecutive event starts per machine; the gaps telescope, so the mean is
sum(max - min) / sum(n - 1) per machine, a plain aggregate with no sort and no
per-machine window (a machine holding a third of all events costs the same as
any other).
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.common import minutes_between, num, num0
from millwright.functions.resolve import find_col, require_col

CAUSE_ALIASES = ("downtime_code", "reason_code", "failure_code", "downtime_category", "category")
MINUTES_ALIASES = ("downtime_minutes", "downtime_min", "duration_min")


def pareto_table(g: DataFrame, value: str, top_n: Optional[int], key: str = "cause") -> DataFrame:
    """pct of the full total and running cum_pct over a small aggregated table, then top-N.

    Ordering is (value desc, key asc nulls last) so ties are deterministic.
    """
    total = F.sum(value).over(Window.partitionBy())  # g is the small aggregated table
    denom = F.when(F.coalesce(total, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(total)
    order = [F.col(value).desc(), F.col(key).asc_nulls_last()]
    w = Window.orderBy(*order)
    out = g.withColumn("pct", F.col(value) / denom).withColumn(
        "cum_pct", F.sum("pct").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    if top_n is not None:
        out = out.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= top_n).drop("_rank")
    return out


def pareto(df: DataFrame, code_col: Optional[str] = None, top_n: Optional[int] = 12) -> DataFrame:
    """Events, minutes, pct of total and cum_pct per cause (null cause is a group)."""
    minutes = require_col(df.columns, *MINUTES_ALIASES)
    code = code_col or find_col(df.columns, *CAUSE_ALIASES)
    cause = F.col(code) if code else F.lit("UNSPECIFIED")
    g = df.groupBy(cause.cast("string").alias("cause")).agg(
        F.count(F.lit(1)).alias("events"), F.sum(num0(minutes)).alias("downtime_minutes")
    )
    return pareto_table(g, "downtime_minutes", top_n)


def mttr(df: DataFrame) -> DataFrame:
    """Mean of positive downtime minutes, event count and total (one row)."""
    minutes = require_col(df.columns, *MINUTES_ALIASES)
    d = num(minutes)
    pos = df.where(d > 0)
    return pos.agg(
        F.count(F.lit(1)).alias("events"),
        F.avg(d).alias("mttr_min"),
        F.sum(d).alias("total_downtime_min"),
    )


def _gap_stats(df: DataFrame, keys: list[str], start: str) -> DataFrame:
    """Per key: number of non-null starts and the span between the first and last start."""
    s = F.col(start)
    return df.where(s.isNotNull()).groupBy(*keys).agg(
        F.count(s).alias("_n"), minutes_between(F.min(s), F.max(s)).alias("_span_min")
    )


def mtbf_gaps(df: DataFrame) -> DataFrame:
    """D3: pooled mean gap between consecutive starts per machine; MTBF = max(mean gap - MTTR, 0)."""
    minutes = require_col(df.columns, *MINUTES_ALIASES)
    start = require_col(df.columns, "start_time", "timestamp", "event_start")
    machine = require_col(df.columns, "machine_id", "machine", "asset_id")
    per = _gap_stats(df.where(F.col(machine).isNotNull()), [machine], start)
    gaps = per.agg(
        F.sum(F.col("_n") - 1).alias("gaps"),
        F.try_divide(F.sum("_span_min"), F.sum(F.col("_n") - 1)).alias("mean_interarrival_min"),
    )
    m = df.where(num(minutes) > 0).select(F.avg(num(minutes))).scalar()
    return gaps.select(
        "gaps",
        "mean_interarrival_min",
        m.alias("mttr_min"),
        F.greatest(F.col("mean_interarrival_min") - m, F.lit(0.0)).alias("mtbf_min"),
    )


def mtbf_planned(df: DataFrame) -> DataFrame:
    """Fallback MTBF = max(sum planned - sum positive downtime, 0) / events."""
    minutes = require_col(df.columns, *MINUTES_ALIASES)
    planned = require_col(df.columns, "planned_time_min", "planned_minutes")
    d = num(minutes)
    g = df.agg(
        F.sum(num0(planned)).alias("_p"),
        F.sum(F.when(d > 0, d)).alias("_d"),
        F.count(F.when(d > 0, 1)).alias("events"),
    )
    run = F.greatest(F.col("_p") - F.coalesce(F.col("_d"), F.lit(0.0)), F.lit(0.0))
    return g.select("events", (run / F.greatest(F.col("events"), F.lit(1))).alias("mtbf_min"))


def mttr_timestamps(df: DataFrame) -> DataFrame:
    """Mean positive (end - start) in minutes."""
    start = require_col(df.columns, "start_time", "timestamp", "event_start")
    end = require_col(df.columns, "end_time", "event_end")
    dur = minutes_between(F.col(start), F.col(end))
    return df.select(dur.alias("_dur")).where(F.col("_dur") > 0).agg(
        F.count(F.lit(1)).alias("events"), F.avg("_dur").alias("mttr_from_timestamps_min")
    )


def by_dimension(df: DataFrame, dim: str) -> DataFrame:
    """Events (non-null minutes) and minutes per value of ``dim``; null values dropped."""
    minutes = require_col(df.columns, "downtime_minutes", "downtime_min")
    m = num(minutes)
    return df.where(F.col(dim).isNotNull()).groupBy(dim).agg(
        F.count(m).alias("events"), F.coalesce(F.sum(m), F.lit(0.0)).alias("downtime_minutes")
    )


def chronic_machines(df: DataFrame, top_n: int = 5) -> DataFrame:
    """Top machines by downtime minutes (null machine dropped)."""
    machine = require_col(df.columns, "machine_id", "machine")
    minutes = require_col(df.columns, "downtime_minutes", "downtime_min")
    m = num0(minutes)
    g = df.where(F.col(machine).isNotNull()).groupBy(F.col(machine).alias("machine_id")).agg(
        F.count(F.lit(1)).alias("events"), F.sum(m).alias("downtime_minutes"), F.avg(m).alias("mean_min")
    )
    return g.orderBy(F.col("downtime_minutes").desc(), F.col("machine_id").asc()).limit(top_n)


def reliability_proxy(df: DataFrame) -> DataFrame:
    """MTBF / (MTBF + MTTR) when both are positive."""
    g = mtbf_gaps(df)
    ok = (F.col("mtbf_min") > 0) & (F.col("mttr_min") > 0)
    return g.select(
        "mttr_min", "mtbf_min",
        F.when(ok, F.col("mtbf_min") / (F.col("mtbf_min") + F.col("mttr_min"))).alias("reliability_proxy"),
    )


def share_by_line(df: DataFrame) -> DataFrame:
    """Downtime minutes per line and share of the total."""
    line = require_col(df.columns, "line_id", "line")
    minutes = require_col(df.columns, *MINUTES_ALIASES)
    g = df.groupBy(F.col(line).alias("line_id")).agg(F.sum(num0(minutes)).alias("downtime_minutes"))
    total = F.sum("downtime_minutes").over(Window.partitionBy())  # one row per line
    return g.withColumn("share", F.try_divide(F.col("downtime_minutes"), total))
