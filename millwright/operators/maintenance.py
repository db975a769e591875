"""Maintenance overlay: planned vs unplanned, reason Pareto per asset, asset risk.

The asset risk table is one hash aggregate over events keyed by (machine, line);
per-asset MTBF uses the telescoped gap mean (max - min) / (n - 1), so there is
no per-asset sort.  Normalisation (min-max over assets) reads min and max from
one scalar subquery over the asset-grain table.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.functions.common import clip, days_between, in_trailing_window, minmax_norm, minutes_between, num, num0, trailing_window
from millwright.functions.resolve import find_col, require_col
from millwright.operators.downtime import MINUTES_ALIASES

# Fixed values from the reference: classification tokens and flag values.
PLANNED_TOKENS = ("planned", "pm07", "preventive", "changeover", "chg01", "setup", "smed", "scheduled", "pm ")
UNPLANNED_TOKENS = ("breakdown", "brk", "failure", "unplanned", "mechanical", "electrical", "jam", "fault")
PLANNED_FLAG_VALUES = ("1", "true", "yes", "y", "planned", "p")
PLANNED_TYPE_PATTERN = "plan|changeover|setup|pm|prevent"

# Fixed values from the reference: sensor column name tokens.
SENSOR_TOKENS = ("vibration", "temp", "temperature", "current", "pressure", "rms", "sensor", "amp", "motor")
SENSOR_EXCLUDE = ("count", "minute", "rate", "oee", "scrap", "reject", "planned", "good", "total")

# Risk weights, action thresholds and texts.
RISK_WEIGHTS = {"freq": 35.0, "mttr": 25.0, "longest": 20.0, "unplanned": 20.0}
ACTION_HIGH, ACTION_WATCH = 55.0, 35.0
ACTION_TEXT = (
    "Inspect this week — kit spares and schedule a window",
    "Watch this week — add to walk-around list",
    "Routine PM cadence",
)


def _any_token(text: Column, tokens) -> Column:
    cond = F.lit(False)
    for t in tokens:
        cond = cond | text.contains(t)
    return cond


def classify(df: DataFrame) -> DataFrame:
    """Adds is_planned, event_class (Planned/Unplanned) and class_source.

    Flag column by exact alias only; an event-type text is tested for unplanned
    words before the planned pattern, so "unplanned" is never read as planned.
    """
    cols = df.columns
    flag = find_col(cols, "is_planned", "planned_flag", exact_only=True)
    etype = find_col(cols, "event_class", "event_type", "downtime_type", "stop_type", "failure_type")
    if flag:
        raw = F.col(flag)
        if isinstance(df.schema[flag].dataType, T.BooleanType):
            planned = F.coalesce(raw, F.lit(False))
        else:
            planned = F.coalesce(F.lower(F.trim(raw.cast("string"))).isin(*PLANNED_FLAG_VALUES), F.lit(False))
    elif etype:
        t = F.lower(F.col(etype).cast("string"))
        planned = F.coalesce(~t.contains("unplanned") & t.rlike(PLANNED_TYPE_PATTERN), F.lit(False))
    else:
        parts = [
            find_col(cols, "downtime_category", "category", "reason"),
            find_col(cols, "downtime_code", "reason_code", "failure_code"),
        ]
        blob = F.lit("")
        for c in [p for p in parts if p]:
            blob = F.concat(blob, F.lit(" "), F.lower(F.coalesce(F.col(c).cast("string"), F.lit("nan"))))
        planned = ~_any_token(blob, UNPLANNED_TOKENS) & _any_token(blob, PLANNED_TOKENS)
    return df.withColumns(
        {
            "is_planned": planned,
            "event_class": F.when(planned, "Planned").otherwise("Unplanned"),
            "class_source": F.lit("column" if (flag or etype) else "heuristic"),
        }
    )


def sensor_columns(df: DataFrame) -> list[str]:
    """Numeric columns whose name has a sensor token and no excluded token."""
    nums = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.DecimalType)
    out = []
    for f in df.schema.fields:
        n = f.name.lower()
        if isinstance(f.dataType, nums) and not any(x in n for x in SENSOR_EXCLUDE) and any(t in n for t in SENSOR_TOKENS):
            out.append(f.name)
    return out


def sensor_anomaly_by_asset(scored: DataFrame, features: list[str]) -> DataFrame:
    """X11: per machine sensor rows, isolation-forest anomalies, mean score and anomaly rate (%)."""
    g = scored.groupBy("machine_id").agg(
        F.count(F.col(features[0])).alias("sensor_rows"),
        F.count(F.when(F.col("anomaly"), 1)).alias("iso_anomalies"),
        F.avg("anomaly_score").alias("iso_score_mean"),
    )
    return g.withColumn("iso_anomaly_rate_pct",
                        F.col("iso_anomalies") / F.greatest(F.col("sensor_rows"), F.lit(1)) * 100.0)


def planned_vs_unplanned(df: DataFrame) -> DataFrame:
    """Planned / unplanned minutes, shares and event counts (one row)."""
    minutes = require_col(df.columns, *MINUTES_ALIASES)
    w = classify(df)
    m = num0(minutes)
    g = w.agg(
        F.first("class_source").alias("source"),
        F.sum(m).alias("total_min"),
        F.sum(F.when(F.col("is_planned"), m).otherwise(0.0)).alias("planned_min"),
        F.sum(F.when(~F.col("is_planned"), m).otherwise(0.0)).alias("unplanned_min"),
        F.count(F.when(F.col("is_planned"), 1)).alias("planned_events"),
        F.count(F.when(~F.col("is_planned"), 1)).alias("unplanned_events"),
    )
    share = lambda c: F.when(F.col("total_min") != 0, F.col(c) / F.col("total_min")).otherwise(0.0)
    return g.select(
        "source", "total_min", "planned_min", "unplanned_min",
        share("planned_min").alias("planned_pct"), share("unplanned_min").alias("unplanned_pct"),
        "planned_events", "unplanned_events",
    )


def planned_by_line(df: DataFrame) -> DataFrame:
    """Minutes per (line, class); null lines kept."""
    minutes = require_col(df.columns, *MINUTES_ALIASES)
    line = require_col(df.columns, "line_id", "line")
    w = classify(df)
    return w.groupBy(F.col(line).alias("line_id"), "event_class").agg(F.sum(num0(minutes)).alias("downtime_minutes"))


def reason_pareto_by(df: DataFrame, by: str = "machine_id", top_n: int = 8) -> DataFrame:
    """Events, minutes and share within each asset; top-N causes per asset."""
    minutes = require_col(df.columns, *MINUTES_ALIASES)
    dim = require_col(df.columns, by, "machine", "asset_id", "line")
    code = find_col(df.columns, "downtime_code", "downtime_category", "reason_code", "failure_code", "category")
    cause = F.col(code) if code else F.lit("UNSPECIFIED")
    g = df.groupBy(F.col(dim).alias("asset"), cause.alias("cause")).agg(
        F.count(F.lit(1)).alias("events"), F.sum(num0(minutes)).alias("downtime_minutes")
    )
    # windows run on the (asset, cause) aggregate, not on events
    wa = Window.partitionBy("asset")
    tot = F.sum("downtime_minutes").over(wa)
    ranked = g.withColumns(
        {
            "pct_within_asset": F.col("downtime_minutes") / F.when(tot == 0, F.lit(1.0)).otherwise(tot),
            "_rank": F.row_number().over(wa.orderBy(F.col("downtime_minutes").desc(), F.col("cause").asc_nulls_last())),
        }
    )
    return ranked.where(F.col("_rank") <= top_n).drop("_rank").withColumn("scope", F.lit(by))


def longest_events(df: DataFrame, top_n: int = 10) -> DataFrame:
    """Top positive events by minutes with context columns (TakeOrderedAndProject)."""
    minutes = require_col(df.columns, *MINUTES_ALIASES)
    w = classify(df).withColumn("_m", num0(minutes))
    cols = [c for c in (
        find_col(w.columns, "event_id"),
        find_col(w.columns, "shift_date", "date"),
        find_col(w.columns, "line_id", "line"),
        find_col(w.columns, "machine_id", "machine", "asset_id"),
        find_col(w.columns, "downtime_code"),
        find_col(w.columns, "downtime_category", "category"),
    ) if c]
    tail = [c for c in (find_col(w.columns, "start_time"), find_col(w.columns, "end_time")) if c]
    tie = [F.col(cols[0]).asc()] if cols else []
    return (
        w.where(F.col("_m") > 0)
        .orderBy(F.col("_m").desc(), *tie)
        .limit(top_n)
        .select(*cols, F.col("_m").alias("downtime_minutes"), "event_class", *tail)
    )


def asset_keys(df: DataFrame) -> list[str]:
    machine = require_col(df.columns, "machine_id", "machine", "asset_id")
    line = find_col(df.columns, "line_id", "line")
    return [machine] + ([line] if line and line != machine else [])


def asset_risk(df: DataFrame, recent_days: Optional[int] = None) -> DataFrame:
    """X6 + X8: per (machine, line) reliability metrics and the rule score.

    ``recent_days`` adds ``events_7d``, ``minutes_7d`` and ``events_7d_norm`` of the trailing
    days, counted in the same pass over the events.
    """
    minutes = require_col(df.columns, *MINUTES_ALIASES)
    keys = asset_keys(df)
    w = classify(df).withColumn("_m", num0(minutes))
    date_col = find_col(w.columns, "shift_date", "start_time", "date")
    start = find_col(w.columns, "start_time", "timestamp", "event_start")
    m = F.col("_m")
    pos = F.when(m > 0, m)
    aggs = [
        F.count(pos).alias("events"),
        F.sum(m).alias("downtime_minutes"),
        F.coalesce(F.avg(pos), F.lit(0.0)).alias("mttr_min"),
        F.coalesce(F.max(pos), F.lit(0.0)).alias("longest_event_min"),
        F.sum(F.when(~F.col("is_planned"), m).otherwise(0.0)).alias("unplanned_minutes"),
    ]
    if date_col:
        d = F.col(date_col)
        if isinstance(w.schema[date_col].dataType, T.DateType):
            span = F.datediff(F.max(d), F.min(d)).cast("double")
        else:
            span = days_between(F.min(d), F.max(d))
        aggs.append(F.coalesce(F.greatest(span, F.lit(1.0)), F.lit(1.0)).alias("_days"))
    else:
        aggs.append(F.lit(1.0).alias("_days"))
    if start:
        s = F.col(start)
        aggs += [F.count(s).alias("_ns"), minutes_between(F.min(s), F.max(s)).alias("_span")]
    recency = []
    if recent_days is not None:
        w = w.withColumn("_recent", in_trailing_window(df, date_col, recent_days))
        raw = F.when(F.col("_recent"), num(minutes))
        aggs += [F.count(raw).cast("double").alias("events_7d"), F.coalesce(F.sum(raw), F.lit(0.0)).alias("minutes_7d")]
        recency = ["events_7d", "minutes_7d"]
    g = w.groupBy(*keys).agg(*aggs)
    mtbf = (
        F.when((F.col("events") > 1) & (F.col("_ns") > 1),
               F.greatest(F.col("_span") / (F.col("_ns") - 1) - F.col("mttr_min"), F.lit(0.0)))
        if start else F.lit(None).cast("double")
    )
    g = g.select(
        F.col(keys[0]).alias("machine_id"),
        (F.col(keys[1]) if len(keys) > 1 else F.lit(None).cast("string")).alias("line_id"),
        "events", "downtime_minutes", "mttr_min", mtbf.alias("mtbf_min"),
        (F.col("events") / F.col("_days")).alias("failure_freq_per_day"),
        "longest_event_min", "unplanned_minutes",
        F.when(F.col("downtime_minutes") != 0, F.col("unplanned_minutes") / F.col("downtime_minutes"))
        .otherwise(0.0).alias("unplanned_share"),
        *recency,
    )
    n = minmax_norm(g, ["failure_freq_per_day", "mttr_min", "longest_event_min", *recency[:1]])
    wt = RISK_WEIGHTS
    score = (
        wt["freq"] * F.col("failure_freq_per_day_norm")
        + wt["mttr"] * F.col("mttr_min_norm")
        + wt["longest"] * F.col("longest_event_min_norm")
        + wt["unplanned"] * clip(F.col("unplanned_share"), 0, 1)
    )
    return n.withColumn("rule_score", score).drop(
        "failure_freq_per_day_norm", "mttr_min_norm", "longest_event_min_norm"
    )


def events_recent(df: DataFrame, days: int = 7) -> DataFrame:
    """Events and minutes per asset within the trailing ``days`` of data."""
    minutes = require_col(df.columns, *MINUTES_ALIASES)
    keys = asset_keys(df)
    date_col = find_col(df.columns, "shift_date", "start_time", "date")
    recent = trailing_window(df, date_col, days)
    g = recent.groupBy(*keys).agg(
        F.count(num(minutes)).alias("events_7d"), F.coalesce(F.sum(num(minutes)), F.lit(0.0)).alias("minutes_7d")
    )
    out = g.withColumnRenamed(keys[0], "machine_id")
    if len(keys) > 1:
        out = out.withColumnRenamed(keys[1], "line_id")
    else:
        out = out.withColumn("line_id", F.lit(None).cast("string"))
    return out


def remaining_risk(downtime: DataFrame, sensor_by_asset: Optional[DataFrame] = None,
                   top_n: Optional[int] = 8) -> DataFrame:
    """X13 + X14: rule score + sensor boost + recency, action and why text; top-N.

    A machine on two lines keeps one row per line.  Recent events come from the pass that
    builds the risk table.  The sensor table is per machine (one row each).
    """
    risk = asset_risk(downtime, recent_days=7)
    if sensor_by_asset is not None:
        s = sensor_by_asset.select("machine_id", "iso_anomaly_rate_pct")
        risk = risk.join(s, on="machine_id", how="left").withColumn(
            "iso_anomaly_rate_pct", F.coalesce(F.col("iso_anomaly_rate_pct"), F.lit(0.0))
        )
        risk = risk.withColumn("iso_boost", clip(F.col("iso_anomaly_rate_pct") * 1.5, 0, 25))
    else:
        risk = risk.withColumns({"iso_anomaly_rate_pct": F.lit(0.0), "iso_boost": F.lit(0.0)})
    risk = risk.withColumn(
        "remaining_risk",
        clip(F.col("rule_score") + F.col("iso_boost") + 10.0 * F.col("events_7d_norm"), 0, 100),
    ).drop("events_7d_norm")
    risk = risk.withColumns({"why": why_text(), "action": action_text(F.col("remaining_risk"))})
    if top_n is None:
        return risk
    return risk.orderBy(F.col("remaining_risk").desc(), F.col("machine_id").asc(), F.col("line_id").asc_nulls_last()).limit(top_n)


def action_text(r: Column) -> Column:
    return F.when(r >= ACTION_HIGH, ACTION_TEXT[0]).when(r >= ACTION_WATCH, ACTION_TEXT[1]).otherwise(ACTION_TEXT[2])


def why_text() -> Column:
    base = F.format_string(
        "MTTR %.0f min; %.2f fails/day; %.0f%% unplanned",
        F.col("mttr_min"), F.col("failure_freq_per_day"), F.col("unplanned_share") * 100,
    )
    sensor = F.when(F.col("iso_anomaly_rate_pct") > 5,
                    F.format_string("sensor anomalies %.0f%%", F.col("iso_anomaly_rate_pct")))
    recent = F.when(F.col("events_7d") > 0,
                    F.format_string("%d events in last 7 days of data", F.col("events_7d").cast("bigint")))
    return F.concat_ws("; ", base, sensor, recent)


def availability_loss_hours(downtime: DataFrame, plant_oee: DataFrame, planned_hours: Column) -> DataFrame:
    """Downtime hours by class tied to the plant availability loss (one row).

    ``plant_oee`` is the one-row plant OEE frame; ``planned_hours`` a scalar
    column (sum of planned minutes / 60).
    """
    pu = planned_vs_unplanned(downtime)
    tot = pu.select((F.col("total_min") / 60.0)).scalar()
    unp = pu.select((F.col("unplanned_min") / 60.0)).scalar()
    pln = pu.select((F.col("planned_min") / 60.0)).scalar()
    a = F.col("availability")
    return plant_oee.select(
        tot.alias("downtime_hours"),
        unp.alias("unplanned_hours"),
        pln.alias("planned_downtime_hours"),
        a.alias("oee_availability"),
        planned_hours.alias("planned_production_hours"),
        ((F.lit(1.0) - a) * planned_hours).alias("availability_loss_hours"),
        F.greatest(F.lit(0.0), (F.lit(0.90) - a) * planned_hours).alias("hours_to_90pct_availability"),
    )
