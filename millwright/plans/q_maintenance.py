"""Maintenance queries (X1-X15) over the events-derived downtime table."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.operators import maintenance as mt
from millwright.operators import oee
from millwright.plans.catalog import register
from millwright.plans.sqlparts import DOWNTIME, PLANT, oee_group_select, pillars, r4, with_
from millwright.sources import testdata as td

US_PER_MIN = "CAST(60000000 AS DOUBLE)"


def _norm(x: str, mn: str, mx: str) -> str:
    return f"(CASE WHEN {mx} - {mn} <= 1e-12 THEN 0.0 ELSE (coalesce({x}, 0.0) - {mn}) / ({mx} - {mn}) END)"


# CTEs: ra (per-asset aggregate), rb (metrics), rs (min/max), risk (with rule_score)
ASSET_RISK_CTES = [
    f"""ra AS (SELECT machine_id, line_id,
   count(*) FILTER (WHERE downtime_minutes > 0) AS events,
   sum(coalesce(downtime_minutes, 0.0)) AS downtime_minutes,
   coalesce(avg(downtime_minutes) FILTER (WHERE downtime_minutes > 0), 0.0) AS mttr_min,
   coalesce(max(downtime_minutes) FILTER (WHERE downtime_minutes > 0), 0.0) AS longest_event_min,
   sum(CASE WHEN NOT coalesce(is_planned, false) THEN coalesce(downtime_minutes, 0.0) ELSE 0.0 END) AS unplanned_minutes,
   coalesce(greatest(CAST(date_diff('day', min(shift_date), max(shift_date)) AS DOUBLE), 1.0), 1.0) AS days,
   count(start_time) AS ns, (epoch_us(max(start_time)) - epoch_us(min(start_time))) / {US_PER_MIN} AS span
  FROM downtime GROUP BY machine_id, line_id)""",
    """rb AS (SELECT machine_id, line_id, events, downtime_minutes, mttr_min,
   CASE WHEN events > 1 AND ns > 1 THEN greatest(span / (ns - 1) - mttr_min, 0.0) END AS mtbf_min,
   events / days AS failure_freq_per_day, longest_event_min, unplanned_minutes,
   CASE WHEN downtime_minutes <> 0 THEN unplanned_minutes / downtime_minutes ELSE 0.0 END AS unplanned_share
  FROM ra)""",
    """rs AS (SELECT min(failure_freq_per_day) AS f0, max(failure_freq_per_day) AS f1, min(mttr_min) AS m0, max(mttr_min) AS m1,
   min(longest_event_min) AS l0, max(longest_event_min) AS l1 FROM rb)""",
    f"""risk AS (SELECT rb.*,
   35.0 * {_norm('failure_freq_per_day', 'f0', 'f1')} + 25.0 * {_norm('mttr_min', 'm0', 'm1')}
   + 20.0 * {_norm('longest_event_min', 'l0', 'l1')} + 20.0 * least(greatest(unplanned_share, 0.0), 1.0) AS rule_score
  FROM rb, rs)""",
]

RISK_COLS = ["machine_id", "line_id", "events", "downtime_minutes", "mttr_min", "mtbf_min", "failure_freq_per_day",
             "longest_event_min", "unplanned_minutes", "unplanned_share", "rule_score"]

RECENT_CTE = """recent AS (SELECT machine_id, line_id, count(downtime_minutes) AS events_7d,
   coalesce(sum(downtime_minutes), 0.0) AS minutes_7d FROM downtime
  WHERE shift_date >= (SELECT max(shift_date) FROM downtime) - INTERVAL 7 DAY GROUP BY machine_id, line_id)"""

REMAINING_CTES = ASSET_RISK_CTES + [
    RECENT_CTE,
    """rr AS (SELECT risk.*, 0.0::DOUBLE AS iso_anomaly_rate_pct, 0.0::DOUBLE AS iso_boost,
   coalesce(CAST(recent.events_7d AS DOUBLE), 0.0) AS events_7d, coalesce(recent.minutes_7d, 0.0) AS minutes_7d
  FROM risk LEFT JOIN recent ON risk.machine_id IS NOT DISTINCT FROM recent.machine_id
                            AND risk.line_id IS NOT DISTINCT FROM recent.line_id)""",
    f"""rrs AS (SELECT min(events_7d) AS e0, max(events_7d) AS e1 FROM rr)""",
    f"""rem AS (SELECT rr.*, least(greatest(rule_score + iso_boost + 10.0 * {_norm('events_7d', 'e0', 'e1')}, 0.0), 100.0) AS remaining_risk
  FROM rr, rrs)""",
]


def _sel(cols, src="") -> str:
    p = f"{src}." if src else ""
    num = {"events", "machine_id", "line_id", "event_class", "scope", "cause", "asset", "class_source", "action"}
    return ", ".join(f"{p}{c}" if c in num else f"{r4(p + c)} AS {c}" for c in cols)


@register("classify_planned", with_(DOWNTIME) + """SELECT event_id, coalesce(is_planned, false) AS is_planned,
  CASE WHEN coalesce(is_planned, false) THEN 'Planned' ELSE 'Unplanned' END AS event_class, 'column' AS class_source FROM downtime""")
def classify_planned(spark, sf):
    """planned/unplanned from the flag column."""
    return mt.classify(td.downtime(spark, sf)).select("event_id", "is_planned", "event_class", "class_source")


_BLOB = "(' ' || lower(coalesce(downtime_category, 'nan')) || ' ' || lower(coalesce(downtime_code, 'nan')))"
_HEUR = ("(NOT (" + " OR ".join(f"contains({_BLOB}, '{t}')" for t in mt.UNPLANNED_TOKENS) + ") AND ("
         + " OR ".join(f"contains({_BLOB}, '{t}')" for t in mt.PLANNED_TOKENS) + "))")


@register("classify_planned_heuristic", with_(DOWNTIME) + f"""SELECT event_id, {_HEUR} AS is_planned,
  CASE WHEN {_HEUR} THEN 'Planned' ELSE 'Unplanned' END AS event_class, 'heuristic' AS class_source FROM downtime""")
def classify_planned_heuristic(spark, sf):
    """planned/unplanned from category and code text when no flag column exists."""
    d = td.downtime(spark, sf).drop("is_planned")
    return mt.classify(d).select("event_id", "is_planned", "event_class", "class_source")


@register("planned_vs_unplanned", with_(DOWNTIME) + f"""SELECT 'column' AS source, {r4('t')} AS total_min, {r4('pm')} AS planned_min,
  {r4('um')} AS unplanned_min, {r4('CASE WHEN t <> 0 THEN pm / t ELSE 0.0 END')} AS planned_pct,
  {r4('CASE WHEN t <> 0 THEN um / t ELSE 0.0 END')} AS unplanned_pct, pe AS planned_events, ue AS unplanned_events
FROM (SELECT sum(coalesce(downtime_minutes, 0.0)) AS t,
   sum(CASE WHEN coalesce(is_planned, false) THEN coalesce(downtime_minutes, 0.0) ELSE 0.0 END) AS pm,
   sum(CASE WHEN NOT coalesce(is_planned, false) THEN coalesce(downtime_minutes, 0.0) ELSE 0.0 END) AS um,
   count(*) FILTER (WHERE coalesce(is_planned, false)) AS pe, count(*) FILTER (WHERE NOT coalesce(is_planned, false)) AS ue
  FROM downtime)""")
def planned_vs_unplanned(spark, sf):
    """Planned vs unplanned minutes, shares and events."""
    return mt.planned_vs_unplanned(td.downtime(spark, sf))


@register("planned_by_line", with_(DOWNTIME) + f"""SELECT line_id, CASE WHEN coalesce(is_planned, false) THEN 'Planned' ELSE 'Unplanned' END AS event_class,
  {r4('sum(coalesce(downtime_minutes, 0.0))')} AS downtime_minutes FROM downtime GROUP BY 1, 2""")
def planned_by_line(spark, sf):
    """Minutes by line and class."""
    return mt.planned_by_line(td.downtime(spark, sf))


def _reason_sql(by: str) -> str:
    return with_(DOWNTIME) + f"""SELECT asset, cause, events, {r4('downtime_minutes')} AS downtime_minutes,
  {r4('pct_within_asset')} AS pct_within_asset, '{by}' AS scope FROM (
  SELECT *, downtime_minutes / (CASE WHEN sum(downtime_minutes) OVER (PARTITION BY asset) = 0 THEN 1.0
                                     ELSE sum(downtime_minutes) OVER (PARTITION BY asset) END) AS pct_within_asset,
         row_number() OVER (PARTITION BY asset ORDER BY downtime_minutes DESC, cause ASC NULLS LAST) AS _rk
  FROM (SELECT {by} AS asset, downtime_code AS cause, count(*) AS events, sum(coalesce(downtime_minutes, 0.0)) AS downtime_minutes
        FROM downtime GROUP BY 1, 2)) WHERE _rk <= 8"""


@register("reason_pareto_by_machine", _reason_sql("machine_id"))
def reason_pareto_by_machine(spark, sf):
    """Top 8 causes per machine with share within the machine."""
    return mt.reason_pareto_by(td.downtime(spark, sf), "machine_id")


@register("reason_pareto_by_line", _reason_sql("line_id"))
def reason_pareto_by_line(spark, sf):
    """Top 8 causes per line with share within the line."""
    return mt.reason_pareto_by(td.downtime(spark, sf), "line_id")


@register("longest_events", with_(DOWNTIME) + f"""SELECT event_id, shift_date, line_id, machine_id, downtime_code, downtime_category,
  {r4('coalesce(downtime_minutes, 0.0)')} AS downtime_minutes,
  CASE WHEN coalesce(is_planned, false) THEN 'Planned' ELSE 'Unplanned' END AS event_class, start_time, end_time
FROM downtime WHERE coalesce(downtime_minutes, 0.0) > 0 ORDER BY coalesce(downtime_minutes, 0.0) DESC, event_id LIMIT 10""")
def longest_events(spark, sf):
    """Ten longest positive events."""
    return mt.longest_events(td.downtime(spark, sf))


@register("asset_risk", with_(DOWNTIME, *ASSET_RISK_CTES) + f"SELECT {_sel(RISK_COLS)} FROM risk")
def asset_risk(spark, sf):
    """Per-asset events, MTTR, MTBF, frequency, longest, unplanned share, rule score."""
    return mt.asset_risk(td.downtime(spark, sf))


@register("minmax_norm", with_(DOWNTIME, *ASSET_RISK_CTES) + f"""SELECT machine_id, line_id,
  {r4(_norm('failure_freq_per_day', 'f0', 'f1'))} AS failure_freq_per_day_norm,
  {r4(_norm('mttr_min', 'm0', 'm1'))} AS mttr_min_norm, {r4(_norm('longest_event_min', 'l0', 'l1'))} AS longest_event_min_norm
FROM rb, rs""")
def minmax_norm(spark, sf):
    """Min-max normalised risk inputs per asset."""
    from millwright.functions.common import minmax_norm as mm

    r = mt.asset_risk(td.downtime(spark, sf))
    return mm(r, ["failure_freq_per_day", "mttr_min", "longest_event_min"]).select(
        "machine_id", "line_id", "failure_freq_per_day_norm", "mttr_min_norm", "longest_event_min_norm"
    )


@register("rule_score", with_(DOWNTIME, *ASSET_RISK_CTES) + f"SELECT machine_id, line_id, {r4('rule_score')} AS rule_score FROM risk")
def rule_score(spark, sf):
    """Weighted rule score per asset."""
    return mt.asset_risk(td.downtime(spark, sf)).select("machine_id", "line_id", "rule_score")


@register("events_7d", with_(DOWNTIME, RECENT_CTE) + f"SELECT machine_id, line_id, events_7d, {r4('minutes_7d')} AS minutes_7d FROM recent")
def events_7d(spark, sf):
    """Events and minutes per asset in the trailing 7 days of data."""
    return mt.events_recent(td.downtime(spark, sf))


REM_COLS = RISK_COLS + ["iso_anomaly_rate_pct", "iso_boost", "events_7d", "minutes_7d", "remaining_risk", "action"]
_ACTION = (f"CASE WHEN remaining_risk >= 55 THEN '{mt.ACTION_TEXT[0]}' WHEN remaining_risk >= 35 THEN '{mt.ACTION_TEXT[1]}' "
           f"ELSE '{mt.ACTION_TEXT[2]}' END")


@register("remaining_risk", with_(DOWNTIME, *REMAINING_CTES) + f"""SELECT {_sel(REM_COLS[:-1])}, {_ACTION} AS action
FROM rem ORDER BY remaining_risk DESC, machine_id, line_id NULLS LAST LIMIT 8""")
def remaining_risk(spark, sf):
    """Remaining risk = rule score + sensor boost (0 here) + recency, top 8."""
    return mt.remaining_risk(td.downtime(spark, sf)).select(*REM_COLS)


_WHY = ("concat_ws('; ', printf('MTTR %.0f min; %.2f fails/day; %.0f%% unplanned', mttr_min, failure_freq_per_day, unplanned_share * 100), "
        "CASE WHEN iso_anomaly_rate_pct > 5 THEN printf('sensor anomalies %.0f%%', iso_anomaly_rate_pct) END, "
        "CASE WHEN events_7d > 0 THEN printf('%d events in last 7 days of data', CAST(events_7d AS BIGINT)) END)")


@register("risk_action", with_(DOWNTIME, *REMAINING_CTES) + f"SELECT machine_id, line_id, {_ACTION} AS action, {_WHY} AS why FROM rem")
def risk_action(spark, sf):
    """Action by risk thresholds and a why text per asset (all assets)."""
    return mt.remaining_risk(td.downtime(spark, sf), top_n=None).select("machine_id", "line_id", "action", "why")


@register("availability_loss_hours", with_(PLANT, DOWNTIME) + f"""SELECT {r4('dt.t / 60')} AS downtime_hours, {r4('dt.u / 60')} AS unplanned_hours,
  {r4('dt.p / 60')} AS planned_downtime_hours, pl.availability AS oee_availability, {r4('pl.h')} AS planned_production_hours,
  {r4('(1 - pl.a) * pl.h')} AS availability_loss_hours, {r4('greatest(0.0, (0.90 - pl.a) * pl.h)')} AS hours_to_90pct_availability
FROM (SELECT sum(coalesce(downtime_minutes, 0.0)) AS t,
        sum(CASE WHEN NOT coalesce(is_planned, false) THEN coalesce(downtime_minutes, 0.0) ELSE 0.0 END) AS u,
        sum(CASE WHEN coalesce(is_planned, false) THEN coalesce(downtime_minutes, 0.0) ELSE 0.0 END) AS p FROM downtime) dt,
     (SELECT availability, a, h FROM (""" + oee_group_select("", extra=", " + pillars("_p", "_d", "_i", "_t", "_g")["availability"] + " AS a, _p / 60 AS h") + ")) pl")
def availability_loss_hours(spark, sf):
    """Downtime hours by class against plant availability loss hours."""
    plant_rows = td.plant_rows(spark, sf)
    p = oee.plant(plant_rows)
    hours = plant_rows.select(F.sum("planned_time_min") / 60.0).scalar()
    return mt.availability_loss_hours(td.downtime(spark, sf), p, hours)
