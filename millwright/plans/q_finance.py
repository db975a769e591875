"""Finance queries (F1-F8): rates, lost hours, dollars, asset cost x risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.operators import finance as fi
from millwright.plans.catalog import register
from millwright.plans.q_downtime import pareto_sql
from millwright.plans.q_maintenance import REMAINING_CTES, _norm
from millwright.plans.sqlparts import DOWNTIME, PLANT, dollars, fixed, pillars, r4, with_
from millwright.sources import testdata as td

RATE = "CAST(CASE line_id WHEN 'L1' THEN 850 WHEN 'L2' THEN 1100 WHEN 'L3' THEN 720 ELSE 850 END AS DOUBLE)"
_pm = pillars("_p", "_d", "_i", "_t", "_g")
_rm = pillars("planned_time_min", "downtime_minutes", "ideal_rate", "total_count", "good_count")
PLANT_PILLARS = f"""pp AS (SELECT _p / 60 AS h, {_pm['availability']} AS a, {_pm['performance']} AS p, {_pm['quality']} AS q, {_pm['oee']} AS o
  FROM (SELECT sum(planned_time_min) AS _p, sum(downtime_minutes) AS _d, avg(ideal_rate) AS _i, sum(total_count) AS _t,
               sum(good_count) AS _g FROM plant))"""
LOST = """lh AS (SELECT h AS planned_hours, (1 - a) * h AS availability_hours, a * (1 - least(p, 1.0)) * h AS performance_hours,
   a * least(p, 1.0) * (1 - least(q, 1.0)) * h AS quality_hours, (1 - least(o, 1.0)) * h AS oee_hours,
   a AS availability, p AS performance, q AS quality, o AS oee FROM pp)"""


@register("line_rate", with_(PLANT) + f"SELECT line_id, {RATE} AS usd_per_hour FROM (SELECT DISTINCT line_id FROM plant)")
def line_rate(spark, sf):
    """F1 + F2: normalised rates; each production line's $/hour (line rate, else plant rate)."""
    lines = td.production(spark, sf).select("line_id").distinct()
    return fi.with_line_rate(lines, fi.normalize_rates(None))


@register("lost_hours", with_(PLANT, PLANT_PILLARS, LOST) + "SELECT " + ", ".join(
    f"{r4(c)} AS {c}" for c in ["planned_hours", "availability_hours", "performance_hours", "quality_hours", "oee_hours",
                                "availability", "performance", "quality", "oee"]) + " FROM lh")
def lost_hours(spark, sf):
    """OEE losses expressed as hours of planned time."""
    return fi.lost_hours(td.plant_rows(spark, sf))


@register("dollar_impact", with_(PLANT, PLANT_PILLARS, LOST) + f"""SELECT 850.0::DOUBLE AS plant_usd_per_hour,
  {r4('availability_hours')} AS availability_hours, {r4('performance_hours')} AS performance_hours, {r4('quality_hours')} AS quality_hours,
  {r4('greatest(availability_hours, 0.0) * 850.0')} AS availability_usd, {r4('greatest(performance_hours, 0.0) * 850.0')} AS performance_usd,
  {r4('greatest(quality_hours, 0.0) * 850.0')} AS quality_usd,
  {r4('greatest(availability_hours, 0.0) * 850.0 + greatest(performance_hours, 0.0) * 850.0 + greatest(quality_hours, 0.0) * 850.0')} AS total_usd,
  'Management estimate' AS label FROM lh""")
def dollar_impact(spark, sf):
    """dollar impact of lost hours per pillar at the plant rate."""
    return fi.dollar_impact(td.plant_rows(spark, sf))


@register("pareto_dollars", with_(
    DOWNTIME, f"dr AS (SELECT *, {RATE} AS rate FROM downtime)",
    pareto_sql("dr", "downtime_code", "coalesce(downtime_minutes, 0.0)", 12,
               extra_cols=", sum(coalesce(downtime_minutes, 0.0) / 60.0 * rate) AS usd_lost"),
) + f"""SELECT cause, events, {r4('downtime_minutes')} AS downtime_minutes, {r4('usd_lost')} AS usd_lost, {r4('pct')} AS pct,
  {r4('cum_pct')} AS cum_pct FROM c WHERE _rk <= 12""")
def pareto_dollars(spark, sf):
    """downtime Pareto with dollars at line rates (pct of the full total)."""
    return fi.pareto_dollars(td.downtime(spark, sf))


ASSET_HOURS = f"""ah AS (SELECT machine_id, line_id, sum(planned_time_min) / 60.0 AS planned_hours, avg({_rm['availability']}) AS availability
  FROM plant GROUP BY machine_id, line_id)"""


@register("asset_hours", with_(PLANT, ASSET_HOURS) + f"""SELECT machine_id, line_id, {r4('planned_hours')} AS planned_hours,
  {r4('availability')} AS availability, {r4('(1 - availability) * planned_hours')} AS availability_hours_lost FROM ah""")
def asset_hours(spark, sf):
    """planned hours, mean availability and hours lost per asset."""
    return fi.asset_hours(td.plant_rows(spark, sf))


MATRIX_CTES = [
    ASSET_HOURS,
    *REMAINING_CTES,
    f"""mx AS (SELECT ah.machine_id, ah.line_id, ah.planned_hours, ah.availability,
   coalesce((1 - ah.availability) * ah.planned_hours, 0.0) AS availability_hours_lost,
   coalesce(rem.remaining_risk, 0.0) AS remaining_risk, rem.rule_score, rem.events, rem.downtime_minutes
  FROM ah LEFT JOIN rem ON ah.machine_id IS NOT DISTINCT FROM rem.machine_id AND ah.line_id IS NOT DISTINCT FROM rem.line_id)""",
    f"mr AS (SELECT mx.*, {RATE} AS usd_per_hour, availability_hours_lost * {RATE} AS usd_lost FROM mx)",
    "ms AS (SELECT min(usd_lost) AS u0, max(usd_lost) AS u1, min(remaining_risk) AS k0, max(remaining_risk) AS k1 FROM mr)",
    f"""mp AS (SELECT mr.*, 55.0 * {_norm('usd_lost', 'u0', 'u1')} + 45.0 * {_norm('remaining_risk', 'k0', 'k1')} AS priority_score FROM mr, ms)""",
]
MATRIX_COLS = ["machine_id", "line_id", "planned_hours", "availability", "availability_hours_lost", "remaining_risk",
               "rule_score", "events", "downtime_minutes", "usd_per_hour", "usd_lost", "priority_score"]


def _cols(cols):
    keep = {"machine_id", "line_id", "events"}
    return ", ".join(c if c in keep else f"{r4(c)} AS {c}" for c in cols)


@register("cost_risk_matrix", with_(PLANT, DOWNTIME, *MATRIX_CTES) + f"""SELECT {_cols(MATRIX_COLS)}, 'Management estimate' AS label
FROM mp ORDER BY priority_score DESC, machine_id NULLS LAST, line_id NULLS LAST LIMIT 20""")
def cost_risk_matrix(spark, sf):
    """asset hours lost x $ next to remaining risk, top 20 by priority."""
    return fi.cost_risk_matrix(td.plant_rows(spark, sf), td.downtime(spark, sf)).select(*MATRIX_COLS, "label")


# the three first rows of the rounded matrix, and the narrative over them
NARRATIVE_CTES = [
    f"""m3 AS (SELECT machine_id, line_id, {r4('priority_score')} AS s, {r4('availability_hours_lost')} AS hours, {r4('usd_lost')} AS usd,
   {r4('remaining_risk')} AS risk FROM (SELECT * FROM mp ORDER BY priority_score DESC, machine_id NULLS LAST, line_id NULLS LAST LIMIT 20)
  ORDER BY s DESC, machine_id NULLS LAST LIMIT 3)""",
    f"""nar AS (SELECT machine_id, line_id, s AS priority_score, 'Inspect this week: ' || machine_id || ' on ' || line_id
   || ' is both costly and high failure-risk. Availability hours lost ' || {fixed('hours')} || ' h · ' || {dollars('usd')}
   || ' (Management estimate) · PdM risk ' || {fixed('risk', 0)} || '/100. Top 3 by $ × risk: '
   || (SELECT string_agg(machine_id || ' (' || {dollars('usd')} || ', risk ' || {fixed('risk', 0)} || ')', '; ' ORDER BY s DESC, machine_id DESC) FROM m3)
   || '.' AS narrative FROM (SELECT * FROM m3 ORDER BY s DESC, machine_id, line_id LIMIT 1))""",
]


@register("inspect_top3", with_(PLANT, DOWNTIME, *MATRIX_CTES, *NARRATIVE_CTES) + "SELECT machine_id, line_id, narrative FROM nar")
def inspect_top3(spark, sf):
    """F8: narrative for the top asset plus the top three by $ x risk."""
    m = fi.cost_risk_matrix(td.plant_rows(spark, sf), td.downtime(spark, sf))
    return fi.inspect_top3(m).select("machine_id", "line_id", "narrative")
