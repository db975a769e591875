"""Insight queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.operators import insights as ins
from millwright.plans.catalog import register
from millwright.plans.q_downtime import US_PER_MIN, pareto_sql
from millwright.plans.q_finance import LOST, MATRIX_CTES, NARRATIVE_CTES, PLANT_PILLARS
from millwright.plans.q_maintenance import _ACTION, _WHY
from millwright.plans.q_quality import _SF, _WORST, OOC, SPC_CTES, WEEK, _by_line_sql
from millwright.plans.sqlparts import DOWNTIME, PLANT, dollars, fixed, percent, pillars, r4, with_
from millwright.sources import testdata as td

_rm = pillars("_p", "_d", "_i", "_t", "_g")
_SUMS = "sum(planned_time_min) AS _p, sum(downtime_minutes) AS _d, avg(ideal_rate) AS _i, sum(total_count) AS _t, sum(good_count) AS _g"


def _by(k: str) -> str:
    return f"(SELECT {k}, {_rm['oee']} AS oee FROM (SELECT {k}, {_SUMS} FROM plant GROUP BY {k}))"


BASE = [PLANT, DOWNTIME, f"bl AS {_by('line_id')}", f"bm AS {_by('machine_id')}", f"bs AS {_by('shift')}",
        PLANT_PILLARS, LOST, pareto_sql("downtime", "downtime_code", "coalesce(downtime_minutes, 0.0)", 5)]

# sums of planned and unplanned minutes, week's scrap per line, capability inputs
MORE = [*MATRIX_CTES, *SPC_CTES, WEEK,
        """pu AS (SELECT sum(coalesce(downtime_minutes, 0.0)) AS t,
   sum(CASE WHEN coalesce(is_planned, false) THEN coalesce(downtime_minutes, 0.0) ELSE 0.0 END) AS pl,
   sum(CASE WHEN NOT coalesce(is_planned, false) THEN coalesce(downtime_minutes, 0.0) ELSE 0.0 END) AS un FROM downtime)""",
        f"kl AS (WITH {_by_line_sql('wk')} SELECT * FROM blw)",
        f"bq AS (SELECT line_id, {_rm['quality']} AS quality FROM (SELECT line_id, {_SUMS} FROM plant GROUP BY line_id))",
        """sp AS (SELECT median(lsl) AS lo, median(usl) AS hi, avg(measurement_mm) AS m, stddev_samp(measurement_mm) AS s FROM plant)""",
        "cap AS (SELECT (hi - lo) / (6.0 * s) AS cp, least((hi - m) / (3.0 * s), (m - lo) / (3.0 * s)) AS cpk FROM sp)"]

_USD_TOTAL = "greatest(availability_hours, 0.0) * 850.0 + greatest(performance_hours, 0.0) * 850.0 + greatest(quality_hours, 0.0) * 850.0"
_PILLAR = "(CASE WHEN a <= p AND a <= q THEN 'Availability' WHEN p <= q THEN 'Performance' ELSE 'Quality' END)"
_SCRAP_BEST = "(SELECT line_id FROM kl ORDER BY scrap_rate_weighted, line_id NULLS FIRST LIMIT 1)"
_SCRAP_PLANT = f"(SELECT CASE WHEN total <> 0 THEN rejects / total ELSE 0.0 END FROM {_SF.format(src='wk')})"


def _p(x: str) -> str:
    return percent(r4(x))


def _f(x: str, digits: int = 1) -> str:
    return fixed(r4(x), digits)


# (seq, priority, title, metric, value, message): the sentences of ``insights.cards``, one SELECT per rule
CARDS = [*BASE, *MORE, *NARRATIVE_CTES, f"""cards AS (
  SELECT 1 AS seq, CASE WHEN o < 0.65 THEN 'high' WHEN o < 0.85 THEN 'medium' ELSE 'low' END AS priority, 'Plant OEE position' AS title,
         'oee' AS metric, o AS value, 'Overall effectiveness stands at ' || {_p('o')} || ': availability ' || {_p('a')} || ', performance ' || {_p('p')}
         || ', quality ' || {_p('q')} || '.' AS message FROM pp
  UNION ALL SELECT 2, 'high', 'Primary loss pillar: ' || {_PILLAR}, 'pillar', least(a, p, q),
         'Of the three pillars ' || {_PILLAR} || ' costs most; it stands at ' || {_p('least(a, p, q)')} || '.' FROM pp
  UNION ALL SELECT 3, 'high', 'Line ' || arg_min(line_id, oee) || ' underperforming', 'line_oee', min(oee), 'Lowest line: ' || arg_min(line_id, oee)
         || ' with an OEE of ' || {_p('min(oee)')} || '. Highest: ' || arg_max(line_id, oee) || ' with ' || {_p('max(oee)')} || '.' FROM bl HAVING count(*) > 0
  UNION ALL SELECT 4, 'medium', 'Machine ' || arg_min(machine_id, oee) || ' is the bottleneck', 'machine_oee', min(oee),
         'No machine has a lower OEE than ' || arg_min(machine_id, oee) || ': ' || {_p('min(oee)')} || '.' FROM bm HAVING count(*) > 0
  UNION ALL SELECT 5, 'medium', 'Shift performance gap', 'shift_oee', min(oee), 'Shifts differ: ' || arg_min("shift", oee) || ' runs at an OEE of '
         || {_p('min(oee)')} || ', ' || arg_max("shift", oee) || ' at ' || {_p('max(oee)')} || '.' FROM bs HAVING count(*) > 1
  UNION ALL SELECT 6, 'high', 'Top downtime driver', 'downtime_pct', pct, 'Most time is lost to ''' || cause || ''': ' || {_p('pct')}
         || ' of all downtime, ' || {_f('downtime_minutes', 0)} || ' minutes in ' || events || ' stops.' FROM c WHERE _rk = 1
  UNION ALL (SELECT 7, 'high', 'Changeover availability loss', 'changeover_pct', pct, 'Setting up (''' || cause || ''') took '
         || {_f('downtime_minutes', 0)} || ' minutes, a share of ' || {_p('pct')} || '.' FROM c WHERE contains(lower(cause), 'change')
             ORDER BY downtime_minutes DESC, cause LIMIT 1)
  UNION ALL SELECT 8, 'medium', 'Reliability snapshot', 'mttr_min', avg(downtime_minutes), 'A repair takes ' || {_f('avg(downtime_minutes)')}
         || ' minutes on average; ' || count(*) || ' stops were counted.' FROM downtime WHERE downtime_minutes > 0 HAVING count(*) > 0
  UNION ALL SELECT 9, 'medium', 'Chronic downtime machines', 'downtime_minutes', max(m), 'Machines with most downtime, in order: '
         || string_agg(machine_id, ', ' ORDER BY m DESC, machine_id) || '.'
            FROM (SELECT machine_id, sum(coalesce(downtime_minutes, 0.0)) AS m FROM downtime WHERE machine_id IS NOT NULL GROUP BY machine_id
                  ORDER BY m DESC, machine_id LIMIT 3) HAVING count(*) > 0
  UNION ALL SELECT 10, 'medium', 'Production planning caution', 'oee', o, 'OEE is under 75%: leave slack in the production plan.' FROM pp WHERE o < 0.75
  UNION ALL SELECT 11, 'high', 'Lost OEE dollars (Management estimate)', 'total_usd', {_USD_TOTAL}, 'Lost availability: ' || {_f('availability_hours')}
         || ' hours, worth ' || {dollars(r4('greatest(availability_hours, 0.0) * 850.0'))} || '; all three losses together: ' || {dollars(r4(_USD_TOTAL))} || '.' FROM lh
  UNION ALL SELECT 12, 'high', 'Inspect first by cost and risk', 'priority_score', priority_score, narrative FROM nar
  UNION ALL (SELECT 13, 'high', 'Inspect first: ' || machine_id, 'remaining_risk', remaining_risk, machine_id || ' on line ' || line_id || ' has remaining risk '
         || {_f('remaining_risk', 0)} || ' of 100. ' || {_WHY} || '. ' || {_ACTION} || '.' FROM rem
             ORDER BY remaining_risk DESC, machine_id, line_id NULLS LAST LIMIT 1)
  UNION ALL SELECT 14, 'high', 'Unplanned stops dominate', 'unplanned_pct', un / t, {_p('un / t')} || ' of downtime (' || {_f('un', 0)} || ' min) was not planned.'
            FROM pu WHERE t <> 0 AND un / t >= 0.45
  UNION ALL SELECT 15, 'medium', 'Availability loss hours', 'availability_loss_hours', (1 - a) * h, {_f('(1 - a) * h')} || ' of ' || {_f('h')}
         || ' planned hours were lost to availability; logged downtime is ' || {_f('t / 60')} || ' hours.' FROM pp, pu
  UNION ALL (SELECT 16, 'high', 'Line ' || line_id || ' hurts quality most this week', 'worst_scrap_rate', scrap_rate_weighted, 'Line ' || line_id || ' scraps '
         || {_p('scrap_rate_weighted')} || ' (plant ' || {_p(_SCRAP_PLANT)} || ') and makes ' || {_p('reject_share')} || ' of all rejects; best is line '
         || {_SCRAP_BEST} || '.' FROM kl {_WORST})
  UNION ALL (SELECT 17, 'medium', 'Quality pillar weakest on line ' || line_id, 'line_quality', quality, 'Line ' || line_id || ' has the lowest quality pillar, '
         || {_p('quality')} || '.' FROM bq ORDER BY quality, line_id NULLS FIRST LIMIT 1)
  UNION ALL SELECT 18, 'high', 'Points outside control limits', 'spc_ooc', CAST(count(*) AS DOUBLE),
         count(*) || ' daily points lie outside the plant''s I-MR limits.' FROM pm, lim WHERE n >= 5 AND {OOC} HAVING count(*) > 0
  UNION ALL SELECT 19, 'high', 'Process not capable (Cpk below 1)', 'cpk', cpk, 'measurement_mm: Cpk ' || {_f('cpk', 3)} || ', Cp ' || {_f('cp', 3)} || ' between '
         || {_f('lo', 3)} || ' and ' || {_f('hi', 3)} || '.' FROM cap, sp WHERE cpk < 1.0)"""]
_RANK = "CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"


@register("insight_cards", with_(*CARDS) + f"SELECT priority, title, metric, {r4('value')} AS value FROM cards")
def insight_cards(spark, sf):
    """Prioritised cards (priority, title, metric, value); messages in insight_messages."""
    return ins.cards(td.plant_rows(spark, sf), td.downtime(spark, sf)).select("priority", "title", "metric", "value")


@register("insight_messages", with_(*CARDS) + f"SELECT priority, title, message FROM cards ORDER BY {_RANK}, seq")
def insight_messages(spark, sf):
    """The cards with their plant-language messages, high priority first."""
    c = ins.cards(td.plant_rows(spark, sf), td.downtime(spark, sf))
    return c.orderBy("rank", "seq").select("priority", "title", "message")


@register("pareto_third_cause", with_(*BASE) + f"""SELECT cause, {r4('cum_pct')} AS cum_pct FROM c
WHERE _rk = least(3, (SELECT count(*) FROM c WHERE _rk <= 5))""")
def pareto_third_cause(spark, sf):
    """Cumulative downtime share reached by the third cause."""
    return ins.third_cause(td.downtime(spark, sf))


@register("changeover_loss", with_(DOWNTIME, pareto_sql("downtime", "downtime_category", "coalesce(downtime_minutes, 0.0)", 0))
          + f"""SELECT cause, {r4('downtime_minutes')} AS downtime_minutes, {r4('pct')} AS pct FROM c WHERE contains(lower(cause), 'change')""")
def changeover_loss(spark, sf):
    """Changeover causes (by category text): minutes and share of downtime."""
    return ins.changeover_loss(td.downtime(spark, sf), code_col="downtime_category")


def _ctx(scope: str, entity: str, metrics: dict[str, str], src: str) -> str:
    """One SELECT per metric over the same source."""
    return " UNION ALL ".join(f"SELECT '{scope}' AS scope, {entity} AS entity, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM {src}"
                              for m, e in metrics.items())


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


_ASSET, _PLANT = "machine_id || ' / ' || line_id", "'plant'"
_GROUP = f"(SELECT {{k}}, {_rm['oee']} AS oee, {_rm['availability']} AS availability, _d AS downtime_minutes FROM (SELECT {{k}}, {_SUMS} FROM plant GROUP BY {{k}}) ORDER BY oee, {{k}} LIMIT {{n}})"
_GAPS = f"""(SELECT m, greatest(mg - m, 0.0) AS b FROM (SELECT avg(gap) AS mg FROM (SELECT (epoch_us(start_time)
   - epoch_us(lag(start_time) OVER (PARTITION BY machine_id ORDER BY start_time))) / {US_PER_MIN} AS gap
   FROM downtime WHERE start_time IS NOT NULL AND machine_id IS NOT NULL)),
   (SELECT avg(downtime_minutes) AS m FROM downtime WHERE downtime_minutes > 0))"""
_USD = {k: f"greatest({k}_hours, 0.0) * 850.0" for k in ("availability", "performance", "quality")}
_DEFECTS = f"(WITH {pareto_sql('plant', chr(34) + 'defect_code' + chr(34), 'coalesce(reject_count, 0.0)', 4, value='rejects')} SELECT * FROM c WHERE _rk <= 4)"
CONTEXT_SQL = with_(*BASE, *MORE, f"sfp AS {_SF.format(src='plant')}") + f"SELECT scope, entity, metric, {r4('value')} AS value FROM (" + " UNION ALL ".join([
    _ctx("plant", _PLANT, {"availability": "a", "performance": "p", "quality": "q", "oee": "o", "world_class_gap": "greatest(0.85 - o, 0.0)"}, "pp"),
    _ctx("line", "line_id", _same("oee", "availability"), _GROUP.format(k="line_id", n=8)),
    _ctx("machine", "machine_id", _same("oee", "downtime_minutes"), _GROUP.format(k="machine_id", n=5)),
    _ctx("cause", "cause", _same("downtime_minutes", "pct"), "(SELECT * FROM c WHERE _rk <= 6)"),
    _ctx("reliability", _PLANT, {"mttr_min": "m", "mtbf_min": "b"}, _GAPS),
    _ctx("reliability", _PLANT, {"events": "count(*)"}, "(SELECT 1 FROM downtime WHERE downtime_minutes > 0)"),
    _ctx("money", _PLANT, {"availability_hours": "availability_hours", "availability_usd": _USD["availability"],
                           "total_usd": " + ".join(_USD.values())}, "lh"),
    _ctx("asset", _ASSET, _same("availability_hours_lost", "usd_lost", "remaining_risk", "priority_score"),
         "(SELECT * FROM mp ORDER BY priority_score DESC, machine_id NULLS LAST, line_id NULLS LAST LIMIT 5)"),
    _ctx("maintenance", _PLANT, {"downtime_hours": "t / 60", "planned_min": "pl", "unplanned_min": "un",
                                 "planned_pct": "CASE WHEN t <> 0 THEN pl / t ELSE 0.0 END"}, "pu"),
    _ctx("maintenance", _PLANT, {"availability_loss_hours": "(1 - a) * h"}, "pp"),
    _ctx("inspect", _ASSET, _same("remaining_risk"),
         "(SELECT * FROM rem ORDER BY remaining_risk DESC, machine_id, line_id NULLS LAST LIMIT 4)"),
    _ctx("quality", _PLANT, {"scrap_rate": "CASE WHEN total <> 0 THEN rejects / total ELSE 0.0 END",
                             "fpy": "CASE WHEN total <> 0 THEN 1.0 - rejects / total ELSE 0.0 END"}, "sfp"),
    _ctx("quality", _PLANT, {"quality_oee": "q"}, "pp"),
    _ctx("defect", "cause", _same("rejects", "pct"), _DEFECTS),
    _ctx("quality", _PLANT, _same("cp", "cpk"), "cap"),
]) + ")"


@register("metrics_context", CONTEXT_SQL)
def metrics_context(spark, sf):
    """I4: flat metrics context (scope, entity, metric, value)."""
    return ins.metrics_context(td.plant_rows(spark, sf), td.downtime(spark, sf))


_TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@register("match_cards", with_(
    *CARDS,
    f"ct AS (SELECT title, {_RANK} AS rk, seq, {_TOKENS.format("title || ' ' || message")} AS tok FROM cards)",
    f"""qs AS (SELECT row_number() OVER () AS qid, conv_id, turn, {_TOKENS.format("coalesce(text, '')")} AS tok, text IS NULL AS missing
   FROM conversations WHERE role = 'user')""",
    """sc AS (SELECT qid, conv_id, turn, title, len(list_intersect(qs.tok, ct.tok)) AS score, missing,
   row_number() OVER (PARTITION BY qid ORDER BY len(list_intersect(qs.tok, ct.tok)) DESC, rk, seq) AS place FROM qs, ct)""",
) + """SELECT conv_id, turn, CASE WHEN score > 0 AND NOT missing THEN title END AS best_card,
  CASE WHEN missing THEN 0 ELSE CAST(score AS INTEGER) END AS score FROM sc WHERE place = 1""")
def match_cards(spark, sf):
    """Every user question of ``conversations`` matched to its best insight card."""
    conv = td.table(spark, sf, "conversations").where(F.col("role") == "user").select("conv_id", "turn", "text")
    cards = ins.cards(td.plant_rows(spark, sf), td.downtime(spark, sf))
    return ins.match_cards(conv, cards)
