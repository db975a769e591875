"""Downtime and reliability queries (D1-D9) over the events-derived downtime table."""

from __future__ import annotations

from millwright.operators import downtime as dt
from millwright.plans.catalog import register
from millwright.plans.sqlparts import DOWNTIME, PLANT, r4, with_
from millwright.sources import testdata as td

US_PER_MIN = "CAST(60000000 AS DOUBLE)"


def pareto_sql(src: str, cause: str, value_expr: str, top_n: int, value: str = "downtime_minutes",
               count_expr: str = "count(*)", count_name: str = "events", extra_cols: str = "") -> str:
    """Pareto over ``src``: count, value, pct of the full total, running cum_pct, top-N."""
    return f"""g AS (SELECT {cause} AS cause, {count_expr} AS {count_name}, sum({value_expr}) AS {value}{extra_cols}
       FROM {src} GROUP BY 1),
tot AS (SELECT sum({value}) AS t FROM g),
p AS (SELECT g.*, {value} / (CASE WHEN coalesce(t, 0) = 0 THEN 1.0 ELSE t END) AS pct FROM g, tot),
c AS (SELECT p.*, sum(pct) OVER (ORDER BY {value} DESC, cause ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pct,
             row_number() OVER (ORDER BY {value} DESC, cause ASC NULLS LAST) AS _rk FROM p)"""


@register("downtime_pareto", with_(DOWNTIME, pareto_sql("downtime", "downtime_code", "coalesce(downtime_minutes, 0.0)", 12))
          + f"SELECT cause, events, {r4('downtime_minutes')} AS downtime_minutes, {r4('pct')} AS pct, {r4('cum_pct')} AS cum_pct FROM c WHERE _rk <= 12")
def downtime_pareto(spark, sf):
    """Downtime Pareto by code, top 12, pct of the full total."""
    return dt.pareto(td.downtime(spark, sf), top_n=12)


@register("mttr", with_(DOWNTIME) + f"""SELECT count(*) AS events, {r4('avg(downtime_minutes)')} AS mttr_min,
  {r4('sum(downtime_minutes)')} AS total_downtime_min FROM downtime WHERE downtime_minutes > 0""")
def mttr(spark, sf):
    """MTTR over positive events."""
    return dt.mttr(td.downtime(spark, sf))


MTBF_GAPS_SQL = with_(
    DOWNTIME,
    f"""gp AS (SELECT (epoch_us(start_time) - epoch_us(lag(start_time) OVER (PARTITION BY machine_id ORDER BY start_time)))
              / {US_PER_MIN} AS gap FROM downtime WHERE start_time IS NOT NULL AND machine_id IS NOT NULL)""",
    "mt AS (SELECT avg(downtime_minutes) AS m FROM downtime WHERE downtime_minutes > 0)",
    "gs AS (SELECT count(gap) AS gaps, avg(gap) AS mg FROM gp)",
)


@register("mtbf_gaps", MTBF_GAPS_SQL + f"""SELECT gaps, {r4('mg')} AS mean_interarrival_min, {r4('m')} AS mttr_min,
  {r4('greatest(mg - m, 0.0)')} AS mtbf_min FROM gs, mt""")
def mtbf_gaps(spark, sf):
    """D3: MTBF from gaps between consecutive event starts per machine (checked against lag)."""
    return dt.mtbf_gaps(td.downtime(spark, sf))


@register("mtbf_planned", with_(PLANT) + f"""SELECT count(*) FILTER (WHERE downtime_minutes > 0) AS events,
  {r4('greatest(sum(planned_time_min) - coalesce(sum(downtime_minutes) FILTER (WHERE downtime_minutes > 0), 0.0), 0.0) / greatest(count(*) FILTER (WHERE downtime_minutes > 0), 1)')} AS mtbf_min
FROM plant""")
def mtbf_planned(spark, sf):
    """MTBF proxy from planned time over production shift rows."""
    return dt.mtbf_planned(td.production(spark, sf))


@register("mttr_timestamps", with_(DOWNTIME) + f"""SELECT count(*) AS events, {r4('avg(d)')} AS mttr_from_timestamps_min
FROM (SELECT (epoch_us(end_time) - epoch_us(start_time)) / {US_PER_MIN} AS d FROM downtime) WHERE d > 0""")
def mttr_timestamps(spark, sf):
    """MTTR from event start/end timestamps."""
    return dt.mttr_timestamps(td.downtime(spark, sf))


@register("downtime_by_dim", with_(DOWNTIME) + f"""SELECT line_id, count(downtime_minutes) AS events,
  {r4('coalesce(sum(downtime_minutes), 0.0)')} AS downtime_minutes FROM downtime WHERE line_id IS NOT NULL GROUP BY line_id""")
def downtime_by_dim(spark, sf):
    """Downtime by a dimension (line)."""
    return dt.by_dimension(td.downtime(spark, sf), "line_id")


@register("chronic_machines", with_(DOWNTIME) + f"""SELECT machine_id, count(*) AS events,
  {r4('sum(coalesce(downtime_minutes, 0.0))')} AS downtime_minutes, {r4('avg(coalesce(downtime_minutes, 0.0))')} AS mean_min
FROM downtime WHERE machine_id IS NOT NULL GROUP BY machine_id
ORDER BY sum(coalesce(downtime_minutes, 0.0)) DESC, machine_id LIMIT 5""")
def chronic_machines(spark, sf):
    """Top 5 machines by downtime minutes."""
    return dt.chronic_machines(td.downtime(spark, sf))


@register("reliability_proxy", MTBF_GAPS_SQL + f"""SELECT {r4('m')} AS mttr_min, {r4('greatest(mg - m, 0.0)')} AS mtbf_min,
  {r4('CASE WHEN greatest(mg - m, 0.0) > 0 AND m > 0 THEN greatest(mg - m, 0.0) / (greatest(mg - m, 0.0) + m) END')} AS reliability_proxy
FROM gs, mt""")
def reliability_proxy(spark, sf):
    """MTBF / (MTBF + MTTR)."""
    return dt.reliability_proxy(td.downtime(spark, sf))


@register("downtime_share_line", with_(DOWNTIME) + f"""SELECT line_id, {r4('m')} AS downtime_minutes, {r4('m / sum(m) OVER ()')} AS share
FROM (SELECT line_id, sum(coalesce(downtime_minutes, 0.0)) AS m FROM downtime GROUP BY line_id)""")
def downtime_share_line(spark, sf):
    """Downtime minutes and share by line."""
    return dt.share_by_line(td.downtime(spark, sf))
