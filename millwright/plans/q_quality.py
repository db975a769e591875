"""Quality queries (Q1-Q12) over the lineitem-derived quality frame."""

from __future__ import annotations

from millwright.operators import oee
from millwright.operators import quality as qa
from millwright.plans.catalog import register
from millwright.plans.q_downtime import pareto_sql
from millwright.plans.sqlparts import PLANT, oee_group_select, pillars, r4, with_
from millwright.sources import testdata as td

SCRAP = "least(greatest(coalesce(reject_count / nullif(total_count, 0), 0.0), 0.0), 1.0)"
QC = f"""qc AS (SELECT *, {SCRAP} AS scrap_rate, least(greatest(1.0 - {SCRAP}, 0.0), 1.0) AS fpy FROM plant)"""
SUBGROUPS = "sg AS (SELECT shift_date, shift, line_id, avg(scrap_rate) AS xbar FROM qc GROUP BY 1, 2, 3)"


@register("quality_counts", with_(PLANT, QC) + f"""SELECT l_orderkey, l_linenumber, {r4('good_count')} AS good_count,
  {r4('reject_count')} AS reject_count, {r4('total_count')} AS total_count, {r4('scrap_rate')} AS scrap_rate, {r4('fpy')} AS fpy FROM qc""")
def quality_counts(spark, sf):
    """Q1: per-row counts, scrap rate and FPY."""
    return qa.counts(td.quality(spark, sf)).select(
        "l_orderkey", "l_linenumber", "good_count", "reject_count", "total_count", "scrap_rate", "fpy"
    )


_SF = """(SELECT sum(good_count) AS good, sum(reject_count) AS rejects,
   CASE WHEN sum(total_count) <= 0 THEN sum(good_count) + sum(reject_count) ELSE sum(total_count) END AS total FROM {src})"""


@register("scrap_fpy", with_(PLANT) + f"""SELECT {r4('good')} AS good, {r4('rejects')} AS rejects, {r4('total')} AS total,
  {r4('CASE WHEN total <> 0 THEN rejects / total ELSE 0.0 END')} AS scrap_rate,
  {r4('CASE WHEN total <> 0 THEN 1.0 - rejects / total ELSE 0.0 END')} AS fpy FROM {_SF.format(src='plant')}""")
def scrap_fpy(spark, sf):
    """Q2: plant scrap rate and first-pass yield."""
    return qa.scrap_fpy(td.quality(spark, sf))


def _by_line_sql(src: str) -> str:
    return f"""bl AS (SELECT line_id, sum(good_count) AS good, sum(reject_count) AS rejects, sum(total_count) AS total,
   avg(scrap_rate) AS scrap_rate, avg(fpy) AS fpy FROM {src} GROUP BY line_id),
blw AS (SELECT bl.*, CASE WHEN total > 0 THEN rejects / total ELSE scrap_rate END AS scrap_rate_weighted,
   1.0 - (CASE WHEN total > 0 THEN rejects / total ELSE scrap_rate END) AS fpy_weighted,
   rejects / greatest(coalesce((SELECT sum(reject_count) FROM {src}), 0.0), 1.0) AS reject_share FROM bl)"""


@register("scrap_by_line", with_(PLANT, QC, _by_line_sql("qc")) + f"""SELECT line_id, {r4('good')} AS good, {r4('rejects')} AS rejects,
  {r4('total')} AS total, {r4('scrap_rate')} AS scrap_rate, {r4('fpy')} AS fpy, {r4('scrap_rate_weighted')} AS scrap_rate_weighted,
  {r4('fpy_weighted')} AS fpy_weighted, {r4('reject_share')} AS reject_share FROM blw""")
def scrap_by_line(spark, sf):
    """Q3: scrap and FPY per line (mean and weighted) with reject share."""
    return qa.scrap_by_line(td.quality(spark, sf))


_pm = pillars("_p", "_d", "_i", "_t", "_g")


@register("quality_oee_link", with_(PLANT) + f"""SELECT {r4('q')} AS quality_oee, {r4('a * p * (1 - q)')} AS quality_loss_oee_pts
FROM (SELECT {_pm['availability']} AS a, {_pm['performance']} AS p, {_pm['quality']} AS q FROM (
  SELECT sum(planned_time_min) AS _p, sum(downtime_minutes) AS _d, avg(ideal_rate) AS _i, sum(total_count) AS _t,
         sum(good_count) AS _g FROM plant))""")
def quality_oee_link(spark, sf):
    """Q4: quality pillar of plant OEE and quality loss in OEE points."""
    return qa.quality_oee_link(oee.plant(td.plant_rows(spark, sf)))


@register("defect_codes", with_(PLANT) + "SELECT l_orderkey, l_linenumber, coalesce(defect_code, 'UNSPECIFIED') AS defect_code FROM plant")
def defect_codes(spark, sf):
    """Q5: defect code from the column."""
    return qa.defect_codes(td.quality(spark, sf))[0].select("l_orderkey", "l_linenumber", "defect_code")


@register("defect_codes_synth", with_(PLANT) + """SELECT l_orderkey, l_linenumber,
  ['DIM', 'SCRATCH', 'CONTAM', 'OTHER'][(strpos('0123456789abcdef', right(md5(machine_id || line_id), 1)) - 1) % 4 + 1] AS defect_code
FROM plant""")
def defect_codes_synth(spark, sf):
    """Q5: stable synthesized defect code md5(machine || line) mod 4 when no defect column exists."""
    return qa.defect_codes(td.quality(spark, sf).drop("defect_code"))[0].select("l_orderkey", "l_linenumber", "defect_code")


@register("defect_pareto", with_(PLANT, pareto_sql("plant", "coalesce(defect_code, 'UNSPECIFIED')", "coalesce(reject_count, 0.0)", 10, value="rejects"))
          + f"SELECT cause AS defect_code, events, {r4('rejects')} AS rejects, {r4('pct')} AS pct, {r4('cum_pct')} AS cum_pct, false AS synthesized FROM c WHERE _rk <= 10")
def defect_pareto(spark, sf):
    """Q6: defect Pareto by rejects, top 10."""
    return qa.defect_pareto(td.quality(spark, sf))


@register("spc_subgroups", with_(PLANT, QC, SUBGROUPS) + f"SELECT shift_date, shift, line_id, {r4('xbar')} AS xbar FROM sg")
def spc_subgroups(spark, sf):
    """Q7: subgroup means of scrap rate per date, shift, line."""
    return qa.spc_subgroups(td.quality(spark, sf))


SPC_CTES = [
    QC, SUBGROUPS,
    "ps AS (SELECT shift_date, avg(xbar) AS xbar FROM sg WHERE shift_date IS NOT NULL GROUP BY 1)",
    """pm AS (SELECT shift_date, xbar, row_number() OVER (ORDER BY shift_date) AS point,
   abs(xbar - lag(xbar) OVER (ORDER BY shift_date)) AS mr FROM ps)""",
    "lim AS (SELECT avg(xbar) AS cl, coalesce(avg(mr), 0.0) AS mr_bar, count(xbar) AS n FROM pm)",
]
OOC = "(xbar > cl + 2.66 * mr_bar OR xbar < greatest(0.0, cl - 2.66 * mr_bar))"


@register("spc_plant", with_(PLANT, *SPC_CTES) + f"""SELECT shift_date, point, {r4('xbar')} AS xbar, {r4('cl')} AS cl, {r4('cl + 2.66 * mr_bar')} AS ucl,
  {r4('greatest(0.0, cl - 2.66 * mr_bar)')} AS lcl, {r4('mr_bar')} AS mr_bar,
  {OOC} AS ooc FROM pm, lim WHERE n >= 5""")
def spc_plant(spark, sf):
    """Q8: plant I-MR control chart on daily subgroup means."""
    return qa.spc_plant(td.quality(spark, sf))


@register("spc_by_line", with_(
    PLANT, QC, SUBGROUPS,
    """lp AS (SELECT line_id, shift_date, shift, xbar, row_number() OVER (PARTITION BY line_id ORDER BY shift_date, shift) AS point,
   abs(xbar - lag(xbar) OVER (PARTITION BY line_id ORDER BY shift_date, shift)) AS mr FROM sg)""",
    "ll AS (SELECT line_id, avg(xbar) AS cl0, coalesce(avg(mr), 0.0) AS mr0, count(xbar) AS n FROM lp GROUP BY line_id)",
    """lc AS (SELECT lp.*, CASE WHEN n >= 5 THEN cl0 END AS cl, CASE WHEN n >= 5 THEN cl0 + 2.66 * mr0 END AS ucl,
   CASE WHEN n >= 5 THEN greatest(0.0, cl0 - 2.66 * mr0) END AS lcl
  FROM lp JOIN ll ON lp.line_id IS NOT DISTINCT FROM ll.line_id)""",
) + f"""SELECT line_id, shift_date, shift, point, {r4('xbar')} AS xbar, {r4('cl')} AS cl, {r4('ucl')} AS ucl, {r4('lcl')} AS lcl,
  coalesce(xbar > ucl OR xbar < lcl, false) AS ooc FROM lc""")
def spc_by_line(spark, sf):
    """Q9: per-line I-MR charts in one result."""
    return qa.spc_by_line(td.quality(spark, sf))


@register("cpk_plant", with_(PLANT) + f"""SELECT 'measurement_mm' AS measurement, {r4('lo')} AS lsl, {r4('hi')} AS usl,
  {r4('m')} AS mean, {r4('s')} AS std, n, {r4('(hi - lo) / (6.0 * s)')} AS cp,
  {r4('least((hi - m) / (3.0 * s), (m - lo) / (3.0 * s))')} AS cpk, true AS ok, NULL::VARCHAR AS reason
FROM (SELECT median(lsl) AS lo, median(usl) AS hi, avg(measurement_mm) AS m, stddev_samp(measurement_mm) AS s,
             count(measurement_mm) AS n FROM plant)""")
def cpk_plant(spark, sf):
    """Q10: plant Cp / Cpk (exact medians of the spec limits)."""
    return qa.cpk_plant(td.quality(spark, sf))


@register("cpk_by_line", with_(PLANT) + f"""SELECT line_id, n, {r4('m')} AS mean, {r4('s')} AS std, {r4('(hi - lo) / (6.0 * s)')} AS cp,
  {r4('least((hi - m) / (3.0 * s), (m - lo) / (3.0 * s))')} AS cpk
FROM (SELECT line_id, avg(measurement_mm) AS m, stddev_samp(measurement_mm) AS s, count(measurement_mm) AS n FROM plant GROUP BY line_id),
     (SELECT median(lsl) AS lo, median(usl) AS hi FROM plant)
WHERE n >= 8 AND s > 1e-12""")
def cpk_by_line(spark, sf):
    """Q11: Cp / Cpk per line against plant limits."""
    return qa.cpk_by_line(td.quality(spark, sf))


WEEK = "wk AS (SELECT * FROM qc WHERE shift_date >= (SELECT max(shift_date) FROM qc) - INTERVAL 7 DAY)"
_WORST = "ORDER BY scrap_rate_weighted DESC NULLS LAST, line_id NULLS FIRST LIMIT 1"


@register("killer_line_7d", with_(PLANT, QC, WEEK, _by_line_sql("wk")) + f"""SELECT
  (SELECT line_id FROM blw {_WORST}) AS worst_line,
  (SELECT {r4('max(scrap_rate_weighted)')} FROM blw) AS worst_scrap_rate,
  (SELECT {r4('fpy_weighted')} FROM blw {_WORST}) AS worst_fpy,
  (SELECT {r4('reject_share')} FROM blw {_WORST}) AS worst_reject_share,
  (SELECT line_id FROM blw ORDER BY scrap_rate_weighted, line_id NULLS FIRST LIMIT 1) AS best_line,
  (SELECT {r4('min(scrap_rate_weighted)')} FROM blw) AS best_scrap_rate,
  {r4('CASE WHEN total <> 0 THEN rejects / total ELSE 0.0 END')} AS plant_scrap_rate
FROM {_SF.format(src='wk')}""")
def killer_line_7d(spark, sf):
    """Q12: worst and best line by weighted scrap over the trailing 7 days."""
    return qa.killer_line(td.quality(spark, sf))
