"""OEE queries (O1-O10) over the lineitem-derived plant frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.operators import oee
from millwright.plans.catalog import register
from millwright.plans.sqlparts import PLANT, oee_group_select, pillars, r4, with_
from millwright.sources import testdata as td

ROW_KEYS = ["l_orderkey", "l_linenumber", "line_id", "machine_id", "shift", "shift_date"]


def _pillars_rows_sql(extra: str = "") -> str:
    m = pillars("planned_time_min", "downtime_minutes", "ideal_rate", "total_count", "good_count")
    return f"""SELECT l_orderkey, l_linenumber, line_id, machine_id, shift, shift_date,
  {r4(m['run_time_min'])} AS run_time_min, {r4(m['availability'])} AS availability,
  {r4(m['performance'])} AS performance, {r4(m['quality'])} AS quality, {r4(m['oee'])} AS oee{extra}
FROM plant"""


@register("oee_prepare", with_(PLANT) + """SELECT l_orderkey, l_linenumber, planned_time_min, downtime_minutes,
  ideal_rate, total_count, good_count FROM plant""")
def oee_prepare(spark, sf):
    """O1: canonical OEE inputs with defaults and coercion."""
    return oee.prepare(td.plant_rows(spark, sf)).select(
        "l_orderkey", "l_linenumber", "planned_time_min", "downtime_minutes", "ideal_rate", "total_count", "good_count"
    )


@register("oee_rows", with_(PLANT) + _pillars_rows_sql())
def oee_rows(spark, sf):
    """O2: row-level run time, A, P, Q, OEE."""
    return oee.rows(td.plant_rows(spark, sf)).select(*ROW_KEYS, *oee.METRICS)


_rm = pillars("_p", "_d", "_i", "_t", "_g")
_m = pillars("planned_time_min", "downtime_minutes", "ideal_rate", "total_count", "good_count")
_A, _P, _Q = _m["availability"], _m["performance"], _m["quality"]


@register("oee_losses", with_(PLANT) + f"""SELECT l_orderkey, l_linenumber,
  {r4(f'greatest(1 - {_A}, 0.0::DOUBLE)')} AS loss_availability,
  {r4(f'greatest({_A} * (1 - {_P}), 0.0::DOUBLE)')} AS loss_performance,
  {r4(f'greatest({_A} * {_P} * (1 - {_Q}), 0.0::DOUBLE)')} AS loss_quality
FROM plant""")
def oee_losses(spark, sf):
    """O3: availability, performance and quality losses per row."""
    return oee.rows(td.plant_rows(spark, sf)).select(
        "l_orderkey", "l_linenumber", "loss_availability", "loss_performance", "loss_quality"
    )


for _name, _keys in {
    "oee_by_line": ["line_id"],
    "oee_by_machine": ["machine_id"],
    "oee_by_shift": ["shift"],
    "oee_by_cell": ["line_id", "machine_id", "shift", "shift_date"],
}.items():

    def _make(keys):
        def q(spark, sf):
            return oee.aggregate(td.plant_rows(spark, sf), keys)

        q.__doc__ = f"O4: weighted OEE by {', '.join(keys)}."
        return q

    register(_name, with_(PLANT) + oee_group_select(", ".join(_keys)))(_make(_keys))


@register("oee_plant", with_(PLANT) + "SELECT 'plant' AS scope, * FROM (" + oee_group_select("") + ")")
def oee_plant(spark, sf):
    """Plant OEE as the global weighted aggregate."""
    return oee.plant(td.plant_rows(spark, sf))


@register("oee_worst_cell", with_(PLANT) + "SELECT * EXCLUDE (_o) FROM (" + oee_group_select(
    "line_id, machine_id, shift, shift_date", extra=", " + _rm["oee"] + " AS _o")
          + ") ORDER BY _o, line_id, machine_id, shift, shift_date LIMIT 1")
def oee_worst_cell(spark, sf):
    """Lowest-OEE cell (what the reference reports as 'plant')."""
    return oee.worst_cell(td.plant_rows(spark, sf))


@register("oee_gap", with_(PLANT) + "SELECT oee, " + r4("greatest(0.85 - oee, 0.0)")
          + " AS world_class_gap FROM (" + oee_group_select("") + ")")
def oee_gap(spark, sf):
    """Gap of plant OEE to world-class 0.85."""
    return oee.gap(td.plant_rows(spark, sf))


_oee = _m["oee"]


@register("oee_loss_mean", with_(PLANT) + f"""SELECT metric, {r4('value')} AS value FROM (
  SELECT 'loss_availability' AS metric, avg(greatest(1 - {_A}, 0.0::DOUBLE)) AS value FROM plant
  UNION ALL SELECT 'loss_performance', avg(greatest({_A} * (1 - {_P}), 0.0::DOUBLE)) FROM plant
  UNION ALL SELECT 'loss_quality', avg(greatest({_A} * {_P} * (1 - {_Q}), 0.0::DOUBLE)) FROM plant
  UNION ALL SELECT 'oee', avg({_oee}) FROM plant)""")
def oee_loss_mean(spark, sf):
    """Mean losses and OEE over rows, long format."""
    return oee.loss_mean(td.plant_rows(spark, sf))


@register("oee_rollup", with_(PLANT) + f"""SELECT scope, key,
  {r4(_rm['run_time_min'])} AS run_time_min, {r4(_rm['availability'])} AS availability,
  {r4(_rm['performance'])} AS performance, {r4(_rm['quality'])} AS quality, {r4(_rm['oee'])} AS oee,
  shifts, {r4('_t')} AS total_count, {r4('_g')} AS good_count, {r4('_d')} AS downtime_minutes
FROM (
  SELECT CASE grouping(line_id, machine_id, shift) WHEN 7 THEN 'plant' WHEN 3 THEN 'line' WHEN 5 THEN 'machine' ELSE 'shift' END AS scope,
         CASE grouping(line_id, machine_id, shift) WHEN 3 THEN line_id WHEN 5 THEN machine_id WHEN 6 THEN shift END AS key,
         sum(planned_time_min) AS _p, sum(downtime_minutes) AS _d, avg(ideal_rate) AS _i,
         sum(total_count) AS _t, sum(good_count) AS _g, count(*) AS shifts
  FROM plant GROUP BY GROUPING SETS ((), (line_id), (machine_id), (shift)))""")
def oee_rollup(spark, sf):
    """Plant, line, machine and shift OEE in one grouping-sets aggregate."""
    return oee.rollup(td.plant_rows(spark, sf))


def _ext_sql() -> str:
    g = lambda k: f"(SELECT {k}, {_rm['oee']} AS oee FROM (SELECT {k}, sum(planned_time_min) AS _p, sum(downtime_minutes) AS _d, avg(ideal_rate) AS _i, sum(total_count) AS _t, sum(good_count) AS _g FROM plant GROUP BY {k}))"
    pl = f"(SELECT {_rm['availability']} AS a, {_rm['performance']} AS p, {_rm['quality']} AS q FROM (SELECT sum(planned_time_min) AS _p, sum(downtime_minutes) AS _d, avg(ideal_rate) AS _i, sum(total_count) AS _t, sum(good_count) AS _g FROM plant))"
    return with_(PLANT, f"bl AS {g('line_id')}", f"bm AS {g('machine_id')}", f"bs AS {g('shift')}", f"pl AS {pl}") + f"""
SELECT CASE WHEN a <= p AND a <= q THEN 'Availability' WHEN p <= q THEN 'Performance' ELSE 'Quality' END AS weakest_pillar,
  {r4('least(a, p, q)')} AS weakest_value,
  (SELECT line_id FROM bl ORDER BY oee, line_id NULLS FIRST LIMIT 1) AS worst_line, (SELECT {r4('min(oee)')} FROM bl) AS worst_line_oee,
  (SELECT line_id FROM bl ORDER BY oee DESC, line_id NULLS FIRST LIMIT 1) AS best_line, (SELECT {r4('max(oee)')} FROM bl) AS best_line_oee,
  (SELECT machine_id FROM bm ORDER BY oee, machine_id NULLS FIRST LIMIT 1) AS worst_machine, (SELECT {r4('min(oee)')} FROM bm) AS worst_machine_oee,
  (SELECT shift FROM bs ORDER BY oee, shift NULLS FIRST LIMIT 1) AS worst_shift, (SELECT {r4('min(oee)')} FROM bs) AS worst_shift_oee,
  (SELECT shift FROM bs ORDER BY oee DESC, shift NULLS FIRST LIMIT 1) AS best_shift, (SELECT {r4('max(oee)')} FROM bs) AS best_shift_oee
FROM pl"""


@register("oee_extremes", _ext_sql())
def oee_extremes(spark, sf):
    """Weakest pillar and worst/best line, machine, shift."""
    return oee.extremes(td.plant_rows(spark, sf))
