"""Join queries (J2-J9) over cell-grain production/quality and event-level downtime."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.operators import joins as jn
from millwright.operators import oee
from millwright.plans.catalog import register
from millwright.plans.sqlparts import DOWNTIME, PLANT, oee_group_select, r4, with_
from millwright.sources import testdata as td

KEYS = jn.PLANT_KEYS
KSQL = ", ".join(KEYS)

PC = f"""pc AS (SELECT {KSQL}, sum(planned_time_min) AS planned_time_min, sum(downtime_minutes) AS downtime_minutes,
   sum(total_count) AS total_count FROM plant GROUP BY {KSQL})"""
DC = f"dc AS (SELECT {KSQL}, count(*) AS events, sum(downtime_minutes) AS downtime_minutes FROM downtime GROUP BY {KSQL})"
QCELL = f"""qcl AS (SELECT {KSQL}, sum(good_count) AS good_count, sum(reject_count) AS reject_count, avg(measurement_mm) AS measurement_mm
  FROM plant GROUP BY {KSQL})"""


def pcell(spark, sf):
    return td.plant_rows(spark, sf).groupBy(*KEYS).agg(
        F.sum("planned_time_min").alias("planned_time_min"),
        F.sum("downtime_minutes").alias("downtime_minutes"),
        F.sum("total_count").alias("total_count"),
    )


def dcell(spark, sf):
    return td.downtime(spark, sf).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("events"), F.sum("downtime_minutes").alias("downtime_minutes")
    )


def qcell(spark, sf):
    return td.plant_rows(spark, sf).groupBy(*KEYS).agg(
        F.sum("good_count").alias("good_count"), F.sum("reject_count").alias("reject_count"),
        F.avg("measurement_mm").alias("measurement_mm"),
    )


def _two_sql(how: str) -> str:
    join = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN"}[how]
    cond = " AND ".join(f"p.{k} IS NOT DISTINCT FROM d.{k}" for k in KEYS)
    if how in ("right", "full"):
        ks = ", ".join(f"coalesce(p.{k}, d.{k}) AS {k}" for k in KEYS)
    else:
        ks = ", ".join(f"p.{k}" for k in KEYS)
    return with_(PLANT, DOWNTIME, PC, DC) + f"""SELECT {ks}, {r4('p.planned_time_min')} AS planned_time_min,
  {r4('p.downtime_minutes')} AS downtime_minutes_l, {r4('p.total_count')} AS total_count, d.events,
  {r4('d.downtime_minutes')} AS downtime_minutes_r FROM pc p {join} dc d ON {cond}"""


for _how in jn.JOIN_TYPES:

    def _make(how):
        def q(spark, sf):
            return jn.join_two(pcell(spark, sf), dcell(spark, sf), how, on=KEYS)

        q.__doc__ = f"J2: production cells {how} join downtime cells on the plant keys, suffixes _l/_r."
        return q

    register(f"join_{_how}", _two_sql(_how))(_make(_how))


_BYM = """bm AS (SELECT machine_id, sum(downtime_minutes) AS downtime_minutes, sum(planned_time_min) AS planned_time_min FROM plant GROUP BY machine_id),
dm AS (SELECT machine_id, count(*) AS events, sum(downtime_minutes) AS downtime_minutes FROM downtime GROUP BY machine_id)"""


def _by_machine(spark, sf):
    left = td.plant_rows(spark, sf).groupBy("machine_id").agg(
        F.sum("downtime_minutes").alias("downtime_minutes"), F.sum("planned_time_min").alias("planned_time_min")
    )
    right = td.downtime(spark, sf).groupBy("machine_id").agg(
        F.count(F.lit(1)).alias("events"), F.sum("downtime_minutes").alias("downtime_minutes")
    )
    return left, right


@register("join_different_keys", with_(PLANT, DOWNTIME, _BYM) + f"""SELECT bm.machine_id, {r4('bm.downtime_minutes')} AS downtime_minutes_l,
  {r4('bm.planned_time_min')} AS planned_time_min, dm.machine_id AS equipment, dm.events, {r4('dm.downtime_minutes')} AS downtime_minutes_r
FROM bm JOIN dm ON bm.machine_id = dm.machine_id""")
def join_different_keys(spark, sf):
    """left_on / right_on with different names; both key columns kept."""
    left, right = _by_machine(spark, sf)
    return jn.join_two(left, right.withColumnRenamed("machine_id", "equipment"), "inner",
                       left_on="machine_id", right_on="equipment")


@register("join_auto_key", with_(PLANT, DOWNTIME, _BYM) + f"""SELECT bm.machine_id, {r4('bm.downtime_minutes')} AS downtime_minutes_l,
  {r4('bm.planned_time_min')} AS planned_time_min, dm.events, {r4('dm.downtime_minutes')} AS downtime_minutes_r
FROM bm JOIN dm ON bm.machine_id IS NOT DISTINCT FROM dm.machine_id""")
def join_auto_key(spark, sf):
    """No keys given, join on the first suggested key (machine_id)."""
    left, right = _by_machine(spark, sf)
    return jn.join_two(left, right, "inner")


def _cond(a, b):
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in KEYS)


@register("join_chain", with_(PLANT, DOWNTIME, PC, DC, QCELL) + f"""SELECT {', '.join('p.' + k for k in KEYS)},
  {r4('p.planned_time_min')} AS planned_time_min, {r4('p.downtime_minutes')} AS downtime_minutes_l, {r4('p.total_count')} AS total_count,
  d.events, {r4('d.downtime_minutes')} AS downtime_minutes_r, {r4('q.good_count')} AS good_count, {r4('q.reject_count')} AS reject_count,
  {r4('q.measurement_mm')} AS measurement_mm
FROM pc p LEFT JOIN dc d ON {_cond('p', 'd')} LEFT JOIN qcl q ON {_cond('p', 'q')}""")
def join_chain(spark, sf):
    """Left-deep chain production cells -> downtime cells -> quality cells."""
    tables = {"production": pcell(spark, sf), "downtime": dcell(spark, sf), "quality": qcell(spark, sf)}
    steps = [{"left": "production", "right": "downtime", "how": "left", "on": KEYS},
             {"left": "_result", "right": "quality", "how": "left", "on": KEYS}]
    return jn.join_chain(tables, steps)


_RAW_COLS = KEYS + ["planned_time_min", "downtime_minutes_l", "event_id", "downtime_code", "downtime_minutes_r",
                    "good_count", "reject_count"]


@register("join_plant_raw", with_(PLANT, DOWNTIME, PC, QCELL) + f"""SELECT {', '.join('p.' + k for k in KEYS)},
  {r4('p.planned_time_min')} AS planned_time_min, {r4('p.downtime_minutes')} AS downtime_minutes_l, d.event_id, d.downtime_code,
  {r4('d.downtime_minutes')} AS downtime_minutes_r, {r4('q.good_count')} AS good_count, {r4('q.reject_count')} AS reject_count
FROM pc p LEFT JOIN downtime d ON {_cond('p', 'd')} LEFT JOIN qcl q ON {_cond('p', 'q')}""")
def join_plant_raw(spark, sf):
    """Production cells LEFT downtime events LEFT quality cells (event-level rows)."""
    d = td.downtime(spark, sf).select(*KEYS, "event_id", "downtime_code", "downtime_minutes")
    q = qcell(spark, sf).select(*KEYS, "good_count", "reject_count")
    return jn.plant_raw(pcell(spark, sf), d, q).select(*_RAW_COLS)


@register("join_plant_sql", with_(PLANT, DOWNTIME, PC, QCELL) + f"""SELECT {', '.join('p.' + k for k in KEYS)},
  {r4('p.planned_time_min')} AS planned_time_min, {r4('p.downtime_minutes')} AS downtime_minutes, {r4('p.total_count')} AS total_count,
  {r4('d.downtime_minutes')} AS event_downtime_minutes, d.downtime_code, d.downtime_category, d.event_id,
  {r4('q.good_count')} AS good_count, {r4('q.reject_count')} AS reject_count
FROM pc p
LEFT JOIN downtime d ON p.machine_id = d.machine_id AND CAST(p.shift_date AS DATE) = CAST(d.shift_date AS DATE) AND p.shift = d.shift
LEFT JOIN qcl q ON p.machine_id = q.machine_id AND CAST(p.shift_date AS DATE) = CAST(q.shift_date AS DATE) AND p.shift = q.shift""")
def join_plant_sql(spark, sf):
    """The SQL variant (no line key); the event column is aliased event_downtime_minutes."""
    return jn.plant_sql(pcell(spark, sf), td.downtime(spark, sf), qcell(spark, sf))


@register("join_plant_safe", with_(PLANT, DOWNTIME, PC, QCELL,
                                   f"ds AS (SELECT {KSQL}, sum(downtime_minutes) AS dt FROM downtime GROUP BY {KSQL})")
          + f"""SELECT {', '.join('p.' + k for k in KEYS)}, {r4('p.planned_time_min')} AS planned_time_min,
  {r4('p.total_count')} AS total_count, {r4('q.good_count')} AS good_count, {r4('q.reject_count')} AS reject_count,
  {r4('q.measurement_mm')} AS measurement_mm, {r4('coalesce(ds.dt, 0.0)')} AS downtime_minutes
FROM pc p LEFT JOIN qcl q ON {_cond('p', 'q')} LEFT JOIN ds ON {_cond('p', 'ds')}""")
def join_plant_safe(spark, sf):
    """Production LEFT quality, downtime pre-summed to the keys replaces downtime_minutes."""
    return jn.plant_safe(pcell(spark, sf), qcell(spark, sf), td.downtime(spark, sf))


@register("join_log", with_(PLANT, DOWNTIME, PC, DC, QCELL,
                            f"c1 AS (SELECT count(*) AS n FROM pc p LEFT JOIN dc d ON {_cond('p', 'd')})",
                            f"c2 AS (SELECT count(*) AS n FROM pc p LEFT JOIN dc d ON {_cond('p', 'd')} LEFT JOIN qcl q ON {_cond('p', 'q')})")
          + f"""SELECT 1::BIGINT AS step, 'left' AS how, '{','.join(KEYS)}' AS keys, (SELECT count(*) FROM pc) AS left_rows,
  (SELECT count(*) FROM dc) AS right_rows, (SELECT n FROM c1) AS result_rows
UNION ALL SELECT 2::BIGINT, 'left', '{','.join(KEYS)}', (SELECT n FROM c1), (SELECT count(*) FROM qcl), (SELECT n FROM c2)""")
def join_log(spark, sf):
    """Row counts per join step of the plant chain."""
    tables = {"production": pcell(spark, sf), "downtime": dcell(spark, sf), "quality": qcell(spark, sf)}
    steps = [{"left": "production", "right": "downtime", "how": "left", "on": KEYS},
             {"left": "_result", "right": "quality", "how": "left", "on": KEYS}]
    return jn.join_log(tables, steps)


PCR = PC.replace("pc AS (", "pcr AS (").replace("sum(total_count) AS total_count", "sum(total_count) AS total_count, avg(ideal_rate) AS ideal_rate")


@register("oee_plant_safe", with_(PLANT, DOWNTIME, PCR, QCELL,
                                  f"ds AS (SELECT {KSQL}, sum(downtime_minutes) AS dt FROM downtime GROUP BY {KSQL})",
                                  f"""j8 AS (SELECT p.*, coalesce(ds.dt, 0.0) AS dtm, q.good_count FROM pcr p LEFT JOIN qcl q ON {_cond('p', 'q')}
                                      LEFT JOIN ds ON {_cond('p', 'ds')})""")
          + "SELECT * FROM (" + oee_group_select(
              "line_id", src="(SELECT line_id, planned_time_min, dtm AS downtime_minutes, ideal_rate, total_count, good_count FROM j8)") + ")")
def oee_plant_safe(spark, sf):
    """O4 over J8: line OEE on the fan-out-safe integrated frame (events' downtime, mean ideal rate of the cell)."""
    rate = td.plant_rows(spark, sf).groupBy(*KEYS).agg(
        F.sum("planned_time_min").alias("planned_time_min"), F.sum("downtime_minutes").alias("downtime_minutes"),
        F.sum("total_count").alias("total_count"), F.avg("ideal_rate").alias("ideal_rate"))
    j = jn.plant_safe(rate, qcell(spark, sf), td.downtime(spark, sf))
    return oee.aggregate(j, ["line_id"])
