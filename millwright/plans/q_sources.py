"""Source / sink queries (S1-S5): file round trips and SAP extract mapping.

Each query writes a table Spark derives from the test tables into a fresh
folder under the shared checkpoint dir, then scans it back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.operators import mapping as mp
from millwright.operators.store import KeyedStore
from millwright.plans.catalog import register
from millwright.plans.sqlparts import DOWNTIME, PLANT, r4, with_
from millwright.session import scratch_path
from millwright.sources import files as fs
from millwright.sources import testdata as td

DT_COLS = ["event_id", "line_id", "machine_id", "shift", "shift_date", "downtime_code", "downtime_category",
           "downtime_minutes", "start_time", "end_time", "is_planned"]
_SCAN_SQL = with_(DOWNTIME) + f"""SELECT CAST(event_id AS VARCHAR) AS event_id, line_id, machine_id, shift, shift_date, downtime_code,
  downtime_category, {r4('downtime_minutes')} AS downtime_minutes, start_time, end_time, is_planned FROM downtime"""


@register("scan_csv", _SCAN_SQL)
def scan_csv(spark, sf):
    """Downtime written as CSV, scanned back with canonical coercion."""
    path = scratch_path(spark, "csv")
    fs.write_csv(td.downtime(spark, sf).select(*DT_COLS), path)
    return fs.scan_csv(spark, path)


@register("scan_tsv", with_(DOWNTIME) + f"""SELECT CAST(event_id AS VARCHAR) AS event_id, line_id, machine_id, shift,
  strftime(shift_date, '%Y-%m-%d') AS shift_date, downtime_code, downtime_category, {r4('downtime_minutes')} AS downtime_minutes,
  strftime(start_time, '%Y-%m-%dT%H:%M:%S.%f') AS start_time, strftime(end_time, '%Y-%m-%dT%H:%M:%S.%f') AS end_time, is_planned
FROM downtime""")
def scan_tsv(spark, sf):
    """Downtime written tab-separated, scanned back without date parsing (dates stay text)."""
    path = scratch_path(spark, "tsv")
    fs.write_csv(td.downtime(spark, sf).select(*DT_COLS), path, sep="\t")
    return fs.scan_tsv(spark, path)


@register("scan_json", _SCAN_SQL)
def scan_json(spark, sf):
    """S3: downtime written as JSON lines, scanned back with canonical coercion."""
    path = scratch_path(spark, "json")
    fs.write_json(td.downtime(spark, sf).select(*DT_COLS), path)
    return fs.scan_json(spark, path, DT_COLS)


@register("snapshot_roundtrip", with_(DOWNTIME) + f"""SELECT event_id, line_id, machine_id, shift, shift_date, downtime_code,
  downtime_category, {r4('downtime_minutes')} AS downtime_minutes, start_time, end_time, is_planned FROM downtime""")
def snapshot_roundtrip(spark, sf):
    """Frames saved as parquet partitioned by run_id, one run saved twice; it is read back (partition-pruned)."""
    root = scratch_path(spark, "snapshots")
    frames = {"downtime": td.downtime(spark, sf).select(*DT_COLS)}
    for run in ("run-1", "run-2", "run-1"):
        fs.save_snapshot(frames, root, run)
    return fs.load_snapshot(spark, root, "downtime", "run-1")


@register("result_export", with_(DOWNTIME) + f"""SELECT downtime_code, count(*) AS events, {r4('sum(downtime_minutes)')} AS minutes
FROM downtime GROUP BY downtime_code""")
def result_export(spark, sf):
    """A result frame exported as JSON records and read back, every row of it."""
    root = scratch_path(spark, "export")
    res = td.downtime(spark, sf).groupBy("downtime_code").agg(F.count(F.lit(1)).alias("events"), F.sum("downtime_minutes").alias("minutes"))
    fs.export_results({"downtime_by_code": res}, root, {"downtime_by_code": ["downtime_code"]})
    return spark.read.schema(res.schema).json(f"{root}/downtime_by_code")


def sap_pp_extract(spark, sf):
    """A SAP PP-style production extract (all strings) derived from lineitem."""
    p = td.plant_rows(spark, sf)
    s = lambda c: F.col(c).cast("string")
    return p.select(
        F.lit("P100").alias("WERKS"), s("line_id").alias("ARBPL"), s("machine_id").alias("EQUNR"),
        s("shift_date").alias("BUDAT"), s("shift").alias("SCHICHT"), s("planned_time_min").alias("VGW02"),
        (F.col("planned_time_min") - F.col("downtime_minutes")).cast("string").alias("ISTDZ"),
        s("total_count").alias("GAMNG"), s("good_count").alias("LMNGA"), s("reject_count").alias("XMNGA"),
        F.concat(F.lit("MAT"), s("l_partkey")).alias("MATNR"), s("l_orderkey").alias("AUFNR"),
        s("l_linenumber").alias("POSNR"), s("vibration_rms").alias("VIBRATION_RMS"), s("temp_c").alias("TEMP_C"),
        s("motor_current_a").alias("MOTOR_CURRENT_A"),
    )


@register("scan_sap_extract", with_(PLANT) + f"""SELECT 'P100' AS WERKS, line_id, machine_id, shift_date, shift,
  {r4('planned_time_min')} AS planned_time_min, {r4('planned_time_min - downtime_minutes')} AS run_time_min,
  {r4('total_count')} AS total_count, {r4('good_count')} AS good_count, {r4('reject_count')} AS reject_count,
  concat('MAT', CAST(l_partkey AS VARCHAR)) AS MATNR, CAST(l_orderkey AS VARCHAR) AS AUFNR, CAST(l_linenumber AS VARCHAR) AS POSNR,
  {r4('vibration_rms')} AS vibration_rms, {r4('temp_c')} AS temp_c, {r4('motor_current_a')} AS motor_current_a,
  {r4('coalesce(greatest(planned_time_min - (planned_time_min - downtime_minutes), 0.0), 0.0)')} AS downtime_minutes
FROM plant""")
def scan_sap_extract(spark, sf):
    """S4 + M5-M7: SAP PP headers mapped by preset, coerced, downtime derived from planned - run."""
    return mp.scan_sap_extract(sap_pp_extract(spark, sf), "production")


@register("mapping_store", """SELECT user_id, event_type, ts, value, CAST(changes AS BIGINT) AS changes FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC, event_id DESC) AS rn,
         count(*) OVER (PARTITION BY user_id, event_type) AS changes
  FROM (SELECT user_id, event_type, ts, round(value, 4) AS value, event_id FROM events))
WHERE rn = 1""")
def mapping_store(spark, sf):
    """Every event an upsert keyed by (user, type) in three change sets and a compaction; the latest per key and how often it came."""
    ev = td.table(spark, sf, "events").select("user_id", "event_type", "ts", F.round("value", 4).alias("value"), "event_id")
    store = KeyedStore(spark, scratch_path(spark, "mapping-store"), ev.schema.simpleString()[7:-1].replace(":", " "), ["user_id", "event_type"], "ts")
    for part in (0, 1):
        store.upsert(ev.where(F.col("event_id") % 3 == part))
    store.compact()
    store.upsert(ev.where(F.col("event_id") % 3 == 2))
    times = ev.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("changes"))
    return store.read().drop("event_id").join(times, ["user_id", "event_type"])
