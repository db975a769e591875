"""Adapter from the driver's test tables to the three plant tables.

``lineitem`` rows become production + quality shift records, ``events`` rows
become downtime events.  Every column is a built-in expression over the scan,
so Catalyst prunes the parquet read to the source columns each query needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL_KEYS = ["shift_date", "shift", "line_id", "machine_id"]

# Downtime code and category per event type, and defect code per
# return flag (codes and category texts as in the reference's demo plant).
EVENT_TYPE_CODE = {
    "error": ("BRK02", "Breakdown — mechanical"),
    "purchase": ("CHG01", "Changeover"),
    "signup": ("PM07", "Planned maintenance"),
    "view": ("MAT04", "Material shortage"),
    "click": ("STP08", "Minor stoppage"),
}
PLANNED_EVENT_TYPES = ("purchase", "signup")
RETURNFLAG_DEFECT = {"A": "DIM", "R": "SCRATCH"}
DEFAULT_DEFECT = "CONTAM"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _line(id_col: str):
    return F.concat(F.lit("L"), (F.col(id_col) % 5 + 1).cast("string"))


def _machine(id_col: str):
    return F.concat(F.lit("M"), F.col(id_col).cast("string"))


def plant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production and quality columns on one row per lineitem (the integrated shift frame)."""
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    total = q * 100
    rejects = q * F.round(F.col("l_tax") * 100)
    defect = F.when(F.col("l_returnflag") == "A", "DIM").when(F.col("l_returnflag") == "R", "SCRATCH").otherwise(DEFAULT_DEFECT)
    return li.select(
        _line("l_suppkey").alias("line_id"),
        _machine("l_suppkey").alias("machine_id"),
        F.when(F.col("l_linenumber") % 3 == 0, "A").when(F.col("l_linenumber") % 3 == 1, "B").otherwise("C").alias("shift"),
        F.col("l_shipdate").cast("date").alias("shift_date"),
        F.lit(480.0).alias("planned_time_min"),
        (F.lit(8) + F.lit(2) * (F.col("l_partkey") % 3)).cast("double").alias("ideal_rate"),
        total.alias("total_count"),
        rejects.alias("reject_count"),
        (total - rejects).alias("good_count"),
        (F.col("l_discount") * 1000).alias("downtime_minutes"),
        (F.lit(1.0) + F.col("l_extendedprice") / 20000).alias("vibration_rms"),
        (F.lit(40.0) + q / 2).alias("temp_c"),
        (F.lit(10.0) + F.col("l_discount") * 50).alias("motor_current_a"),
        defect.alias("defect_code"),
        (F.lit(10.0) + (q - F.lit(25.5)) / 100).alias("measurement_mm"),
        F.lit(9.5).alias("lsl"),
        F.lit(10.5).alias("usl"),
        F.col("l_orderkey"),
        F.col("l_linenumber"),
        F.col("l_partkey"),
    )


PRODUCTION_COLS = CELL_KEYS + [
    "planned_time_min", "ideal_rate", "total_count", "downtime_minutes",
    "vibration_rms", "temp_c", "motor_current_a", "l_orderkey", "l_linenumber", "l_partkey",
]
QUALITY_COLS = CELL_KEYS + [
    "total_count", "good_count", "reject_count", "defect_code", "measurement_mm", "lsl", "usl",
    "l_orderkey", "l_linenumber", "l_partkey",
]


def production(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plant_rows(spark, sf_dir).select(*PRODUCTION_COLS)


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plant_rows(spark, sf_dir).select(*QUALITY_COLS)


def downtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return downtime_from_events(table(spark, sf_dir, "events"))


def downtime_from_events(ev: DataFrame) -> DataFrame:
    """Downtime events from an ``events`` frame (batch or streaming)."""
    et = F.col("event_type")
    code = F.lit(None).cast("string")
    cat = F.lit(None).cast("string")
    for k, (c, t) in reversed(list(EVENT_TYPE_CODE.items())):
        code = F.when(et == k, F.lit(c)).otherwise(code)
        cat = F.when(et == k, F.lit(t)).otherwise(cat)
    hour = F.hour("ts")
    return ev.select(
        F.col("event_id"),
        _line("user_id").alias("line_id"),
        _machine("user_id").alias("machine_id"),
        F.when(hour < 8, "A").when(hour < 16, "B").otherwise("C").alias("shift"),
        F.date_add(F.lit("1999-06-01").cast("date"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))).alias("shift_date"),
        code.alias("downtime_code"),
        cat.alias("downtime_category"),
        F.col("value").alias("downtime_minutes"),
        F.col("ts").alias("start_time"),
        F.timestamp_add("SECOND", F.floor(F.col("value") * 60).cast("bigint"), F.col("ts")).alias("end_time"),
        et.isin(*PLANNED_EVENT_TYPES).alias("is_planned"),
    )
