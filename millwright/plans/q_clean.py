"""Cleaning queries (C1-C7) over a raw all-string downtime extract."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.functions.common import trailing_window
from millwright.operators import clean as cl
from millwright.plans.catalog import register
from millwright.plans.sqlparts import DOWNTIME, r4, with_
from millwright.sources import testdata as td

RAW_COLS = ["line_id", "machine_id", "shift", "shift_date", "downtime_code", "downtime_category", "downtime_minutes",
            "is_planned"]
RAW = "raw AS (SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in RAW_COLS) + " FROM downtime)"
NOT_EMPTY = "NOT (" + " AND ".join(f"{c} IS NULL" for c in RAW_COLS) + ")"


def raw_extract(spark, sf):
    """The downtime table as a string-typed extract (what a CSV upload looks like)."""
    return td.downtime(spark, sf).select(*[F.col(c).cast("string").alias(c) for c in RAW_COLS])


def _trim(c: str) -> str:
    return f"CASE WHEN trim({c}) IN ('nan', 'None', '') THEN NULL ELSE trim({c}) END"


_TYPED = {
    "shift_date": "TRY_CAST({} AS TIMESTAMP)",
    "downtime_minutes": "TRY_CAST({} AS DOUBLE)",
}


def _clean_cols(trim=True, typed=True, rnd=True) -> str:
    out = []
    for c in RAW_COLS:
        e = _trim(c) if trim else c
        if typed and c in _TYPED:
            e = _TYPED[c].format(e)
            if c == "downtime_minutes" and rnd:
                e = r4(e)
        out.append(f"{e} AS {c}")
    return ", ".join(out)


@register("clean_drop_empty", with_(DOWNTIME, RAW) + f"SELECT * FROM raw WHERE {NOT_EMPTY}")
def clean_drop_empty(spark, sf):
    """Rows with all values NULL dropped."""
    return cl.drop_empty(raw_extract(spark, sf))


@register("clean_strings", with_(DOWNTIME, RAW) + f"SELECT {_clean_cols(typed=False)} FROM raw")
def clean_strings(spark, sf):
    """Strings trimmed, 'nan' / 'None' / '' to NULL."""
    return cl.clean_strings(raw_extract(spark, sf))


@register("clean_numeric", with_(DOWNTIME, RAW) + "SELECT " + ", ".join(
    f"{r4('TRY_CAST(downtime_minutes AS DOUBLE)')} AS downtime_minutes" if c == "downtime_minutes" else c for c in RAW_COLS)
          + " FROM raw")
def clean_numeric(spark, sf):
    """Numeric coercion of columns whose name marks a quantity."""
    raw = raw_extract(spark, sf)
    return raw.select(*[F.col(c).try_cast("double").alias(c) if cl.is_numeric_name(c) else F.col(c) for c in raw.columns])


@register("clean_dates", with_(DOWNTIME, RAW) + "SELECT " + ", ".join(
    "TRY_CAST(shift_date AS TIMESTAMP) AS shift_date" if c == "shift_date" else c for c in RAW_COLS) + " FROM raw")
def clean_dates(spark, sf):
    """C4: datetime parsing of columns whose name marks a date or time."""
    raw = raw_extract(spark, sf)
    return raw.select(*[F.try_to_timestamp(F.col(c)).cast("timestamp_ntz").alias(c) if cl.is_date_name(c) else F.col(c)
                        for c in raw.columns])


@register("clean_dedupe", with_(DOWNTIME, RAW) + "SELECT DISTINCT * FROM raw")
def clean_dedupe(spark, sf):
    """Exact duplicate rows dropped."""
    return raw_extract(spark, sf).dropDuplicates()


@register("clean_plant", with_(DOWNTIME, RAW) + f"SELECT DISTINCT {_clean_cols()} FROM raw WHERE {NOT_EMPTY}")
def clean_plant(spark, sf):
    """The cleaned frame."""
    return cl.clean_plant_frame(raw_extract(spark, sf))


@register("clean_log", with_(DOWNTIME, RAW, f"cl AS (SELECT {_clean_cols(rnd=False)} FROM raw WHERE {NOT_EMPTY})")
          + """SELECT (SELECT count(*) FROM raw) AS rows_in,
  (SELECT count(*) FROM cl) - (SELECT count(*) FROM (SELECT DISTINCT * FROM cl)) AS duplicates_removed,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM cl)) AS rows_out""")
def clean_log(spark, sf):
    """Rows in, duplicates removed, rows out."""
    return cl.clean_log(raw_extract(spark, sf))


@register("trailing_window", with_(DOWNTIME) + f"""SELECT event_id, machine_id, shift_date, {r4('downtime_minutes')} AS downtime_minutes
FROM downtime WHERE shift_date >= (SELECT max(shift_date) FROM downtime) - INTERVAL 7 DAY""")
def trailing_window_q(spark, sf):
    """Rows within 7 days of the latest shift date."""
    d = td.downtime(spark, sf)
    return trailing_window(d, "shift_date", 7).select("event_id", "machine_id", "shift_date", "downtime_minutes")
