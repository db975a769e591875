"""Cleaning of raw plant extracts: empty rows, string cleanup, coercion by name, dedupe.

Column roles come from the column *names* (planning time); the data work is
one projection plus one distinct (a hash aggregate over all columns with
map-side pre-aggregation, so heavily duplicated rows collapse before the
shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values from the reference: name tokens that select coercions.
NUMERIC_TOKENS = ("count", "minutes", "rate", "oee", "availability", "performance", "quality", "scrap", "ideal",
                  "target", "produced")
DATE_SKIP_TOKENS = ("minute", "min", "count", "rate", "oee")
DATE_TOKENS = ("timestamp", "shift_date", "start_time", "end_time", "datetime")
MISSING_STRINGS = ("nan", "None", "")


def is_numeric_name(name: str) -> bool:
    n = name.lower()
    return any(k in n for k in NUMERIC_TOKENS)


def is_date_name(name: str) -> bool:
    n = name.lower()
    if any(k in n for k in DATE_SKIP_TOKENS):
        return False
    return any(k in n for k in DATE_TOKENS) or n.endswith("_date") or n.endswith("_time") or n in {"date", "time"}


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop rows where every value is NULL."""
    return df.dropna(how="all")


def clean_strings(df: DataFrame) -> DataFrame:
    """Trim strings; 'nan', 'None' and '' become NULL."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            t = F.trim(c)
            out.append(F.when(t.isin(*MISSING_STRINGS), F.lit(None).cast("string")).otherwise(t).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def coerce_by_name(df: DataFrame) -> DataFrame:
    """C3 + C4: numeric coercion and datetime parsing selected by column name."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if is_numeric_name(f.name):
            c = c.try_cast("double")
        elif is_date_name(f.name) and isinstance(f.dataType, T.StringType):
            c = F.try_to_timestamp(c).cast("timestamp_ntz")
        elif is_date_name(f.name) and isinstance(f.dataType, T.DateType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def clean_plant_frame(df: DataFrame) -> DataFrame:
    """The cleaned frame (duplicates removed)."""
    return coerce_by_name(clean_strings(drop_empty(df))).dropDuplicates()


def clean_log(df: DataFrame) -> DataFrame:
    """rows_in (before C1), duplicates_removed, rows_out in one row."""
    before = coerce_by_name(clean_strings(drop_empty(df)))
    cols = [F.col(f"`{c}`") for c in before.columns]
    per_row = before.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    dist = per_row.agg(F.sum("_n").alias("kept_in"), F.count(F.lit(1)).alias("rows_out"))
    rows_in = df.select(F.count(F.lit(1))).scalar()
    return dist.select(
        rows_in.alias("rows_in"),
        (F.coalesce(F.col("kept_in"), F.lit(0)) - F.col("rows_out")).alias("duplicates_removed"),
        F.col("rows_out"),
    )
