"""Built-in column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def num(c: Column | str) -> Column:
    """Coerce to double; unparsable values become NULL (pandas ``to_numeric(errors='coerce')``)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("double")


def num0(c: Column | str) -> Column:
    """Coerce to double with NULL -> 0."""
    return F.coalesce(num(c), F.lit(0.0))


def div(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0 (pandas replaces a zero denominator by NaN)."""
    return F.try_divide(a, b)


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """pandas ``clip``: NULL stays NULL (Spark's least/greatest would skip it)."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(out)


def minutes_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(60_000_000.0)


def days_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(86_400_000_000.0)


def minmax_norm(df: DataFrame, cols: Iterable[str], suffix: str = "_norm") -> DataFrame:
    """(v - min) / (max - min) per column, 0 when the span is <= 1e-12, NULL read as 0.

    The bounds of all columns are one aggregate read as a scalar subquery, so rows stay
    where they are: no window over the whole table.  The subquery is a column of its own,
    so that it is planned once and not once per use.
    """
    cols = list(cols)
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    bounds = df.agg(F.struct(*[f(value[c]).alias(f"{c}_{n}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]).alias("b")).scalar()
    b = F.col("_bounds")
    out = {}
    for c in cols:
        lo, span = b[f"{c}_lo"], b[f"{c}_hi"] - b[f"{c}_lo"]
        out[c + suffix] = F.when(span <= 1e-12, F.lit(0.0)).otherwise((value[c] - lo) / span)
    return df.withColumn("_bounds", bounds).withColumns(out).drop("_bounds")


ROUND_NUDGE = 1e-9


def round_half_away(c: Column, digits: int = 4) -> Column:
    """Tie-robust rounding: round((x + sign(x) * 1e-9) * 10^d) / 10^d.

    Averages of decimal data often sit exactly on a rounding tie, where the
    last-ulp noise of a different summation order would decide the digit.  The
    nudge moves true ties away from zero in every engine (the oracle SQL uses
    the same formula); it only matters within 1e-9 of a tie.
    """
    scale = float(10**digits)
    return F.round((c + F.signum(c) * F.lit(ROUND_NUDGE)) * F.lit(scale)) / F.lit(scale)


def round_doubles(df: DataFrame, digits: int = 4, keep: Iterable[str] = ()) -> DataFrame:
    """Round every double column once, in the final projection (never mid-plan)."""
    keep = set(keep)
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in keep:
            exprs.append(round_half_away(F.col(f.name), digits).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)


def trailing_window(df: DataFrame, date_col: str | None, days: int = 7) -> DataFrame:
    """Rows whose date is within ``days`` of the latest date (inclusive).

    The latest date is a scalar subquery and the filter a plain comparison, so files
    laid out by date can be skipped.  No date column: the whole table.  No dates at all:
    the rows without a date, read by a branch of its own.
    """
    if not date_col or date_col not in df.columns:
        return df
    ts, mx, start = _window_start(df, date_col, days)
    return df.where(ts >= start).unionByName(df.where(ts.isNull() & mx.isNull()))


def in_trailing_window(df: DataFrame, date_col: str | None, days: int = 7) -> Column:
    """Whether ``trailing_window`` keeps the row, for use inside an aggregate over all rows."""
    if not date_col or date_col not in df.columns:
        return F.lit(True)
    ts, mx, start = _window_start(df, date_col, days)
    return F.coalesce(ts >= start, mx.isNull())


def _window_start(df: DataFrame, date_col: str, days: int) -> tuple[Column, Column, Column]:
    """The row's date, the latest date (a scalar subquery) and the start of the window."""
    d = F.col(date_col)
    dtype = df.schema[date_col].dataType
    if isinstance(dtype, T.DateType):
        mx = df.select(F.max(d)).scalar()
        return d, mx, F.date_sub(mx, days)
    ts = d.try_cast("timestamp_ntz") if isinstance(dtype, T.StringType) else d
    mx = df.select(F.max(ts)).scalar()
    return ts, mx, mx - F.make_dt_interval(F.lit(days))


def ensure_parallel(df: DataFrame) -> DataFrame:
    """Spread an input that has fewer splits than the cluster's parallelism (e.g. one parquet
    row group) round-robin over the cores before a CPU-heavy Python stage.  Large inputs
    already have more splits than cores, so on a real cluster this is a no-op."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df
