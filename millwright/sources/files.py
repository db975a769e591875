"""File sources and sinks: CSV / TSV / JSON scans, parquet snapshots, result export.

Scans read every column as a string (no schema inference pass over the
data) and coerce canonical columns with ``try_cast`` / ``try_to_timestamp``,
so a bad value becomes NULL instead of failing the job.  Snapshots are
parquet partitioned by ``run_id`` so reading one run prunes the others.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.operators.mapping import CANONICAL_NAMES, canonical_cast

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _canonical(df: DataFrame, parse_dates: bool = True) -> DataFrame:
    out = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if c in CANONICAL_NAMES:
            kind_is_date = c in ("shift_date", "timestamp", "start_time", "end_time")
            if kind_is_date and not parse_dates:
                out.append(col)
                continue
            out.append(canonical_cast(c, col).alias(c))
        else:
            out.append(col)
    return df.select(*out)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    (df.write.mode("overwrite").option("header", True).option("sep", sep)
       .option("timestampNTZFormat", TS_FORMAT).option("timestampFormat", TS_FORMAT).csv(path))


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header; canonical numerics, dates and flags coerced, bad values NULL."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return _canonical(raw)


def scan_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated, numerics coerced, no date parsing."""
    raw = spark.read.option("header", True).option("sep", "\t").option("inferSchema", False).csv(path)
    return _canonical(raw, parse_dates=False)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("timestampNTZFormat", TS_FORMAT).option("timestampFormat", TS_FORMAT).json(path)


def scan_json(spark: SparkSession, path: str, columns: Optional[list[str]] = None, multiline: bool = False) -> DataFrame:
    """S3: JSON records (JSON lines by default; ``multiline`` for one array per file).

    ``columns`` are read as strings and coerced; by default the canonical ones, so no job has
    to look at the data for a schema.
    """
    schema = ", ".join(f"`{c}` string" for c in columns or CANONICAL_NAMES)
    return _canonical(spark.read.schema(schema).option("multiLine", multiline).json(path))


def save_snapshot(frames: dict[str, DataFrame], root: str, run_id: str) -> None:
    """Persist named frames under root/<name>/run_id=<id>/ as parquet; a run saved again replaces itself only."""
    for name, df in frames.items():
        (df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy("run_id").parquet(f"{root.rstrip('/')}/{name}"))


def load_snapshot(spark: SparkSession, root: str, name: str, run_id: str) -> DataFrame:
    """Read one frame of one run; the run_id filter prunes partitions."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{name}")
    return df.where(F.col("run_id") == run_id).drop("run_id")


def export_results(frames: dict[str, DataFrame], root: str, order_by: Optional[dict[str, list]] = None) -> None:
    """All rows of each result frame, in a stated order, as JSON records under root/<name>.

    The order is a range partitioning, so files in name order hold the rows in order and no
    task holds them all.
    """
    for name, df in frames.items():
        keys = (order_by or {}).get(name) or df.columns
        df.orderBy(*keys).write.mode("overwrite").option("timestampNTZFormat", TS_FORMAT).json(f"{root.rstrip('/')}/{name}")
