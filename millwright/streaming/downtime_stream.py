"""Structured Streaming: incremental downtime minutes per window, line and class.

The same adapter expressions as the batch path run on a ``readStream`` of
event files.  A watermark on the event start bounds the state: windows older
than the watermark are finalised, emitted once (append mode) and dropped.
Running Pareto shares and gap windows stay batch operators, since streaming
has no row-ordered windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millwright.operators.maintenance import classify
from millwright.sources.testdata import downtime_from_events


def events_stream(spark: SparkSession, directory: str, glob: str = "*.parquet", max_files_per_trigger: int = 64) -> DataFrame:
    """Event files arriving in ``directory`` (only names matching ``glob``)."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(directory).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(directory))


def windowed_downtime(events: DataFrame, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Minutes and events per (window, line, downtime code, class) with a watermark on start_time."""
    d = classify(downtime_from_events(events)).withColumn("start_time", F.col("start_time").cast("timestamp"))
    return (
        d.withWatermark("start_time", watermark)
        .groupBy(F.window("start_time", window).alias("w"), "line_id", "downtime_code", "event_class")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("downtime_minutes").alias("downtime_minutes"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "line_id", "downtime_code",
                "event_class", "events", "downtime_minutes")
    )


def start_to_parquet(agg: DataFrame, out_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append finalised windows to parquet; the checkpoint folder must be on shared storage."""
    w = agg.writeStream.outputMode("append").format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
