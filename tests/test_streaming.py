"""The streaming windowed downtime aggregate equals the batch aggregate once all windows close."""

from pyspark.sql import functions as F

from millwright.operators.maintenance import classify
from millwright.session import scratch_path
from millwright.sources import testdata as td
from millwright.streaming.downtime_stream import events_stream, start_to_parquet, windowed_downtime


def test_windowed_downtime_matches_batch(spark, sf):
    out = scratch_path(spark, "stream-out")
    ck = scratch_path(spark, "stream-ckpt")
    # watermark 0 so that every window but the last closes within the run
    q = start_to_parquet(windowed_downtime(events_stream(spark, sf, "events.parquet"), "1 hour", "0 seconds"), out, ck)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    batch = (classify(td.downtime(spark, sf)).withColumn("w", F.window(F.col("start_time").cast("timestamp"), "1 hour"))
             .groupBy("w", "line_id", "downtime_code", "event_class")
             .agg(F.count(F.lit(1)).alias("events"), F.sum("downtime_minutes").alias("downtime_minutes")))
    last_start = batch.agg(F.max("w.start")).first()[0]
    closed = batch.where(F.col("w.start") < last_start)
    assert got.count() == closed.count()
    a = got.agg(F.sum("events"), F.round(F.sum("downtime_minutes"), 4)).first()
    b = closed.agg(F.sum("events"), F.round(F.sum("downtime_minutes"), 4)).first()
    assert tuple(a) == tuple(b)
