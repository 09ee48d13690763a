"""Status history: counts of events by kind and span of time, for tables and for streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def history(events: DataFrame, span: str = "1 day", kind: str = "event_type", time: str = "ts") -> DataFrame:
    """(kind, start, n) of events by tumbling windows."""
    return events.groupBy(kind, F.window(time, span).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(kind, F.col("w.start").alias("start"), "n")


def watch(spark: SparkSession, path: str, schema: str, late: str = "1 hour", span: str = "1 day", kind: str = "event_type", time: str = "ts") -> DataFrame:
    """history() of a folder of Parquet files as a stream; events later than `late` behind the newest are dropped, repeated ids too."""
    events = spark.readStream.schema(schema).parquet(path).withWatermark(time, late).dropDuplicatesWithinWatermark(["event_id"])
    return history(events, span, kind, time)
