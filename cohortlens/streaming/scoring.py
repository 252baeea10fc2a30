"""Scoring of arriving samples, and windowed quality counters with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.learning import score


def score_stream(spark: SparkSession, source: str, schema: str, model: dict, sink: str, checkpoint: str) -> StreamingQuery:
    """Score CSV files as they arrive in ``source`` and append (sample_id, probability, predicted) to ``sink`` as Parquet, once each."""
    arriving = spark.readStream.schema(schema).option("header", True).csv(source)
    scored = score(arriving, model).select("sample_id", "probability", "predicted")
    return scored.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and mean values by event type and tumbling window; rows later than the watermark don't reopen windows."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
