"""Step metrics of a growing log, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.telemetry import step_metrics


def stream_step_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of every step line in files that appear in ``folder``; the same expressions as for a batch."""
    lines = spark.readStream.text(folder).select(F.make_valid_utf8("value").alias("value"))
    return step_metrics(lines)


def start_metrics_sink(metrics: DataFrame, path: str, checkpoint: str):
    """Append to Parquet, each batch once; take what is there and stop."""
    return metrics.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
