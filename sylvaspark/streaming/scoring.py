"""Scoring a stream with a fitted tree model: an addition for continuous use."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.trees import TreeModel


def score_stream(stream: DataFrame, model: TreeModel, out: str, checkpoint: str, available_now: bool = True):
    """Append each micro-batch with its prediction to a parquet folder; the model is a plain expression, so no state is kept."""
    writer = stream.withColumn("prediction", model.predict()).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
