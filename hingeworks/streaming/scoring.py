"""A fitted model over a stream: predictions, and running confusion counts per window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hingeworks.functions.linear import decision, predict
from hingeworks.functions.metrics import confusion


def scored(stream: DataFrame, columns: list[str], w: list[float], b: float) -> DataFrame:
    """Adds score and prediction; no state, so it runs on a stream as on a table."""
    score = decision([F.col(c) for c in columns], w, b)
    return stream.withColumn("score", score).withColumn("prediction", predict(score))


def windowed_confusion(stream: DataFrame, time: str, label: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """tn, fp, fn, tp per window of event time, behind a watermark."""
    counts = {k: c.alias(k) for k, c in confusion(F.col(label), F.col("prediction")).items()}
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stream.withWatermark(time, late).groupBy(F.window(time, size)).agg(*counts.values())
