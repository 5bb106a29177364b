"""Joint counts over a stream of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_joint_counts(stream: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``window, field, device, value, n``: state is dropped once a window is older than the watermark."""
    each = stream.withWatermark(time, late).groupBy(F.window(time, width), "field", "device", "value")
    return each.agg(F.sum("n_frames").cast("long").alias("n"))
