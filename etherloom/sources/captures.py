"""Reader of nested JSON captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etherloom.operators.observe import path_label

SCHEMA = "MAC string, LABEL string, PROBE_REQs array<struct<TIME:array<string>,RSSI:array<string>,DATA:variant>>"


def read_captures(spark: SparkSession, path: str, label_from: str | None = None, files: str = "*.json") -> DataFrame:
    """``MAC, LABEL, PROBE_REQs, file, place`` of all ``files`` below ``path``, which may be a folder, a pattern or a file.

    Each file is a list of addresses or one; a malformed file gives no rows. Addresses are not merged; ``place`` orders
    them by file, then as they stand in it. ``label_from`` takes the label from the ``folder`` or the ``file`` instead.
    """
    reader = spark.read.schema(SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
    rows = reader.option("pathGlobFilter", files).json(path).select("*", F.col("_metadata.file_path").alias("file"))
    rows = rows.where(F.col("MAC").isNotNull() | F.col("PROBE_REQs").isNotNull())
    if label_from is not None:
        rows = rows.withColumn("LABEL", path_label(F.col("file"), label_from))
    return rows.withColumn("place", F.struct("file", F.monotonically_increasing_id().alias("row")))
