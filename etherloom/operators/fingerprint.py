"""Fingerprints over several fields and the size of the sets that share them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def request_fingerprints(requests: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``mac, device, fp``: the field values of each request in the given order; missing ones keep their place."""
    return requests.select("mac", "device", F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("NULL")) for f in fields]).alias("fp"))


def device_fingerprints(prints: DataFrame) -> DataFrame:
    return prints.select("device", "fp").distinct()


def most_common(prints: DataFrame, top: int = 1) -> DataFrame:
    """``device, fp, n``: the ``top`` fingerprints of each device by requests; ties by the text of the fingerprint."""
    n = prints.groupBy("device", "fp").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("device").orderBy(F.desc("n"), F.concat_ws("', '", "fp")))
    return n.withColumn("r", rank).where(F.col("r") <= top).drop("r")


def anonymity(prints: DataFrame, owner: str) -> DataFrame:
    """``set_size, n_members``: memberships by how many owners share the fingerprint."""
    sets = prints.groupBy("fp").agg(F.count_distinct(owner).alias("set_size"))
    return sets.groupBy("set_size").agg(F.sum("set_size").cast("long").alias("n_members"))


def sharing(prints: DataFrame, owner: str = "device") -> DataFrame:
    """``set_size, n_fingerprints``: fingerprints by how many owners share them."""
    sets = prints.groupBy("fp").agg(F.count_distinct(owner).alias("set_size"))
    return sets.groupBy("set_size").agg(F.count("*").alias("n_fingerprints"))
