"""Row numbers over all rows without bringing them into one task."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etherloom.sources.storage import stash


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with its row number from 0 in ``name``, by the columns of ``order``, which should tell rows apart.

    The rows are dealt out by ranges and sorted there; the numbers of rows of the ranges, one for each task, are added up in the driver.
    """
    at, part = f"__at_{name}", f"__part_{name}"
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    held = stash(spread.withColumn(part, F.shiftright(at, 33)), "numbered")
    counts = sorted(held.groupBy(part).agg(F.count("*").alias("n")).collect())
    starts = [0, *accumulate(r["n"] for r in counts)]
    offsets = df.sparkSession.createDataFrame([(r[part], s) for r, s in zip(counts, starts)], f"{part} long, {name} long")  # a row for each task
    number = (F.col(name) + F.col(at).bitwiseAND((1 << 33) - 1)).alias(name)
    return held.join(F.broadcast(offsets), part).select(*[F.col(f"`{c}`") for c in df.columns], number)
