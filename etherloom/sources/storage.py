"""Tables between steps, in a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` or ``setCheckpointDir`` names; one of our own where neither does, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="etherloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_OWN = threading.local()  # the scopes of this thread: pipelines of several threads do not delete each other's tables


def _scopes() -> list[list[str]]:
    if not hasattr(_OWN, "scopes"):
        _OWN.scopes = []
    return _OWN.scopes


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is not taken."""
    return f"{shared_dir(spark)}/etherloom-{label}-{uuid.uuid4().hex}"


def _table(path: str) -> str:
    return path.rpartition("/")[2].replace("-", "_")


def _hadoop(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _owned(spark: SparkSession, name: str) -> None:
    """Note what was written: the scope deletes it, or else the driver's JVM when it ends."""
    for paths in _scopes()[-1:]:
        paths.append(name)
    path, system = _hadoop(spark, name)
    system.deleteOnExit(path)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: the lineage ends in files every executor sees."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    _owned(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stash_by(df: DataFrame, column: str | list[str], label: str, ordered: bool = True) -> DataFrame:
    """``stash`` as a table bucketed by ``column``, one or several, so that joins and groups on it move only the other side.

    ``df`` should come from a grouping or a join by the column: its tasks then hold whole buckets, and each bucket is one file.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    n = min(int(spark.conf.get(f"spark.sql.{c}")) for c in ("shuffle.partitions", "sources.bucketing.maxBuckets"))
    name = _table(path)
    to = df.write.format("parquet").bucketBy(n, column)
    (to.sortBy(column) if ordered else to).option("path", path).saveAsTable(name)
    _owned(spark, path)
    return spark.table(name)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """What is stashed inside is deleted at the end, unless it is taken from the list: for work whose result is written by then."""
    paths: list[str] = []
    _scopes().append(paths)
    try:
        yield paths
    finally:
        _scopes().pop()
        for name in paths:
            path, system = _hadoop(spark, name)
            system.delete(path, True)
            spark.sql(f"DROP TABLE IF EXISTS {_table(name)}")
