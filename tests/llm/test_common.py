"""What the corpus operators share: spread joins, components with hubs, storage."""

import os
import random
from types import SimpleNamespace

import pytest

pytest.importorskip("etherloom.llm")
from pyspark.sql import functions as F  # noqa: E402

from etherloom.llm import common, components  # noqa: E402


def test_spread_join_equals_a_plain_one(spark):
    draw = random.Random(1)
    rows = [(7 if draw.random() < 0.5 else draw.randrange(3000), k) for k in range(4000)]
    left = spark.createDataFrame(rows, "k long, v long")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("most")).where("k % 5 <> 1")
    found = common.spread_join(left, right, "k", "n")
    assert found.columns == ["k", "v", "most"]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, left.join(right.drop("n"), "k").collect()))
    twice = common.spread_join(left, right.union(right), "k", "n", total=len(rows))
    assert twice.count() == 2 * found.count()
    none = common.spread_join(left.where("false"), right.where("false"), "k", "n")
    assert none.count() == 0
    hot = found.groupBy(F.spark_partition_id()).agg(F.count_if(F.col("k") == 7).alias("n")).collect()
    assert max(r["n"] for r in hot) <= 2100


def test_components_of_a_hub_and_of_a_chain(spark):
    edges = [(0, k) for k in range(1, 1500)] + [(k, k + 1) for k in range(2000, 2100)] + [(-5, 2050), (9000, 9001), (9001, 9000), (9500, 9500)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[k] for k in range(1, 1500)} == {0} and {found[k] for k in range(2000, 2101)} == {-5} and found[9001] == 9000 and 9500 not in found


def test_a_shared_folder_is_asked_for():
    fake = lambda master, conf=None, own=None: SimpleNamespace(
        conf=SimpleNamespace(get=lambda *_: conf, set=lambda *_: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: own)
    )
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://h"):
        with pytest.raises(ValueError):
            common.shared_dir(fake(master))
        assert common.shared_dir(fake(master, "s3a://x")) == "s3a://x" and common.shared_dir(fake(master, None, "hdfs:/y")) == "hdfs:/y"
    assert os.path.isdir(common.shared_dir(fake("local[2]")))


def test_scratch_deletes_all_but_what_is_taken(spark):
    with common.scratch(spark) as paths:
        common.stash(spark.range(3).toDF("x"), "a")
        kept = common.stash(spark.range(4).toDF("x"), "b")
        with common.scratch(spark) as inner:
            common.stash(spark.range(5).toDF("x"), "c")
            assert len(inner) == 1 and os.path.isdir(inner[0])
            gone = inner[0]
        assert not os.path.exists(gone)
        own = paths.pop()
        first = paths[0]
    assert kept.count() == 4 and os.path.isdir(own) and not os.path.exists(first)
