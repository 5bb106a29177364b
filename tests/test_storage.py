"""Tables between steps: bucketed ones are joined where they lie, scopes are those of a thread."""

import os
import threading

from pyspark.sql import functions as F

from etherloom.sources.storage import scratch, stash, stash_by


def test_a_bucketed_table_is_not_moved_by_joins_on_its_column(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        with scratch(spark) as paths:
            rows = spark.range(1000).select((F.col("id") % 97).alias("k"), F.col("id").cast("string").alias("text"))
            table = stash_by(rows.groupBy("k").agg(F.max("text").alias("text")), "k", "test")
            other = spark.range(0, 97, 3).select(F.col("id").alias("k"), F.lit("x").alias("x"))
            joined = table.join(other, "k")
            found = {r["k"]: r["text"] for r in joined.collect()}
            plan = joined._jdf.queryExecution().executedPlan().toString()
            name = next(x for x in os.listdir(os.path.dirname(paths[0])) if "-test-" in x)
            listed = spark.catalog.tableExists(name.replace("-", "_"))
        assert found == {k: max(str(i) for i in range(k, 1000, 97)) for k in range(0, 97, 3)}
        assert plan.split("== Initial Plan ==")[0].count("Exchange") == 1 and listed  # the other side only
        assert not os.path.exists(paths[0]) and not spark.catalog.tableExists(name.replace("-", "_"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_scope_does_not_reach_into_another_thread(spark):
    held = []

    def other():
        held.append(stash(spark.range(5).toDF("x"), "other"))

    with scratch(spark) as paths:
        worker = threading.Thread(target=other)
        worker.start()
        worker.join(60)
        stash(spark.range(3).toDF("x"), "own")
        assert len(paths) == 1
    assert held[0].count() == 5 and not os.path.exists(paths[0])
