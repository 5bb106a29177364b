"""Statistics that are kept up to date against a recount after each part."""

import random

from pyspark.sql import functions as F

from etherloom.operators import fieldstats, observe, upkeep


def rounded(df):
    return sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_equals_a_recount_after_each_part(spark):
    draw = random.Random(6)
    macs = [f"m{k}" for k in range(30)]
    seen, labels, state = [], {}, upkeep.empty(spark)
    for part in range(3):
        rows = [(draw.choice(macs), draw.choice("fg"), draw.choice(["a", "b", "c", "NULL"]), draw.choice([0, 1, 1, 5])) for _ in range(60)]
        rows += [("quiet", "f", "only", 0)] if part == 0 else []
        given = {m: f"d{draw.randrange(6)}" for m in draw.sample(macs, 12)}  # some are labelled anew, some late, some never
        if part == 2:
            given["unseen"] = "d0"
        state = upkeep.update(
            state, spark.createDataFrame(rows, "mac string, field string, value string, n_frames int"), spark.createDataFrame([*given.items(), (None, "x"), ("m1", None)], "mac string, device string")
        )
        seen, labels = seen + rows, labels | given
        obs = spark.createDataFrame([(labels.get(m, m), *x) for m, *x in seen], "device string, field string, value string, n_frames int")
        joint = observe.joint_counts(obs)
        assert rounded(state.joint.select("field", "device", "value", "n")) == rounded(joint)
        assert rounded(state.values.select("field", "value", "k")) == rounded(fieldstats.value_devices(joint).select("field", "value", "k"))
        assert rounded(state.of_devices.select("field", "device", F.col("k").alias("n_values"))) == rounded(fieldstats.device_cardinality(joint).select("field", "device", "n_values"))
        assert rounded(upkeep.information(state)) == rounded(fieldstats.information(joint).select("field", "h_value", "h_device", "mi"))
    nothing = upkeep.update(state, obs.where("false").withColumn("mac", F.lit("m")).select("mac", "field", "value", "n_frames"), spark.createDataFrame([], "mac string, device string"))
    assert rounded(nothing.joint) == rounded(state.joint) and rounded(upkeep.information(nothing)) == rounded(upkeep.information(state))


def test_what_is_kept_is_not_moved_again(spark, monkeypatch):
    """A part shuffles its own changes: the kept joint counts are read where they lie, and counts by address are appended, two parts made one."""
    plans, write = [], upkeep.stash_by

    def noted(df, column, label, **more):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, column, label, **more)

    monkeypatch.setattr(upkeep, "stash_by", noted)
    monkeypatch.setattr(upkeep, "FAN", 2)
    seen, state = [], upkeep.empty(spark)
    for part in range(4):
        rows = [(f"m{k % 5}", "f", "abc"[(k + part) % 3], k % 4) for k in range(12)]
        labels = {f"m{k}": f"d{k % 2}" for k in range(part)}  # an address more with each part, late
        state = upkeep.update(state, spark.createDataFrame(rows, "mac string, field string, value string, n_frames int"), spark.createDataFrame([*labels.items()], "mac string, device string"))
        seen += rows
        joint = observe.joint_counts(spark.createDataFrame([(labels.get(m, m), *x) for m, *x in seen], "device string, field string, value string, n_frames int"))
        assert rounded(state.joint.select("field", "device", "value", "n")) == rounded(joint)
        assert rounded(upkeep.information(state)) == rounded(fieldstats.information(joint).select("field", "h_value", "h_device", "mi"))
    assert [r for r, _ in state.addresses] == [2]  # four parts, two of two
    moved = [plan.count("Exchange hashpartitioning(device") for label, plan in plans if label == "joint"]
    assert moved[1:] == [1, 1, 1]
    assert len([1 for label, _ in plans if label == "addresses"]) == 4 + 3


def test_a_part_that_lies_by_address_is_not_moved(spark, monkeypatch):
    """Counting it exchanges nothing, and changes go to their device before anything is added up."""
    plans, write = {}, upkeep.stash_by

    def noted(df, column, label, **more):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, column, label, **more)

    rows = spark.createDataFrame([(f"m{k % 5}", "f", "abc"[k % 3], k % 4) for k in range(40)], "mac string, field string, value string, n_frames int")
    labels = spark.createDataFrame([("m1", "d1"), ("m2", "d1")], "mac string, device string")
    lying, own = write(rows.repartition("mac"), "mac", "rows", ordered=False), labels.where("false")
    monkeypatch.setattr(upkeep, "stash_by", noted)
    state = upkeep.update(upkeep.update(upkeep.empty(spark), lying, own, placed=True), lying, labels, placed=True)
    assert "Exchange" not in plans["addresses"]
    assert "Aggregate" not in plans["joint"].split("Exchange hashpartitioning(device")[1]
    both = rows.union(rows).join(labels, "mac", "left").selectExpr("coalesce(device, mac) AS device", "mac", "field", "value", "n_frames")
    assert rounded(state.joint.select("field", "device", "value", "n")) == rounded(observe.joint_counts(both))
