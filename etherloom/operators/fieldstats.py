"""Distributions, cardinalities, stability and information of each field, all from the joint counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .observe import NULL
from .ordering import numbered


def _by(*keys: str):
    return Window.partitionBy(*keys)


def _value_frames(joint: DataFrame) -> DataFrame:
    return joint.where("n > 0").groupBy("field", "value").agg(F.sum("n").cast("long").alias("n"))


def _field_frames(joint: DataFrame) -> DataFrame:
    """``field, total``: a row a field, which are an argument of the observations and few."""
    return F.broadcast(joint.groupBy("field").agg(F.sum("n").cast("long").alias("total")))


def distribution(joint: DataFrame) -> DataFrame:
    """``field, value, n, share`` of frames; a value that only requests without frames have is left out."""
    return _value_frames(joint).join(_field_frames(joint), "field").select("field", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def value_devices(joint: DataFrame) -> DataFrame:
    """``field, value, k``: how many devices have the value. Requests without frames count."""
    return joint.groupBy("field", "value").agg(F.count("*").alias("k"))  # a device is one row of a value


def k_summary(joint: DataFrame) -> DataFrame:
    return value_devices(joint).groupBy("field", "k").agg(F.count("*").alias("n_values"))


def uniqueness(joint: DataFrame) -> DataFrame:
    """``field, score``: the mean of 1/k over the values."""
    return value_devices(joint).groupBy("field").agg(F.avg(1 / F.col("k")).alias("score"))


def device_min_k(joint: DataFrame) -> DataFrame:
    return joint.join(value_devices(joint), ["field", "value"]).groupBy("field", "device").agg(F.min("k").alias("min_k"))


def device_k_cumulative(joint: DataFrame) -> DataFrame:
    """``field, k, n_devices, percent``: devices of which some value is shared by at most k. A field has few distinct k."""
    counts = device_min_k(joint).groupBy("field", F.col("min_k").alias("k")).agg(F.count("*").alias("n"))
    up_to = _by("field").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(
        "field", "k", F.sum("n").over(up_to).alias("n_devices"),
        (100 * F.sum("n").over(up_to) / F.sum("n").over(_by("field"))).alias("percent"),
    )


def field_cardinality(joint: DataFrame) -> DataFrame:
    return joint.groupBy("field").agg(F.count_distinct("value").alias("n_values"))


def device_cardinality(joint: DataFrame) -> DataFrame:
    return joint.groupBy("field", "device").agg(F.count("*").alias("n_values"))


def cardinality_histogram(joint: DataFrame) -> DataFrame:
    n = device_cardinality(joint).groupBy("field", "n_values").agg(F.count("*").alias("n_devices"))
    return n.withColumn("percent", 100 * F.col("n_devices") / F.sum("n_devices").over(_by("field")))


def cardinality_matrix(joint: DataFrame, fields: list[str]) -> DataFrame:
    """One row a device, one column a field; 0 where the device lacks the field."""
    return joint.groupBy("device").pivot("field", fields).agg(F.count("value")).na.fill(0)


def affected_devices(joint: DataFrame, devices: DataFrame) -> DataFrame:
    """``field, n_devices, percent`` of all devices with some value that is not missing."""
    total = devices.select("device").distinct().agg(F.count("*").alias("total"))
    hit = joint.groupBy("field").agg(F.count_distinct(F.when(F.col("value") != NULL, F.col("device"))).alias("n_devices"))
    percent = F.when(F.col("total") == 0, 0.0).otherwise(100 * F.col("n_devices") / F.col("total"))
    return hit.join(F.broadcast(total)).select("field", "n_devices", percent.alias("percent"))  # one row is sent


def representative_value(joint: DataFrame) -> DataFrame:
    """``field, device, value, n``: the value of most frames; of equals the least."""
    best = joint.where("n > 0").groupBy("field", "device").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("x"))
    return best.select("field", "device", "x.value", (-F.col("x.m")).alias("n"))


def stability_by_device(joint: DataFrame, devices: DataFrame) -> DataFrame:
    """``field, device, stability``: the share of frames with the representative value; 1 without frames."""
    known = joint.groupBy("field", "device").agg(F.try_divide(F.max("n"), F.sum("n")).alias("s"))
    fields = F.broadcast(joint.select("field").distinct())  # an argument of the observations, and few
    every = devices.select("device").distinct().join(fields)
    return every.join(known, ["field", "device"], "left").select("field", "device", F.coalesce("s", F.lit(1.0)).alias("stability"))


def stability(joint: DataFrame, devices: DataFrame) -> DataFrame:
    return stability_by_device(joint, devices).groupBy("field").agg(F.avg("stability").alias("stability"))


def value_labels(joint: DataFrame, label: Column | None = None, most: int = 1000) -> DataFrame:
    """``field, value, part, labels, n_labels``: all labels in order, joined by ', ', ``most`` to a row; parts count from 0.

    Null labels are left out; a value without another has a row of none. A missing field is a value that most devices
    have, so its labels are numbered in many tasks and no row holds more than ``most``.
    """
    label = F.col("device") if label is None else label
    each = joint.select("field", "value", label.alias("label")).distinct()
    ranked = numbered(each.where("label IS NOT NULL"), ["field", "value", "label"], "at")
    n = ranked.groupBy("field", "value").agg(F.min("at").alias("first"), F.count("*").alias("n_labels"))
    parts = ranked.join(n, ["field", "value"]).withColumn("part", F.floor((F.col("at") - F.col("first")) / most))
    listed = F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("labels")
    found = parts.groupBy("field", "value", "part").agg(listed, F.max("n_labels").alias("n_labels"))
    every = each.select("field", "value").distinct().join(found, ["field", "value"], "left")
    none = lambda c, x: F.coalesce(c, F.lit(x)).alias(c)
    return every.select("field", "value", none("part", 0), none("labels", ""), none("n_labels", 0))


def short_label(label: Column) -> Column:
    """Fourth character of the second part by '_', null where there is none."""
    return F.nullif(F.substring(F.get(F.split(label, "_"), F.lit(1)), 4, 1), F.lit(""))


def abbreviated(value: Column, most: int = 16) -> Column:
    return F.when(F.length(value) > most, F.concat(F.left(value, F.lit(8)), F.lit("..."), F.right(value, F.lit(4)))).otherwise(value)


def top_and_other(joint: DataFrame, top: int = 15) -> DataFrame:
    """``field, value, n, share``: the ``top`` values by frames; OTHER is what the field has besides, if it has more values.

    The rank is filtered, so each task keeps ``top`` rows of a field before anything is sorted together.
    """
    n = _value_frames(joint)
    rank = F.row_number().over(_by("field").orderBy(F.desc("n"), "value"))
    best = n.withColumn("at", rank).where(F.col("at") <= top).select("field", "value", "n")
    values = F.broadcast(n.groupBy("field").agg(F.count("*").alias("values")))
    rest = best.groupBy("field").agg(F.sum("n").alias("shown"), F.count("*").alias("k")).join(_field_frames(joint), "field").join(values, "field")
    rest = rest.where("values > k").select("field", F.lit("OTHER").alias("value"), (F.col("total") - F.col("shown")).alias("n"))
    return best.union(rest).join(_field_frames(joint), "field").select("field", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def frames_rollup(obs: DataFrame) -> DataFrame:
    """Frames of each MAC, of each device and of all, by rollup."""
    return obs.rollup("device", "mac").agg(F.sum("n_frames").cast("long").alias("n_frames"))


def _bits(n: str, total: str) -> Column:
    p = F.col(n) / F.col(total)
    return F.coalesce(F.sum(F.when(F.col(n) > 0, -p * F.log2(p))), F.lit(0.0))


def information(joint: DataFrame) -> DataFrame:
    """``field, h_value, h_device, h_value_given_device, h_device_given_value, mi, nmi`` in bits, frames as weights."""
    seen = joint.where("n > 0")
    total = seen.groupBy("field").agg(F.sum("n").alias("total"))

    def entropy(*keys: str) -> DataFrame:
        return seen.groupBy("field", *keys).agg(F.sum("n").alias("c")).join(F.broadcast(total), "field").groupBy("field").agg(_bits("c", "total").alias("h"))  # a row a field is sent

    h = entropy("value").withColumnRenamed("h", "hx")
    h = h.join(entropy("device").withColumnRenamed("h", "hy"), "field").join(entropy("device", "value").withColumnRenamed("h", "hxy"), "field")
    mi, least = F.greatest(F.col("hx") + F.col("hy") - F.col("hxy"), F.lit(0.0)), F.least("hx", "hy")
    return h.select(
        "field", F.col("hx").alias("h_value"), F.col("hy").alias("h_device"),
        F.greatest(F.col("hxy") - F.col("hy"), F.lit(0.0)).alias("h_value_given_device"),
        F.greatest(F.col("hxy") - F.col("hx"), F.lit(0.0)).alias("h_device_given_value"),
        mi.alias("mi"), F.when(least > 0, mi / least).otherwise(0.0).alias("nmi"),
    )
