"""Field statistics kept up to date: each new part of the captures costs what it touches, not a recount.

An address may get its label late; its frames then move from one device to another. So a change is a table of signed
differences of the joint counts: what is new, and what moves, with minus where it was. Distinct counts follow from the
entries that appear and vanish, entropies from sums of n log2 n, of which only the touched terms change. What is kept lies in
tables bucketed by what the next part is joined on, so a part moves its own rows and those whose device changes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etherloom.sources.storage import stash, stash_by

JOINT = ["device", "value", "field"]  #: what differs most comes first, so that sorts compare little
FAN = 8  #: parts of the counts by address that become one


@dataclass(frozen=True)
class State:
    """What is kept: counts by address, the devices of addresses, the joint counts and their margins, and the sums of n log2 n."""

    addresses: tuple[tuple[int, DataFrame], ...]  #: rank, and mac, field, value, n, rows; the counts of an address are the sums over all parts
    devices: DataFrame  #: mac, device
    joint: DataFrame  #: field, device, value, n, rows
    values: DataFrame  #: field, value, n, k: frames, and devices that have the value
    of_devices: DataFrame  #: field, device, n, k: frames, and values of the device
    sums: DataFrame  #: field, total, value_sum, device_sum, joint_sum


def empty(spark: SparkSession) -> State:
    none = lambda schema: spark.createDataFrame([], schema)
    return State(
        (), none("mac string, device string"),
        none("field string, device string, value string, n long, rows long"), none("field string, value string, n long, k long"),
        none("field string, device string, n long, k long"), none("field string, total long, value_sum double, device_sum double, joint_sum double"),
    )


def _weight(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n)).otherwise(0.0)


def _changed(old: DataFrame, change: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``old`` and of ``change``, with each number before (``_0``) and after (``_1``)."""
    numbers = [c for c in change.columns if c not in keys]
    joined = old.select(*keys, *[F.col(c).alias(f"{c}_0") for c in numbers]).join(change.withColumnsRenamed({c: f"{c}_d" for c in numbers}), keys, "full")
    joined = joined.withColumns({x: F.coalesce(x, F.lit(0)) for c in numbers for x in (f"{c}_0", f"{c}_d")})
    return joined.select(*keys, *[x for c in numbers for x in (F.col(f"{c}_0"), (F.col(f"{c}_0") + F.col(f"{c}_d")).alias(f"{c}_1"))])


def _touched(changed: DataFrame, *numbers: str) -> DataFrame:
    return changed.where(" OR ".join(f"{c}_0 <> {c}_1" for c in numbers))


def _after(changed: DataFrame, keys: list[str], numbers: list[str], alive: str) -> DataFrame:
    """What is kept: rows whose ``alive`` is 0 afterwards are gone."""
    return changed.where(F.col(f"{alive}_1") > 0).select(*keys, *[F.col(f"{c}_1").alias(c) for c in numbers])


def _counted(rows: DataFrame, n: Column, seen: Column, placed: bool = False) -> DataFrame:
    """Counts by address, in a table bucketed by it; rows go to their address first, unless they lie there, so that the tasks hold whole buckets."""
    counts = (rows if placed else rows.repartition("mac")).groupBy("mac", "field", "value").agg(F.sum(n).cast("long").alias("n"), seen.cast("long").alias("rows"))
    return stash_by(counts, "mac", "addresses", ordered=False)


def _grown(parts: tuple[tuple[int, DataFrame], ...], new: DataFrame) -> tuple[tuple[int, DataFrame], ...]:
    """The parts with a new one; ``FAN`` parts of a rank become one of the next, so a count is written again only as often as ranks rise."""
    found, rank = [*parts, (0, new)], 0
    while len(same := [x for r, x in found if r == rank]) >= FAN:
        found = [x for x in found if x[0] != rank] + [(rank + 1, _counted(reduce(DataFrame.unionByName, same), F.col("n"), F.sum("rows")))]
        rank += 1
    return tuple(found)


def update(state: State, observed: DataFrame, labelled: DataFrame, placed: bool = False) -> State:
    """The state after new observations (``mac, field, value, n_frames``) and new labels (``mac, device``, one row an address).

    An address without a label is its own device. Observations without frames count as there, with no frames. Null
    addresses and null labels are left out. ``placed`` tells that the observations are read from a table bucketed by
    ``mac``, so that counting them moves none.
    """
    new = _counted(observed.where("mac IS NOT NULL").select("mac", "field", "value", "n_frames"), F.col("n_frames"), F.count("*"), placed)
    given = labelled.where("mac IS NOT NULL AND device IS NOT NULL").select("mac", F.col("device").alias("given"))
    known = state.devices.join(given, "mac", "full").select("mac", F.coalesce("device", "mac").alias("old"), F.coalesce("given", "device").alias("device"))
    known = stash_by(known, "mac", "devices", ordered=False)
    moved = known.where("old <> device").select("mac", "old", "device").hint("shuffle_hash")  # one row an address: even parts, and no sort of the counts
    change = new.join(known.select("mac", "device").hint("shuffle_hash"), "mac", "left").select("field", F.coalesce("device", "mac").alias("device"), "value", "n", "rows")
    sign = F.explode(F.lit([-1, 1])).alias("sign")
    for _, part in state.addresses:
        moves = part.join(moved, "mac").select("field", "value", "old", "device", "n", "rows", sign)
        times = lambda c: (F.col("sign") * F.col(c)).alias(c)
        change = change.unionByName(moves.select("field", F.when(F.col("sign") < 0, F.col("old")).otherwise(F.col("device")).alias("device"), "value", times("n"), times("rows")))
    # counts of a device come from many tasks: to add them up before they meet would find next to nothing
    change = change.repartition(*JOINT).groupBy(*JOINT).agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).where("n <> 0 OR rows <> 0")
    joint = stash_by(_changed(state.joint, change, JOINT), JOINT, "joint", ordered=False)
    touched = _touched(joint, "n", "rows")

    appears = (F.col("rows_1") > 0).cast("long") - (F.col("rows_0") > 0).cast("long")
    margin = lambda keys: touched.groupBy(*keys).agg(F.sum(F.col("n_1") - F.col("n_0")).alias("n"), F.sum(appears).alias("k"))
    values = stash(_changed(state.values, margin(["field", "value"]), ["field", "value"]), "values")
    of_devices = stash(_changed(state.of_devices, margin(["field", "device"]), ["field", "device"]), "of-devices")
    gain = (_weight(F.col("n_1")) - _weight(F.col("n_0"))).alias("gain")
    parts = [(touched, "joint_sum"), (_touched(values, "n"), "value_sum"), (_touched(of_devices, "n"), "device_sum")]
    sums = state.sums
    for rows, name in parts:
        zero = {c: F.lit(0.0 if c != "total" else 0) for c in ("total", "value_sum", "device_sum", "joint_sum")}
        more = rows.select("field", gain, (F.col("n_1") - F.col("n_0")).alias("m")).groupBy("field").agg(F.sum("gain").alias(name), F.sum("m").alias("total"))
        own = zero | {name: F.col(name)} | ({"total": F.col("total")} if name == "joint_sum" else {})
        sums = sums.unionByName(more.select("field", *[c.alias(n) for n, c in own.items()]))
    sums = sums.groupBy("field").agg(F.sum("total").cast("long").alias("total"), *[F.sum(c).alias(c) for c in ("value_sum", "device_sum", "joint_sum")])
    return State(
        _grown(state.addresses, new), known.select("mac", "device"), _after(joint, JOINT, ["n", "rows"], "rows"),
        _after(values, ["field", "value"], ["n", "k"], "k"), _after(of_devices, ["field", "device"], ["n", "k"], "k"), stash(sums, "sums"),
    )


def information(state: State) -> DataFrame:
    """``field, h_value, h_device, mi`` in bits; 0 without frames."""
    t = F.col("total")
    h = lambda c: F.when(t > 0, F.greatest(F.log2(t) - F.col(c) / t, F.lit(0.0))).otherwise(0.0)
    found = state.sums.select("field", h("value_sum").alias("h_value"), h("device_sum").alias("h_device"), h("joint_sum").alias("h"))
    return found.select("field", "h_value", "h_device", F.greatest(F.col("h_value") + F.col("h_device") - F.col("h"), F.lit(0.0)).alias("mi"))
