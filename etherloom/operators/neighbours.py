"""Core distances of addresses by an exact search of nearest neighbours, without the matrix of all pairs.

Addresses with equal fields are one profile, which counts as often as it has addresses. Near profiles are found in
rounds of a growing tolerance: two profiles no further apart than it share a key, made of the sets that must then be
equal and of one of the classes that the bits are dealt into (one more than bits may differ). Who has found
``min_samples`` within the tolerance is done, as nothing nearer can be missing; the next round asks for the others.

If only a few are left they are compared with all. More are searched for by pivots: profiles that lack the same
fields, and write the others alike, form a pattern: between them the distances of bits and of sets obey the triangle
inequality, so from the distances to a few pivots follows how near two of them can be at least. Each profile is put
into the cell of its nearest pivot and compared with that cell; what it then knows as its ``min_samples``-th least
distance bounds the cells, and the members of these, that can hold a nearer one. Another pattern is at least the
penalties away that the two have between them. A field of a kind without the inequality only adds to a distance; kinds
that may take away from it have no bound, and their core distances come from the matrix.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etherloom.sources.storage import stash

from . import density, matrix
from .matrix import Spec

PIVOTS = 2000  #: of a pattern at most, about; the square root of its profiles if that is less
BLOCK = 2000  #: profiles of a cell or of a key that are compared with one asking at once
ROUNDS = 4  #: tolerances: 0 bits of the field whose bits weigh least, 1, 2 and so on
KEYS = 16  #: of a profile in a round, if its fields have one value each
METRIC = {"hex_bit", "data_rates"}
NEVER_NEGATIVE = METRIC | {"ie_list"}


def _state(kind: str, values: Column) -> Column:
    """Missing (m), alike by the length of its digits (a number), a set (s), or odd (o)."""
    texts = F.transform(values, lambda x: x["v"])
    alike = F.forall(texts, lambda t: t.rlike("^0x[0-9A-Fa-f]+$") & (F.length(t) == F.length(texts[0])))
    known = {"hex_bit": F.when(alike, F.length(texts[0]).cast("string")).otherwise("o"), "data_rates": F.lit("s")}.get(kind, F.lit("o"))
    return F.when(F.size(values) == 0, "m").otherwise(known)


def _distance(specs: Mapping[str, Spec], a: str | Column, b: str | Column, bounded: bool = False) -> Column:
    """Of two structs of values by field: the whole distance, or the part with the triangle inequality between profiles of one pattern."""
    side = lambda x: F.col(x) if isinstance(x, str) else x
    total = F.lit(0.0)
    for k, (field, spec) in enumerate(specs.items()):
        if bounded and spec.kind not in METRIC:
            continue
        x, y = side(a)["fields"][f"f{k}"], side(b)["fields"][f"f{k}"]
        d = float(spec.weights[0]) * matrix.unit_distance({field: spec}, F.lit(field), x, y)
        total = total + (F.when(side(a)["states"][k].isin("m", "o"), 0.0).otherwise(d) if bounded else d)
    return total if bounded else F.greatest(total, F.lit(0.0))


def _least_apart(specs: Mapping[str, Spec], a: Column, b: Column) -> Column:
    """Least distance of profiles of two patterns: the penalties of fields that one lacks, or that are written differently."""
    total = F.lit(0.0)
    for k, spec in enumerate(specs.values()):
        penalty = float(spec.weights[0] * spec.penalty)
        x, y = a[k], b[k]
        total = total + F.when((x == y) | ((x == "o") & (y != "m")) | ((y == "o") & (x != "m")), 0.0).otherwise(penalty)
    return total


def _keys(specs: Mapping[str, Spec], tolerance: float, longest: Mapping[str, int]) -> tuple[list[str], Column]:
    """The fields that keys of ``own`` tell apart, and the keys: profiles no further apart than ``tolerance`` share one.

    Of two lists of bits some pair of values is no further apart than their mean. A field that may differ wholly is left out.
    """
    used, many, keys = [], 1, F.array(F.lit(0).cast("long"))
    for k, (field, spec) in enumerate(specs.items()):
        weight, values = float(spec.weights[0]), F.col("own.fields")[f"f{k}"]
        if weight * spec.penalty <= tolerance:
            continue
        some = F.array(F.lit(1).cast("long"))
        if spec.kind == "data_rates" and weight > tolerance:
            used.append(field)
            some = F.array(F.xxhash64(F.array_sort(F.array_distinct(F.transform(values, lambda x: x["v"])))))
        elif field in longest and many * (most := floor(tolerance * 4 * longest[field] / weight + 1e-9) + 1) <= KEYS:
            used.append(field)
            many *= most
            some = F.array_distinct(F.flatten(F.transform(F.filter(values, lambda x: x["bits"].isNotNull()), lambda x: _classes(x["bits"], tolerance / weight, most))))
        own = F.when(F.size(values) == 0, F.array(F.lit(0).cast("long"))).otherwise(some)
        keys = _with_each(keys, own)
    return used, keys


def _with_each(keys: Column, own: Column) -> Column:
    return F.flatten(F.transform(keys, lambda x: F.transform(own, lambda y: F.xxhash64(x, y))))


def _classes(bits: Column, share: float, most: int) -> Column:
    """A number for each class of the bits: as many as ``share`` of the bits, and one; every so manieth bit is of a class."""
    masks = F.lit([[sum(1 << j for j in range(i, 32, n)) for i in range(n)] for n in range(1, most + 1)]).cast("array<array<bigint>>")
    more = F.floor(F.lit(share * 4) * bits[0] + 1e-9).cast("int")
    pieces = F.slice(bits, 2, F.size(bits) - 1)
    one = lambda i: F.xxhash64(bits[0], i, F.transform(pieces, lambda x: x.bitwiseAND(F.get(F.get(masks, more), i))))
    return F.transform(F.sequence(F.lit(0), more), one)


def _fewest(rows: DataFrame, m: int) -> DataFrame:
    """``pid, least, n``: the ``m`` least of ``d``, each ``times`` times, and the number of rows; listed in blocks of a bounded size."""
    few = lambda c: F.slice(F.array_sort(c), 1, m)
    again = F.array_repeat("d", F.least("times", F.lit(m)).cast("int"))
    same = rows.groupBy("pid", "d").agg(F.sum("times").alias("times"), F.count("*").alias("n"))  # most distances are few
    parts = same.groupBy("pid", F.pmod(F.xxhash64("d"), F.lit(64)).alias("block"), F.shiftright(F.xxhash64("d"), 48).alias("fine"))
    parts = parts.agg(few(F.flatten(F.collect_list(F.when(F.col("d").isNotNull(), again)))).alias("least"), F.sum("n").alias("n"))
    parts = parts.groupBy("pid", "block").agg(few(F.flatten(F.collect_list("least"))).alias("least"), F.sum("n").alias("n"))
    return parts.groupBy("pid").agg(few(F.flatten(F.collect_list("least"))).alias("least"), F.sum("n").alias("n"))


def _meet(asking: DataFrame, held: DataFrame, on: str, tasks: int) -> DataFrame:
    """``asking`` with ``other, theirs, times`` and what else ``held`` has, where they agree in ``on``, in a given number of tasks.

    What many hold goes in blocks of about BLOCK. By their bytes alone, the few rows that make very many pairs would all go to one task.
    """
    sizes = held.groupBy(on).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    large = F.broadcast(stash(sizes, "large"))  # a thousandth of the rows and less
    blocks = F.coalesce("blocks", F.lit(1))
    a = asking.join(large, on, "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    h = held.join(large, on, "left").withColumn("block", F.pmod(F.xxhash64("other"), blocks).cast("int")).drop("blocks")
    return a.repartition(tasks, on, "block").join(h.repartition(tasks, on, "block"), [on, "block"])


def _tasks(rows: int) -> int:
    return max(1, min(matrix.TASKS, rows // 500))


def _by_keys(once: DataFrame, specs: Mapping[str, Spec], m: int) -> tuple[list[DataFrame], DataFrame, int]:
    """Profiles that are done, ``pid, core, n``, those left, ``pid, own, n``, and how many these are."""
    numbers = {f: F.max(F.array_max(F.transform(F.col("own.fields")[f"f{k}"], lambda x: x["bits"][0]))).alias(f"f{k}") for k, (f, s) in enumerate(specs.items()) if s.kind == "hex_bit"}
    row = once.agg(F.count("*"), *numbers.values()).first()
    longest = {f: n for f, n in zip(numbers, row[1:]) if n and specs[f].weights[0] > 0}
    unit = min((specs[f].weights[0] / (4 * n) for f, n in longest.items()), default=None)
    done, left, n, fields = [], once.select("pid", "own", F.lit(0).cast("long").alias("n")), row[0], _keys(specs, 0.0, longest)[0]
    for bits in range(ROUNDS if unit else 1):
        tolerance = bits * unit if bits else 0.0
        used, keys = _keys(specs, tolerance, longest)
        if not n or not used or used != fields:
            break
        held = once.select(F.col("pid").alias("other"), F.col("own").alias("theirs"), "times", keys.alias("same")).withColumn("key", F.explode("same"))
        met = _meet(left.select("pid", "own", keys.alias("keys")).withColumn("key", F.explode("keys")), held, "key", _tasks(row[0] + n))
        met = met.where(F.col("key") == F.array_min(F.array_intersect("keys", "same")))  # a pair once
        d = _distance(specs, "own", "theirs")
        found = _fewest(met.select("pid", "times", d.alias("d")).withColumn("d", F.expr(f"IF(d <= {tolerance * (1 + 1e-12)!r}D, d, NULL)")), m)
        left = left.join(found.select("pid", F.get("least", F.lit(m - 1)).alias("core"), F.col("n").alias("more")), "pid", "left")
        round_ = stash(left.select("pid", "own", "core", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "round")
        done.append(round_.where("core IS NOT NULL").select("pid", "core", "n"))
        left = round_.where("core IS NULL").select("pid", "own", "n")
        n = left.count()
    return done, left, n


def core_distances(prof: DataFrame, specs: Mapping[str, Spec], min_samples: int = 2) -> DataFrame:
    """``mac, core, n_compared``: the ``min_samples``-th least distance, its own to itself included, and the profiles compared for it.

    Null where there are fewer addresses. ``prof`` has ``mac, field, values`` as ``profiles`` makes them; a field that
    an address has no row for is missing. Every address with a row of one of the fields counts.
    """
    if any(s.kind not in NEVER_NEGATIVE or s.weights[0] < 0 or s.penalty < 0 for s in specs.values()):
        full = matrix.mac_distances(prof, specs).select(F.lit(0).alias("scenario"), "i", "j", "distance")
        n = prof.where(F.col("field").isin(list(specs))).select("mac").distinct().count()
        return density.core_distances(full, min_samples).select("mac", "core", F.lit(n).cast("long").alias("n_compared"))
    prof = prof.where(F.col("field").isin(list(specs))).withColumn("values", matrix.taken_apart(F.col("values"), F.col("field"), specs))
    none = F.array().cast(dict(prof.dtypes)["values"])
    of = [F.coalesce(F.first(F.when(F.col("field") == f, F.col("values")), ignorenulls=True), none).alias(f"f{k}") for k, f in enumerate(specs)]
    wide = prof.groupBy("mac").agg(F.struct(*of).alias("fields"))
    states = F.array(*[_state(s.kind, F.col("fields")[f"f{k}"]) for k, s in enumerate(specs.values())])
    wide = wide.withColumn("states", states).withColumns({"pid": F.xxhash64(F.to_json("fields")), "pattern": F.array_join("states", ",")})
    wide = stash(wide, "wide")
    once = wide.groupBy("pid").agg(F.first("fields").alias("fields"), F.first("states").alias("states"), F.first("pattern").alias("pattern"), F.count("*").alias("times"))
    once = stash(once.select("pid", "pattern", "times", F.struct("fields", "states").alias("own")), "profiles")

    done, left, n = _by_keys(once, specs, min_samples)
    all_ = once.count()
    tasks = _tasks(all_)
    if n and n * n <= all_:  # fewer than there would be pivots
        held = once.select(F.lit(0).alias("all"), F.col("pid").alias("other"), F.col("own").alias("theirs"), "times")
        met = _meet(left.select("pid", "own", F.lit(0).alias("all")), held, "all", tasks)
        rest = _fewest(met.select("pid", "times", _distance(specs, "own", "theirs").alias("d")), min_samples)
        done.append(_cores(left, rest, min_samples))
    elif n:
        done.append(_cores(left, _by_pivots(once, left, specs, min_samples, tasks), min_samples))
    found = reduce(DataFrame.unionByName, done) if done else once.select("pid", F.lit(None).cast("double").alias("core"), F.lit(0).cast("long").alias("n"))
    return wide.select("mac", "pid").join(found, "pid").select("mac", "core", F.col("n").alias("n_compared"))


def _cores(left: DataFrame, found: DataFrame, m: int) -> DataFrame:
    found = found.select("pid", F.get("least", F.lit(m - 1)).alias("core"), F.col("n").alias("more"))
    return left.select("pid", "n").join(found, "pid", "left").select("pid", "core", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))


def _by_pivots(once: DataFrame, left: DataFrame, specs: Mapping[str, Spec], min_samples: int, tasks: int) -> DataFrame:
    """``pid, least, n`` of the profiles ``left``, compared with those of all that can be near enough."""
    # pivots: by hash, about the square root of a pattern's profiles, at least one
    sizes = once.groupBy("pattern").agg(F.count("*").alias("n"), F.min("pid").alias("one"))
    every = F.ceil(F.greatest(F.sqrt("n"), F.col("n") / PIVOTS))
    picked = once.join(F.broadcast(sizes), "pattern").where((F.col("pid") == F.col("one")) | (F.pmod(F.xxhash64("pid"), every) == 0))
    pivots = stash(picked.groupBy("pattern").agg(F.collect_list(F.struct(F.col("pid").alias("cell"), "own")).alias("pivots")), "pivots")  # PIVOTS rows a pattern
    near = F.array_min(F.transform("pivots", lambda p: F.struct(_distance(specs, F.col("own"), p["own"], True).alias("d"), p["cell"].alias("cell"))))
    placed = once.repartition(tasks, "pid").join(F.broadcast(pivots), "pattern").select("pid", "pattern", "times", "own", near.alias("near"))
    placed = stash(placed.select("pid", "pattern", "times", "own", F.col("near.cell").alias("cell"), F.col("near.d").alias("d")), "placed")
    cells = stash(placed.groupBy("pattern", "cell").agg(F.max("d").alias("radius")), "cells")
    held = placed.select("cell", F.col("pid").alias("other"), F.col("own").alias("theirs"), F.col("d").alias("from"), "times")

    # each with its own cell
    asking = placed.join(left.select("pid"), "pid", "left_semi")
    met = _meet(asking.select("pid", "own", "cell"), held, "cell", tasks)
    first = stash(_fewest(met.select("pid", "times", _distance(specs, "own", "theirs").alias("d")), min_samples), "nearest")

    # cells that can hold a nearer one: by the pivots of the own pattern, by the penalties to another
    bound = F.coalesce(F.get("least", F.lit(min_samples - 1)), F.lit(float("inf"))).alias("bound")
    asking = stash(asking.join(first.select("pid", bound), "pid"), "asking").repartition(tasks, "pid")
    own = F.filter(
        F.transform("pivots", lambda p: F.struct(p["cell"].alias("cell"), _distance(specs, F.col("own"), p["own"], True).alias("to"))), lambda x: x["cell"] != F.col("cell")
    )
    inside = asking.join(F.broadcast(pivots), "pattern").select("pid", "own", "bound", F.inline(own))
    inside = inside.join(F.broadcast(cells.select("cell", "radius")), "cell").where(F.col("to") - F.col("radius") < F.col("bound"))
    other = cells.select(F.col("pattern").alias("there"), "cell")
    kinds = cells.select(F.col("pattern").alias("there"), F.split("pattern", ",").alias("kinds")).distinct()
    apart = asking.select("pid", "own", "bound", "pattern").join(F.broadcast(kinds), F.col("pattern") != F.col("there"))  # patterns: a few states a field
    apart = apart.where(_least_apart(specs, F.col("own.states"), F.col("kinds")) < F.col("bound")).join(F.broadcast(other), "there")
    asked = inside.select("pid", "own", "bound", "cell", "to").unionByName(apart.select("pid", "own", "bound", "cell", F.lit(None).cast("double").alias("to")))
    met = _meet(asked, held, "cell", tasks).where(F.col("to").isNull() | (F.abs(F.col("to") - F.col("from")) < F.col("bound")))
    found = _fewest(met.select("pid", "times", _distance(specs, "own", "theirs").alias("d")), min_samples)
    both = first.join(found.select("pid", F.col("least").alias("more"), F.col("n").alias("m")), "pid", "left")
    least = F.slice(F.array_sort(F.concat("least", F.coalesce("more", F.array().cast("array<double>")))), 1, min_samples)
    return both.select("pid", least.alias("least"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
