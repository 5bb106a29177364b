"""Distances between addresses: profiles of their fields, unit distances of pairs, and weighted sums of them.

A matrix has a row for each pair by its nature. Three things keep it bearable: addresses with the same values share one
profile, so a pair of profiles is compared once; a profile has each value once, with its number, taken apart once; and
blocks of profiles meet in a task that holds two of them at most and compares them as arrays, each value that repeats
there once. A profile brings the list of its addresses along, and the pairs of addresses are unfolded where the profiles meet: what is moved grows with the addresses
and the number of blocks, never with the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from etherloom.functions import distance
from etherloom.sources.storage import stash

from . import blocks as blocks_
from .observe import NULL

BLOCK = 2000  #: profiles, or addresses, of a field in a block, on average
MACS = 500  #: addresses of a profile in a row
TASKS = 400  #: pairs of blocks are dealt out to as many tasks at most: small rows, but much work each
SPREAD = 16  #: blocks at least, where there are as many profiles
CHARS = 500  #: characters of a profile, on average: longer ones make smaller blocks
LISTED = 100_000  #: pairs of profiles in a batch at most

# The fields that distances are defined for, by kind; those of the last three kinds have several weights.
FIELDS = {
    "hex_bit": ("HT_CAP", "HT_CAP_INFO", "HT_AMPDU_PARMS", "HT_MCS_SET", "HT_EXT_CAP", "HT_Tx", "HT_ANTENNA", "VHT_CAP", "EXT_CAP"),
    "ie_list": ("TAG_LIST",),
    "data_rates": ("DATA_RTS.SUPP", "DATA_RTS.EXT"),
    "ext_tag": ("EXT_TAG",),
    "vendor_spec": ("VENDOR_SPEC",),
    "rssi_time": ("RSSI_TIME",),
}
SEVERAL = {"ext_tag": 3, "vendor_spec": 3, "rssi_time": 4}
ONE_SIDED = {"ext_tag", "vendor_spec"}  #: kinds that measure by the first side's length


@dataclass(frozen=True)
class Spec:
    """How a field is compared: its kind, its weights and the penalty where one side lacks it."""

    kind: str
    weights: tuple[float, ...] = (1.0,)
    penalty: float = 1.0

    def effective_weight(self) -> float:
        """The weight; of several, the mean of those above 0, and 0 if none is."""
        if self.kind not in SEVERAL:
            return self.weights[0]
        above = [w for w in self.weights if w > 0]
        return sum(above) / len(above) if above else 0.0

    def effective_penalty(self, scaled: bool = True) -> float:
        return self.penalty * self.effective_weight() if scaled else self.penalty


def registry(weights: Mapping[str, float] | None = None) -> dict[str, Spec]:
    """The Spec of each known field. A weight is named like its field, or ``<field>_weight<k>`` where it has several; others are 1."""
    given = weights or {}

    def of(field: str, kind: str) -> Spec:
        names = [f"{field}_weight{k}" for k in range(1, SEVERAL[kind] + 1)] if kind in SEVERAL else [field]
        return Spec(kind, tuple(float(given.get(n, 1.0)) for n in names))

    return {f: of(f, kind) for kind, fields in FIELDS.items() for f in fields}


def profiles(obs: DataFrame, ordered: Collection[str] = ()) -> DataFrame:
    """``mac, field, values array<struct<v,n>>``: the non-missing values of each address, each once with its number; none gives ``[]``.

    Those of the ``ordered`` fields are listed in the order of their requests instead, repeats included.
    """
    order = [c for c in ("cap", "pr_ord") if c in obs.columns]
    value = F.when(F.col("value") != NULL, F.col("value"))
    parts = []
    if ordered:
        each = F.struct(*order, value.alias("v"))
        listed = F.filter(F.transform(F.array_sort(F.collect_list(each)), lambda x: F.struct(x["v"].alias("v"), F.lit(1).cast("long").alias("n"))), lambda x: x["v"].isNotNull())
        parts.append(obs.where(F.col("field").isin(list(ordered))).groupBy("mac", "field").agg(listed.alias("values")))
    counted = obs.where(~F.col("field").isin(list(ordered))).groupBy("mac", "field", value.alias("v")).agg(F.count("*").alias("n"))
    known = F.filter(F.array_sort(F.collect_list(F.struct("v", "n"))), lambda x: x["v"].isNotNull())
    parts.append(counted.groupBy("mac", "field").agg(known.alias("values")))
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def frame_profiles(requests: DataFrame, field: str = "RSSI_TIME") -> DataFrame:
    """Profiles of the pseudo-field of levels and times: a value ``level|time`` for each frame of an address."""
    each = requests.select("mac", F.explode(F.arrays_zip(F.col("rssi").alias("r"), F.col("time").alias("t"))).alias("x"))
    known = each.where("x.r IS NOT NULL AND x.t IS NOT NULL").groupBy("mac", F.concat_ws("|", "x.r", "x.t").alias("v")).agg(F.count("*").alias("n"))
    return known.groupBy("mac").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("values")).select("mac", F.lit(field).alias("field"), "values")


def _values(xs: Column) -> Column:
    return F.transform(xs, lambda x: x["v"])


def _mean(a: Column, b: Column, of) -> Column:
    """Mean over all pairs of the two lists of ``of(entry, entry)``."""
    times = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x["n"])
    inner = lambda x: F.aggregate(b, F.lit(0.0), lambda s, y: s + x["n"] * y["n"] * of(x, y).cast("double"))
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + inner(x)) / (times(a) * times(b))


def _tags(v: Column) -> Column:
    return F.transform_values(F.from_json(v, "map<string,string>"), lambda _, x: distance.payload_pieces(x))


def _vendors(v: Column) -> Column:
    types = lambda _, m: F.transform_values(m, lambda _, x: distance.payload_pieces(x))
    return F.transform_values(F.from_json(v, "map<string,map<string,string>>"), types)


def _frame(v: Column) -> Column:
    part = lambda k: F.get(F.split(v, r"\|"), F.lit(k)).cast("double")
    return F.struct(part(0).alias("r"), part(1).alias("t"))


#: what an entry is taken apart into by its kind, beside its text
PARTS = {
    "hex_bit": ("bits", "array<bigint>", distance.hex_pieces),
    "ext_tag": ("tags", "map<string,array<bigint>>", _tags),
    "vendor_spec": ("vendors", "map<string,map<string,array<bigint>>>", _vendors),
    "rssi_time": ("frame", "struct<r:double,t:double>", _frame),
}


def taken_apart(values: Column, field: Column, specs: Mapping[str, Spec]) -> Column:
    """The values with what their kind compares, so that this is found once a profile, not once a pair."""
    used = [k for k in PARTS if any(s.kind == k for s in specs.values())]

    def part(kind: str, v: Column) -> Column:
        name, type_, of = PARTS[kind]
        return F.when(field.isin([f for f, s in specs.items() if s.kind == kind]), of(v)).otherwise(F.lit(None).cast(type_)).alias(name)

    return F.transform(values, lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), *[part(k, x["v"]) for k in used]))


#: kind -> distance of two profiles, their values taken apart, from (a, b, weights, penalty); a kind with one weight gives it at weight 1
KINDS = {
    "hex_bit": lambda a, b, w, penalty: _mean(a, b, lambda x, y: distance.bits_apart(x["bits"], y["bits"], penalty)),
    "ie_list": lambda a, b, w, penalty: distance.ie_list(_values(a), _values(b)),
    "data_rates": lambda a, b, w, penalty: distance.data_rates(_values(a), _values(b)),
    "ext_tag": lambda a, b, w, penalty: _mean(a, b, lambda x, y: distance.ext_tag(x["tags"], y["tags"], *w, distance.pieces_share)),
    "vendor_spec": lambda a, b, w, penalty: _mean(a, b, lambda x, y: distance.vendor_spec(x["vendors"], y["vendors"], *w, distance.pieces_share)),
    "rssi_time": lambda a, b, w, penalty: distance.frames_apart(*[F.transform(x, lambda v: v["frame"]) for x in (a, b)], *w),
}


def _specs(kinds: Mapping[str, str | Spec], penalty: float) -> dict[str, Spec]:
    specs = {f: k if isinstance(k, Spec) else Spec(k, (1.0,) * SEVERAL.get(k, 1), penalty) for f, k in kinds.items()}
    unknown = {s.kind for s in specs.values()} - KINDS.keys()
    if unknown:
        raise ValueError(f"unknown kind: {', '.join(sorted(unknown))}")
    return specs


def unit_distance(kinds: Mapping[str, str | Spec], field: Column, a: Column, b: Column, penalty: float = 1.0) -> Column:
    """Distance of two profiles of ``field``, their values ``taken_apart``: none on both sides is 0, on one side the penalty.

    A field with one weight is measured at weight 1, whatever its Spec says; one with several has them in its distance,
    and its penalty scaled by their effective weight.
    """
    specs = _specs(kinds, penalty)
    empty = (F.size(a) == 0).cast("int") + (F.size(b) == 0).cast("int")
    found = F.lit(None).cast("double")
    for spec in sorted(set(specs.values()), key=repr):
        of_kind = [f for f, s in specs.items() if s == spec]
        missing = spec.effective_penalty() if spec.kind in SEVERAL else spec.penalty
        own = F.when(empty == 1, float(missing)).otherwise(KINDS[spec.kind](a, b, spec.weights, spec.penalty).cast("double"))
        found = F.when(field.isin(of_kind), own).otherwise(found)
    return F.when(empty == 2, 0.0).otherwise(found)


def in_blocks(rows: DataFrame, on: list[str], count: int, schema: str, work: Callable, tasks: int | None = None) -> DataFrame:
    """What ``work(keys, one, other)`` yields as dicts of columns for each two blocks that agree in ``on``, each with itself too.

    A row is in one of ``count`` blocks by its ``key``; a task holds two blocks at most, as Arrow tables that are ordered by key.
    The number of tasks follows from that of the blocks: by their bytes alone, the few rows that make very many pairs would all go to one task.
    """
    own = F.pmod(F.xxhash64("key"), F.lit(count)).cast("int")
    placed = rows.withColumn("own", own)
    first = placed.withColumns({"p": F.col("own"), "second": F.lit(False)}).withColumn("q", F.explode(F.sequence("own", F.lit(count - 1))))
    second = placed.where("own > 0").withColumns({"q": F.col("own"), "second": F.lit(True)}).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("own") - 1)))
    names = [*on, "p", "q"]
    dealt = first.unionByName(second).drop("own").repartition(tasks or max(1, min(TASKS, count * (count + 1) // 2)), *names).sortWithinPartitions(*names, "key")
    types = _parse_datatype_string(schema)

    def run(batches):
        arrow = to_arrow_schema(types)
        for keys, one, other in blocks_.in_pairs(batches, names):
            for columns in work(keys, one, other) if one.num_rows and other.num_rows else ():
                yield pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type, from_pandas=True) for f in arrow], schema=arrow)

    return dealt.mapInArrow(run, types)


def _listed(known: DataFrame, on: list[str]) -> DataFrame:
    """``*on, key, texts, macs``: a row for each profile with its addresses, several where more than MACS share it."""
    known = known.withColumn("pid", F.xxhash64("texts"))
    parts = known.groupBy(*on, "pid").agg(F.ceil(F.count("*") / MACS).cast("int").alias("parts"))
    key = F.struct("pid", F.pmod(F.xxhash64("mac"), F.col("parts")).cast("int").alias("part")).alias("key")
    return known.join(parts, [*on, "pid"]).groupBy(*on, key).agg(F.first("texts").alias("texts"), F.collect_list("mac").alias("macs"))


def _met(known: DataFrame, on: list[str], blocks: int | None, values: list[str], compared: Callable) -> DataFrame:
    """``*on, same, a_macs, b_macs`` and ``values`` of all pairs of profiles, from ``*on, mac, texts``.

    ``compared(keys, a, b)`` gives the values of all pairs of the lists of texts ``a`` and ``b`` as arrays, and which pairs count.
    The number of blocks follows from the number of profiles, of addresses and of characters.
    """
    listed = stash(_listed(known, on), "listed")
    of = lambda c: F.coalesce(F.max(c), F.lit(0))
    length = F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(F.length(x), F.lit(0))))
    rows, macs, chars, fields = listed.groupBy(*on).agg(F.count("*").alias("r"), F.sum(F.size("macs")).alias("m"), length.alias("c")).agg(of("r"), of("m"), of("c"), F.count("*")).first()
    count = blocks or max(1, min(rows, max(SPREAD, -(-max(rows, macs, chars // CHARS) // BLOCK))))
    kinds = dict(listed.dtypes)

    def work(keys, one, other):
        a, b = (x.column("texts").to_pylist() for x in (one, other))
        found, known_ = compared(keys, a, b)
        here, there = (x.column("macs").combine_chunks() for x in (one, other))
        size = len(here.flatten()) / len(here) + len(there.flatten()) / len(there)
        step = max(1, int(min(LISTED, LISTED * 20 / size)) // len(b))
        for at in range(0, len(a), step):
            cells = np.ones((len(a[at : at + step]), len(b)), dtype=bool) if known_ is None else known_[at : at + step].copy()
            if one is other:
                cells &= np.arange(len(b))[None, :] >= np.arange(at, at + len(cells))[:, None]
            i, j = np.nonzero(cells)
            i, j = i + at, j.astype(np.int64)
            columns = {c: pa.repeat(pa.scalar(k), len(i)) for c, k in zip(on, keys)}
            columns |= {"same": (i == j) if one is other else np.zeros(len(i), bool), "a_macs": here.take(pa.array(i)), "b_macs": there.take(pa.array(j))}
            yield columns | {c: x[i, j] for c, x in zip(values, found)}

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in on], "same boolean", f"a_macs {kinds['macs']}", f"b_macs {kinds['macs']}", *[f"{c} double" for c in values]])
    return in_blocks(listed, on, count, schema, work, max(1, min(TASKS, fields * count * (count + 1) // 2)))


def _unfolded(pairs: DataFrame, keep: list[str], both: bool) -> DataFrame:
    """``*keep, i, j, value`` of the pairs of addresses; ``pairs`` has ``same, a_macs, b_macs, there, back``, the value by either order."""
    each = pairs.select(*keep, "same", "there", "back", "b_macs", F.explode("a_macs").alias("x"))
    each = each.select(*keep, "same", "there", "back", "x", F.explode("b_macs").alias("y")).where("NOT same OR x <= y")
    if not both:
        return each.select(*keep, F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), F.when(F.col("x") <= F.col("y"), F.col("there")).otherwise(F.col("back")).alias("value"))
    row = lambda i, j, v: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.col(v).alias("value"))
    return each.select(*keep, F.inline(F.when(F.col("x") == F.col("y"), F.array(row("x", "y", "there"))).otherwise(F.array(row("x", "y", "there"), row("y", "x", "back")))))


def _missing(spec: Spec) -> float:
    return spec.effective_penalty() if spec.kind in SEVERAL else spec.penalty


def unit_distances(
    prof: DataFrame, kinds: Mapping[str, str | Spec], penalty: float = 1.0, blocks: int | None = None, both: bool = False, places: int | None = None
) -> DataFrame:
    """``field, i, j, unit`` of every pair of addresses ``i <= j``, the diagonal included, which need not be 0.

    With ``both`` the pairs ``j, i`` too: kinds that measure by the first side's length differ by the order. The number
    of blocks follows from the number of profiles and of addresses, unless ``blocks`` gives it. Units are rounded to
    ``places``, if given, before they are unfolded.
    """
    specs = _specs(kinds, penalty)
    # written once: the captures behind the profiles are read once, whatever follows
    known = prof.where(F.col("field").isin(list(specs)))
    known = stash(known.select("field", "mac", F.array(_text(F.col("values"), F.col("field"), specs)).alias("texts")), "profiles")

    def compared(keys, a, b):
        spec = specs[keys[0]]
        of = lambda x, y: blocks_.rounded(blocks_.unit([t[0] for t in x], [t[0] for t in y], spec, _missing(spec)), places)
        there = of(a, b)
        return [there, of(b, a).T if spec.kind in ONE_SIDED else there], None

    return _unfolded(_met(known, ["field"], blocks, ["there", "back"], compared), ["field"], both).withColumnRenamed("value", "unit")


def _text(values: Column, field: Column, specs: Mapping[str, Spec]) -> Column:
    return F.to_json(taken_apart(values, field, specs), {"ignoreNullFields": "false"})


def whole_profiles(prof: DataFrame, specs: Mapping[str, Spec]) -> DataFrame:
    """``mac, texts``: the values of each field of ``specs``, taken apart, as a text; null where an address has no row for it."""
    fields = list(specs)
    known = prof.where(F.col("field").isin(fields)).select("field", "mac", _text(F.col("values"), F.col("field"), specs).alias("text"))
    of = [F.first(F.when(F.col("field") == f, F.col("text")), ignorenulls=True) for f in fields]
    return known.groupBy("mac").agg(F.array(*of).alias("texts"))


def whole_distances(a: list, b: list, specs: Mapping[str, Spec], weights: list[list[float]], places: int | None = None) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of all pairs of texts of ``whole_profiles``: a distance for each list of weights, there and back, and which pairs have one."""
    shape = len(a), len(b)
    there, back, known = [np.zeros(shape) for _ in weights], [np.zeros(shape) for _ in weights], np.zeros(shape, dtype=bool)
    sided = any(s.kind in ONE_SIDED for s in specs.values())
    for k, spec in enumerate(specs.values()):
        x, y = [t[k] for t in a], [t[k] for t in b]
        units = [blocks_.unit(x, y, spec, _missing(spec))]
        known |= ~np.isnan(units[0])
        if sided:
            units.append(blocks_.unit(y, x, spec, _missing(spec)).T if spec.kind in ONE_SIDED else units[0])
        for side, u in zip((there, back), units):
            u = np.nan_to_num(u, nan=0.0)
            for n, w in enumerate(weights):
                side[n] += w[k] * u
    done = lambda side: [blocks_.rounded(np.maximum(x, 0.0), places) for x in side]
    there = done(there)
    return there, done(back) if sided else there, known


def composed_distances(
    prof: DataFrame, kinds: Mapping[str, str | Spec], scenarios: DataFrame, penalty: float = 1.0, blocks: int | None = None, places: int | None = None
) -> DataFrame:
    """``compose(unit_distances(prof, kinds, penalty), scenarios)`` without a row for each field of a pair: what is moved does not grow with the pairs."""
    specs = _specs(kinds, penalty)
    given = [(r["scenario"], r["weights"]) for r in scenarios.select("scenario", "weights").collect()]  # a handful of rows
    weights = [[1.0 if w.get(f) is None else float(w[f]) for f in specs] for _, w in given]

    def compared(keys, a, b):
        there, back, known = whole_distances(a, b, specs, weights, places)
        return [*there, *back], known

    names = [[f"{side}{k}" for k in range(len(given))] for side in ("there", "back")]
    pairs = _met(stash(whole_profiles(prof, specs), "whole"), [], blocks, [*names[0], *names[1]], compared)
    kind = scenarios.schema["scenario"].dataType
    of = F.array(*[F.struct(F.lit(s).cast(kind).alias("scenario"), F.col(x).alias("there"), F.col(y).alias("back")) for (s, _), x, y in zip(given, *names)])
    each = _unfolded(pairs.select("same", "a_macs", "b_macs", F.inline(of)), ["scenario"], False)
    return each.select("scenario", "i", "j", F.col("value").alias("distance"))


def compose(units: DataFrame, scenarios: DataFrame) -> DataFrame:
    """``scenario, i, j, distance`` for all scenarios at once: weighted sums of the unit distances, not below 0.

    ``scenarios``: ``scenario, weights map<string,double>``, a handful of rows; a field without a weight has 1.
    """
    weight = F.coalesce(F.try_element_at("weights", F.col("field")), F.lit(1.0))
    all_weights = units.select("field").distinct().crossJoin(scenarios.select("scenario", "weights"))  # fields by scenarios
    weighted = units.join(all_weights.select("scenario", "field", weight.alias("w")), "field")
    return weighted.groupBy("scenario", "i", "j").agg(F.greatest(F.sum(F.col("w") * F.col("unit")), F.lit(0.0)).alias("distance"))


def own_weights(specs: Mapping[str, Spec]) -> list[float]:
    """The weights of the Specs; fields that have several have them in their distance."""
    return [1.0 if x.kind in SEVERAL else float(x.weights[0]) for x in specs.values()]


def mac_distances(prof: DataFrame, specs: Mapping[str, Spec], blocks: int | None = None, both: bool = False, places: int | None = None) -> DataFrame:
    """``i, j, distance`` with the weights of the Specs: the sum over the fields, which may be negative each, not below 0."""
    specs = dict(specs)

    def compared(keys, a, b):
        there, back, known = whole_distances(a, b, specs, [own_weights(specs)], places)
        return [there[0], back[0]], known

    pairs = _met(stash(whole_profiles(prof, specs), "whole"), [], blocks, ["there", "back"], compared)
    return _unfolded(pairs, [], both).withColumnRenamed("value", "distance")


def representatives(prof: DataFrame, fields: Collection[str]) -> DataFrame:
    """``mac, first``: for each address the least one of those that have the same values in all of the ``fields``."""
    known = prof.where(F.col("field").isin(list(fields)))
    one = known.groupBy("mac").agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("field", F.to_json("values"))))).alias("pid"))
    one = stash(one, "profile-of")
    return one.join(one.groupBy("pid").agg(F.min("mac").alias("first")), "pid").select("mac", "first")


def of_representatives(prof: DataFrame, members: DataFrame) -> DataFrame:
    """The profiles of the addresses that stand for others."""
    return stash(prof.join(members.where("mac = first").select("mac"), "mac", "left_semi"), "representatives")


def pairs_of_addresses(matrix: DataFrame, members: DataFrame) -> DataFrame:
    """The matrix ``i, j, distance`` (``i <= j``) of representatives with ``n``: how many pairs of addresses each row stands for.

    ``members`` may lack addresses; rows that then stand for none are left out.
    """
    many = lambda c: members.groupBy(F.col("first").alias(c)).agg(F.count("*").alias(f"n_{c}"))
    joined = matrix.join(many("i"), "i").join(many("j"), "j")
    return joined.select("i", "j", "distance", F.when(F.col("i") == F.col("j"), F.col("n_i") * (F.col("n_i") + 1) / 2).otherwise(F.col("n_i") * F.col("n_j")).cast("long").alias("n"))


def compare(one: DataFrame, other: DataFrame, keys: Collection[str] = ("i", "j"), tolerance: float = 1e-9) -> DataFrame:
    """``n_pairs, n_only_one, max_abs, mean_abs, close`` of two matrices: whether a composed one equals a direct one.

    A row may stand for several pairs, which ``n`` tells; without it a row is one.
    """
    times = lambda m: F.col("n") if "n" in m.columns else F.lit(1).cast("long")
    of = lambda m, d, n: m.select(*keys, F.col("distance").alias(d), times(m).alias(n))
    joined = of(one, "x", "n_x").join(of(other, "y", "n_y"), list(keys), "full")
    apart, zero = F.abs(F.col("x") - F.col("y")), F.lit(0).cast("long")
    n_x, n_y = F.coalesce("n_x", zero), F.coalesce("n_y", zero)
    shared = F.least(n_x, n_y)
    alone = F.coalesce(F.sum(F.abs(n_x - n_y)), zero)
    far = F.count_if(apart > tolerance + tolerance * F.abs(F.col("y")))
    return joined.agg(
        F.coalesce(F.sum(F.greatest(n_x, n_y)), zero).alias("n_pairs"), alone.alias("n_only_one"), F.max(apart).alias("max_abs"),
        (F.sum(apart * shared) / F.sum(F.when(apart.isNotNull(), shared))).alias("mean_abs"), ((alone == 0) & (far == 0)).alias("close"),
    )


def matrix_stats(matrix: DataFrame) -> DataFrame:
    """``scenario, n, min, max, mean, std`` of the full square: a pair beside the diagonal counts twice."""
    times = F.when(F.col("i") == F.col("j"), 1).otherwise(2)
    d = F.col("distance")
    sums = matrix.groupBy("scenario").agg(
        F.sum((F.col("i") == F.col("j")).cast("long")).alias("n"), F.min(d).alias("min"), F.max(d).alias("max"),
        F.sum(times).alias("cells"), F.sum(d * times).alias("s"), F.sum(d * d * times).alias("ss"),
    )
    mean = F.col("s") / F.col("cells")
    std = F.sqrt(F.greatest(F.col("ss") / F.col("cells") - mean * mean, F.lit(0.0)))
    return sums.select("scenario", "n", "min", "max", mean.alias("mean"), std.alias("std"))
