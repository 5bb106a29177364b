"""Equal addresses worked on as one: distances, edges and comparisons against those of every address; few rows in many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from etherloom.operators import density, matrix, observe


@pytest.mark.parametrize("seed, k", [(1, 2), (2, 2), (3, 4), (4, 1)])
def test_tree_of_groups_equals_that_of_all_addresses(spark, seed, k):
    draw = random.Random(seed)
    group = {m: draw.randrange(9) for m in draw.sample(range(100), 34)}
    first = {g: min(m for m in group if group[m] == g) for g in set(group.values())}
    d = {(a, b): float(draw.choice((0, 1, 1, 2, 3))) for a in range(9) for b in range(a, 9)}
    of = lambda i, j: d[min(group[i], group[j]), max(group[i], group[j])]
    rows = lambda macs: spark.createDataFrame([("s", i, j, of(i, j)) for i in macs for j in macs if i <= j], "scenario string, i long, j long, distance double")
    full, small = rows(group), rows(first.values())
    members = spark.createDataFrame([("s", m, first[g]) for m, g in group.items()], "scenario string, mac long, first long")
    core, grouped = density.core_distances(full, k), density.grouped_core_distances(small, members, k)
    assert set(map(tuple, grouped.collect())) == set(map(tuple, core.collect()))
    edges = density.grouped_reach_edges(small, members, grouped)
    tree = lambda e: set(map(tuple, density.spanning_tree(e).collect()))
    assert tree(edges) == tree(density.reach_edges(full, core))
    assert edges.count() < 34 * 33 // 2


def profiles_of(spark, n):
    rows = [(m, f"0x{m * 2654435761 % 65536 // (1 + m % 3):04x}", chr(97 + m % 5)) for m in range(n)]
    each = F.inline(F.array(F.struct(F.lit("HEX").alias("field"), F.col("h").alias("value")), F.struct(F.lit("TAGS").alias("field"), F.col("t").alias("value"))))
    return matrix.profiles(spark.createDataFrame(rows, "mac long, h string, t string").select("mac", F.lit(0).alias("pr_ord"), each).where("field = 'HEX' OR mac % 7 > 0"), ["TAGS"])


KINDS = {"HEX": "hex_bit", "TAGS": "ie_list"}


def test_few_profiles_go_to_many_tasks(spark):
    found = matrix.unit_distances(profiles_of(spark, 120), {"HEX": "hex_bit"})
    assert found.count() == 120 * 121 // 2 and found.select(F.spark_partition_id()).distinct().count() > 16


def test_composed_in_one_go_equals_composed_units(spark, monkeypatch):
    monkeypatch.setattr(matrix, "MACS", 3)  # a profile of several rows
    prof = profiles_of(spark, 40)
    prof = prof.union(prof.where("mac < 9").withColumn("mac", F.col("mac") + 100)).union(prof.where("mac = 4").select(F.explode(F.sequence(F.lit(200), F.lit(208))).alias("mac"), "field", "values"))
    weights = spark.sql("SELECT * FROM VALUES ('a', map('HEX', 2.0D)), ('b', map('HEX', 0.0D, 'TAGS', 0.5D)) AS (scenario, weights)")
    rows = lambda m: {(r["scenario"], r["i"], r["j"]): round(r["distance"], 9) for r in m.collect()}
    found = matrix.composed_distances(prof, KINDS, weights)
    assert rows(found) == rows(matrix.compose(matrix.unit_distances(prof, KINDS), weights)) and found.count() == 2 * 58 * 59 // 2


def test_comparison_of_representatives_equals_that_of_all(spark):
    prof = profiles_of(spark, 20)
    prof = prof.union(prof.where("mac < 9").withColumn("mac", F.col("mac") + 100))
    members = matrix.representatives(prof, KINDS)
    few = matrix.of_representatives(prof, members)
    specs = [{f: matrix.Spec(k, (w,)) for f, k in KINDS.items()} for w in (1.0, 1.5)]
    of = lambda p: [matrix.mac_distances(p, x) for x in specs]
    shown = lambda one, other: [round(x, 9) for x in matrix.compare(one, other).first()]
    counted = [matrix.pairs_of_addresses(m, members) for m in of(few)]
    assert few.select("mac").distinct().count() == 20 and shown(*counted) == shown(*of(prof)) and shown(*counted)[0] == 29 * 30 // 2


def test_prefixes_beyond_four_digits(spark):
    """The prefix begins anew at 16 bits; with ``leading`` its first digits are kept."""
    frames = spark.range(65540).select(F.col("id").alias("ord"), F.col("id").alias("src"))
    last = lambda **x: {r["mac"] for r in observe.pseudonyms(frames, **x).where("src = 65537").collect()}
    assert last() == {"02:00:02:00:00:01"} and last(leading=True) == {"02:10:00:00:00:01"}


#: values of each kind: of several lengths, several to a profile, none, odd ones
ODD = {
    "hex_bit": ["0x0f", "0xff", "0x00ff", "0x", "0xzz", "7", "0x0123456789abcdef01", "0xf123456789abcdef01"], "ie_list": list("abca"), "data_rates": list("abcd"),
    "ext_tag": ['{"1":"0x0f"}', '{"1":"0xff","2":"abc"}', '{"2":"0x","3":null}', "[", "{}", '{"1":"123456789abc","3":"0x1"}'],
    "vendor_spec": ['{"u":{"x":"0x0f"}}', '{"u":{"x":"ff1","y":"0x"},"w":{}}', '{"w":{"x":"0x1"}}', '{"u":null}', "no"],
    "rssi_time": ["-40|10", "-43|12.5", "-50|2", "-41|30"],
}


def by_columns(prof, specs):
    """field -> (i, j) -> unit distance by the column expressions, from the side of i, a row for each pair."""
    side = lambda c: prof.select("field", F.col("mac").alias(c), matrix.taken_apart(F.col("values"), F.col("field"), specs).alias(f"of_{c}"))
    pairs = side("i").join(side("j"), "field").select("field", "i", "j", matrix.unit_distance(specs, F.col("field"), F.col("of_i"), F.col("of_j")).alias("unit"))
    found = {f: {} for f in specs}
    for r in pairs.collect():
        found[r["field"]][r["i"], r["j"]] = r["unit"]
    return found


@pytest.mark.parametrize("cells", [2000, 3])
def test_blocks_measure_as_columns_do(spark, monkeypatch, cells):
    draw = random.Random(7)
    monkeypatch.setattr(matrix.blocks_, "CELLS", cells)
    specs = {k: matrix.Spec(k, tuple(0.5 + 0.25 * w for w in range(matrix.SEVERAL.get(k, 1))), 0.75) for k in ODD}
    rows = [(k, m, [(v, 1 + (m + len(v)) % 3) for v in (draw.sample(odd, draw.randrange(4)) if m else [])]) for k, odd in ODD.items() for m in range(14) if m != 5 or k == "hex_bit"]
    prof = spark.createDataFrame(rows, "field string, mac long, values array<struct<v:string,n:bigint>>")
    wanted = by_columns(prof, specs)
    near = lambda x: None if x is None else pytest.approx(x, abs=1e-12)
    texts = {(r["field"], r["mac"]): r["t"] for r in prof.select("field", "mac", matrix._text(F.col("values"), F.col("field"), specs).alias("t")).collect()}
    for k, spec in specs.items():
        macs = sorted(m for f, m in texts if f == k)
        got = matrix.blocks_.unit([texts[k, m] for m in macs], [texts[k, m] for m in macs], spec, matrix._missing(spec))
        assert {(i, j): None if got[a, b] != got[a, b] else got[a, b] for a, i in enumerate(macs) for b, j in enumerate(macs)} == {p: near(x) for p, x in wanted[k].items()}
    units = {(r["field"], r["i"], r["j"]): r["unit"] for r in matrix.unit_distances(prof, specs, both=True, places=6).collect()}
    rounds = by_columns(prof, specs)
    assert units == {(f, *p): None if x is None else pytest.approx(x, abs=5.1e-7) for f, of in rounds.items() for p, x in of.items()}


def test_halves_are_rounded_as_spark_does(spark):
    import numpy as np

    xs = [0.0078125, -0.0078125, 0.0234375, 1.0000005, 0.1234565, 2.5, -1e-9, 1 / 3, 175 / 64, 1e6 + 1 / 128]
    wanted = [r["x"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(F.round("x", 6).alias("x")).collect()]
    assert matrix.blocks_.rounded(np.array(xs), 6).tolist() == wanted


@pytest.mark.parametrize("blocks, k", [(1, 2), (7, 2), (4, 3), (40, 1)])
def test_cores_and_tree_of_blocks_equal_those_of_the_matrix(spark, blocks, k):
    specs = {"HEX": matrix.Spec("hex_bit", (2.0,), 0.5), "TAGS": matrix.Spec("ie_list", (0.5,))}
    prof = profiles_of(spark, 60)
    odd = prof.where("mac = 7 AND field = 'TAGS'").select(F.lit("HEX").alias("field"), F.expr("array(named_struct('v', '0x', 'n', 1L))").alias("values"))
    more = [prof.where("mac < 20").withColumn("mac", 500 - 7 * F.col("mac")), odd.select(F.explode(F.array(*[F.lit(m).cast("long") for m in (90, 3000, 4000)])).alias("mac"), "field", "values")]
    for x in more:
        prof = prof.unionByName(x)
    members = matrix.representatives(prof, specs)
    few = matrix.of_representatives(prof, members)
    small = matrix.mac_distances(few, specs, places=6).select(F.lit("s").alias("scenario"), "i", "j", "distance")
    named = members.select(F.lit("s").alias("scenario"), "mac", "first")
    core = density.grouped_core_distances(small, named, k)
    times = members.groupBy(F.col("first").alias("key")).agg(F.count("*").alias("times"))
    groups = matrix.whole_profiles(few, specs).withColumnRenamed("mac", "key").join(times, "key")
    own = density.profile_core_distances(groups, specs, k, 6, blocks)
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=repr)
    assert rows(members.join(own.withColumnRenamed("key", "first"), "first"), "mac", "core") == rows(core, "mac", "core")
    edges = density.profile_edges(groups.join(own, "key"), members, specs, 6, blocks)
    tree = lambda e: rows(density.spanning_tree(e), "i", "j", "weight")
    found = tree(edges.select(F.lit("s").alias("scenario"), "i", "j", "weight"))
    assert found == tree(density.grouped_reach_edges(small, named, core)) and len(found) == members.count() - 1
