"""The search of nearest neighbours against the whole matrix."""

import random

import pytest
from pyspark.sql import functions as F

from etherloom.operators import density, matrix, neighbours


@pytest.fixture(scope="module")
def prof(spark):
    draw, rows = random.Random(4), []
    for mac in range(260):
        base = draw.choice((0x0000, 0x0F0F, 0xFF00, 0xABCD))
        values = [f"0x{base ^ (1 << draw.randrange(16)) ^ (1 << draw.randrange(16)):04x}" for _ in range(draw.choice((1, 1, 2)))]
        if mac % 23 == 0:
            values = draw.choice((["0x"], ["0xZZ"], ["0x00ff00"], ["0x1", "0x1234"]))
        hexed = [] if mac % 11 == 0 else values
        rates = [] if mac % 13 == 0 else draw.sample("123456789", draw.choice((1, 3, 4)))
        rows += [(mac, "HEX", v) for v in hexed] + [(mac, "RATES", v) for v in rates] + [(mac, "TAGS", v) for v in draw.choices("ab", k=3)]
    same = [(mac + 1000, f, v) for mac, f, v in rows if mac % 40 == 1]
    counted = spark.createDataFrame(rows + same, "mac long, field string, v string").groupBy("mac", "field", "v").agg(F.count("*").alias("n"))
    return counted.groupBy("mac", "field").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("values"))


SPECS = {"HEX": matrix.Spec("hex_bit", (2.0,), 0.75), "RATES": matrix.Spec("data_rates", (0.5,), 1.0)}


@pytest.mark.parametrize("k, block", [(2, 2000), (1, 7), (5, 2000)])
def test_cores_equal_those_of_the_matrix(spark, prof, monkeypatch, k, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    for specs in (SPECS, {**SPECS, "TAGS": matrix.Spec("ie_list", (0.25,))}) if k == 2 else (SPECS,):
        # an address without a field has an empty profile in the matrix
        empty = prof.select("mac").distinct().crossJoin(spark.createDataFrame([(f,) for f in specs], "field string")).join(prof, ["mac", "field"], "left")
        full = empty.withColumn("values", F.coalesce("values", F.array().cast("array<struct<v:string,n:bigint>>")))
        wanted = density.core_distances(matrix.mac_distances(full, specs).withColumn("scenario", F.lit("x")), k)
        wanted = {r["mac"]: round(r["core"], 9) for r in wanted.collect()}
        found = neighbours.core_distances(full, specs, k).collect()
        assert {r["mac"]: round(r["core"], 9) for r in found} == wanted and len(found) == len(wanted)
        if "TAGS" not in specs and k == 2:
            assert sum(r["n_compared"] for r in found) < 0.6 * len(found) ** 2  # far from all pairs


def test_kinds_without_a_bound_and_few_addresses(spark, prof):
    few = prof.where("mac in (1, 2)")
    assert {r["core"] for r in neighbours.core_distances(few, SPECS, 3).collect()} == {None}
    specs = {"HEX": matrix.Spec("hex_bit", (-1.0,)), "RATES": matrix.Spec("data_rates", (2.0,))}
    small = prof.where("mac < 30 AND mac % 11 > 0 AND mac % 13 > 0")
    wanted = density.core_distances(matrix.mac_distances(small, specs).withColumn("scenario", F.lit("x")))
    assert {(r["mac"], r["core"]) for r in neighbours.core_distances(small, specs).collect()} == {(r["mac"], r["core"]) for r in wanted.collect()}
    assert neighbours.core_distances(prof.where("false"), SPECS).collect() == []


def test_near_profiles_are_not_compared_with_most_others(spark):
    """Bits without clusters, which pivots tell little about: all 12-bit numbers, each a bit from twelve others."""
    one = F.array(F.struct(F.concat(F.lit("0x"), F.lpad(F.hex("id"), 3, "0")).alias("v"), F.lit(1).cast("long").alias("n")))
    prof = spark.range(4096).select(F.col("id").alias("mac"), F.lit("HEX").alias("field"), one.alias("values"))
    found = neighbours.core_distances(prof, {"HEX": matrix.Spec("hex_bit", (1.0,))}).agg(F.count("*").alias("n"), F.min("core").alias("a"), F.max("core").alias("b"), F.max("n_compared").alias("m")).first()
    assert (found["n"], found["a"], found["b"]) == (4096, 1 / 12, 1 / 12)
    assert found["m"] <= 1 + 2 * 64  # itself, and who shares one of two classes of six bits
