"""Distances against values worked by hand (FIXTURES.md, g1 to g3), sinks by reading them back."""

import pytest
from pyspark.sql import functions as F

from etherloom.functions import distance as D
from etherloom.operators import matrix, validate
from etherloom.sources import reports


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def strings(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


def mapped(d):
    entries = [x for k, v in d.items() for x in (F.lit(k), mapped(v) if isinstance(v, dict) else F.lit(v))]
    return F.create_map(*entries)


def test_scalar_distances(spark):
    v = lambda c: value(spark, c)
    assert v(D.hex_bit(F.lit("0x0f"), F.lit("0xff"))) == 0.5
    assert v(D.hex_bit(F.lit("0x0f"), F.lit("0x00ff"))) == v(D.hex_bit(F.lit("0f"), F.lit("0f"))) == 1.0
    assert v(D.data_rates(strings("a", "b"), strings("b", "c"))) == 2.0
    assert v(D.data_rates(strings(), strings())) == 0.0
    assert v(D.ie_list(strings("x", "x", "y"), strings("x", "y", "y"))) == 3.0
    assert v(D.ie_list(strings("x", "y"), strings("y", "x"))) == 1.0
    assert v(D.ie_list(strings(), strings("y"))) == 2.0
    assert v(D.ext_tag(mapped({"1": "0x0f"}), mapped({"1": "0xff", "2": "0x00"}))) == 0.5
    assert v(D.vendor_spec(mapped({"o": {"1": "0x0f"}}), mapped({"o": {"1": "0xff"}}))) == 0.5
    numbers = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    assert v(D.rssi_time(numbers(-40), numbers(10), numbers(-40), numbers(10.5), 1, 1, 1, 1)) == 1.0


def test_long_hex_and_lcs_against_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = []
    for _ in range(40):
        n = rng.randint(1, 52)
        rows.append(("".join(rng.choices("0123456789abcdef", k=n)), "".join(rng.choices("0123456789abcdef", k=n)),
                     rng.choices("abc", k=rng.randint(0, 7)), rng.choices("abc", k=rng.randint(0, 7))))

    def longest(a, b):
        return 0 if not a or not b else longest(a[:-1], b[:-1]) + 1 if a[-1] == b[-1] else max(longest(a[:-1], b), longest(a, b[:-1]))

    df = spark.createDataFrame(rows, "a string, b string, x array<string>, y array<string>")
    for r in df.select("*", D.hamming(F.col("a"), F.col("b")).alias("h"), D.lcs(F.col("x"), F.col("y")).alias("l")).collect():
        assert r["h"] == (int(r["a"], 16) ^ int(r["b"], 16)).bit_count()
        assert r["l"] == longest(r["x"], r["y"])


def test_g1_matrix(spark):
    rows = [("m1", 0, "0x0f"), ("m1", 1, "0xff"), ("m2", 0, "0x0f"), ("m3", 0, "0xff"), ("m4", 0, "NULL")]
    obs = spark.createDataFrame(rows, "mac string, pr_ord int, value string").withColumn("field", F.lit("HT_CAP"))
    units = matrix.unit_distances(matrix.profiles(obs), {"HT_CAP": "hex_bit"}, blocks=3)
    d = {(r["i"], r["j"]): r["unit"] for r in units.collect()}
    assert len(d) == 10
    wanted = {("m1", "m2"): 0.25, ("m1", "m1"): 0.25, ("m1", "m3"): 0.25, ("m2", "m3"): 0.5, ("m1", "m4"): 1.0, ("m4", "m4"): 0.0}
    assert {k: d[k] for k in wanted} == wanted
    with pytest.raises(ValueError):
        matrix.unit_distances(matrix.profiles(obs), {"HT_CAP": "other"})
    assert matrix.unit_distances(matrix.profiles(obs.limit(0)), {"HT_CAP": "hex_bit"}).count() == 0


def test_g2_ami(spark):
    clusters = spark.createDataFrame([("m1", 0), ("m2", 0), ("m3", 0), ("m4", 1), ("m5", 1)], "mac string, cluster int")
    labels = spark.createDataFrame([("m1", "A"), ("m2", "A"), ("m3", "B"), ("m4", "B"), ("m5", "B")], "mac string, label string")
    found = validate.adjusted_mutual_information(validate.contingency(clusters, labels)).first()
    assert found["emi"] == pytest.approx(0.1629386927956707, abs=1e-12)
    assert found["ami"] == pytest.approx(0.2512669357, abs=1e-9)


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("s", "a", "x, y")], "scenario string, value string, labels string").coalesce(1)
    reports.write_value_labels(rows, str(tmp_path / "csv"))
    assert [p.read_text() for p in (tmp_path / "csv").glob("part*")] == ["Value;Labels\na;x, y\n"]
    reports.write_lines(rows.select("value", "labels"), str(tmp_path / "txt"))
    assert [p.read_text() for p in (tmp_path / "txt").glob("part*")] == ["a: x, y\n"]
    reports.write_by_scenario(rows, str(tmp_path / "json"))
    assert (tmp_path / "json" / "scenario=s").is_dir()
