"""The capture path: field access, types, merging, labels, readers, the stream; quirks that are kept or settled."""

import json

import pytest
from pyspark.sql import functions as F

from etherloom.functions import distance as D
from etherloom.operators import fieldstats, matrix, observe, ordering, validate
from etherloom.sources import config, reports
from etherloom.sources.captures import SCHEMA, read_captures
from etherloom.streaming.joint import windowed_joint_counts
from etherloom.streaming.merge import merge_stream


def requests_of(spark, *data, time=("1",)):
    rows = [{"MAC": "m", "LABEL": "d", "PROBE_REQs": [{"TIME": list(time), "RSSI": ["-40"] * len(time), "DATA": x} for x in data]}]
    text = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string")
    parsed = text.select(F.from_json("j", "MAC string, LABEL string, PROBE_REQs array<struct<TIME:array<string>,RSSI:array<string>,DATA:variant>>").alias("x")).select("x.*")
    return observe.probe_requests(parsed)


def values(requests, field, objects=True):
    return [r["v"] for r in requests.orderBy("pr_ord").select(observe.field_value(field, objects).alias("v")).collect()]


def test_values_by_type(spark):
    r = requests_of(spark, {"A": "[x", "B": True, "C": [1, None, "q", False], "D": {"z": None, "a": [1]}, "E": None, "F": "", "G": [], "H": {}, "I": "{y", "J": 7, "o": {"b'c": "v"}})
    wanted = {"A": "[x", "B": "True", "C": "[1,None,q,False]", "D": "{a:[1],z:None}", "E": "NULL", "F": "", "G": "[]", "H": "{}", "I": "{y", "J": "7", "K": "NULL", "o.b'c": "v"}
    assert {f: values(r, f)[0] for f in wanted} == wanted
    assert values(r, "D", objects=False) == ['{"a":[1],"z":null}']


def test_paths_from_the_root(spark):
    r = requests_of(spark, {"O": {"P": "x"}, "TIME": "inner", "DATA": {"Q": "deep"}}, time=("1", "2"))
    wanted = {"O.P": "x", "DATA.O.P": "x", "TIME": "[1,2]", "RSSI": "[-40,-40]", "DATA.TIME": "inner", "DATA.DATA.Q": "deep", "DATA.Q": "NULL", "": "NULL", "TIME.x": "NULL"}
    assert {f: values(r, f)[0] for f in wanted} == wanted


def test_merge_of_equal_addresses(spark):
    pr = lambda d, *t: {"TIME": list(t), "RSSI": ["-1"] * len(t), "DATA": d}
    rows = [
        (0, {"MAC": "m", "LABEL": None, "PROBE_REQs": [pr({"a": 1, "b": 2}, "3"), pr({"c": 1}, "4")]}), (1, {"MAC": "m", "LABEL": "first", "PROBE_REQs": [pr({"b": 2, "a": 1}, "5", "6")]}),
        (2, {"MAC": "m", "LABEL": "last", "PROBE_REQs": []}), (3, {"MAC": None, "LABEL": "x", "PROBE_REQs": [pr({}, "1")]}), (4, {"MAC": "n", "LABEL": "", "PROBE_REQs": [pr({"a": 1}, )]}),
    ]
    caps = spark.createDataFrame([(i, json.dumps(r)) for i, r in rows], "ord long, j string").select("ord", F.from_json("j", SCHEMA).alias("x")).select("ord", "x.*")
    merged = observe.merge_requests(observe.probe_requests(caps, "ord"))
    got = {(r["mac"], r["cap"], r["pr_ord"]): (r["label"], r["time"], r["n_frames"]) for r in merged.collect()}
    assert got == {("m", 0, 0): ("first", ["3", "5", "6"], 3), ("m", 0, 1): ("first", ["4"], 1), ("n", 4, 0): ("", [], 0)}
    assert {tuple(r) for r in observe.mac_labels(caps, "ord").collect()} == {("m", "last")}  # the last, null and empty ones left out
    assert {r["device"] for r in observe.devices(caps).collect()} == {"m", "first", "last", "x", ""}


def test_reader_of_folders_patterns_and_files(spark, tmp_path):
    (tmp_path / "data_devA_dataset").mkdir()
    row = {"MAC": "m1", "PROBE_REQs": [{"TIME": ["1"], "RSSI": ["-1"], "DATA": {"X": "1"}}]}
    (tmp_path / "data_devA_dataset" / "a.1.json").write_text(json.dumps([row, {**row, "LABEL": "own"}]))
    (tmp_path / "b.json").write_text(json.dumps(row))
    (tmp_path / "c.txt").write_text(json.dumps(row))
    (tmp_path / "d.json").write_text("[{")
    at = str(tmp_path)
    assert read_captures(spark, at).count() == 3
    assert read_captures(spark, f"{at}/*.json").count() == 1 and read_captures(spark, f"{at}/b.json").count() == 1
    found = read_captures(spark, at, "folder").orderBy("place").select("LABEL", observe.folder_device(F.col("file")).alias("d")).collect()
    assert [tuple(r) for r in found] == [(tmp_path.name, None), ("data_devA_dataset",) * 2, ("data_devA_dataset",) * 2] or [tuple(r) for r in found] == [("data_devA_dataset",) * 2, ("data_devA_dataset",) * 2, (tmp_path.name, None)]
    assert {r["LABEL"] for r in read_captures(spark, at, "file").collect()} == {"a.1", "b"}
    assert observe.file_frames(read_captures(spark, at)).where("file IS NULL").first()["n_frames"] == 3


def test_configuration(spark, tmp_path):
    (tmp_path / "f.yaml").write_text("name: best\ndescription: \"x\"\n\nactive_fields:\n  - HT_CAP # note\n  - DATA_RTS.SUPP\n")
    assert config.read_fields(spark, str(tmp_path / "f.yaml")) == ["HT_CAP", "DATA_RTS.SUPP"]
    assert config._plain((tmp_path / "f.yaml").read_text().splitlines())["active_fields"] == ["HT_CAP", "DATA_RTS.SUPP"]
    for bad in ([], {}, {"active_fields": "x"}, {"active_fields": [" ", None]}):
        with pytest.raises(ValueError):
            config.active_fields(bad)
    (tmp_path / "w.json").write_text(json.dumps([{"name": "a", "weights": {"HT_CAP": 0.5, "TAG_LIST": 0}}, {"name": "b", "weights": {}}]))
    assert {r["scenario"]: r["weights"] for r in config.read_scenarios(spark, str(tmp_path / "w.json")).collect()} == {"a": {"HT_CAP": 0.5, "TAG_LIST": 0.0}, "b": {}}
    assert config.read_scenarios(spark).first()["weights"] == {}


def test_registry():
    specs = matrix.registry({"HT_CAP": 0.5, "EXT_TAG_weight1": 0.0, "EXT_TAG_weight2": 2.0, "RSSI_TIME_weight4": -1.0})
    assert len(specs) == 15 and specs["HT_CAP"].effective_penalty() == 0.5 and specs["HT_CAP"].effective_penalty(scaled=False) == 1.0
    assert specs["EXT_TAG"].effective_weight() == 1.5 and specs["RSSI_TIME"].effective_weight() == 1.0
    assert matrix.Spec("vendor_spec", (0.0, 0.0, 0.0)).effective_weight() == 0.0


def test_odd_payloads_take_the_penalty(spark):
    v = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    for a, b in (("0x", "0x"), ("0xzz", "0x00"), ("0x0f", "0xz0"), ("", ""), ("0x0f", "0f00")):
        assert v(D.hex_bit(F.lit(a), F.lit(b), 0.25)) == 0.25
        assert v(D.bit_share(F.lit("0x"), F.lit(b))) == 1.0


def test_fields_may_be_negative_the_sum_not(spark):
    rows = [("a", '{"1":"0x0f"}'), ("b", '{"1":"0x0f"}')]
    obs = spark.createDataFrame([(m, 0, "EXT_TAG", v) for m, v in rows], "mac string, pr_ord int, field string, value string")
    prof, specs = matrix.profiles(obs), matrix.registry()
    units = {(r["i"], r["j"]): r["unit"] for r in matrix.unit_distances(prof, {"EXT_TAG": specs["EXT_TAG"]}).collect()}
    assert units == {("a", "a"): -1.0, ("a", "b"): -1.0, ("b", "b"): -1.0}
    assert {r["distance"] for r in matrix.mac_distances(prof, {"EXT_TAG": specs["EXT_TAG"]}).collect()} == {0.0}


def test_blocks_do_not_change_a_matrix(spark):
    rows = [(f"m{i:02}", 0, "H", f"0x{i * 37 % 256:02x}" if i % 4 else "NULL") for i in range(30)]
    prof = matrix.profiles(spark.createDataFrame(rows, "mac string, pr_ord int, field string, value string"))
    of = lambda n: sorted(map(tuple, matrix.unit_distances(prof, {"H": "hex_bit"}, blocks=n).collect()))
    assert of(1) == of(4) == of(None) and len(of(4)) == 30 * 31 // 2


def test_validation_at_the_edges(spark):
    members = lambda rows: spark.createDataFrame(rows, "mac string, cluster int")
    labels = spark.createDataFrame([("a", "x"), ("b", "y")], "mac string, label string")
    none, one, apart = (validate.contingency(members(r), labels) for r in ([], [("a", 0)], [("a", 0), ("b", 1)]))
    zero = {"tp": 0, "fp": 0, "fn": 0, "p": 0.0, "r": 0.0, "f1": 0.0}
    for ck in (none, one, apart):
        assert validate.pairwise(ck).first().asDict() == zero
    assert str(validate.adjusted_rand(none).first()["ari"]) == "nan" and validate.adjusted_rand(one).first()["ari"] == 1.0 == validate.adjusted_rand(apart).first()["ari"]
    assert validate.purity_summary(none).first().asDict() == {"n_clusters": 0, "macro_purity": 0.0, "weighted_purity": 0.0, "n_pure": 0, "pure_share": 0.0}
    v = validate.v_measure(none).first()
    assert str(v["v"]) == str(v["homogeneity"]) == "nan" and (v["vi"], v["n"], v["n_classes"]) == (0.0, 0, 0)
    assert validate.bcubed(none).first().asDict() == {"p": 0.0, "r": 0.0, "f1": 0.0}
    assert {r["macro"] for r in validate.best_match_summary(none).collect()} == {0.0}
    assert validate.majority_accuracy(none).first().asDict() == {"correct": 0, "incorrect": 0, "total": 0, "accuracy": 0.0}
    assert str(validate.adjusted_mutual_information(none).first()["ami"]) == "nan" and validate.adjusted_mutual_information(one).first()["ami"] == 1.0
    assert validate.fragmentation_summary(none, labels).first()["detected_share"] == 0.0
    assert validate.external(apart).first()["nmi"] == 1.0


def test_statistics_without_frames(spark):
    joint = spark.createDataFrame([("f", "d", "v", 0)], "field string, device string, value string, n long")
    devices = spark.createDataFrame([("d",), ("e",)], "device string")
    assert fieldstats.distribution(joint).count() == 0 and fieldstats.top_and_other(joint).count() == 0
    assert {r["stability"] for r in fieldstats.stability_by_device(joint, devices).collect()} == {1.0}
    assert fieldstats.value_devices(joint).first()["k"] == 1
    assert {r["device"]: r["n"] for r in observe.device_joint(joint, devices).collect()} == {"d": 0, "e": 0}


def test_labels_in_short(spark):
    row = spark.createDataFrame([("data_devA_dataset", "plain")], "a string, b string").select(
        fieldstats.short_label(F.col("a")).alias("p"), fieldstats.short_label(F.col("b")).alias("q"), observe.table_label(F.col("a")).alias("r"), observe.table_label(F.col("b")).alias("s"),
        fieldstats.abbreviated(F.lit("0123456789abcdef")).alias("t"), fieldstats.abbreviated(F.lit("0123456789abcdefg")).alias("u"),
    ).first()
    assert tuple(row) == ("A", None, "devA", "plain", "0123456789abcdef", "01234567...defg")
    many = spark.createDataFrame([("f", f"d{i}", "v", 1) for i in range(9)], "field string, device string, value string, n long")
    assert sorted(map(tuple, fieldstats.value_labels(many, most=4).collect())) == [("f", "v", 0, "d0, d1, d2, d3", 9), ("f", "v", 1, "d4, d5, d6, d7", 9), ("f", "v", 2, "d8", 9)]
    assert [tuple(r) for r in fieldstats.value_labels(many, F.lit(None).cast("string")).collect()] == [("f", "v", 0, "", 0)]


def test_stream_of_joint_counts(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "f", "d", "v", 2), ("2024-01-01 00:50:00", "f", "d", "v", 3), ("2024-01-01 01:10:00", "f", "d", "v", 5), ("2024-01-01 05:00:00", "f", "e", "w", 1)]
    schema = "ts timestamp, field string, device string, value string, n_frames int"
    spark.createDataFrame(rows, "t string, field string, device string, value string, n_frames int").selectExpr("cast(t as timestamp) AS ts", "field", "device", "value", "n_frames").write.parquet(str(tmp_path / "in"))
    stream = windowed_joint_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    late = spark.createDataFrame([("2024-01-01 00:30:00", "f", "d", "v", 100), ("2024-01-01 09:00:00", "f", "e", "w", 1)], "t string, field string, device string, value string, n_frames int")
    late.selectExpr("cast(t as timestamp) AS ts", "field", "device", "value", "n_frames").write.mode("append").parquet(str(tmp_path / "in"))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    found = {(r["window"]["start"].hour, r["device"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {(0, "d"): 5, (1, "d"): 5, (5, "e"): 1}  # what is older than the watermark is not counted again


def test_reports(spark, tmp_path):
    stats = spark.createDataFrame([("s", 2, 0.12345678), ("t", 3, None)], "scenario string, n int, mean double")
    lines = reports.report_lines({"matrix": stats, "weights": spark.sql("SELECT 's' AS scenario, map('A', 1.0D) AS weights")})
    reports.write_report(lines, str(tmp_path / "r"))
    read = lambda s: [x for p in (tmp_path / "r" / f"scenario={s}").glob("part*") for x in p.read_text().splitlines()]
    assert read("s") == ["[matrix] n: 2, mean: 0.123457", '[weights] weights: {"A":1.0}'] and read("t") == ["[matrix] n: 3, mean: -"]
    reports.write_lines(stats.select("n", "scenario").repartition(3), str(tmp_path / "l"), by="n")
    assert [x for p in sorted((tmp_path / "l").glob("part*")) for x in p.read_text().splitlines()] == ["2: s", "3: t"]
    reports.write_paths(observe.key_paths(requests_of(spark, {"b": [{"c": 1}], "a": {"d": {"e": 2}}})), str(tmp_path / "k"))
    assert [x for p in sorted((tmp_path / "k").glob("part*")) for x in p.read_text().splitlines()] == ["a", "a.d", "a.d.e", "b", "b.c"]


def test_key_paths_of_twelve_levels(spark):
    deep = value = {}
    for k in range(11):
        value[f"k{k}"] = [{"x": None}, {}] if k % 2 else {}
        value = value[f"k{k}"][1] if k % 2 else value[f"k{k}"]
    value["end"] = 1
    found = {r["path"] for r in observe.key_paths(requests_of(spark, deep)).collect()}
    names = [f"k{k}" for k in range(11)]
    wanted = {".".join(names[: k + 1]) for k in range(11)} | {".".join(names[: k + 1]) + ".x" for k in range(1, 11, 2)} | {".".join(names) + ".end"}
    assert found == wanted


def test_last_label_of_one_place_and_numbers_in_many_tasks(spark):
    rows = [("M", "b", 3), ("M", "c", 3), ("M", "a", 3), ("M", "z", 2)]
    assert observe.mac_labels(spark.createDataFrame(rows, "MAC string, LABEL string, cap long"), "cap").first()["label"] == "c"
    draw = __import__("random").Random(2)
    values = draw.sample(range(10**6), 5000)
    found = ordering.numbered(spark.createDataFrame([(v, "x") for v in values], "v long, n string").repartition(7), ["v"], "at").collect()
    assert {r["v"]: r["at"] for r in found} == {v: k for k, v in enumerate(sorted(values))}
    assert ordering.numbered(spark.createDataFrame([], "v long"), ["v"], "at").collect() == []


def test_merging_over_a_stream_equals_the_batch(spark, tmp_path):
    """Three batches out of order, labels that come late or never, requests without frames or content; the last row ends every address."""
    day = lambda d: f"2024-01-{d:02d} 12:00:00"
    batches = [
        [("m", None, 2, 0, ["3"], ["-1"], '{"a":1}', day(2)), ("m", "late", 2, 1, ["4"], ["-2"], '{"b":1}', day(2)), (None, "x", 1, 0, ["1"], ["-1"], None, day(2))],
        [("m", "first", 1, 3, ["1", "2"], ["-3", None], '{"a":1}', day(1)), ("n", None, 1, 0, None, None, None, day(2)), ("n", None, 1, 1, [], [], "", day(3))],
        [("m", None, 3, 0, ["9"], ["-9"], '{"a":1}', day(4)), ("n", None, 0, 7, ["0"], ["-7"], '{"a":1}', day(3))],
    ]
    schema = "mac string, label string, cap long, pr_ord int, time array<string>, rssi array<string>, content string, at string"
    frames = [spark.createDataFrame(b, schema).select("*", F.to_timestamp("at").alias("ts")).drop("at") for b in batches]
    end = spark.createDataFrame([("end", None, 9, 0, [], [], "", "2025-01-01 00:00:00")], schema).select("*", F.to_timestamp("at").alias("ts")).drop("at")
    for k, frame in enumerate([*frames, end]):
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = merge_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), quiet="5 days", late="3 days")
        sink = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["mac"] != "end"]
    whole = frames[0].union(frames[1]).union(frames[2]).withColumn("data", F.try_parse_json(F.nullif("content", F.lit(""))))
    wanted = observe.merge_requests(whole).select("mac", "label", "device", "cap", "pr_ord", "n_frames", "time", "rssi", F.coalesce(F.to_json("data"), F.lit("")).alias("content"))
    key = lambda r: (r["mac"], r["content"])
    assert [tuple(r) for r in sorted(found, key=key)] == [tuple(r) for r in sorted(wanted.collect(), key=key)] and len(found) == 4


def test_an_address_that_comes_back_is_merged_anew_whatever_the_batches(spark, tmp_path):
    """Requests further apart than ``quiet`` are two rows, in one batch as in two; a null and an empty content are one."""
    row = lambda d, cap, label, content: ("m", label, cap, 0, [str(cap)], None, content, f"2024-01-{d:02d} 12:00:00")
    parts = [row(1, 1, None, None), row(3, 2, "a", ""), row(20, 3, "b", "")]
    schema = "mac string, label string, cap long, pr_ord int, time array<string>, rssi array<string>, content string, at string"
    end = ("end", None, 9, 0, [], [], "", "2025-01-01 00:00:00")
    for name, batches in (("one", [parts, [end]]), ("two", [parts[:2], parts[2:], [end]])):
        for batch in batches:
            frame = spark.createDataFrame(batch, schema).select("*", F.to_timestamp("at").alias("ts")).drop("at")
            frame.coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
            stream = merge_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / name / "in")), quiet="5 days", late="30 days")
            sink = stream.writeStream.format("parquet").option("path", str(tmp_path / name / "out")).option("checkpointLocation", str(tmp_path / name / "state"))
            sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        found = spark.read.parquet(str(tmp_path / name / "out")).where("mac = 'm'").orderBy("cap").collect()
        assert [(r["label"], r["cap"], r["n_frames"], r["time"], r["rssi"]) for r in found] == [("a", 1, 2, ["1", "2"], []), ("b", 3, 1, ["3"], [])]
