"""Values worked by hand from the formulas (FIXTURES.md, g1 and g2)."""

import json

import pytest

from etherloom.operators import fieldstats, observe, validate
from etherloom.sources.captures import read_captures


def _pr(value, frames):
    data = {} if value is None else {"HT_CAP": value}
    return {"TIME": [str(i) for i in range(frames)], "RSSI": ["-40"] * frames, "DATA": data}


@pytest.fixture(scope="module")
def g1(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("captures")
    rows = [
        {"MAC": "m1", "LABEL": "A", "PROBE_REQs": [_pr("0x0f", 3), _pr("0xff", 1)]},
        {"MAC": "m2", "LABEL": "A", "PROBE_REQs": [_pr("0x0f", 2)]},
        {"MAC": "m3", "LABEL": "B", "PROBE_REQs": [_pr("0xff", 4)]},
        {"MAC": "m4", "LABEL": "C", "PROBE_REQs": [_pr(None, 2)]},
    ]
    (d / "a.json").write_text(json.dumps(rows))
    (d / "deep").mkdir()
    (d / "deep" / "b.json").write_text(json.dumps({"MAC": "m5", "LABEL": "D", "PROBE_REQs": []}))
    (d / "bad.json").write_text("{not json")
    captures = read_captures(spark, str(d))
    requests = observe.probe_requests(captures)
    return captures, observe.joint_counts(observe.observations(requests, ["HT_CAP"]))


def test_g1(g1):
    captures, joint = g1
    assert captures.count() == 5
    info = fieldstats.information(joint).first()
    assert info["h_value"] == pytest.approx(1.4833557549816874)
    assert info["h_device"] == pytest.approx(1.4591479170272448)
    assert info["h_value_given_device"] == pytest.approx(0.32501121082417694)
    assert info["nmi"] == pytest.approx(0.7938499795945515)
    devices = captures.selectExpr("coalesce(LABEL, MAC) AS device")
    assert fieldstats.stability(joint, devices).first()["stability"] == pytest.approx(0.9583333333333)
    assert fieldstats.uniqueness(joint).first()["score"] == pytest.approx(0.8333333333)
    hit = fieldstats.affected_devices(joint, devices).first()
    assert (hit["n_devices"], hit["percent"]) == (2, 50.0)
    k = {r["value"]: r["k"] for r in fieldstats.value_devices(joint).collect()}
    assert k == {"0x0f": 1, "0xff": 2, "NULL": 1}


def test_g2(spark):
    clusters = spark.createDataFrame([("m1", 0), ("m2", 0), ("m3", 0), ("m4", 1), ("m5", 1), ("m6", -1)], "mac string, cluster int")
    labels = spark.createDataFrame([("m1", "A"), ("m2", "A"), ("m6", "A"), ("m3", "B"), ("m4", "B"), ("m5", "B"), ("m7", "C")], "mac string, label string")
    ck = validate.contingency(clusters, labels)
    p = validate.pairwise(ck).first()
    assert (p["tp"], p["fp"], p["fn"]) == (2, 2, 2)
    assert validate.bcubed(ck).first()["f1"] == pytest.approx(0.7333333, abs=1e-6)
    v = validate.v_measure(ck).first()
    assert (v["v"], v["vi"]) == (pytest.approx(0.4325380678), pytest.approx(0.7638170020))
    assert validate.adjusted_rand(ck).first()["ari"] == pytest.approx(0.1666667, abs=1e-6)
    assert validate.purity_summary(ck).first()["weighted_purity"] == pytest.approx(0.8)
    noisy = validate.contingency(clusters, labels, noise=True)
    assert validate.v_measure(noisy).first()["vi"] == pytest.approx(0.9547712524)
    assert [r["mac"] for r in validate.missing_labelled(clusters, labels).collect()] == ["m7"]
