"""Guards, stored tables and sources in their odd cases."""

import hashlib
import ipaddress
import json

import pytest
from pyspark.sql import functions as F

from flowscope.functions.parsing import to_ip
from flowscope.operators import contracts, evaluate as E, models, rules, sinks, studies, windows
from flowscope.plans.flows import flows_from_events
from flowscope.schemas import FLOW_FEATURES
from flowscope.sources import binetflow, lines, records, stored, zeek


@pytest.fixture(scope="module")
def flows(spark):
    return flows_from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).drop("k").cache()


@pytest.fixture(scope="module")
def features(spark, flows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("f") / "features")
    sinks.write_features(windows.features(flows, "1.0.0"), path)
    return path


def test_lines_of_split_files_are_numbered(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("".join(f"{k}-{i}\r\n" for i in range(1, 3001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = lines.numbered_lines(spark, str(tmp_path))
        got = {(r.file[-5], r.line_no, r.value) for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(str(k), i, f"{k}-{i}") for k in range(3) for i in range(1, 3001)}


def test_text_that_is_not_utf8(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes((",".join(binetflow.FIELDS) + "\n").encode() + b"2011/08/10 09:46:59.6,1,tcp,\xff\xfe,1,->,b,80,CON,0,0,1,60,60,flow=Background\n")
    _, issues, _ = binetflow.parse(spark, str(tmp_path), "s", "2024-01-01 00:00:00")
    assert [r.issue_type for r in issues.collect()] == ["invalid_encoding"]
    with pytest.raises(ValueError, match="invalid_encoding: 1"):
        binetflow.parse(spark, str(tmp_path), "s", "2024-01-01 00:00:00", fail_on_rejects=True)
    with pytest.raises(Exception, match="not UTF-8"):
        binetflow.parse(spark, str(tmp_path), "s", "2024-01-01 00:00:00", strict_text=True)[0].collect()


def test_digests_of_small_and_streamed_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 10)
    (tmp_path / "b").write_bytes(b"y" * 3_000_000)
    got = {r.file[-1]: (r.size_bytes, r.sha256) for r in lines.file_digests(spark, str(tmp_path), whole_bytes=100).collect()}
    assert got == {"a": (10, hashlib.sha256(b"x" * 10).hexdigest()), "b": (3_000_000, hashlib.sha256(b"y" * 3_000_000).hexdigest())}
    assert lines.source_url("https://example.org/sets/", "cap-1", "x.txt") == "https://example.org/sets/cap-1/detailed-bidirectional-flow-labels/x.txt"


def test_zeek_repeated_names_take_the_last(spark, tmp_path):
    (tmp_path / "conn.log").write_text("#separator \\x09\n#fields\tts\tuid\tproto\tproto\n1.5\tC1\ttcp\tudp\n")
    events, issues, rows = zeek.parse(spark, str(tmp_path), "z", "2024-01-01 00:00:00")
    assert [(r.protocol, r.source_event_id) for r in events.collect()] == [("udp", "C1")] and issues.isEmpty()
    assert zeek.source_labels(rows).isEmpty()


def test_stored_features_are_pruned_and_guarded(spark, features, tmp_path):
    rows = stored.features(spark, features, "1.0.0", ["cap-0"])
    plan = rows.select("event_id", "dst_port_dns")._jdf.queryExecution().executedPlan().toString()
    assert "log_total_bytes" not in plan and "PartitionFilters" in plan
    assert {r[0] for r in rows.select("scenario_id").distinct().collect()} == {"cap-0"}
    with pytest.raises(ValueError, match="sealed"):
        stored.features(spark, features, "1.0.0", ["cap-0"], sealed=("cap-0",))
    with pytest.raises(FileNotFoundError):
        stored.features(spark, features, "1.0.0", ["cap-0"], raw_files={})
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        stored.features(spark, features, "1.0.0", ["cap-0"], raw_files={"cap-0": str(tmp_path / "none")})
    (tmp_path / "raw").write_text("x")
    found = stored.provenance(spark, stored.features(spark, features, "1.0.0", ["cap-0"], raw_files={"cap-0": str(tmp_path / "raw")}), {"cap-0": str(tmp_path / "raw")}).first()
    assert found.source_checksum == hashlib.sha256(b"x").hexdigest() and found.accepted_rows == rows.count() == found.known_rows + found.unknown_rows
    with pytest.raises(Exception, match="sealed scenario"):
        contracts.guard_sealed(rows, ["cap-0"]).collect()


def test_wanted_ids_and_drift(spark, features):
    rows = stored.features(spark, features, "1.0.0")
    some = rows.where("event_id < 50").select("event_id", "scenario_id")
    assert stored.wanted_features(rows, some).count() == some.count()
    with pytest.raises(ValueError):
        stored.wanted_features(rows, some.union(spark.createDataFrame([(-5, "cap-0")], "event_id long, scenario_id string")))
    contracts.guard_drift(rows, rows, FLOW_FEATURES)
    with pytest.raises(ValueError, match="dst_port_dns differs"):
        contracts.guard_drift(rows, rows.withColumn("dst_port_dns", F.col("dst_port_dns") + 1), FLOW_FEATURES)


def test_training_and_score_guards(spark, flows):
    rows = windows.features(flows, "1.0.0")
    with pytest.raises(ValueError, match="both classes"):
        models.fit_and_score(rows.where("ground_truth_label <> 'malicious'"), rows, FLOW_FEATURES, "decision_tree")
    with pytest.raises(ValueError, match="validation"):
        contracts.guard_splits({"train": rows, "validation": rows.limit(0)})
    scores = spark.createDataFrame([(1, "s", "d", "benign", 1.5)], "event_id long, scenario_id string, detector string, label string, score double")
    with pytest.raises(Exception, match="between 0 and 1"):
        E.calibration_scores(scores).collect()
    with pytest.raises(Exception, match="no score"):
        models.labelled_scores(flows, scores.limit(0)).collect()
    low, _ = E.wilson(F.lit(5), F.lit(3))
    with pytest.raises(Exception, match="successes"):
        spark.range(1).select(low).collect()
    with pytest.raises(ValueError):
        E.wilson(F.lit(1), F.lit(3), 1.0)


def test_study_artifacts(spark, tmp_path):
    doc = {"feature_version": "1.1.0", "validation_scenarios": ["a"], "models": {"m": {"scenarios": {"a": {"f1": 0.5, "tp": 3}}}}, "cases": [{"event_id": "1", "scenario_id": "a", "caught_by": ["m"]}]}
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=1))
    held = stored.read_artifact(spark, str(tmp_path))
    assert {tuple(r) for r in stored.study_metrics(held).collect()} == {("m", "a", "f1", 0.5), ("m", "a", "tp", 3.0)}
    assert [r.caught_by for r in stored.study_cases(held, "1.1.0").collect()] == [["m"]]
    for version, sealed in (("1.2.0", ()), ("1.1.0", ("a",))):
        with pytest.raises(ValueError):
            stored.study_cases(held, version, sealed)


SOURCE = {"source_type": "synthetic", "source_dataset": "d", "dataset_version": "1.0.0", "source_event_id": "e1", "raw_payload_reference": "a/b.json", "raw_checksum": None}
PROVENANCE = {"adapter_name": "x", "adapter_version": "1.0.0", "transformation_version": "1.0.0", "processed_at": "2026-09-20T12:00:01Z", "quality_flags": []}
DETAILS = {"kind": "network", "src_ip": "192.0.2.10", "dst_ip": "2001:DB8::1", "src_port": 1, "dst_port": "443", "session_duration_seconds": 1.25, "network_bytes": 80.0, "tunnel_parents": ["a", " b "]}
EVENT = {"schema_version": "1.0.0", "source": SOURCE, "observed_at": "2026-09-20T12:00:00+02:00", "ingested_at": "2026-09-20T12:00:00Z", "event_type": " x ", "session_id": None, "ground_truth_label": "benign", "label_source": "l", "details": DETAILS, "provenance": PROVENANCE}


def without(d, *keys):
    return {k: v for k, v in d.items() if k not in keys}


BAD_EVENTS = [
    ({**EVENT, "observed_at": "2026-09-20T12:00:00"}, "observed_at_without_zone"),
    ({**EVENT, "observed_at": "2026-13-20T12:00:00Z"}, "observed_at_value"),
    ({**EVENT, "details": {**DETAILS, "src_port": 70000}}, "src_port_range"),
    ({**EVENT, "details": {**DETAILS, "dst_port": "abc"}}, "dst_port_type"),
    ({**EVENT, "details": {**DETAILS, "dst_port": 80.5}}, "dst_port_type"),
    ({**EVENT, "details": {**DETAILS, "dst_port": [80]}}, "dst_port_type"),
    ({**EVENT, "details": {**DETAILS, "more": 1}}, "details_unknown_key"),
    ({**EVENT, "details": {**DETAILS, "source_label": "x"}}, "details_unknown_key"),
    ({**EVENT, "details": {**DETAILS, "src_ip": "999.1.1.1"}}, "src_ip_address"),
    ({**EVENT, "details": {**DETAILS, "src_ip": 7}}, "src_ip_type"),
    ({**EVENT, "details": {**DETAILS, "tunnel_parents": ["a", 1]}}, "tunnel_parents_value"),
    ({**EVENT, "details": {**DETAILS, "tunnel_parents": None}}, "tunnel_parents_null"),
    ({**EVENT, "details": {**DETAILS, "network_bytes": -1}}, "network_bytes_range"),
    ({**EVENT, "details": {**DETAILS, "protocol": "  "}}, "protocol_empty"),
    ({**EVENT, "details": without(DETAILS, "kind")}, "kind_missing"),
    ({**EVENT, "details": {"kind": "other"}}, "kind_value"),
    ({**EVENT, "details": {"kind": "command"}}, "command_missing"),
    ({**EVENT, "details": {"kind": "command", "command": "x" * 8193}}, "command_length"),
    ({**EVENT, "details": {"kind": "authentication", "outcome": None}}, "outcome_null"),
    ({**EVENT, "details": {"kind": "ctu13_flow"}}, "source_label_missing"),
    ({**EVENT, "details": "text"}, "details_type"),
    ({**EVENT, "source": {**SOURCE, "more": None}}, "source_unknown_key"),
    ({**EVENT, "source": without(SOURCE, "source_dataset")}, "source_dataset_missing"),
    ({**EVENT, "source": {**SOURCE, "source_event_id": None}}, "source_event_id_null"),
    ({**EVENT, "source": {**SOURCE, "raw_checksum": "ab"}}, "raw_checksum_value"),
    ({**EVENT, "source": {**SOURCE, "source_type": "flow"}}, "source_type_value"),
    (without(EVENT, "source"), "source_missing"),
    (without(EVENT, "provenance"), "provenance_missing"),
    ({**EVENT, "provenance": {**PROVENANCE, "processed_at": "2026-09-20T12:00:01"}}, "processed_at_without_zone"),
    ({**EVENT, "provenance": {**PROVENANCE, "adapter_version": "1"}}, "adapter_version_value"),
    ({**EVENT, "provenance": {**PROVENANCE, "more": 1}}, "provenance_unknown_key"),
    ({**EVENT, "label_source": None}, "known_label_without_source"),
    ({**EVENT, "more": 1}, "unknown_key"),
    ({**EVENT, "event_id": "x"}, "event_id_value"),
    ({**EVENT, "event_id": "00000000-0000-5000-8000-000000000000"}, "event_id_mismatch"),
    ({**EVENT, "ground_truth_label": "unknown", "attack_category": "c"}, "unknown_label_with_category"),
    ({**EVENT, "ground_truth_label": None}, "ground_truth_label_null"),
    ({**EVENT, "event_type": 5}, "event_type_type"),
    ([], "not_json"),
]


def test_canonical_events(spark):
    fine = [EVENT, without(EVENT, "schema_version", "session_id"), {**EVENT, "details": None}, {**EVENT, "details": {"kind": "http", "method": "GET"}}, {**EVENT, "details": {"kind": "generic", "fields": {"a": [1]}}}]
    fine += [{**EVENT, "details": {**DETAILS, "kind": "ctu13_flow", "source_label": "flow=x", "source_tos": 0}}, {**without(EVENT, "ground_truth_label"), "label_source": None}]
    events, _ = records.canonical_events(spark.createDataFrame([(json.dumps(r),) for r in fine], "value string"))
    rows = events.collect()
    assert len(rows) == len(fine) and len({r.event_id for r in rows}) == 1
    e = rows[0]
    assert (e.observed_at.isoformat(), e.event_type, e.src_port, e.dst_port, e.network_bytes, e.dst_ip, e.tunnel_parents, e.quality_flags) == ("2026-09-20T10:00:00", "x", 1, 443, 80, "2001:db8::1", '["a","b"]', "[]")
    assert [r.details_kind for r in rows] == ["network", "network", None, "http", "generic", "ctu13_flow", "network"] and json.loads(rows[4].details_json)["fields"] == {"a": [1]}
    again, _ = records.canonical_events(spark.createDataFrame([(json.dumps({**EVENT, "event_id": f"{{{e.event_id.upper()}}}"}),)], "value string"))
    assert again.count() == 1
    rows = spark.createDataFrame([(json.dumps(r),) for r, _ in BAD_EVENTS] + [("{",), (None,), ("",)], "value string")
    good, wrong = records.canonical_events(rows)
    found = {r.value: r.violations for r in wrong.collect()}
    assert good.isEmpty() and {found[json.dumps(r)][0]: len(found[json.dumps(r)]) for r, _ in BAD_EVENTS} == {v: 1 for _, v in BAD_EVENTS}
    assert all(found[json.dumps(r)] == [v] for r, v in BAD_EVENTS) and found[None] == found[""] == found["{"] == ["not_json"]


def test_detection_records(spark, flows, tmp_path):
    made = rules.detections(flows)
    sinks.write_detections(made, str(tmp_path / "d"), "2024-01-01T00:00:00Z", "note")
    good, wrong = records.detections(spark.read.text(str(tmp_path / "d")))
    assert wrong.isEmpty() and good.count() == made.count() > 0
    r = good.where("array_contains(triggered_rules, 'icmp_packet_burst')").first()
    assert [e.field for e in r.supporting_evidence] == ["protocol", "packet_count"] and r.severity == "medium"
    with pytest.raises(Exception, match="broken detection: score_range"):
        sinks.write_detections(made.withColumn("score", F.lit(2.0)), str(tmp_path / "e"), "2024-01-01T00:00:00Z", "note")


def test_split_and_stored_studies(spark, flows, features, tmp_path):
    rows = windows.features(flows, "1.0.0")
    part = {k: rows.where(f"scenario_id = 'cap-{k}'") for k in range(3)}
    out = studies.scenario_split(part[0], part[1], part[2], FLOW_FEATURES, {"tree": {"model": "decision_tree"}}, rules.flags(flows))
    assert {(r.detector, r.split) for r in out["metrics"].collect()} == {(d, s) for d in ("tree", "rules") for s in ("validation", "test")}
    study = studies.stored_study(spark, features, "1.0.0", ["cap-0"], ["cap-1", "cap-2"], {"tree": {"model": "decision_tree"}}, sealed=("cap-7",), floor=0.2)
    known = rows.where("scenario_id <> 'cap-0' AND ground_truth_label <> 'unknown'").count()
    assert study["scores"].count() == known and study["rules"].where("scenario_id IS NULL").count() == 1
    with pytest.raises(ValueError, match="sealed"):
        studies.stored_study(spark, features, "1.0.0", ["cap-0"], ["cap-7"], {}, sealed=("cap-7",))
    sinks.write_summary({k: v for k, v in study.items() if k in ("operating_points", "labels", "scores")}, "study-1", str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s" / "labels")).first().study_id == "study-1" and not (tmp_path / "s" / "scores").exists()
    sinks.write_ordered(rows.select("event_id"), str(tmp_path / "o"), ["event_id"])
    files = sorted((tmp_path / "o").glob("part-*"))
    order = [json.loads(x)["event_id"] for f in files for x in f.read_text().splitlines()]
    assert order == sorted(order) and len(order) == rows.count()


def test_one_scenario(spark, flows):
    with pytest.raises(ValueError, match="more than one scenario"):
        windows.features(flows, "1.0.0", one_scenario=True)
    assert windows.features(flows.where("scenario_id = 'cap-0'"), "1.0.0", one_scenario=True).count() > 0
    assert contracts.guard_sealed_names(["cap-1", "/data/cap-10/x"], ["cap-2"])
    for name in ("cap-2", "/data/cap-2/x.parquet", "data\\scenario_id=cap-2", "cap-2_behavioral.parquet"):
        with pytest.raises(ValueError, match="sealed"):
            contracts.guard_sealed_names([name], ["cap-2"])


def test_empty_addresses_are_missing(spark, flows):
    rows = flows.limit(20).withColumns({"source_src_address": F.lit(""), "protocol": F.lit("")})
    out = windows.prior_features(rows.withColumn("observed_at", F.col("observed_at").cast("timestamp")))
    assert out.agg(F.max("prior_source_connections_300s")).first()[0] == 0


def test_addresses_stay_in_the_jvm(spark):
    """Rows with all of a record's fields would wait for Python, and be spilled."""
    texts = ["::", "::1", "1::", "2001:DB8::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "1:::2", "1::2::3", ":1:2:3:4:5:6:7", "::ffff:1.2.3.4", "::FFFF:102:304", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.256", "fe80::1%eth0", "::1%", "::1/64"]
    texts += ["0:0:1:0:0:1:1:1", "0:0:0:1:0:0:0:1", "1:0:0:2:0:0:0:3", "0001:0:2:0:3:0:4:0", "00001::", "g::", "::1\n", "1.2.3.4:80", "1.2.3.4", "1.2.3", ""]

    def expected(text):
        try:
            return str(ipaddress.ip_address(text))
        except ValueError:
            return None

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", to_ip(F.col("t")).alias("ip"))
    assert {r.t: r.ip for r in rows.collect()} == {t: expected(t) for t in texts}
    events, wrong = records.canonical_events(spark.createDataFrame([(json.dumps(EVENT),)], "value string"))
    assert not any("EvalPython" in t._jdf.queryExecution().executedPlan().toString() for t in (rows, events, wrong))


def test_hardening_fits_the_whole_model_once(spark, flows, monkeypatch):
    """The model with all features, whose scores are there, is not fitted again for the ablation."""
    rows, fits, fit = windows.features(flows, "1.0.0"), [], studies._score
    monkeypatch.setattr(studies, "_score", lambda train, rows, names, **options: fits.append(len(names)) or fit(train, rows, names, **options))
    out = studies.hardening(rows, rows, FLOW_FEATURES, {"model": "decision_tree"}, groups={"ports": FLOW_FEATURES[:1]})
    assert sorted(fits) == [len(FLOW_FEATURES) - 1, len(FLOW_FEATURES), len(FLOW_FEATURES)]  # without a group, raw, and for the sigmoid
    assert {r["without"] for r in out["ablation"].select("without").collect()} == {"none", "ports"}
