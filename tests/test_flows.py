import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowscope.functions.flow_features import with_flow_features
from flowscope.operators import evaluate as E, models, rules, studies, windows
from flowscope.schemas import CAUSAL_FEATURES, FEATURES

COLUMNS = "event_id long, scenario_id string, source_event_id string, observed_at timestamp, source_src_address string, source_dst_address string, src_port long, dst_port long, protocol string, flow_direction string, connection_state string, network_bytes long, orig_bytes long, packet_count long, session_duration_seconds double, ground_truth_label string"


@pytest.fixture(scope="module")
def flows(spark):
    rng = random.Random(11)
    start, out = datetime(2024, 1, 1), []
    for i in range(400):
        at = start + timedelta(seconds=rng.choice([0, 60, 240, 300, 3599, 3600, 3660]) + rng.randrange(0, 200, 20))
        maybe = lambda v: v if rng.random() > 0.1 else None
        out.append((i, rng.choice(["a", "b"]), f"line-{i}", at, maybe(rng.choice(["h1", "h2"])), maybe(rng.choice("xyz")), 5, maybe(rng.choice([80, 53])), maybe(rng.choice(["tcp", "TCP", "icmp"])), "->", "S", maybe(rng.randrange(10**7)), maybe(9), maybe(rng.randrange(200)), maybe(rng.choice([0.5, 1.0, 400.0])), rng.choice(["benign", "malicious", "unknown"])))
    return spark.createDataFrame(out, COLUMNS), out


def test_prior_windows_against_brute_force(flows):
    df, rows = flows
    got = {r.event_id: r for r in windows.prior_features(df, bucket=600).collect()}
    assert len(got) == len(rows)
    for r in rows:
        host = lambda x: x[4] or f"missing:{x[0]}"
        before = [x for x in rows if x[1] == r[1] and host(x) == host(r) and (x[3], str(x[0])) < (r[3], str(r[0]))]
        near = {w: [x for x in before if x[3] > r[3] - timedelta(seconds=w)] for w in (60, 300)}
        g = got[r[0]]
        for w in (60, 300):
            assert g[f"prior_source_connections_{w}s"] == len(near[w])
            assert g[f"prior_unique_destinations_{w}s"] == len({x[5] for x in near[w]})
            assert g[f"prior_unique_destination_ports_{w}s"] == len({x[7] for x in near[w]} - {None})
        assert g.prior_unique_protocols_300s == len({x[8] and x[8].lower() for x in near[300]})
        assert g.prior_destination_reuse_300s == sum(x[5] == r[5] for x in near[300])
        assert g.prior_destination_port_reuse_300s == (sum(x[7] == r[7] for x in near[300]) if r[7] else 0)
        assert g.prior_short_connections_60s == sum(x[14] is not None and x[14] <= 1 for x in near[60])
        assert g.prior_total_bytes_300s_missing == float(all(x[11] is None for x in near[300]))
        assert g.seconds_since_prior_source_flow_missing == float(not before)
        gap = (r[3] - max(x[3] for x in before)).total_seconds() if before else 0.0
        assert g.log_seconds_since_prior_source_flow == pytest.approx(math.log1p(gap))


def test_feature_versions(flows):
    df, _ = flows
    for version, names in FEATURES.items():
        assert windows.features(df, version).columns[5:] == names
    assert windows.audit(df).count() == 0 and len(CAUSAL_FEATURES) == 45


def test_rules(spark):
    row = [(1, "icmp", 10_000_000, 100, 300.0), (2, "ICMP", 999_999, 99, 300.0), (3, None, None, None, None)]
    df = spark.createDataFrame(row, "event_id long, protocol string, network_bytes long, packet_count long, session_duration_seconds double")
    hits = rules.detections(df).collect()
    assert {(r.event_id, r.rule_id) for r in hits} == {(1, "high_volume_flow"), (1, "long_lived_high_volume_flow"), (1, "icmp_packet_burst")}
    assert all(r.evidence and r.score == 1.0 for r in hits) and len({r.detection_id for r in hits}) == 3
    assert {r.event_id: r.flag for r in rules.flags(df).collect()} == {1: True, 2: False, 3: False}


def test_rules_on_features_at_a_limit(spark):
    at = [(10_000_000, 1.0), (9_999_999, 1.0), (1_000_000, 300.0), (999_999, 300.0), (1_000_000, 299.0), (None, 400.0)]
    df = spark.createDataFrame([(i, "a", "l", datetime(2024, 1, 1), "h", "d", 1, 2, "tcp", "->", "S", b, 1, 1, s, "benign") for i, (b, s) in enumerate(at)], COLUMNS)
    got = {r.event_id: r.flag for r in rules.flags_from_features(with_flow_features(df)).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: False, 5: False} == {r.event_id: r.flag for r in rules.flags(df).collect()}


def scored(spark, rows):
    return spark.createDataFrame([(i, "s", "d", l, float(s)) for i, (l, s) in enumerate(rows)], "event_id long, scenario_id string, detector string, label string, score double")


def test_metrics_and_policy(spark):
    m = E.binary_metrics(scored(spark, [("benign", 0.1), ("benign", 0.8), ("malicious", 0.2), ("malicious", 0.9)]), 0.5).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (1, 1, 1, 1)
    rows = [("malicious", 0.9)] * 2 + [("benign", 0.1)] * 10 + [("unknown", 0.9)]
    p = E.operating_point(scored(spark, rows)).first()
    assert (p.status, p.threshold) == ("policy_met", 0.11)
    f = E.operating_point(scored(spark, rows), 0.95, 0.0).first()
    assert (f.status, f.threshold) == ("fallback", 0.91)
    v = E.alert_volume(scored(spark, [("benign", 0.1), ("benign", 0.2), ("malicious", 0.7), ("malicious", 0.9), ("unknown", 0.8)]), 0.5).first()
    assert (v.known_alerts, v.all_alerts, v.alerts_per_1000) == (2, 3, 500.0)
    assert E.average_precision(scored(spark, [("benign", 0.5)])).first().pr_auc is None
    with pytest.raises(ValueError):
        E.binary_metrics(scored(spark, rows), 1.5)


def test_wilson_and_cases(spark):
    low, high = E.wilson(F.col("s"), F.col("n"))
    a, b = spark.createDataFrame([(5, 10), (0, 0)], "s long, n long").select(low.alias("l"), high.alias("h")).collect()
    assert 0.2 < a.l < 0.3 and 0.7 < a.h < 0.8 and b.l is None
    c = spark.createDataFrame([(1, "s", ["a"])], "event_id long, scenario_id string, caught_by array<string>")
    with pytest.raises(ValueError):
        E.case_changes(c, c.withColumn("event_id", F.lit(2)))


def test_models(spark, flows):
    df, _ = flows
    rows = windows.features(df, "1.0.0").withColumn("ground_truth_label", F.when(F.col("log_total_bytes") > 15.2, "malicious").otherwise("benign"))
    names = ["log_total_bytes", "duration_seconds", "protocol_tcp"]
    for scores in (models.fit_and_score(rows, rows, names, "logistic_regression")[0], models.extra_trees(rows, rows, names, trees=10, depth=4), models.isolation_forest(rows, rows, names, trees=5)):
        s = scores.agg(F.count("*"), F.min("score"), F.max("score"), F.avg(F.when(F.col("label") == "malicious", F.col("score"))), F.avg(F.when(F.col("label") == "benign", F.col("score")))).first()
        assert s[0] == 400 and 0 <= s[1] <= s[2] <= 1
        last = s
    assert last is not None
    e = models.extra_trees(rows, rows, names, trees=20, depth=8)
    assert E.average_precision(e.withColumn("detector", F.lit("e"))).first().pr_auc > 0.8
    one = spark.createDataFrame([(1.0,), (1.0,)], "score double")
    assert [r.score for r in models.normalise_range(one, one).collect()] == [0.0, 0.0]


def test_studies(spark, flows):
    df, _ = flows
    rows = windows.features(df, "1.0.0").withColumn("ground_truth_label", F.when(F.col("log_total_bytes") > 15.2, "malicious").when(F.col("event_id") % 5 == 0, "unknown").otherwise("benign"))
    names = ["log_total_bytes", "duration_seconds", "protocol_tcp"]
    kinds = {"tree": {"model": "decision_tree"}, "extra": {"model": "extra_trees", "trees": 5, "depth": 4}, "iso": {"model": "isolation_forest", "trees": 5}}
    b = studies.benchmark(rows, rows, names, kinds, rules.flags(df))
    assert {r.detector: r.status for r in b["status"].collect()} == dict.fromkeys(kinds, "fitted")
    assert {r.detector for r in b["metrics"].where("scenario_id IS NULL").collect()} == {*kinds, "rules"}
    bad = rows.where("ground_truth_label = 'malicious'").count()
    assert b["coverage"].agg(F.sum("n")).first()[0] == bad
    h = studies.hardening(rows, rows, names, {"model": "random_forest", "trees": 3, "depth": 3}, groups={"bytes": names[:1]})
    assert {r.detector for r in h["calibration"].collect()} == {"raw", "sigmoid"} and h["volume"].count() == len(studies.VOLUME_THRESHOLDS)
    assert h["ablation"].count() == 2
    cases = b["cases"].withColumn("caught_by", F.when(F.col("event_id") % 2 == 0, F.array(F.lit("iso"))).otherwise(F.array().cast("array<string>")))
    own = studies.unique_coverage(cases, rows, "iso", ["tree", "extra"], names[:1])
    assert own["counts"].where("scenario_id IS NULL").first().n == cases.where("event_id % 2 = 0").count()
    d = studies.overlap_diagnosis(b["cases"], cases, rows, ["iso", "tree"], names)
    assert d["categories"].where("scenario_id IS NULL").agg(F.sum("n")).first()[0] == bad
    assert {r.outcome for r in d["hypothesis"].collect()} == set()


@pytest.mark.parametrize("whole", [0, 10**6])
def test_exact_quantiles(spark, monkeypatch, whole):
    monkeypatch.setattr(E, "WHOLE", whole)
    import numpy as np

    rng = random.Random(3)
    rows = [(g, None if g is None and i % 9 == 0 else float(rng.randrange(k)) + rng.choice([0, 0.5])) for g, k in (("a", 10**6), ("b", 5), (None, 30)) for i in range(150_000 if g == "a" else 120_000)]
    got = {(r.g, r.fraction): r for r in E.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", [0.25, 0.5, 0.9]).collect()}
    for g in ("a", "b", None):
        x = np.array([v for k, v in rows if k == g and v is not None])
        for f in (0.25, 0.5, 0.9):
            assert (got[g, f].n, got[g, f].lower) == (len(x), np.sort(x)[int((len(x) - 1) * f)])
            assert got[g, f].value == pytest.approx(np.quantile(x, f))
