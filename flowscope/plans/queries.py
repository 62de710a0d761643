"""Registered queries on the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.flow_features import with_flow_features
from ..functions.ids import EVENTS, event_id
from ..operators import evaluate as E, rules, studies, windows
from ..schemas import FLOW_FEATURES
from .flows import flows, flows_sql, scores, scores_sql

DAY, WEEK = 86_400, 604_800
QUERIES: dict = {}
SQL: dict[str, str] = {}
F0, S0 = flows_sql(), scores_sql()
LIMITS = {"a": 0.5, "b": 0.6, "c": 0.7}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


_FIRED = """
fired AS (
  SELECT event_id, 'high_volume_flow' AS rule_id FROM flows WHERE network_bytes >= 10000000
  UNION ALL SELECT event_id, 'long_lived_high_volume_flow' FROM flows WHERE session_duration_seconds >= 300 AND network_bytes >= 1000000
  UNION ALL SELECT event_id, 'icmp_packet_burst' FROM flows WHERE lower(protocol) = 'icmp' AND packet_count >= 100)"""


@query("rule_hits", f"WITH {F0}, {_FIRED} SELECT event_id, rule_id, 'medium' AS severity, 1.0::DOUBLE AS score, CASE rule_id WHEN 'high_volume_flow' THEN 'network_bytes' WHEN 'long_lived_high_volume_flow' THEN 'session_duration_seconds,network_bytes' ELSE 'protocol,packet_count' END AS fields FROM fired")
def rule_hits(spark: SparkSession, sf: str) -> DataFrame:
    return rules.detections(flows(spark, sf)).select("event_id", "rule_id", "severity", "score", F.array_join(F.col("evidence.field"), ",").alias("fields"))


@query("rule_flags", f"WITH {F0}, {_FIRED} SELECT event_id, event_id IN (SELECT event_id FROM fired) AS flag, CASE WHEN event_id IN (SELECT event_id FROM fired) THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM flows")
def rule_flags(spark, sf):
    return rules.flags(flows(spark, sf))


@query("rule_flags_from_features", f"WITH {F0} SELECT event_id, flag, CASE WHEN flag THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM (SELECT event_id, coalesce(network_bytes >= 10000000 OR (session_duration_seconds >= 300 AND network_bytes >= 1000000), false) OR coalesce(lower(protocol) = 'icmp' AND packet_count >= 100, false) AS flag FROM flows)")
def rule_flags_from_features(spark, sf):
    return rules.flags_from_features(with_flow_features(flows(spark, sf)))


def _flag(c: str) -> str:
    return f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END::DOUBLE"


_FLOW_SQL = {
    "duration_seconds": "round(coalesce(session_duration_seconds, 0), 6)::DOUBLE", "duration_missing": _flag("session_duration_seconds IS NULL"),
    "log_total_bytes": "round(coalesce(ln(1 + network_bytes), 0), 6)", "total_bytes_missing": _flag("network_bytes IS NULL"),
    "log_packet_count": "round(coalesce(ln(1 + packet_count), 0), 6)", "packet_count_missing": _flag("packet_count IS NULL"),
    "log_source_bytes": "round(coalesce(ln(1 + orig_bytes), 0), 6)", "source_bytes_missing": _flag("orig_bytes IS NULL"),
    "src_port_well_known": _flag("src_port <= 1023"), "src_port_missing": _flag("src_port IS NULL"),
    "dst_port_well_known": _flag("dst_port <= 1023"), "dst_port_missing": _flag("dst_port IS NULL"),
    "dst_port_http": _flag("dst_port IN (80, 443, 8080)"), "dst_port_dns": _flag("dst_port = 53"),
    **{f"protocol_{p}": _flag(f"lower(protocol) = '{p}'") for p in ("tcp", "udp", "icmp")},
    "protocol_other": _flag("lower(protocol) NOT IN ('tcp', 'udp', 'icmp')"), "protocol_missing": _flag("protocol IS NULL"),
    **{f"direction_{d}": _flag(f"flow_direction = '{s}'") for d, s in (("forward", "->"), ("reverse", "<-"), ("bidirectional", "<->"))},
    "direction_other": _flag("flow_direction NOT IN ('->', '<-', '<->')"), "direction_missing": _flag("flow_direction IS NULL"),
    "state_length": "coalesce(length(connection_state), 0)::DOUBLE", "state_missing": _flag("connection_state IS NULL"),
}


@query("flow_features", f"WITH {F0} SELECT event_id, '1.0.0' AS feature_version, {', '.join(f'{v} AS {k}' for k, v in _FLOW_SQL.items())} FROM flows")
def flow_features(spark, sf):
    return windows.features(flows(spark, sf), "1.0.0").select("event_id", "feature_version", *FLOW_FEATURES)


def _prior_sql(ties: bool, columns: list[str], DAY: int = DAY, WEEK: int = WEEK) -> str:  # noqa: N803
    day, week = DAY * 1_000_000, WEEK * 1_000_000
    d = f"p.us > f.us - {day}"
    every = {
        f"prior_source_connections_{DAY}s": f"count(p.event_id) FILTER ({d})",
        f"prior_unique_destinations_{WEEK}s": "count(DISTINCT p.dst)",
        f"prior_unique_destination_ports_{WEEK}s": "count(DISTINCT p.dst_port)",
        f"prior_repeated_short_connections_{WEEK}s": "count(p.event_id) FILTER (p.session_duration_seconds <= 1.0)",
        f"prior_source_connections_{WEEK}s": "count(p.event_id)",
        f"prior_unique_destinations_{DAY}s": f"count(DISTINCT p.dst) FILTER ({d})",
        f"prior_unique_destination_ports_{DAY}s": f"count(DISTINCT p.dst_port) FILTER ({d})",
        f"prior_unique_protocols_{WEEK}s": "count(DISTINCT p.proto)",
        f"prior_destination_reuse_{WEEK}s": "count(p.event_id) FILTER (p.dst = f.dst)",
        f"prior_destination_port_reuse_{WEEK}s": "count(p.event_id) FILTER (p.dst_port = f.dst_port)",
        f"prior_short_connections_{DAY}s": f"count(p.event_id) FILTER ({d} AND p.session_duration_seconds <= 1.0)",
        f"log_prior_total_bytes_{WEEK}s": "round(ln(1 + coalesce(sum(p.network_bytes), 0)), 6)",
        f"prior_total_bytes_{WEEK}s_missing": "(count(p.network_bytes) = 0)::INT",
        f"log_prior_packet_count_{WEEK}s": "round(ln(1 + coalesce(sum(p.packet_count), 0)), 6)",
        f"prior_packet_count_{WEEK}s_missing": "(count(p.packet_count) = 0)::INT",
    }
    base = f"""WITH {flows_sql(ties)},
f AS (SELECT *, CAST(event_id AS VARCHAR) AS id, coalesce(source_src_address, 'missing:' || event_id) AS host, coalesce(source_dst_address, 'missing:') AS dst, coalesce(lower(protocol), 'missing:') AS proto FROM flows)"""
    own = {
        "source_traffic_asymmetry": "any_value(CASE WHEN f.network_bytes > 0 AND f.orig_bytes IS NOT NULL THEN round(f.orig_bytes / f.network_bytes, 6) ELSE 0.0 END)",
        "source_traffic_asymmetry_missing": "any_value(CASE WHEN f.network_bytes > 0 AND f.orig_bytes IS NOT NULL THEN 0.0 ELSE 1.0 END)",
    }
    shown = ", ".join(f"CAST({(every | own)[c]} AS DOUBLE) AS {c}" for c in columns if c in every or c in own)
    out = f"{base} SELECT f.event_id, {shown} FROM f LEFT JOIN f p ON p.scenario_id = f.scenario_id AND p.host = f.host AND p.us > f.us - {week} AND (p.us < f.us OR (p.us = f.us AND p.id < f.id)) GROUP BY f.event_id"
    return out


_NAMES = lambda v: [c.replace("_60s", f"_{DAY}s").replace("_300s", f"_{WEEK}s") for c in v]
from ..schemas import BEHAVIORAL_FEATURES, CAUSAL_FEATURES  # noqa: E402

_BEHAVIOUR = _NAMES(BEHAVIORAL_FEATURES[len(FLOW_FEATURES) :])
_CAUSAL = _NAMES(CAUSAL_FEATURES[len(BEHAVIORAL_FEATURES) :])
_LAST = ["log_seconds_since_prior_source_flow", "seconds_since_prior_source_flow_missing"]


@query("behavioral_features", _prior_sql(False, _BEHAVIOUR))
def behavioral_features(spark, sf):
    return windows.features(flows(spark, sf), "1.1.0", DAY, WEEK).select("event_id", *_BEHAVIOUR)


@query("causal_features", _prior_sql(False, [c for c in _CAUSAL if c not in _LAST]))
def causal_features(spark, sf):
    return windows.features(flows(spark, sf), "1.2.0", DAY, WEEK).select("event_id", *[c for c in _CAUSAL if c not in _LAST])


@query("causal_features_with_ties", _prior_sql(True, [*_BEHAVIOUR, *[c for c in _CAUSAL if c not in _LAST]]))
def causal_features_with_ties(spark, sf):
    return windows.features(flows(spark, sf, ties=True), "1.2.0", DAY, WEEK).select("event_id", *_BEHAVIOUR, *[c for c in _CAUSAL if c not in _LAST])


@query("seconds_since_prior_flow", f"""WITH {F0}, l AS (SELECT event_id, (us - lag(us) OVER (PARTITION BY scenario_id, coalesce(source_src_address, 'missing:' || event_id) ORDER BY us, CAST(event_id AS VARCHAR))) / 1000000.0 AS gap FROM flows)
SELECT event_id, round(coalesce(ln(1 + gap), 0), 6)::DOUBLE AS {_LAST[0]}, (gap IS NULL)::INT::DOUBLE AS {_LAST[1]} FROM l""")
def seconds_since_prior_flow(spark, sf):
    return windows.features(flows(spark, sf), "1.2.0", DAY, WEEK).select("event_id", *_LAST)


@query("window_audit", f"WITH {F0} SELECT scenario_id, count(*) AS flows, CAST(0 AS BIGINT) AS changed FROM flows GROUP BY scenario_id")
def window_audit(spark, sf):
    rows = flows(spark, sf)
    changed = windows.audit(rows, "1.2.0", DAY, WEEK).groupBy("scenario_id").agg(F.count("*").alias("changed"))
    return rows.groupBy("scenario_id").agg(F.count("*").alias("flows")).join(changed, "scenario_id", "left").fillna(0)


@query("event_ids", f"""WITH {F0}, h AS (SELECT event_id, sha1(unhex('{EVENTS.hex}') || encode('["flow","driver","' || scenario_id || '","1","' || source_event_id || '"]')) AS h FROM flows)
SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1))::INT % 4 + 1 AS INT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""")
def event_ids(spark, sf):
    return flows(spark, sf).select("event_id", event_id(F.lit("flow"), F.lit("driver"), F.col("scenario_id"), F.lit("1"), F.col("source_event_id")).alias("id"))


def _conf(by: str, t: str = "0.5", where: str = "label <> 'unknown'", source: str = "scores") -> str:
    return f"SELECT {by}, count(*) FILTER (label = 'malicious' AND score >= {t}) AS tp, count(*) FILTER (label = 'benign' AND score >= {t}) AS fp, count(*) FILTER (label = 'malicious' AND score < {t}) AS fn, count(*) FILTER (label = 'benign' AND score < {t}) AS tn FROM {source} WHERE {where}"


_RATIOS = "round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS fpr, round(fn / nullif(fn + tp, 0), 6) AS fnr, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END, 6)::DOUBLE AS f1"


@query("binary_metrics", f"WITH {F0}, {S0}, c AS ({_conf('detector')} GROUP BY detector) SELECT *, {_RATIOS} FROM c")
def binary_metrics(spark, sf):
    return E.binary_metrics(scores(spark, sf), 0.5)


@query("scenario_metrics", f"WITH {F0}, {S0}, c AS ({_conf('detector, scenario_id')} GROUP BY GROUPING SETS ((detector), (detector, scenario_id))) SELECT *, {_RATIOS} FROM c")
def scenario_metrics(spark, sf):
    return E.scenario_metrics(scores(spark, sf), 0.5)


@query("pr_auc", f"""WITH {F0}, {S0}, s AS (SELECT detector, score, count(*) FILTER (label = 'malicious') AS p, count(*) AS n FROM scores WHERE label <> 'unknown' GROUP BY ALL),
r AS (SELECT detector, p, sum(p) OVER w AS tp, sum(n) OVER w AS n FROM s WINDOW w AS (PARTITION BY detector ORDER BY score DESC))
SELECT detector, round(sum(p * tp / n) / sum(p), 6) AS pr_auc FROM r GROUP BY detector""")
def pr_auc(spark, sf):
    return E.average_precision(scores(spark, sf))


def _grid_sql(steps: int, first: int, last: int) -> str:
    return f"""grid AS (SELECT detector, threshold, count(*) FILTER (label = 'malicious' AND score >= threshold) AS tp, count(*) FILTER (label = 'benign' AND score >= threshold) AS fp,
count(*) FILTER (label = 'malicious' AND score < threshold) AS fn, count(*) FILTER (label = 'benign' AND score < threshold) AS tn, count(*) FILTER (score >= threshold) AS alerts
FROM scores, (SELECT i / {steps}::DOUBLE AS threshold FROM range({first}, {last + 1}) r(i)) GROUP BY ALL)"""


@query("threshold_grid", f"WITH {F0}, {S0}, {_grid_sql(20, 1, 19)} SELECT *, {_RATIOS} FROM grid")
def threshold_grid(spark, sf):
    return E.threshold_grid(scores(spark, sf))


@query("best_threshold", f"WITH {F0}, {S0}, {_grid_sql(20, 1, 19)}, m AS (SELECT *, {_RATIOS} FROM grid), r AS (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY coalesce(f1, -1) DESC, coalesce(recall, -1) DESC, coalesce(precision, -1) DESC, threshold) AS i FROM m) SELECT detector, threshold, f1, recall, precision FROM r WHERE i = 1")
def best_threshold(spark, sf):
    return E.best_threshold(E.threshold_grid(scores(spark, sf)))


def _point_sql(floor: float, cap: float) -> str:
    return f"""WITH {F0}, {S0}, {_grid_sql(100, 0, 100)}, m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p0, coalesce(tp / nullif(tp + fn, 0), 0) AS r0, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, (tp + fp) * 1000.0::DOUBLE / (tp + fp + fn + tn) AS per_1000 FROM grid),
r AS (SELECT *, p0 >= {floor} AND per_1000 <= {cap} AS ok, row_number() OVER (PARTITION BY detector ORDER BY p0 >= {floor} AND per_1000 <= {cap} DESC,
CASE WHEN p0 >= {floor} AND per_1000 <= {cap} THEN -r0 ELSE greatest(per_1000 - {cap}, 0) END, CASE WHEN p0 >= {floor} AND per_1000 <= {cap} THEN -p0 ELSE greatest({floor} - p0, 0) END, CASE WHEN p0 >= {floor} AND per_1000 <= {cap} THEN threshold ELSE -r0 END, threshold) AS i FROM m)
SELECT detector, CASE WHEN ok THEN 'policy_met' ELSE 'fallback' END AS status, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(per_1000, 6) AS per_1000 FROM r WHERE i = 1"""


@query("operating_point", _point_sql(0.3, 200.0))
def operating_point(spark, sf):
    return E.operating_point(scores(spark, sf), 0.3)


@query("operating_point_fallback", _point_sql(0.99, 100.0))
def operating_point_fallback(spark, sf):
    return E.operating_point(scores(spark, sf), 0.99, 100.0)


@query("alert_volume", f"WITH {F0}, {S0} SELECT detector, count(*) FILTER (score >= 0.5 AND label <> 'unknown') AS known_alerts, count(*) FILTER (score >= 0.5 AND label = 'unknown') AS unknown_alerts, count(*) FILTER (score >= 0.5) AS all_alerts, count(*) FILTER (label <> 'unknown') AS labelled, round(count(*) FILTER (score >= 0.5 AND label <> 'unknown') * 1000.0 / count(*) FILTER (label <> 'unknown'), 6)::DOUBLE AS alerts_per_1000 FROM scores GROUP BY detector")
def alert_volume(spark, sf):
    return E.alert_volume(scores(spark, sf), 0.5)


_BINS = "b AS (SELECT detector, CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(score) AS mean_score, avg((label = 'malicious')::INT) AS positive_rate FROM scores WHERE label <> 'unknown' GROUP BY ALL)"


@query("calibration_bins", f"WITH {F0}, {S0}, {_BINS} SELECT detector, bin, n, round(mean_score, 6) AS mean_score, round(positive_rate, 6) AS positive_rate FROM b")
def calibration_bins(spark, sf):
    return E.calibration_bins(scores(spark, sf))


@query("calibration_scores", f"WITH {F0}, {S0}, {_BINS}, e AS (SELECT detector, sum(n * abs(mean_score - positive_rate)) / sum(n) AS ece FROM b GROUP BY detector), r AS (SELECT detector, avg((score - (label = 'malicious')::INT) ** 2) AS brier FROM scores WHERE label <> 'unknown' GROUP BY detector) SELECT detector, round(brier, 6) AS brier, round(ece, 6) AS ece FROM r JOIN e USING (detector)")
def calibration_scores(spark, sf):
    return E.calibration_scores(scores(spark, sf))


@query("error_summary", f"WITH {F0}, {S0} SELECT CASE WHEN score >= 0.5 THEN 'true_positive' ELSE 'false_negative' END AS outcome, count(*) AS n, round(avg(coalesce(session_duration_seconds, 0)), 6) AS duration_seconds, round(avg(coalesce(ln(1 + network_bytes), 0)), 6) AS log_total_bytes FROM flows JOIN scores USING (event_id) WHERE label = 'malicious' AND detector = 'a' GROUP BY 1")
def error_summary(spark, sf):
    return E.error_summary(with_flow_features(flows(spark, sf)), scores(spark, sf).where("detector = 'a'"), 0.5, ["duration_seconds", "log_total_bytes"])


def _cases_sql(name: str, source: str) -> str:
    hit = "score >= CASE detector WHEN 'a' THEN 0.5 WHEN 'b' THEN 0.6 ELSE 0.7 END"
    return f"{name} AS (SELECT event_id, scenario_id, coalesce(string_agg(detector, '+' ORDER BY detector) FILTER ({hit}), '') AS caught, coalesce(string_agg(detector, '+' ORDER BY detector) FILTER (NOT {hit}), '') AS missed, count(*) FILTER ({hit}) AS k FROM {source} WHERE label = 'malicious' GROUP BY ALL)"


_C = f"WITH {F0}, {S0}, {_cases_sql('cases', 'scores')}"


def _cases(spark, sf, shift=0):
    return E.disagreement(scores(spark, sf, shift), LIMITS)


@query("disagreement_cases", f"{_C} SELECT event_id, scenario_id, caught, missed FROM cases")
def disagreement_cases(spark, sf):
    return _cases(spark, sf).select("event_id", "scenario_id", F.array_join("caught_by", "+").alias("caught"), F.array_join("missed_by", "+").alias("missed"))


@query("coverage_histogram", f"{_C} SELECT CAST(k AS INTEGER) AS detectors, count(*) AS n FROM cases GROUP BY k")
def coverage_histogram(spark, sf):
    return E.coverage_histogram(_cases(spark, sf))


@query("pairwise_overlap", f"{_C}, d AS (SELECT event_id, unnest(string_split(caught, '+')) AS d FROM cases WHERE k > 0) SELECT x.d AS \"left\", y.d AS \"right\", count(*) AS n FROM d x JOIN d y ON x.event_id = y.event_id AND x.d <= y.d GROUP BY ALL")
def pairwise_overlap(spark, sf):
    return E.pairwise_overlap(_cases(spark, sf))


@query("unique_catches", f"{_C} SELECT d AS detector, (SELECT count(*) FROM cases WHERE caught = d) AS only_catch, (SELECT count(*) FROM cases WHERE missed = d) AS only_miss FROM (VALUES ('a'), ('b'), ('c')) t(d)")
def unique_catches(spark, sf):
    return E.unique_catches(_cases(spark, sf))


@query("residuals", f"{_C} SELECT scenario_id, count(*) AS n FROM cases WHERE k = 0 GROUP BY scenario_id")
def residuals(spark, sf):
    return E.residuals(_cases(spark, sf))


_V = f"WITH {F0}, {S0}, {scores_sql('later', 7)}, {_cases_sql('ca', 'scores')}, {_cases_sql('cb', 'later')}, v AS (SELECT ca.event_id, ca.scenario_id, ca.caught AS was, cb.caught AS now, CASE WHEN ca.k > 0 AND cb.k > 0 THEN 'both' WHEN cb.k > 0 THEN 'candidate_only' WHEN ca.k > 0 THEN 'reference_only' ELSE 'residual' END AS change FROM ca JOIN cb USING (event_id))"


def _changes(spark, sf):
    return E.case_changes(_cases(spark, sf), _cases(spark, sf, 7))


@query("version_overlap", f"{_V} SELECT scenario_id, change, count(*) AS n FROM v GROUP BY GROUPING SETS ((change), (scenario_id, change))")
def version_overlap(spark, sf):
    return _changes(spark, sf).groupingSets([["change"], ["scenario_id", "change"]], "scenario_id", "change").agg(F.count("*").alias("n"))


@query("overlap_transitions", f"{_V} SELECT coalesce(nullif(was, ''), 'none') || '->' || coalesce(nullif(now, ''), 'none') AS transition, count(*) AS n FROM v GROUP BY 1")
def overlap_transitions(spark, sf):
    return E.transitions(_changes(spark, sf))


@query("detector_gains", f"{_V} SELECT d AS detector, count(*) FILTER (contains(now, d) AND NOT contains(was, d)) AS gained, count(*) FILTER (contains(was, d) AND NOT contains(now, d)) AS lost FROM v, (VALUES ('a'), ('b'), ('c')) t(d) GROUP BY d")
def detector_gains(spark, sf):
    return E.gains(_changes(spark, sf), list(LIMITS))


_Q = ["network_bytes", "packet_count"]


@query("feature_quartiles", f"WITH {F0}, l AS (" + " UNION ALL ".join(f"SELECT ground_truth_label, '{c}' AS feature, {c}::DOUBLE AS x FROM flows" for c in _Q) + ") SELECT ground_truth_label, feature, count(x) AS n, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, round(avg(x), 6) AS mean FROM l GROUP BY ALL")
def feature_quartiles(spark, sf):
    return E.quartiles(flows(spark, sf), "ground_truth_label", _Q)


@query("lower_quantile", f"WITH {F0}, r AS (SELECT ground_truth_label, network_bytes AS x, row_number() OVER (PARTITION BY ground_truth_label ORDER BY network_bytes) AS i, count(*) OVER (PARTITION BY ground_truth_label) AS n FROM flows WHERE network_bytes IS NOT NULL) SELECT ground_truth_label, x AS quantile FROM r WHERE i = floor((n - 1) * 0.25) + 1")
def lower_quantile(spark, sf):
    return E.lower_quantile(flows(spark, sf).where("network_bytes IS NOT NULL"), "ground_truth_label", "network_bytes", 0.25)


@query("hypothesis", f"WITH {F0}, m AS (SELECT ground_truth_label AS g, count(network_bytes) AS nb, quantile_cont(network_bytes::DOUBLE, 0.5) AS b, count(packet_count) AS np, quantile_cont(packet_count::DOUBLE, 0.5) AS p FROM flows GROUP BY 1), r AS (SELECT 'network_bytes' AS feature, m.b / nullif(o.b, 0) AS ratio, m.nb AS n FROM m, m o WHERE m.g = 'malicious' AND o.g = 'benign' UNION ALL SELECT 'packet_count', m.p / nullif(o.p, 0), m.np FROM m, m o WHERE m.g = 'malicious' AND o.g = 'benign') SELECT feature, round(ratio, 6) AS ratio, CASE WHEN n < 100 OR ratio IS NULL THEN 'not_testable' WHEN (feature = 'network_bytes' AND ratio >= 1.5) OR (feature = 'packet_count' AND ratio <= 1.25) THEN 'supported' ELSE 'not_supported' END AS outcome FROM r")
def hypothesis(spark, sf):
    return E.hypothesis(E.quartiles(flows(spark, sf), "ground_truth_label", _Q), "ground_truth_label", "malicious", "benign", {"network_bytes": (">=", 1.5), "packet_count": ("<=", 1.25)})


_Z = "1.959963984540054"


@query("wilson_intervals", f"""WITH {F0}, {S0}, c AS ({_conf('detector')} GROUP BY detector), m AS (SELECT detector, 'precision' AS metric, tp AS successes, tp + fp AS trials FROM c UNION ALL SELECT detector, 'recall', tp, tp + fn FROM c UNION ALL SELECT detector, 'fpr', fp, fp + tn FROM c UNION ALL SELECT detector, 'fnr', fn, fn + tp FROM c UNION ALL SELECT detector, 'alert_rate', tp + fp, tp + fp + fn + tn FROM c),
p AS (SELECT *, successes / trials AS p, {_Z} * {_Z} AS zz FROM m) SELECT detector, metric, successes, trials, round(greatest(0, (p + zz / (2 * trials) - {_Z} * sqrt(p * (1 - p) / trials + zz / (4 * trials * trials))) / (1 + zz / trials)), 6)::DOUBLE AS lower, round(least(1, (p + zz / (2 * trials) + {_Z} * sqrt(p * (1 - p) / trials + zz / (4 * trials * trials))) / (1 + zz / trials)), 6)::DOUBLE AS upper FROM p""")
def wilson_intervals(spark, sf):
    return E.intervals(E.binary_metrics(scores(spark, sf), 0.5), ["detector"])


@query("metric_deltas", f"WITH {F0}, {S0}, {scores_sql('later', 7)}, x AS ({_conf('detector')} GROUP BY detector), y AS ({_conf('detector', source='later')} GROUP BY detector), a AS (SELECT detector, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM x), b AS (SELECT detector, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM y) SELECT detector, round(b.p - a.p, 6) AS precision_delta, round(b.r - a.r, 6) AS recall_delta FROM a JOIN b USING (detector)")
def metric_deltas(spark, sf):
    return E.metric_deltas(E.binary_metrics(scores(spark, sf), 0.5), E.binary_metrics(scores(spark, sf, 7), 0.5), ["precision", "recall"])


_U = "u AS (SELECT event_id, scenario_id, CASE WHEN caught = 'a' THEN 'unique' ELSE 'other' END AS side FROM cases)"


def _unique(spark, sf):
    return studies.unique_coverage(_cases(spark, sf), flows(spark, sf), "a", ["b", "c"], _Q)


@query("unique_coverage", f"{_C}, {_U} SELECT scenario_id, count(*) AS n FROM u WHERE side = 'unique' GROUP BY GROUPING SETS ((), (scenario_id))")
def unique_coverage(spark, sf):
    return _unique(spark, sf)["counts"]


@query("unique_profile", f"{_C}, {_U}, l AS (" + " UNION ALL ".join(f"SELECT side, '{c}' AS feature, {c}::DOUBLE AS x FROM flows JOIN u USING (event_id)" for c in _Q) + ") SELECT side, feature, count(x) AS n, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, round(avg(x), 6) AS mean FROM l GROUP BY ALL")
def unique_profile(spark, sf):
    return _unique(spark, sf)["profile"]


@query("unique_low_share", f"{_C}, {_U}, l AS (" + " UNION ALL ".join(f"SELECT side, '{c}' AS feature, {c}::DOUBLE AS x FROM flows JOIN u USING (event_id) WHERE {c} IS NOT NULL" for c in _Q) + "), q AS (SELECT feature, x AS lim FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY x) AS i, count(*) OVER (PARTITION BY feature) AS n FROM l WHERE side = 'other') WHERE i = floor((n - 1) * 0.25) + 1) SELECT side, feature, round(avg((x <= lim)::INT), 6) AS share FROM l JOIN q USING (feature) GROUP BY ALL")
def unique_low_share(spark, sf):
    return _unique(spark, sf)["low_share"]


@query("scenario_intervals", f"""WITH {F0}, {S0}, c AS ({_conf('detector, scenario_id')} GROUP BY GROUPING SETS ((detector), (detector, scenario_id))), m AS (SELECT detector, scenario_id, 'precision' AS metric, tp AS successes, tp + fp AS trials FROM c UNION ALL SELECT detector, scenario_id, 'recall', tp, tp + fn FROM c UNION ALL SELECT detector, scenario_id, 'fpr', fp, fp + tn FROM c UNION ALL SELECT detector, scenario_id, 'fnr', fn, fn + tp FROM c UNION ALL SELECT detector, scenario_id, 'alert_rate', tp + fp, tp + fp + fn + tn FROM c),
p AS (SELECT *, successes / trials AS p, {_Z} * {_Z} AS zz FROM m) SELECT detector, scenario_id, metric, successes, trials, round(greatest(0, (p + zz / (2 * trials) - {_Z} * sqrt(p * (1 - p) / trials + zz / (4 * trials * trials))) / (1 + zz / trials)), 6)::DOUBLE AS lower, round(least(1, (p + zz / (2 * trials) + {_Z} * sqrt(p * (1 - p) / trials + zz / (4 * trials * trials))) / (1 + zz / trials)), 6)::DOUBLE AS upper FROM p""")
def scenario_intervals(spark, sf):
    return E.intervals(E.scenario_metrics(scores(spark, sf), 0.5), ["detector", "scenario_id"])


@query("version_profile", f"{_V}, l AS (" + " UNION ALL ".join(f"SELECT change, '{c}' AS feature, {c}::DOUBLE AS x FROM flows JOIN v USING (event_id)" for c in _Q) + ") SELECT change, feature, count(x) AS n, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, round(avg(x), 6) AS mean FROM l GROUP BY ALL")
def version_profile(spark, sf):
    return studies.overlap_diagnosis(_cases(spark, sf), _cases(spark, sf, 7), flows(spark, sf), list(LIMITS), _Q)["profile"]
