"""Queries of parsing, contracts, model inputs and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import contracts, models, rules, studies, windows
from ..schemas import FLOW_FEATURES
from ..sources import binetflow, zeek
from ..store import new_path
from .flows import flows, scores
from .queries import F0, S0, query

#: Lines of a rendered file, before what is planted.
FILE_LINES = 20_000
ZONE_HOURS = 5


def _write_files(spark: SparkSession, rows: DataFrame, head: list[str], foot: str | None = None) -> str:
    """``rows`` (event_id, value) as text files of about ``FILE_LINES`` rows, each with the lines of ``head`` first."""
    rows = rows.withColumn("part", F.floor(F.col("event_id") / FILE_LINES))
    heads = rows.select("part").distinct().crossJoin(F.broadcast(spark.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "event_id long, value string")))  # the few head lines
    path = new_path(spark, "lines")
    rows.select("part", "event_id", "value").unionByName(heads.select("part", "event_id", "value")).repartition("part").sortWithinPartitions("part", "event_id").select("part", "value").write.partitionBy("part").text(path)
    return path


def _parsed(spark: SparkSession, sf: str):
    """Flows rendered as text files, with quoted and hexadecimal fields, and some broken and repeated lines, and parsed back."""
    own = flows(spark, sf)
    quoted = F.when(F.col("event_id") % 7 == 1, F.concat("source_src_address", F.lit(', "x"'))).otherwise(F.col("source_src_address"))
    port = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("0x"), F.lower(F.hex("dst_port")))).otherwise(F.col("dst_port").cast("string"))
    rows = binetflow.render(own.withColumns({"source_src_address": quoted, "dst_port": port}))
    broken = F.when(F.col("event_id") % 500 == 7, F.lit("bad,csv")).when(F.col("event_id") % 500 == 8, F.regexp_replace("value", ",[^,]*$", ",-"))
    rows = rows.withColumn("value", F.coalesce(broken, "value"))
    path = _write_files(spark, rows.unionByName(rows.where("event_id % 250 = 3")), [",".join(binetflow.FIELDS)])
    return binetflow.parse(spark, path, F.concat(F.lit("s-"), F.regexp_extract("file", "part=([0-9]+)", 1)), "2024-01-01 00:00:00", zone=f"+0{ZONE_HOURS}:00")


_LINES = f"""WITH {F0}, w AS (SELECT *, false AS second FROM flows UNION ALL SELECT *, true FROM flows WHERE event_id % 250 = 3),
c AS (SELECT *, CASE WHEN event_id % 500 = 7 THEN 'malformed_row' WHEN second THEN 'duplicate_source_record' WHEN event_id % 500 = 8 THEN 'invalid_record' END AS issue FROM w)"""
_TOTALS = "count(*) AS n, CAST(sum(network_bytes) AS BIGINT) AS bytes, CAST(sum(orig_bytes) AS BIGINT) AS orig, CAST(sum(packet_count) AS BIGINT) AS packets, CAST(sum(src_port) AS BIGINT) AS source_ports, CAST(sum(dst_port) AS BIGINT) AS ports, round(sum(session_duration_seconds), 3) AS seconds, count(*) FILTER (ground_truth_label = 'malicious') AS bad, count(protocol) AS protocols, count(connection_state) AS states"


def _totals(events: DataFrame) -> list:
    total = {"bytes": "network_bytes", "orig": "orig_bytes", "packets": "packet_count", "source_ports": "src_port", "ports": "dst_port"}
    return [F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in total.items()], F.round(F.sum("session_duration_seconds"), 3).alias("seconds"), F.count_if(F.col("ground_truth_label") == "malicious").alias("bad"), F.count("protocol").alias("protocols"), F.count("connection_state").alias("states")]


@query("parse_flows", f"{_LINES} SELECT {_TOTALS}, CAST(sum((epoch_us(observed_at) - {ZONE_HOURS} * 3600000000) % 1000003) AS BIGINT) AS times, CAST(sum(length(source_src_address) + CASE WHEN event_id % 7 = 1 THEN 5 ELSE 0 END) AS BIGINT) AS address_chars, count(DISTINCT event_id) AS ids, count(DISTINCT event_id // {FILE_LINES}) AS scenarios FROM c WHERE issue IS NULL")
def parse_flows(spark, sf):
    e, _, _ = _parsed(spark, sf)
    return e.agg(*_totals(e), F.sum(F.unix_micros("observed_at") % 1000003).alias("times"), F.sum(F.length("source_src_address")).alias("address_chars"), F.count_distinct("event_id").alias("ids"), F.count_distinct("scenario_id").alias("scenarios"))


@query("parse_issues", f"{_LINES} SELECT issue AS issue_type, count(*) AS n FROM c WHERE issue IS NOT NULL GROUP BY 1")
def parse_issues(spark, sf):
    _, i, _ = _parsed(spark, sf)
    return i.groupBy("issue_type").agg(F.count("*").alias("n"))


@query("quality_counts", f"{_LINES} SELECT count(*) AS rows_seen, count(*) FILTER (issue IS NULL) AS accepted, count(*) FILTER (issue = 'duplicate_source_record') AS duplicates, count(*) FILTER (issue IS NOT NULL) AS rejected FROM c")
def quality_counts(spark, sf):
    _, i, rows = _parsed(spark, sf)
    return binetflow.quality(rows, i).select("rows_seen", "accepted", "duplicates", "rejected")


_FIELD_COLUMNS = {
    "StartTime": "observed_at IS NULL", "Dur": "session_duration_seconds IS NULL", "Proto": "protocol IS NULL", "SrcAddr": "source_src_address IS NULL", "Sport": "src_port IS NULL", "Dir": "flow_direction IS NULL",
    "DstAddr": "source_dst_address IS NULL", "Dport": "dst_port IS NULL", "State": "connection_state IS NULL", "sTos": "false", "dTos": "true", "TotPkts": "packet_count IS NULL", "TotBytes": "network_bytes IS NULL",
    "SrcBytes": "orig_bytes IS NULL", "Label": "event_id % 500 = 8",
}


@query("missing_counts", f"{_LINES}, k AS (SELECT * FROM c WHERE issue IS DISTINCT FROM 'malformed_row') " + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER ({c}) AS missing FROM k" for f, c in _FIELD_COLUMNS.items()))
def missing_counts(spark, sf):
    _, _, rows = _parsed(spark, sf)
    return binetflow.missing_counts(rows)


_ZEEK_FIELDS = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service", "duration", "orig_bytes", "resp_bytes", "conn_state", "missed_bytes", "history", "orig_pkts", "resp_pkts", "tunnel_parents", "label", "detailed-label"]


def _zeek(spark: SparkSession, sf: str):
    """Flows as connection logs, some lines short of a field, repeated, or with a port out of range, and parsed back."""
    rows = zeek.render(flows(spark, sf).withColumn("dst_port", F.when(F.col("event_id") % 500 == 8, F.lit(70000)).otherwise(F.col("dst_port"))), _ZEEK_FIELDS)
    rows = rows.withColumn("value", F.when(F.col("event_id") % 500 == 7, F.lit("1.0\tC")).otherwise(F.col("value")))
    head = ["#separator \\x09", "#set_separator\t,", "#path\tconn", "\t".join(["#fields", *_ZEEK_FIELDS])]
    return zeek.parse(spark, _write_files(spark, rows.unionByName(rows.where("event_id % 250 = 3")), head), "z", "2024-01-01 00:00:00")


_ZEEK_ROWS = _LINES.replace("WHEN second THEN", "WHEN event_id % 500 = 8 THEN 'invalid_record' WHEN second THEN").replace("WHEN event_id % 500 = 8 THEN 'invalid_record' END", "END")


@query("zeek_flows", f"{_ZEEK_ROWS} SELECT count(*) AS n, CAST(sum(coalesce(network_bytes, 0) + coalesce(orig_bytes, 0)) AS BIGINT) AS bytes, CAST(sum(src_port) AS BIGINT) AS source_ports, CAST(sum(dst_port) AS BIGINT) AS ports, round(sum(session_duration_seconds), 3) AS seconds, count(*) FILTER (ground_truth_label = 'malicious') AS bad, count(connection_state) AS states, CAST(sum(epoch_us(observed_at) % 1000003) AS BIGINT) AS times, count(DISTINCT event_id) AS ids FROM c WHERE issue IS NULL")
def zeek_flows(spark, sf):
    e, _, _ = _zeek(spark, sf)
    return e.agg(F.count("*").alias("n"), F.sum("network_bytes").alias("bytes"), F.sum("src_port").alias("source_ports"), F.sum("dst_port").alias("ports"), F.round(F.sum("session_duration_seconds"), 3).alias("seconds"), F.count_if(F.col("ground_truth_label") == "malicious").alias("bad"), F.count("connection_state").alias("states"), F.sum(F.unix_micros("observed_at") % 1000003).alias("times"), F.count_distinct("event_id").alias("ids"))


@query("zeek_issues", f"{_ZEEK_ROWS} SELECT issue AS issue_type, count(*) AS n FROM c WHERE issue IS NOT NULL GROUP BY 1")
def zeek_issues(spark, sf):
    return _zeek(spark, sf)[1].groupBy("issue_type").agg(F.count("*").alias("n"))


@query("zeek_source_labels", f"{_ZEEK_ROWS} SELECT CASE ground_truth_label WHEN 'malicious' THEN 'C&C' ELSE 'Benign' END AS source_label, count(*) AS n FROM c WHERE issue IS NULL AND ground_truth_label <> 'unknown' GROUP BY 1")
def zeek_source_labels(spark, sf):
    return zeek.source_labels(_zeek(spark, sf)[2])


@query("flow_distributions", f"WITH {F0} SELECT 'protocol' AS field, protocol AS value, count(*) AS n FROM flows WHERE protocol IS NOT NULL GROUP BY protocol UNION ALL SELECT 'flow_direction', flow_direction, count(*) FROM flows WHERE flow_direction IS NOT NULL GROUP BY flow_direction UNION ALL SELECT 'ground_truth_label', ground_truth_label, count(*) FROM flows GROUP BY ground_truth_label UNION ALL SELECT 'connection_state', connection_state, count(*) FROM flows WHERE connection_state IS NOT NULL GROUP BY connection_state")
def flow_distributions(spark, sf):
    return binetflow.distributions(flows(spark, sf), ["protocol", "flow_direction", "ground_truth_label", "connection_state"])


@query("flow_spreads", f"WITH {F0} SELECT 'network_bytes' AS field, min(network_bytes)::DOUBLE AS low, max(network_bytes)::DOUBLE AS high, round(avg(network_bytes), 6) AS mean FROM flows UNION ALL SELECT 'session_duration_seconds', round(min(session_duration_seconds), 6), round(max(session_duration_seconds), 6), round(avg(session_duration_seconds), 6) FROM flows")
def flow_spreads(spark, sf):
    return binetflow.spreads(flows(spark, sf), ["network_bytes", "session_duration_seconds"])


@query("contract_violations", f"WITH {F0}, v AS (SELECT event_id, CASE WHEN network_bytes - 500000 < 0 THEN 'network_bytes_negative' END AS a, CASE WHEN dst_port * 10 > 65535 THEN 'dst_port_range' END AS b FROM flows), u AS (SELECT a AS violation FROM v UNION ALL SELECT b FROM v) SELECT violation, count(*) AS n FROM u WHERE violation IS NOT NULL GROUP BY violation")
def contract_violations(spark, sf):
    rows = flows(spark, sf).withColumns({"network_bytes": F.col("network_bytes") - 500000, "dst_port": F.col("dst_port") * 10})
    return contracts.violations(rows, contracts.event_checks()).select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


@query("balanced_weights", f"WITH {F0}, n AS (SELECT ground_truth_label, count(*) AS n FROM flows WHERE ground_truth_label <> 'unknown' GROUP BY 1) SELECT ground_truth_label, round((SELECT sum(n) FROM n) / (2 * n), 6)::DOUBLE AS weight FROM n")
def balanced_weights(spark, sf):
    return models.balanced_weights(flows(spark, sf))


@query("standardised", f"WITH {F0}, x AS (SELECT event_id, coalesce(session_duration_seconds, 0)::DOUBLE AS d FROM flows) SELECT event_id, round((d - (SELECT avg(d) FROM x)) / (SELECT stddev_pop(d) FROM x), 6) AS duration_seconds FROM x")
def standardised(spark, sf):
    rows = windows.features(flows(spark, sf), "1.0.0").select("event_id", "duration_seconds")
    return models.standardise(rows, ["duration_seconds"])


@query("range_normalised", f"WITH {F0}, {S0}, a AS (SELECT * FROM scores WHERE detector = 'a'), r AS (SELECT min(score) AS lo, max(score) AS hi FROM a WHERE event_id % 7 = 0 AND score BETWEEN 0.2 AND 0.8) SELECT event_id, round(greatest(0, least(1, (score - lo) / (hi - lo))), 6)::DOUBLE AS score FROM a, r")
def range_normalised(spark, sf):
    rows = scores(spark, sf).where("detector = 'a'").select("event_id", "score")
    return models.normalise_range(rows, rows.where("event_id % 7 = 0 AND score BETWEEN 0.2 AND 0.8"))


def _pools(spark: SparkSession, sf: str):
    rows = windows.features(flows(spark, sf), "1.0.0").select("event_id", "scenario_id", "ground_truth_label", *FLOW_FEATURES)
    return rows.where("scenario_id = 'cap-0'"), rows


def _model(name: str, model: str, **options):
    @query(name)
    def run(spark, sf) -> DataFrame:
        train, rows = _pools(spark, sf)
        return models.fit_and_score(train, rows, FLOW_FEATURES, model, **options)[0]


_model("logistic_scores", "logistic_regression")
_model("tree_scores", "decision_tree")
_model("forest_scores", "random_forest")
_model("boosted_scores", "gradient_boosting")
_model("svm_scores", "linear_svm")


@query("extra_tree_scores")
def extra_tree_scores(spark, sf):
    return models.extra_trees(*_pools(spark, sf), FLOW_FEATURES)


@query("isolation_scores")
def isolation_scores(spark, sf):
    return models.isolation_forest(*_pools(spark, sf), FLOW_FEATURES)


@query("calibrated_scores")
def calibrated_scores(spark, sf):
    return models.calibrated(*_pools(spark, sf), FLOW_FEATURES, "random_forest")


@query("ablation")
def ablation(spark, sf):
    train, rows = _pools(spark, sf)
    groups = {"ports": ["dst_port_http", "dst_port_dns"], "protocol": [c for c in FLOW_FEATURES if c.startswith("protocol_")]}
    return studies.ablation(train, rows, FLOW_FEATURES, {"model": "decision_tree"}, 0.5, groups)


@query("comparison_grid")
def comparison_grid(spark, sf):
    train, rows = _pools(spark, sf)
    return studies.comparison(train, rows, {"1.0.0": FLOW_FEATURES}, {"tree": {"model": "decision_tree"}, "regression": {"model": "logistic_regression"}})


@query("stability_points")
def stability_points(spark, sf):
    train, rows = _pools(spark, sf)
    return studies.stability(train, rows, FLOW_FEATURES, {"tree": {"model": "decision_tree"}, "forest": {"model": "random_forest"}}, floor=0.3)["operating_points"]


@query("detector_status")
def detector_status(spark, sf):
    train, rows = _pools(spark, sf)
    return studies.detector_scores(train, rows, FLOW_FEATURES, {"tree": {"model": "decision_tree"}, "none": {"model": "no such model"}})[1].drop("fit_seconds", "message")


@query("benchmark_metrics")
def benchmark_metrics(spark, sf):
    train, rows = _pools(spark, sf)
    return studies.benchmark(train, rows, FLOW_FEATURES, {"tree": {"model": "decision_tree"}, "isolation": {"model": "isolation_forest"}}, rules.flags(flows(spark, sf)))["metrics"]


@query("hardening_calibration")
def hardening_calibration(spark, sf):
    train, rows = _pools(spark, sf)
    return studies.hardening(train, rows, FLOW_FEATURES, {"model": "random_forest"}, groups={})["calibration"]


@query("representation_deltas")
def representation_deltas(spark, sf):
    train, rows = _pools(spark, sf)
    return studies.representation(train, rows, [c for c in FLOW_FEATURES if "missing" not in c], FLOW_FEATURES, {"tree": {"model": "decision_tree"}}, floor=0.3)["deltas"]
