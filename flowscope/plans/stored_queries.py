"""Queries of stored tables, artifacts, joins with checks, summaries, streams and the quality of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ids import event_id
from ..operators import contracts, evaluate as E, linear, models, rules, sinks, windows
from ..schemas import BINETFLOW_EVENTS, FLOW_FEATURES, ZEEK_EVENTS
from ..sources import binetflow, lines, records, stored
from ..store import new_path
from ..streaming import flows as S
from .flows import flows, scores
from .more_queries import _LINES, _ZEEK_ROWS, _parsed, _zeek
from .queries import _BEHAVIOUR, _CAUSAL, _FIRED, _FLOW_SQL, _LAST, DAY, F0, LIMITS, S0, WEEK, _flag, _prior_sql, query

_SHOWN = ["duration_seconds", "log_total_bytes", "dst_port_http", "protocol_missing"]
_FEATURES = f"f AS (SELECT event_id, scenario_id, ground_truth_label, {', '.join(f'{v} AS {k}' for k, v in _FLOW_SQL.items())} FROM flows)"


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return windows.features(flows(spark, sf), "1.0.0")


def _written(spark: SparkSession, sf: str) -> str:
    path = new_path(spark, "features")
    sinks.write_features(_features(spark, sf), path)
    return path


@query("stored_features", f"WITH {F0}, {_FEATURES} SELECT event_id, scenario_id, ground_truth_label, {', '.join(_SHOWN)} FROM f WHERE scenario_id IN ('cap-0', 'cap-1')")
def stored_features(spark, sf):
    rows = stored.features(spark, _written(spark, sf), "1.0.0", ["cap-0", "cap-1"], sealed=("cap-9",))
    return rows.select("event_id", "scenario_id", "ground_truth_label", *_SHOWN)


@query("wanted_features", f"WITH {F0}, {_FEATURES} SELECT event_id, log_total_bytes FROM f WHERE ground_truth_label = 'malicious'")
def wanted_features(spark, sf):
    wanted = flows(spark, sf).where("ground_truth_label = 'malicious'").select("event_id", "scenario_id")
    return stored.wanted_features(stored.features(spark, _written(spark, sf), "1.0.0"), wanted).select("event_id", "log_total_bytes")


@query("feature_drift", f"WITH {F0}, {_FEATURES} SELECT event_id, 'dst_port_http' AS feature, dst_port_http AS before, dst_port_http + 1 AS after FROM f WHERE event_id % 100 = 5")
def feature_drift(spark, sf):
    rows = _features(spark, sf)
    other = rows.withColumn("dst_port_http", F.col("dst_port_http") + (F.col("event_id") % 100 == 5).cast("double"))
    return contracts.drift(rows, other, _SHOWN)


@query("label_counts", f"WITH {F0} SELECT scenario_id, count(*) AS accepted_rows, count(*) FILTER (ground_truth_label <> 'unknown') AS known_rows, count(*) FILTER (ground_truth_label = 'unknown') AS unknown_rows, count(*) FILTER (ground_truth_label = 'benign') AS benign_rows, count(*) FILTER (ground_truth_label = 'malicious') AS malicious_rows FROM flows GROUP BY scenario_id")
def label_counts(spark, sf):
    return stored.label_counts(flows(spark, sf))


_MIX = ("protocol_tcp", "protocol_udp", "protocol_icmp", "protocol_other", "protocol_missing")


@query("protocol_mix", f"WITH {F0}, {_FEATURES} SELECT scenario_id, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _MIX)} FROM f GROUP BY scenario_id")
def protocol_mix(spark, sf):
    return E.protocol_mix(_features(spark, sf), ("scenario_id",))


@query("group_profile", f"""WITH {F0}, {_FEATURES}, p AS (SELECT scenario_id, 'g' || (event_id % 3) AS side, duration_seconds, log_total_bytes FROM f),
q AS (SELECT scenario_id, side, 'duration_seconds' AS feature, duration_seconds AS x FROM p UNION ALL SELECT scenario_id, side, 'log_total_bytes', log_total_bytes FROM p),
r AS (SELECT * FROM q UNION ALL SELECT NULL, side, feature, x FROM q),
d AS (SELECT scenario_id, side, feature FROM (SELECT DISTINCT scenario_id FROM r), (VALUES ('g0'), ('g1'), ('g9')) a(side), (VALUES ('duration_seconds'), ('log_total_bytes')) b(feature))
SELECT d.scenario_id, d.side, d.feature, count(r.x) AS n, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, round(avg(x), 6) AS mean
FROM d LEFT JOIN r ON d.scenario_id IS NOT DISTINCT FROM r.scenario_id AND d.side = r.side AND d.feature = r.feature GROUP BY ALL""")
def group_profile(spark, sf):
    rows = _features(spark, sf).select("scenario_id", F.concat(F.lit("g"), (F.col("event_id") % 3).cast("string")).alias("side"), "duration_seconds", F.round("log_total_bytes", 6).alias("log_total_bytes"))
    return E.group_profile(rows, "side", ["g0", "g1", "g9"], ["duration_seconds", "log_total_bytes"])


_CASES = f"""{F0}, {S0}, cases AS (SELECT event_id, scenario_id, coalesce(list_sort(list(detector) FILTER (score >= CASE detector WHEN 'a' THEN 0.5 WHEN 'b' THEN 0.6 ELSE 0.7 END)), []) AS caught FROM scores WHERE label = 'malicious' GROUP BY ALL)"""


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    return E.disagreement(scores(spark, sf), LIMITS)


@query("pairwise_overlap_dense", f"""WITH {_CASES}, d AS (SELECT * FROM (VALUES ('a'), ('b'), ('c'), ('z')) v(name))
SELECT l.name AS "left", r.name AS "right", (SELECT count(*) FROM cases WHERE list_contains(caught, l.name) AND list_contains(caught, r.name)) AS n FROM d l JOIN d r ON l.name <= r.name""")
def pairwise_overlap_dense(spark, sf):
    return E.pairwise_overlap(_cases(spark, sf), ["a", "b", "c", "z"])


@query("overlap_classes", f"WITH {_CASES}, k AS (SELECT CASE WHEN list_contains(caught, 'a') AND list_contains(caught, 'b') THEN 'shared' WHEN list_contains(caught, 'a') THEN 'a_only' WHEN list_contains(caught, 'b') THEN 'b_only' ELSE 'none' END AS overlap FROM cases) SELECT overlap, count(*) AS n FROM k GROUP BY overlap")
def overlap_classes(spark, sf):
    return _cases(spark, sf).groupBy(E.overlap_class(F.col("caught_by"), ["a", "b"]).alias("overlap")).agg(F.count("*").alias("n"))


@query("residual_counts", f"WITH {_CASES} SELECT scenario_id, count(*) FILTER (len(caught) = 0) AS n FROM cases GROUP BY scenario_id")
def residual_counts(spark, sf):
    return E.residual_profile(_cases(spark, sf), _features(spark, sf), _SHOWN)["counts"]


@query("residual_features", f"""WITH {_CASES}, {_FEATURES}, s AS (SELECT event_id, 'all' AS side FROM cases UNION ALL SELECT event_id, 'missed' FROM cases WHERE len(caught) = 0)
SELECT side, 'duration_seconds' AS feature, count(*) AS n, round(quantile_cont(duration_seconds, 0.25), 6) AS q1, round(quantile_cont(duration_seconds, 0.5), 6) AS median, round(quantile_cont(duration_seconds, 0.75), 6) AS q3, round(avg(duration_seconds), 6) AS mean FROM s JOIN f USING (event_id) GROUP BY side""")
def residual_features(spark, sf):
    return E.residual_profile(_cases(spark, sf), _features(spark, sf), ["duration_seconds"])["profile"]


@query("predictions", f"WITH {F0}, {S0} SELECT event_id, scenario_id, detector AS model_name, label AS ground_truth_label, score, CASE WHEN score >= CASE detector WHEN 'a' THEN 0.5 WHEN 'b' THEN 0.6 ELSE 0.7 END THEN 'malicious' ELSE 'benign' END AS prediction FROM scores")
def predictions(spark, sf):
    path = new_path(spark, "predictions")
    sinks.write_predictions(scores(spark, sf), LIMITS, path)
    return spark.read.parquet(path).select("event_id", "scenario_id", "model_name", "ground_truth_label", "score", "prediction")


@query("labelled_scores", f"WITH {F0}, {S0} SELECT f.event_id, ground_truth_label, score FROM flows f JOIN scores s ON f.event_id = s.event_id AND s.detector = 'b'")
def labelled_scores(spark, sf):
    return models.labelled_scores(flows(spark, sf).select("event_id", "ground_truth_label"), scores(spark, sf).where("detector = 'b'"))


@query("study_artifact", f"""WITH {F0}, {S0}, m AS (SELECT detector AS model, scenario_id, count(*) FILTER (label = 'malicious' AND score >= 0.5)::DOUBLE AS tp, count(*) FILTER (label = 'benign' AND score >= 0.5)::DOUBLE AS fp FROM scores WHERE label <> 'unknown' GROUP BY ALL)
SELECT model, scenario_id, 'tp' AS metric, tp AS value FROM m UNION ALL SELECT model, scenario_id, 'fp', fp FROM m""")
def study_artifact(spark, sf):
    """Metrics as one nested JSON document, written and read back."""
    rows = E.scenario_metrics(scores(spark, sf), 0.5).where("scenario_id IS NOT NULL")
    entry = lambda k, v: F.map_from_entries(F.collect_list(F.struct(F.col(k), v)))
    metrics = F.create_map(F.lit("tp"), F.col("tp").cast("double"), F.lit("fp"), F.col("fp").cast("double"))
    by_model = rows.groupBy("detector").agg(entry("scenario_id", metrics).alias("scenarios"))
    path = new_path(spark, "artifact")
    by_model.agg(F.to_json(F.struct(entry("detector", F.struct("scenarios")).alias("models"))).alias("value")).write.text(path)  # a few metrics
    return stored.study_metrics(stored.read_artifact(spark, path))


#: What is wrong with the records of a fiftieth of the flows, by the id's remainder.
_BAD = {
    1: "event_id_mismatch", 2: "observed_at_without_zone", 3: "dst_port_range", 4: "known_label_without_source", 5: "unknown_key", 6: "not_json", 8: "missed_bytes_type", 9: "missed_bytes_type", 10: "details_unknown_key",
    11: "source_unknown_key", 12: "src_ip_address", 13: "source_dataset_missing", 14: "provenance_missing", 15: "processed_at_without_zone", 16: "kind_missing", 17: "quality_flags_value", 18: "adapter_version_value",
    19: "source_type_value", 20: "protocol_type", 21: "ground_truth_label_null", 22: "source_label_missing", 23: "provenance_unknown_key", 24: "session_duration_seconds_range", 25: "raw_payload_reference_empty",
}
#: Text of a record and what stands there instead.
_BROKEN = {
    5: ('"event_type":', '"no_such_key":1,"event_type":'), 8: ('"missed_bytes":0', '"missed_bytes":"abc"'), 9: ('"missed_bytes":0', '"missed_bytes":80.5'), 10: ('"missed_bytes":0', '"missed_bytes":0,"no_such_key":null'),
    11: ('"source_type":', '"no_such_key":"","source_type":'), 12: ('"missed_bytes":0', '"missed_bytes":0,"src_ip":"999.1.1.1"'), 13: ('"source_dataset":"driver",', ""), 16: ('"kind":"network",', ""), 17: ('["parsed"]', '["parsed"," "]'),
    18: ('"adapter_version":"1.0.0"', '"adapter_version":"1.0"'), 19: ('"source_type":"synthetic"', '"source_type":"flow"'), 20: ('"missed_bytes":0', '"missed_bytes":0,"service":"-","protocol":7'), 22: ('"kind":"network"', '"kind":"ctu13_flow"'),
    23: ('"adapter_name":', '"more":{},"adapter_name":'), 24: ('"missed_bytes":0', '"missed_bytes":"0","session_duration_seconds":-0.5'), 25: ('"raw_payload_reference":"a"', '"raw_payload_reference":"  "'),
    30: ('"missed_bytes":0', '"missed_bytes":0.0,"src_ip":"2001:DB8::1"'), 31: ('"missed_bytes":0', '"missed_bytes":" 0 ","tunnel_parents":["C1"]'),
}


@query("canonical_events", f"""WITH {F0}, c AS (SELECT *, CASE event_id % 50 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in _BAD.items() if k != 4)} WHEN 4 THEN CASE WHEN ground_truth_label <> 'unknown' THEN '{_BAD[4]}' ELSE 'accepted' END ELSE 'accepted' END AS outcome FROM flows)
SELECT outcome, count(*) AS n, CAST(sum(CASE WHEN outcome = 'accepted' THEN coalesce(network_bytes, 0) + epoch_us(observed_at) % 1000003 END) AS BIGINT) AS total,
count(*) FILTER (outcome = 'accepted' AND event_id % 50 = 30) AS addresses, count(*) FILTER (outcome = 'accepted' AND event_id % 50 = 31) AS parents FROM c GROUP BY outcome""")
def canonical_events(spark, sf):
    """Flows as canonical JSON records, most without an id, some broken at one of three depths; read back, with the ids filled in."""
    bad = F.col("event_id") % 50
    reference = [F.lit("synthetic"), F.lit("driver"), F.col("scenario_id"), F.lit("1.0.0"), F.col("source_event_id")]
    made = event_id(*reference)
    source = F.struct(*[c.alias(n) for c, n in zip(reference, ("source_type", "source_dataset", "scenario_id", "dataset_version", "source_event_id"))], F.lit("a").alias("raw_payload_reference"))
    details = F.struct(F.lit("network").alias("kind"), F.when(bad == 3, F.lit(70000)).otherwise(F.col("dst_port")).alias("dst_port"), "src_port", F.when(bad != 20, F.col("protocol")).alias("protocol"), "network_bytes", "connection_state", F.lit(0).alias("missed_bytes"))
    stamp = lambda hit: F.concat(F.lit("2024-01-01T00:00:00"), F.when(bad == hit, "").otherwise("Z"))
    provenance = F.struct(F.lit("driver").alias("adapter_name"), F.lit("1.0.0").alias("adapter_version"), F.lit("1.0.0").alias("transformation_version"), stamp(15).alias("processed_at"), F.array(F.lit("parsed")).alias("quality_flags"))
    known = F.col("ground_truth_label") != "unknown"
    record = F.to_json(F.struct(
        F.when(bad == 1, "00000000-0000-5000-8000-000000000000").when(bad == 7, F.upper(made)).alias("event_id"), source.alias("source"), details.alias("details"), F.when(bad != 21, F.col("ground_truth_label")).alias("ground_truth_label"),
        F.concat(F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(bad == 2, "").otherwise("+00:00")).alias("observed_at"), stamp(-1).alias("ingested_at"), F.lit("network_flow").alias("event_type"),
        F.when(known & (bad != 4), "source_label").alias("label_source"), F.when(bad != 14, provenance).alias("provenance"),
    ))
    record = F.when(bad == 21, F.regexp_replace(record, r"^\{", '{"ground_truth_label":null,')).otherwise(record)
    pairs = F.create_map(*[x for k, (a, b) in _BROKEN.items() for x in (F.lit(k), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])
    rows = flows(spark, sf).select(F.explode(F.array(F.struct(record.alias("record"), bad.alias("bad")))).alias("r")).select("r.*")  # a record is made once
    pair = pairs[F.col("bad").cast("int")]
    broken = F.when(F.col("bad") == 6, "{").when(pair.isNotNull(), F.replace("record", pair["a"], pair["b"])).otherwise(F.col("record"))
    judged = records.judged_events(rows.select(broken.alias("value")))  # a record is read once
    fine = F.size("violations") == 0
    total = F.sum(F.when(fine, F.coalesce("network_bytes", F.lit(0)) + F.unix_micros("observed_at") % 1000003)).alias("total")
    outcome = F.when(fine, F.lit("accepted")).otherwise(F.array_join("violations", "+")).alias("outcome")
    return judged.groupBy(outcome).agg(F.count("*").alias("n"), total, F.count_if(F.col("src_ip") == "2001:db8::1").alias("addresses"), F.count_if(F.col("tunnel_parents") == '["C1"]').alias("parents"))


@query("detection_records", f"""WITH {F0}, {_FIRED}, d AS (SELECT *, CASE event_id % 10 WHEN 1 THEN 'score_range' WHEN 2 THEN 'evidence_incomplete' WHEN 3 THEN 'no_rule' WHEN 4 THEN 'severity_value' ELSE 'accepted' END AS outcome FROM fired)
SELECT outcome, CASE WHEN outcome = 'accepted' THEN rule_id END AS rule_id, count(*) AS n FROM d GROUP BY ALL""")
def detection_records(spark, sf):
    """Detections written as JSON with their evidence, some broken, and read back under the contract; evidence is seen whole."""
    path = new_path(spark, "detections")
    sinks.write_detections(rules.detections(flows(spark, sf)), path, "2024-01-01T00:00:00Z", "a rule fired")
    bad = F.regexp_extract("value", r'"event_id":"(\d+)"', 1).cast("long") % 10
    broken = {1: ('"score":1.0', '"score":1.5'), 2: ('"predicate":', '"predicated":'), 4: ('"severity":"medium"', '"severity":"severe"')}
    value = F.coalesce(*[F.when(bad == k, F.replace("value", F.lit(a), F.lit(b))) for k, (a, b) in broken.items()], F.when(bad == 3, F.regexp_replace("value", r'"triggered_rules":\[[^\]]*\]', '"triggered_rules":[]')), F.col("value"))
    good, wrong = records.detections(spark.read.text(path).select(value.alias("value")))
    whole = F.forall("supporting_evidence", lambda e: e["observed_value"].isNotNull() & (F.length(e["predicate"]) > 3))
    accepted = good.where(whole).groupBy(F.lit("accepted").alias("outcome"), F.col("triggered_rules")[0].alias("rule_id")).agg(F.count("*").alias("n"))
    return accepted.unionByName(wrong.groupBy(F.array_join("violations", "+").alias("outcome"), F.lit(None).cast("string").alias("rule_id")).agg(F.count("*").alias("n")))


@query("stored_events", f"""WITH {F0} SELECT scenario_id, count(*) AS n, CAST(sum(network_bytes) AS BIGINT) AS bytes, 43 AS columns FROM (SELECT *, 's-' || (event_id // 20000) AS s FROM flows WHERE event_id % 500 NOT IN (7, 8)) t(event_id, scenario_0, source_event_id, observed_at, us, a, b, src_port, dst_port, protocol, d, st, network_bytes, ob, pk, du, l, k, scenario_id) GROUP BY scenario_id""")
def stored_events(spark, sf):
    """Parsed events as stored Parquet by scenario, read back."""
    path = new_path(spark, "events")
    sinks.write_events(_parsed(spark, sf)[0], BINETFLOW_EVENTS, path)
    back = spark.read.parquet(path)
    return back.groupBy("scenario_id").agg(F.count("*").alias("n"), F.sum("network_bytes").alias("bytes"), F.lit(len(back.columns)).alias("columns"))


@query("stored_zeek_events", f"{_ZEEK_ROWS} SELECT 'z' AS scenario_id, count(*) AS n, CAST(sum(dst_port) AS BIGINT) AS ports, 37 AS columns FROM c WHERE issue IS NULL")
def stored_zeek_events(spark, sf):
    """Parsed connection logs as stored Parquet by scenario, read back."""
    path = new_path(spark, "zeek-events")
    sinks.write_events(_zeek(spark, sf)[0], ZEEK_EVENTS, path)
    back = spark.read.parquet(path)
    return back.groupBy("scenario_id").agg(F.count("*").alias("n"), F.sum("dst_port").alias("ports"), F.lit(len(back.columns)).alias("columns"))


@query("quality_report", f"{_LINES} SELECT count(*) AS rows_seen, count(*) FILTER (issue IS NULL) AS accepted, count(*) FILTER (issue = 'duplicate_source_record') AS duplicates, count(*) FILTER (issue IS NOT NULL) AS rejected, 15 AS fields FROM c")
def quality_report(spark, sf):
    """The report of a parsed source, written as JSON lines and read back."""
    path = new_path(spark, "quality")
    events, issues, rows = _parsed(spark, sf)
    sinks.write_quality(binetflow.quality(rows, issues), binetflow.missing_counts(rows), binetflow.distributions(events, ["protocol"]), binetflow.spreads(events, ["network_bytes"]), path)
    fields = spark.read.json(f"{path}/missing").agg(F.count("*").cast("int").alias("fields"))
    return spark.read.json(f"{path}/rows").select("rows_seen", "accepted", "duplicates", "rejected").crossJoin(fields)  # one row each


@query("manifest", f"WITH {F0} SELECT count(*) AS record_count, count(*) FILTER (ground_truth_label = 'malicious') AS malicious, count(*) FILTER (ground_truth_label = 'benign') AS benign, epoch_us(min(observed_at)) AS start, epoch_us(max(observed_at)) AS stop, true AS digests FROM flows")
def manifest(spark, sf):
    path = _written(spark, sf)
    made = sinks.manifest(lines.file_digests(spark, f"{path}/*/*.parquet"), flows(spark, sf), "flows", "1", "driver")
    label = F.col("label_distribution")
    stamp = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return made.select("record_count", label["malicious"].alias("malicious"), label["benign"].alias("benign"), stamp("observed_start").alias("start"), stamp("observed_end").alias("stop"), F.forall("files", lambda f: f["sha256"].rlike(contracts.SHA256)).alias("digests"))


#: Flows of a state, about, where all flows come in one batch.
STATE_ROWS = 5000


def _streamed(spark: SparkSession, rows: DataFrame, make) -> DataFrame:
    """``make`` of a stream over ``rows``, run until all is read, as a table."""
    source, out, marks = (new_path(spark, f"stream-{x}") for x in ("in", "out", "marks"))
    rows.write.parquet(source)
    made = make(spark.readStream.schema(rows.schema).parquet(source))
    run = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


def _stamped(spark: SparkSession, sf: str) -> DataFrame:
    return flows(spark, sf).withColumn("observed_at", F.col("observed_at").cast("timestamp"))


@query("stream_rule_hits", f"WITH {F0}, {_FIRED} SELECT event_id, rule_id FROM fired")
def stream_rule_hits(spark, sf):
    return _streamed(spark, _stamped(spark, sf), S.detect).select("event_id", "rule_id")


@query("stream_first_occurrences", f"WITH {F0} SELECT event_id, count(*) AS n FROM flows GROUP BY event_id")
def stream_first_occurrences(spark, sf):
    rows = _stamped(spark, sf)
    return _streamed(spark, rows.unionByName(rows.where("event_id % 3 = 0")), lambda s: S.first_occurrences(s, ["event_id", "scenario_id"])).groupBy("event_id").agg(F.count("*").alias("n"))


@query("stream_prior_features", _prior_sql(False, [*_BEHAVIOUR, *[c for c in _CAUSAL if c not in _LAST]]))
def stream_prior_features(spark, sf):
    rows = _stamped(spark, sf)
    last = rows.limit(1).withColumns({"event_id": F.lit(-1).cast("long"), "observed_at": F.expr("timestamp'2100-01-01'")})  # moves the watermark past all flows
    groups = max(1, rows.count() // STATE_ROWS)
    out = _streamed(spark, rows.unionByName(last), lambda s: S.prior_features(s, DAY, WEEK, groups=groups))
    return out.where("event_id >= 0").select("event_id", *_BEHAVIOUR, *[c for c in _CAUSAL if c not in _LAST])


@query("audit_finds_look_ahead", f"WITH {F0}, l AS (SELECT scenario_id, count(*) AS flows FROM flows GROUP BY scenario_id) SELECT scenario_id, flows AS changed FROM l")
def audit_finds_look_ahead(spark, sf):
    """A feature that counts all flows of a scenario changes for every flow when a later one is added."""
    def ahead(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy(F.col("scenario_id").alias("of")).agg(F.count("*").alias("later")), F.col("scenario_id") == F.col("of")).select("event_id", "scenario_id", "later")

    return windows.audit(flows(spark, sf), make=ahead).groupBy("scenario_id").agg(F.count("*").alias("changed"))


_LEARNABLE = "coalesce(network_bytes, 0) >= 6000000 AND coalesce(session_duration_seconds, 0) >= 60"
_MODELS = ["logistic_regression", "decision_tree", "random_forest", "gradient_boosting", "linear_svm", "extra_trees", "isolation_forest"]


#: Least PR-AUC of each model, and least share of known flows that it decides right; boosting must be better than any single tree.
_BOUNDS = {"logistic_regression": (0.99, 0.96), "linear_svm": (0.99, 0.94), "decision_tree": (0.95, 0.97), "random_forest": (0.995, 0.98), "gradient_boosting": (0.9995, 0.998), "extra_trees": (0.99, 0.95)}


def _quality(name: str) -> None:
    @query(f"quality_{name}", f"WITH {F0} SELECT count(*) AS n, count(*) FILTER (event_id % 5 <> 0) AS known, count(*) FILTER (event_id % 5 <> 0 AND {_LEARNABLE}) AS bad, true AS in_range, true AS ranks, true AS decides FROM flows")
    def run(spark, sf) -> DataFrame:
        """A model of the default size, on all features, for a label that the features tell: all flows are scored, and malicious ones rank high.

        ``ranks``, ``decides``: the model keeps its bounds; it decides at 0.5, a support vector machine at the score of margin 0. The isolation forest sees no labels: its scores are of many values, and flows with two missing
        fields or more are more anomalous than those without any.
        """
        label = F.when(F.col("event_id") % 5 == 0, "unknown").when(F.expr(_LEARNABLE), "malicious").otherwise("benign")
        rows = windows.features(flows(spark, sf).withColumn("ground_truth_label", label), "1.0.0")
        train = rows.where("scenario_id = 'cap-0'")
        at = 0.5
        if name == "linear_svm":  # its scores are margins by their range: margin 0 is where it decides
            made, at = models.margin_scores(linear.fit(train, FLOW_FEATURES), train, rows)
        elif name in ("extra_trees", "isolation_forest"):
            made = getattr(models, name)(train, rows, FLOW_FEATURES)
        else:
            made = models.fit_and_score(train, rows, FLOW_FEATURES, name)[0]
        made = made.withColumn("detector", F.lit(name)).cache()
        totals = made.groupBy("detector").agg(F.count("*").alias("n"), F.count_if(F.col("label") != "unknown").alias("known"), F.count_if(F.col("label") == "malicious").alias("bad"), F.min(F.col("score").between(0, 1)).alias("in_range"), F.count_distinct("score").alias("distinct"), F.avg((((F.col("score") >= at) == (F.col("label") == "malicious")) & (F.col("label") != "unknown")).cast("double")).alias("right"))
        both = totals.join(E.average_precision(made), "detector")
        if name == "isolation_forest":
            gaps = sum((F.col(c) for c in FLOW_FEATURES if c.endswith("_missing")), F.lit(0.0))
            mean = made.join(rows.select("event_id", gaps.alias("gaps")), "event_id").agg(F.avg(F.when(F.col("gaps") >= 2, F.col("score"))).alias("odd"), F.avg(F.when(F.col("gaps") == 0, F.col("score"))).alias("plain")).first()
            return both.select("n", "known", "bad", "in_range", (F.col("distinct") > 10).alias("ranks"), F.lit(mean["odd"] > mean["plain"] + 0.05).alias("decides"))
        auc, right = _BOUNDS[name]
        return both.select("n", "known", "bad", "in_range", (F.col("pr_auc") >= auc).alias("ranks"), (F.col("right") * F.col("n") / F.col("known") >= right).alias("decides"))


for _name in _MODELS:
    _quality(_name)
