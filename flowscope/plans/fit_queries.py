"""Queries of fits that have one result, so that SQL can find it too, and of stored feature versions and artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import boosting, evaluate as E, linear, models, packed, rules, sinks, studies, windows
from ..schemas import BEHAVIORAL_FEATURES, CAUSAL_FEATURES, FLOW_FEATURES
from ..sources import stored
from ..store import new_path
from .flows import flows, scores
from .queries import _FIRED, _FLOW_SQL, _RATIOS, F0, S0, SQL, _conf, _prior_sql, query

_PAIR = ["log_total_bytes", "duration_seconds"]
_STEPS = 40


def _solved(rows: str, slope: str, curve: str, name: str = "") -> str:
    """Newton steps from nothing over ``rows`` (x, y, s, weight): weights a, b of two standardised features and c of a constant one, all of which count in the penalty."""
    sums = {"g1": "a + sum(w * (SLOPE) * s * x)", "g2": "b + sum(w * (SLOPE) * s * y)", "g3": "c + sum(w * (SLOPE) * s)"}
    sums |= {"h11": "1 + sum(w * (CURVE) * x * x)", "h22": "1 + sum(w * (CURVE) * y * y)", "h33": "1 + sum(w * (CURVE))", "h12": "sum(w * (CURVE) * x * y)", "h13": "sum(w * (CURVE) * x)", "h23": "sum(w * (CURVE) * y)"}
    shown = ", ".join(f"{v} AS {k}" for k, v in sums.items()).replace("SLOPE", slope).replace("CURVE", curve)
    det = "(h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13))"
    d1 = "(g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3))"
    d2 = "(h11 * (g2 * h33 - h23 * g3) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13))"
    d3 = "(h11 * (h22 * g3 - g2 * h23) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13))"
    return f"""steps{name} AS (
  SELECT 0 AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c
  UNION ALL
  SELECT k + 1, a - {d1} / {det}, b - {d2} / {det}, c - {d3} / {det} FROM (
    SELECT k, a, b, c, {shown} FROM (SELECT *, s * (a * x + b * y + c) AS z FROM steps{name}, {rows} WHERE k < {_STEPS}) GROUP BY k, a, b, c)),
fitted{name} AS (SELECT a, b, c FROM steps{name} WHERE k = {_STEPS})"""


_LINEAR_ROWS = f"""f AS (SELECT event_id, ground_truth_label AS label, {', '.join(f'{_FLOW_SQL[c]} AS {c}' for c in _PAIR)} FROM flows),
n AS (SELECT count(*) FILTER (label = 'malicious') AS bad, count(*) FILTER (label = 'benign') AS good, {', '.join(f'avg({c}) AS m{i}, stddev_pop({c}) AS d{i}' for i, c in enumerate(_PAIR))} FROM f WHERE label <> 'unknown'),
z AS (SELECT event_id, label, ({_PAIR[0]} - m0) / d0 AS x, ({_PAIR[1]} - m1) / d1 AS y FROM f, n),
pool AS (SELECT x, y, CASE WHEN label = 'malicious' THEN 1.0 ELSE -1.0 END AS s, (bad + good) / (2.0 * CASE WHEN label = 'malicious' THEN bad ELSE good END) AS w FROM z, n WHERE label <> 'unknown')"""


def _pair(spark: SparkSession, sf: str) -> DataFrame:
    rows = windows.features(flows(spark, sf), "1.0.0")
    return rows.select("event_id", "ground_truth_label", *[F.round(c, 6).alias(c) for c in _PAIR])


def _four(table: DataFrame) -> DataFrame:
    return table.select("event_id", F.round("score", 4).alias("score"))


@query("linear_svm_scores", f"""WITH RECURSIVE {F0}, {_LINEAR_ROWS}, {_solved('pool', '-2 * greatest(0, 1 - z)', 'CASE WHEN z < 1 THEN 2.0 ELSE 0.0 END')},
m AS (SELECT event_id, label, a * x + b * y + c AS margin FROM z, fitted), r AS (SELECT min(margin) AS low, max(margin) AS high FROM m WHERE label <> 'unknown')
SELECT event_id, round(greatest(0, least(1, (margin - low) / (high - low))), 4) AS score FROM m, r""")
def linear_svm_scores(spark, sf):
    rows = _pair(spark, sf)
    return _four(models.fit_and_score(rows, rows, _PAIR, "linear_svm")[0])


@query("logistic_probabilities", f"WITH RECURSIVE {F0}, {_LINEAR_ROWS}, {_solved('pool', '-1 / (1 + exp(z))', '1 / (1 + exp(z)) * (1 - 1 / (1 + exp(z)))')} SELECT event_id, round(1 / (1 + exp(-(a * x + b * y + c))), 4) AS score FROM z, fitted")
def logistic_probabilities(spark, sf):
    rows = _pair(spark, sf)
    return _four(models.fit_and_score(rows, rows, _PAIR, "logistic_regression")[0])


@query("linear_weights", f"WITH RECURSIVE {F0}, {_LINEAR_ROWS}, {_solved('pool', '-2 * greatest(0, 1 - z)', 'CASE WHEN z < 1 THEN 2.0 ELSE 0.0 END')} SELECT round(a / d0, 4) AS {_PAIR[0]}, round(b / d1, 4) AS {_PAIR[1]}, round(c - a / d0 * m0 - b / d1 * m1, 4) AS constant FROM fitted, n")
def linear_weights(spark, sf):
    fitted = linear.fit(_pair(spark, sf), _PAIR)
    return spark.createDataFrame([(*[round(w, 4) for w in fitted.weights.tolist()], round(fitted.constant, 4))], f"{_PAIR[0]} double, {_PAIR[1]} double, constant double")


@query("sigmoid_scores", f"""WITH RECURSIVE {F0}, {S0}, q AS (SELECT event_id, label, score FROM scores WHERE detector = 'b'), n AS (SELECT count(*) FILTER (label = 'malicious') AS bad, count(*) FILTER (label = 'benign') AS good FROM q),
pool AS (SELECT score AS x, CASE WHEN label = 'malicious' THEN (bad + 1.0) / (bad + 2.0) ELSE 1.0 / (good + 2.0) END AS t FROM q, n WHERE label <> 'unknown'),
steps AS (
  SELECT 0 AS k, 0.0::DOUBLE AS a, ln((good + 1.0) / (bad + 1.0)) AS b FROM n
  UNION ALL
  SELECT k + 1, a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) FROM (
    SELECT k, a, b, sum((t - p) * x) AS g1, sum(t - p) AS g2, sum(p * (1 - p) * x * x) AS h11, sum(p * (1 - p) * x) AS h12, sum(p * (1 - p)) AS h22
    FROM (SELECT *, 1 / (1 + exp(a * x + b)) AS p FROM steps, pool WHERE k < {_STEPS}) GROUP BY k, a, b))
SELECT event_id, round(1 / (1 + exp(a * score + b)), 4) AS score FROM q, steps WHERE k = {_STEPS}""")
def sigmoid_scores(spark, sf):
    """The scores of a detector as probabilities, by the sigmoid that calibration fits."""
    rows = scores(spark, sf).where("detector = 'b'").select("event_id", "label", "score")
    a, b = models.sigmoid(rows)
    return _four(rows.withColumn("score", 1 / (1 + F.exp(F.col("score") * a + b))))


#: Slope and curvature of each loss at z.
_LOSSES = {"svm": ("-2 * greatest(0, 1 - z)", "CASE WHEN z < 1 THEN 2.0 ELSE 0.0 END"), "regression": ("-1 / (1 + exp(z))", "1 / (1 + exp(z)) * (1 - 1 / (1 + exp(z)))")}
_TRAIN = "scenario_id = 'cap-0'"


def _studied(detectors: dict[str, tuple[str, bool, str]]) -> str:
    """``scores`` of all flows by linear detectors (name: loss, balanced, columns x and y as they are used), fitted on one scenario's known rows."""
    out = [f"""f AS (SELECT event_id, scenario_id, ground_truth_label AS label, {', '.join(f'{_FLOW_SQL[c]} AS {c}' for c in _PAIR)} FROM flows),
n AS (SELECT count(*) FILTER (label = 'malicious') AS bad, count(*) FILTER (label = 'benign') AS good, {', '.join(f'avg({c}) AS m{i}, stddev_pop({c}) AS d{i}' for i, c in enumerate(_PAIR))} FROM f WHERE label <> 'unknown' AND {_TRAIN}),
z AS (SELECT event_id, scenario_id, label, ({_PAIR[0]} - m0) / d0 AS x, ({_PAIR[1]} - m1) / d1 AS y FROM f, n)"""]
    parts = []
    for i, (name, (loss, balanced, used)) in enumerate(detectors.items()):
        weight = "(bad + good) / (2.0 * CASE WHEN label = 'malicious' THEN bad ELSE good END)" if balanced else "1.0"
        out.append(f"pool{i} AS (SELECT {used}, CASE WHEN label = 'malicious' THEN 1.0 ELSE -1.0 END AS s, {weight} AS w FROM z, n WHERE label <> 'unknown' AND {_TRAIN})")
        out.append(_solved(f"pool{i}", *_LOSSES[loss], str(i)))
        out.append(f"m{i} AS (SELECT event_id, scenario_id, label, a * x + b * y + c AS v FROM (SELECT event_id, scenario_id, label, {used} FROM z), fitted{i})")
        score = "1 / (1 + exp(-v))" if loss == "regression" else f"greatest(0, least(1, (v - (SELECT min(v) FROM m{i} WHERE label <> 'unknown' AND {_TRAIN})) / (SELECT max(v) - min(v) FROM m{i} WHERE label <> 'unknown' AND {_TRAIN})))"
        parts.append(f"SELECT '{name}' AS detector, event_id, scenario_id, label, {score} AS score FROM m{i}")
    return ", ".join(out) + f", scores AS ({' UNION ALL '.join(parts)})"


_BOTH = {f"{k}/{w}": (k, w == "balanced", "x, y") for k in _LOSSES for w in ("balanced", "unweighted")}
_KINDS = {"svm": {"model": "linear_svm"}, "regression": {"model": "logistic_regression"}}
_OLD = f"WITH {F0}, {S0}"


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = windows.features(flows(spark, sf), "1.0.0").select("event_id", "scenario_id", "ground_truth_label", *[F.round(c, 6).alias(c) for c in _PAIR])
    return rows.where(_TRAIN), rows


_BEST = SQL["best_threshold"].removeprefix(_OLD).replace("SELECT detector, threshold, f1, recall, precision FROM r WHERE i = 1", "")


@query("study_comparison", f"WITH RECURSIVE {F0}, {_studied(_BOTH)}{_BEST}, chosen AS (SELECT detector, threshold FROM r WHERE i = 1) SELECT m.*, 'fixed' AS choice, 'pair' AS features FROM m WHERE threshold = 0.5 UNION ALL SELECT m.*, 'tuned', 'pair' FROM m JOIN chosen USING (detector, threshold)")
def study_comparison(spark, sf):
    """Two models, balanced or not, each at a fixed and at the tuned threshold."""
    return studies.comparison(*_split(spark, sf), {"pair": _PAIR}, _KINDS)


@query("study_operating_points", SQL["operating_point"].replace(_OLD, f"WITH RECURSIVE {F0}, {_studied({k: (k, True, 'x, y') for k in _LOSSES})}"))
def study_operating_points(spark, sf):
    return studies.stability(*_split(spark, sf), _PAIR, _KINDS, floor=0.3)["operating_points"]


@query("study_volume", SQL["alert_volume"].replace(_OLD, f"WITH RECURSIVE {F0}, {_studied({k: (k, True, 'x, y') for k in _LOSSES})}"))
def study_volume(spark, sf):
    return studies.at_thresholds(studies.detector_scores(*_split(spark, sf), _PAIR, _KINDS)[0], dict.fromkeys(_KINDS, 0.5))["volume"]


_TWO = {k: (k, True, "x, y") for k in _LOSSES}


@query("study_baselines", f"""WITH RECURSIVE {F0}, {_FIRED}, {_studied(_TWO)},
every AS (SELECT * FROM scores UNION ALL SELECT 'rules', event_id, scenario_id, ground_truth_label, CASE WHEN event_id IN (SELECT event_id FROM fired) THEN 1.0 ELSE 0.0 END FROM flows),
parts AS (SELECT detector, CASE scenario_id WHEN 'cap-1' THEN 'validation' ELSE 'test' END AS split, label, score FROM every WHERE label <> 'unknown' AND scenario_id IN ('cap-1', 'cap-2')),
c AS ({_conf('detector, split', source='parts')} GROUP BY detector, split),
g AS (SELECT detector, split, score, count(*) FILTER (label = 'malicious') AS p, count(*) AS n FROM parts GROUP BY ALL),
u AS (SELECT detector, split, p, sum(p) OVER w AS tp, sum(n) OVER w AS n FROM g WINDOW w AS (PARTITION BY detector, split ORDER BY score DESC)),
auc AS (SELECT detector, split, round(sum(p * tp / n) / sum(p), 6) AS pr_auc FROM u GROUP BY detector, split)
SELECT c.*, {_RATIOS}, pr_auc FROM c JOIN auc USING (detector, split)""")
def study_baselines(spark, sf):
    """Detectors fitted on one scenario, and the rules, on the known rows of two others, with the area under the precision-recall curve."""
    train, rows = _split(spark, sf)
    parts = [rows.where(f"scenario_id = 'cap-{k}'") for k in (1, 2)]
    return studies.scenario_split(train, *parts, _PAIR, _KINDS, rules.flags(flows(spark, sf)))["metrics"]


_POINTS = SQL["operating_point"].removeprefix(_OLD).rpartition("SELECT detector")[0]


@query("study_deltas", f"""WITH RECURSIVE {F0}, {_studied({'reference': ('regression', True, 'x, 0.0 AS y'), 'candidate': ('regression', True, 'x, y')})}{_POINTS},
v AS (SELECT detector, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS q, coalesce(fp / nullif(fp + tn, 0), 0) AS f, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS h FROM r WHERE i = 1)
SELECT 'regression' AS detector, round(c.p - a.p, 6) AS precision_delta, round(c.q - a.q, 6) AS recall_delta, round(c.h - a.h, 6)::DOUBLE AS f1_delta, round(c.f - a.f, 6) AS fpr_delta
FROM v a, v c WHERE a.detector = 'reference' AND c.detector = 'candidate'""")
def study_deltas(spark, sf):
    """One model on one feature and on two, each at its operating point: what the second gains."""
    return studies.representation(*_split(spark, sf), _PAIR[:1], _PAIR, {"regression": _KINDS["regression"]}, floor=0.3)["deltas"]


_DROPPED = {"none": "x, y", "bytes": "0.0 AS x, y", "duration": "x, 0.0 AS y"}


@query("study_ablation", SQL["binary_metrics"].replace(_OLD, f"WITH RECURSIVE {F0}, {_studied({k: ('regression', True, u) for k, u in _DROPPED.items()})}").replace("SELECT *, round", "SELECT detector AS without, tp, fp, fn, tn, round"))
def study_ablation(spark, sf):
    """Metrics with both features, and without each."""
    return studies.ablation(*_split(spark, sf), _PAIR, _KINDS["regression"], 0.5, {"bytes": _PAIR[:1], "duration": _PAIR[1:]})


_FLAGS = ["duration_missing", "total_bytes_missing", "src_port_missing", "dst_port_http", "dst_port_dns", "protocol_tcp", "protocol_udp", "protocol_icmp", "direction_forward", "direction_reverse", "direction_other", "state_missing"]
_L2, _RATE = boosting.Options.l2, boosting.Options.rate


@query("boosted_stump", f"""WITH {F0}, f AS (SELECT event_id, ground_truth_label AS label, {', '.join(f'{_FLOW_SQL[c]} AS {c}' for c in _FLAGS)} FROM flows),
known AS (SELECT *, CASE WHEN label = 'malicious' THEN 1.0 ELSE 0.0 END AS y FROM f WHERE label <> 'unknown'), base AS (SELECT avg(y) AS p FROM known),
long AS ({' UNION ALL '.join(f"SELECT {i} AS place, '{c}' AS name, {c} AS v, y FROM known" for i, c in enumerate(_FLAGS))}),
side AS (SELECT place, name, v, sum(p - y) AS g, count(*) * any_value(p * (1 - p)) AS h, count(*) AS n FROM long, base GROUP BY place, name, v),
gain AS (SELECT place, name, sum(g * g / (h + {_L2})) - sum(g) * sum(g) / (sum(h) + {_L2}) AS gain FROM side GROUP BY place, name HAVING count(*) = 2 AND min(n) >= 20),
best AS (SELECT name FROM gain WHERE gain > 0 ORDER BY round(gain, 9) DESC, place LIMIT 1),
leaf AS (SELECT v, -{_RATE} * g / (h + {_L2}) AS value FROM side JOIN best USING (name)),
row_value AS (SELECT event_id, CASE (SELECT name FROM best) {' '.join(f"WHEN '{c}' THEN {c}" for c in _FLAGS)} END AS v FROM f)
SELECT event_id, round(1 / (1 + exp(-(ln(p / (1 - p)) + value))), 6) AS score FROM row_value JOIN leaf USING (v), base""")
def boosted_stump(spark, sf):
    """One boosted tree of two leaves: the feature of the most gain, and both leaves' values."""
    rows = windows.features(flows(spark, sf), "1.0.0")
    fitted = boosting.fit(rows, _FLAGS, early=False, options=boosting.Options(iterations=1, leaves=2))
    return fitted.scores(rows).select("event_id", "score")


@query("pool_summary", f"""WITH {F0}, f AS (SELECT ground_truth_label AS label, {', '.join(f'{_FLOW_SQL[c]} AS {c}' for c in FLOW_FEATURES)} FROM flows), k AS (SELECT * FROM f WHERE label <> 'unknown')
{' UNION ALL '.join(f"SELECT '{c}' AS feature, count(*) FILTER (label = 'benign') AS good, count(*) FILTER (label = 'malicious') AS bad, round(avg({c}), 4) AS mean, round(CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END, 4) AS scale FROM k" for c in FLOW_FEATURES)}""")
def pool_summary(spark, sf):
    """What a fit knows of its pool before it begins, from one pass."""
    s = packed.summary(windows.features(flows(spark, sf), "1.0.0"), FLOW_FEATURES)
    return spark.createDataFrame([(c, s.good, s.bad, round(m, 4), round(d, 4)) for c, m, d in zip(FLOW_FEATURES, s.mean.tolist(), s.scale.tolist())], "feature string, good long, bad long, mean double, scale double")


_PRIOR = [c for c in CAUSAL_FEATURES[len(FLOW_FEATURES) :] if "seconds_since" not in c]


def _stored_version(version: str, names: list[str]) -> None:
    @query(f"stored_features_{version.replace('.', '_')}", _prior_sql(False, names, 60, 300))
    def run(spark, sf):
        """Features of a later version, written by scenario and read back under their contract."""
        path = new_path(spark, "features")
        sinks.write_features(windows.features(flows(spark, sf), version), path)
        return stored.features(spark, path, version).select("event_id", *names)


_stored_version("1.1.0", [c for c in _PRIOR if c in BEHAVIORAL_FEATURES])
_stored_version("1.2.0", _PRIOR)


@query("artifact_intervals", SQL["scenario_intervals"].replace("GROUPING SETS ((detector), (detector, scenario_id))", "(detector, scenario_id)"))
def artifact_intervals(spark, sf):
    """Counts of a study as a nested JSON artifact, read back, and the intervals of all its proportions."""
    counts = ["tp", "fp", "fn", "tn"]
    rows = E.scenario_metrics(scores(spark, sf), 0.5).where("scenario_id IS NOT NULL")
    entry = lambda k, v: F.map_from_entries(F.collect_list(F.struct(F.col(k), v)))
    by_model = rows.groupBy("detector").agg(entry("scenario_id", F.create_map(*[x for c in counts for x in (F.lit(c), F.col(c).cast("double"))])).alias("scenarios"))
    path = new_path(spark, "artifact")
    by_model.agg(F.to_json(F.struct(entry("detector", F.struct("scenarios")).alias("models"))).alias("value")).write.text(path)  # a few metrics
    back = stored.study_metrics(stored.read_artifact(spark, path)).groupBy(F.col("model").alias("detector"), "scenario_id").agg(*[F.max(F.when(F.col("metric") == c, F.col("value"))).cast("long").alias(c) for c in counts])
    return E.intervals(back, ["detector", "scenario_id"])

