"""Composed studies: several models or feature sets fitted on one pool and evaluated alike."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import FEATURE_GROUPS, FEATURES
from ..sources import stored
from ..store import staged
from ..together import all_together, together
from . import contracts, evaluate as E, models, rules

VOLUME_THRESHOLDS = (0.05, 0.1, 0.2, 0.3, 0.5, 0.8)
#: What a burst of connections to few destinations looks like, as ratios of medians.
BURST = {"prior_source_connections_300s": (">=", 1.5), "prior_short_connections_60s": (">=", 1.5), "prior_unique_destinations_300s": ("<=", 1.25)}


def _score(train: DataFrame, rows: DataFrame, names: list[str], model: str, sigmoid: bool = False, **options) -> tuple[DataFrame, float | None]:
    if sigmoid:
        return models.calibrated(train, rows, names, model, **options), None
    if model in ("extra_trees", "isolation_forest"):
        return getattr(models, model)(train, rows, names, **options), None
    return models.fit_and_score(train, rows, names, model, **options)


def detector_scores(train: DataFrame, rows: DataFrame, names: list[str], detectors: dict[str, dict]) -> tuple[DataFrame, DataFrame]:
    """Scores of all detectors (name: options of ``models.fit_and_score``, or of ``extra_trees`` or ``isolation_forest`` with
    that name as model; ``sigmoid`` asks for calibrated scores), and a status row for each.

    A detector that cannot be fitted is a row with its error and leaves the others alone. Detectors are fitted side by side. Scores are stored,
    so that each detector scores once however many tables are made of them.
    """
    place = rows.select("event_id", "scenario_id")
    if len(detectors) > 1:  # the pool and the rows are prepared once for all
        kept = ["event_id", "ground_truth_label", *names]
        train, rows = staged(models.known(train).select(kept), "pool"), staged(rows.select("scenario_id", *kept), "rows")
        place = rows.select("event_id", "scenario_id")

    def one(options: dict) -> tuple[DataFrame, float | None]:
        scored, seconds = _score(train, rows, names, **options)
        return staged(scored, "scores"), seconds

    parts, status = None, []
    for name, done in zip(detectors, together(rows.sparkSession, [lambda o=o: one(o) for o in detectors.values()])):
        if isinstance(done, (ValueError, ArithmeticError, PySparkException, Py4JJavaError)):  # what a fit raises; the failure is the result
            status.append((name, "failed", type(done).__name__, str(done).splitlines()[0][:200], None))
            continue
        if isinstance(done, Exception):
            raise done
        part = done[0].join(place, "event_id").select("event_id", "scenario_id", F.lit(name).alias("detector"), "label", "score")
        parts = part if parts is None else parts.unionByName(part)
        status.append((name, "fitted", None, None, done[1]))
    spark = rows.sparkSession
    kind = f"event_id {dict(rows.dtypes)['event_id']}, scenario_id string, detector string, label string, score double"
    parts = spark.createDataFrame([], kind) if parts is None else parts
    return parts, spark.createDataFrame(status, "detector string, status string, error string, message string, fit_seconds double")


def comparison(train: DataFrame, rows: DataFrame, feature_sets: dict[str, list[str]], kinds: dict[str, dict]) -> DataFrame:
    """Metrics of every model, weighting and feature set, at 0.5 and at the tuned threshold."""
    def one(version: str, names: list[str]) -> DataFrame:
        runs = {f"{k}/{'balanced' if b else 'unweighted'}": {**o, "balanced": b} for k, o in kinds.items() for b in (True, False)}
        scores, _ = detector_scores(train, rows, names, runs)
        grid = E.threshold_grid(scores)
        fixed = grid.where("threshold = 0.5").withColumn("choice", F.lit("fixed"))
        tuned = grid.join(E.best_threshold(grid).select("detector", "threshold"), ["detector", "threshold"]).withColumn("choice", F.lit("tuned"))
        return fixed.unionByName(tuned).withColumn("features", F.lit(version))

    return _union(all_together(rows.sparkSession, [lambda v=v, n=n: one(v, n) for v, n in feature_sets.items()], 2))


def ablation(train: DataFrame, rows: DataFrame, names: list[str], options: dict, threshold: float = 0.2, groups: dict[str, list[str]] | None = None, whole: DataFrame | None = None) -> DataFrame:
    """Metrics with all features, and without each group of them; the pool is prepared once, and the fits run side by side.

    ``whole``: the scores of the model with all features, where they are there already; it is not fitted again then.
    """
    groups = FEATURE_GROUPS if groups is None else groups
    kept = ["event_id", "ground_truth_label", *names]
    if groups or whole is None:
        train, rows = staged(models.known(train).select(kept), "pool"), staged(rows.select("scenario_id", *kept), "rows")

    def one(group: str, dropped: list[str]) -> DataFrame:
        scores = whole if group == "none" and whole is not None else detector_scores(train, rows, [n for n in names if n not in set(dropped)], {"model": options})[0]
        return E.binary_metrics(scores, threshold).drop("detector").withColumn("without", F.lit(group))

    runs = {"none": [], **groups}
    return _union(all_together(rows.sparkSession, [lambda g=g, d=d: one(g, d) for g, d in runs.items()]))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def with_rules(scores: DataFrame, rows: DataFrame, flags: DataFrame) -> DataFrame:
    """``scores`` and those of the rules (``rules.flags``); a row without a flag has score 0."""
    own = rows.select("event_id", "scenario_id", F.col("ground_truth_label").alias("label")).join(flags.select("event_id", "score"), "event_id", "left")
    return scores.unionByName(own.select("event_id", "scenario_id", F.lit("rules").alias("detector"), "label", F.coalesce("score", F.lit(0.0)).alias("score")))


def at_thresholds(scores: DataFrame, thresholds: dict[str, float]) -> dict[str, DataFrame]:
    """Metrics by scenario, intervals, alert volume, disagreement and residuals, each detector at its own threshold."""
    out: dict[str, DataFrame] = {}
    if thresholds:
        own, limit = scores.where(F.col("detector").isin(list(thresholds))), E.each_threshold(thresholds)
        out |= {"metrics": E.scenario_metrics(own, limit), "volume": E.alert_volume(own, limit)}
        cases = staged(E.disagreement(own, thresholds), "cases")
        out["intervals"] = E.intervals(out["metrics"], ["detector", "scenario_id"])
        out |= {"cases": cases, "coverage": E.coverage_histogram(cases), "overlap": E.pairwise_overlap(cases, sorted(thresholds)), "unique": E.unique_catches(cases), "residuals": E.residuals(cases)}
    return out


def _chosen(points: DataFrame) -> dict[str, float]:
    return {r["detector"]: r["threshold"] for r in points.select("detector", "threshold").collect()}  # a row a detector


def stability(train: DataFrame, rows: DataFrame, names: list[str], detectors: dict[str, dict], floor: float = E.FLOOR, cap: float = E.CAP) -> dict[str, DataFrame]:
    """Several detectors at the operating points that the policy gives."""
    scores, status = detector_scores(train, rows, names, detectors)
    points = E.operating_point(scores, floor, cap)
    return {"status": status, "scores": scores, "operating_points": points} | at_thresholds(scores, _chosen(points))


def baselines(train: DataFrame, rows: DataFrame, names: list[str], detectors: dict[str, dict], flags: DataFrame, threshold: float = 0.5) -> dict[str, DataFrame]:
    """Rules and detectors at one fixed threshold, with the area under the precision-recall curve."""
    scores, status = detector_scores(train, rows, names, detectors)
    scores = with_rules(scores, rows, flags)
    return {"status": status, "scores": scores, "pr_auc": E.average_precision(scores)} | at_thresholds(scores, dict.fromkeys((*detectors, "rules"), threshold))


def benchmark(train: DataFrame, rows: DataFrame, names: list[str], detectors: dict[str, dict], flags: DataFrame) -> dict[str, DataFrame]:
    """A family of models, each at the threshold with the best F1, beside the rules at 0.5."""
    scores, status = detector_scores(train, rows, names, detectors)
    best = E.best_threshold(E.threshold_grid(scores))
    chosen = _chosen(best) | {"rules": 0.5}
    scores = with_rules(scores, rows, flags)
    return {"status": status, "scores": scores, "thresholds": best, "pr_auc": E.average_precision(scores)} | at_thresholds(scores, chosen)


def hardening(train: DataFrame, rows: DataFrame, names: list[str], options: dict, threshold: float = 0.2, thresholds: tuple[float, ...] = VOLUME_THRESHOLDS, groups: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """One model: ablation, calibration raw and by sigmoid, alert volume at several thresholds, metrics at the frozen one."""
    scores, status = detector_scores(train, rows, names, {"raw": options, "sigmoid": {**options, "sigmoid": True}})
    raw = scores.where("detector = 'raw'")
    volume = E.alert_volumes(raw, thresholds)
    return {"status": status, "ablation": ablation(train, rows, names, options, threshold, groups, raw), "calibration": E.calibration_scores(scores), "volume": volume, "metrics": E.scenario_metrics(raw, threshold)}


def scenario_split(train: DataFrame, validation: DataFrame, test: DataFrame, names: list[str], detectors: dict[str, dict], flags: DataFrame, threshold: float = 0.5) -> dict[str, DataFrame]:
    """Detectors fitted on one split of whole scenarios, and the rules, on the known rows of two others: metrics and predictions by split."""
    splits = {"train": train, "validation": validation, "test": test}
    contracts.guard_splits(splits)
    contracts.guard_training(models.known(train))
    rows = None
    for name in ("validation", "test"):
        part = models.known(splits[name]).withColumn("split", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    scores, status = detector_scores(train, rows, names, detectors)
    scores = with_rules(scores, rows, flags).join(rows.select("event_id", "split"), "event_id")
    metrics = E.binary_metrics(scores, threshold, ("detector", "split"))
    by_split = scores.withColumn("detector", F.concat_ws("/", "detector", "split"))
    auc = E.average_precision(by_split).select(F.split("detector", "/")[0].alias("detector"), F.split("detector", "/")[1].alias("split"), "pr_auc")
    return {"status": status, "scores": scores, "metrics": metrics.join(auc, ["detector", "split"])}


def stored_study(spark: SparkSession, path: str, version: str, training: list[str], validation: list[str], detectors: dict[str, dict], sealed: tuple[str, ...] = (), raw_files: dict[str, str] | None = None, floor: float = E.FLOOR, cap: float = E.CAP) -> dict[str, DataFrame]:
    """Stability from stored features: only labelled rows are scored; the rules come from the features, too."""
    rows = stored.features(spark, path, version, [*training, *validation], sealed, raw_files)
    pool, own = rows.where(F.col("scenario_id").isin(training)), models.known(rows.where(F.col("scenario_id").isin(validation)))
    contracts.guard_splits({"training": pool, "validation": own})
    out = stability(pool, own, FEATURES[version], detectors, floor, cap)
    flags = with_rules(out["scores"].limit(0), own, rules.flags_from_features(own))
    return out | {"rules": E.scenario_metrics(flags, 0.5), "labels": stored.label_counts(rows), "mix": E.protocol_mix(own, ("scenario_id",)), "residual": E.residual_profile(out["cases"], own, FEATURES[version])["profile"]}


def representation(train: DataFrame, rows: DataFrame, reference: list[str], candidate: list[str], detectors: dict[str, dict], floor: float = E.FLOOR, cap: float = E.CAP) -> dict[str, DataFrame]:
    """The same detectors on two feature lists: both studies, and what the candidate's metrics gain."""
    both = {k: stability(train, rows, v, detectors, floor, cap) for k, v in (("reference", reference), ("candidate", candidate))}
    out = {f"{k}_{name}": table for k, v in both.items() for name, table in v.items()}
    if all("metrics" in v for v in both.values()):
        whole = [both[k]["metrics"].where("scenario_id IS NULL") for k in ("reference", "candidate")]
        out["deltas"] = E.metric_deltas(*whole, ["precision", "recall", "f1", "fpr"])
    return out


def unique_coverage(cases: DataFrame, features: DataFrame, detector: str, others: list[str], columns: list[str]) -> dict[str, DataFrame]:
    """Cases that only ``detector`` caught: counts in all and by scenario, and features beside the other malicious cases'."""
    only = F.array_contains("caught_by", F.lit(detector))
    for o in others:
        only = only & ~F.array_contains("caught_by", F.lit(o))
    rows = cases.select("event_id", "scenario_id", F.when(only, "unique").otherwise("other").alias("side"))
    counts = rows.where("side = 'unique'").groupingSets([[], ["scenario_id"]], "scenario_id").agg(F.count("*").alias("n"))
    wide = features.select("event_id", *columns).join(rows.select("event_id", "side"), "event_id")
    return {"cases": rows, "counts": counts, "profile": E.quartiles(wide, "side", columns), "low_share": E.share_at_or_below(wide, "side", "other", columns)}


CHANGES = ["both", "candidate_only", "reference_only", "residual"]


def overlap_diagnosis(reference: DataFrame, candidate: DataFrame, features: DataFrame, detectors: list[str], columns: list[str], ratios: dict[str, tuple[str, float]] | None = None, reference_features: DataFrame | None = None) -> dict[str, DataFrame]:
    """How the cases of two feature versions changed, what the changed groups look like (together and by scenario), and whether they are bursts.

    Raises unless the features hold each case once, and, where the reference's are given, if a shared feature differs.
    """
    changes = staged(E.case_changes(reference, candidate), "changes")
    own = contracts.same_ids(features, changes)
    if reference_features is not None:
        shared = [c for c in columns if c in reference_features.columns]
        contracts.guard_drift(contracts.same_ids(reference_features, changes), own, shared)
    changes = changes.withColumns({"overlap_before": E.overlap_class(F.col("before"), detectors), "overlap_after": E.overlap_class(F.col("after"), detectors)})
    wide = own.select("event_id", *columns).join(changes.select("event_id", "scenario_id", "change"), "event_id")
    profile = E.quartiles(wide, "change", columns)
    kept = changes.groupBy("scenario_id").agg(F.count_if(F.size("after") > 0).alias("successes"), F.count("*").alias("trials"))
    low, high = E.wilson(F.col("successes"), F.col("trials"))
    return {
        "changes": changes,
        "categories": changes.groupingSets([["change"], ["scenario_id", "change"]], "scenario_id", "change").agg(F.count("*").alias("n")),
        "overlap": changes.groupBy("overlap_before", "overlap_after").agg(F.count("*").alias("n")),
        "transitions": E.transitions(changes),
        "gains": E.gains(changes, detectors),
        "caught": kept.withColumns({"lower": low, "upper": high}),
        "profile": profile,
        "scenario_profile": E.group_profile(wide, "change", CHANGES, columns),
        "hypothesis": E.hypothesis(profile, "change", "candidate_only", "reference_only", BURST if ratios is None else ratios),
    }
