"""Stored tables: Parquet by scenario, JSON lines, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ids import manifest_id
from ..schemas import RULE_VERSION
from ..sources.binetflow import conform
from .contracts import detection_checks, violations
from .evaluate import each_threshold


def write_events(events: DataFrame, schema: str, path: str, mode: str = "errorifexists") -> None:
    conform(events, schema).write.mode(mode).option("compression", "zstd").partitionBy("scenario_id").parquet(path)


def write_features(features: DataFrame, path: str, mode: str = "errorifexists") -> None:
    features.write.mode(mode).option("compression", "zstd").partitionBy("scenario_id").parquet(path)


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Detections, reports or manifests as JSON lines."""
    rows.write.mode(mode).json(path)


def detection_records(detections: DataFrame, created_at: str, note: str) -> DataFrame:
    """``value``: each detection as a JSON record with its rule and evidence; ``records.detections`` reads it back."""
    fixed = {"schema_version": F.lit(RULE_VERSION), "event_id": F.col("event_id").cast("string"), "triggered_rules": F.array("rule_id"), "supporting_evidence": F.col("evidence"), "created_at": F.lit(created_at), "note": F.lit(note)}
    kept = ["detection_id", "detector_type", "detector_name", "detector_version", "severity", "score"]
    return detections.select(F.to_json(F.struct(*[F.col(c) for c in kept], *[v.alias(k) for k, v in fixed.items()])).alias("value"), "detection_id")


def write_detections(detections: DataFrame, path: str, created_at: str, note: str, mode: str = "errorifexists") -> None:
    """Detections that keep their contract as JSON lines in the order of their ids; fails on one that breaks it."""
    checked = violations(detections, detection_checks())
    fine = checked.where(F.assert_true(F.size("violations") == 0, F.concat(F.lit("broken detection: "), F.array_join("violations", ", "))).isNull())
    detection_records(fine, created_at, note).repartitionByRange("detection_id").sortWithinPartitions("detection_id").select("value").write.mode(mode).text(path)


def write_ordered(rows: DataFrame, path: str, keys: list[str], mode: str = "errorifexists") -> None:
    """JSON lines in the order of ``keys``, over the files and within them, so that equal tables give equal files."""
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).json(path)


def predictions(scores: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """event_id, scenario_id, model_name, ground_truth_label, score, prediction: each detector at its threshold."""
    hit = F.col("score") >= each_threshold(thresholds)
    return scores.where(F.col("detector").isin(list(thresholds))).select("event_id", "scenario_id", F.col("detector").alias("model_name"), F.col("label").alias("ground_truth_label"), "score", F.when(hit, "malicious").otherwise("benign").alias("prediction"))


def write_predictions(scores: DataFrame, thresholds: dict[str, float], path: str, mode: str = "errorifexists") -> None:
    predictions(scores, thresholds).write.mode(mode).option("compression", "zstd").partitionBy("model_name").parquet(path)


def write_summary(sections: dict[str, DataFrame], study_id: str, path: str, mode: str = "errorifexists", leave: tuple[str, ...] = ("scores", "cases")) -> None:
    """The result tables of a study as ordered JSON lines, a folder a section, each row with the study's id; row-level tables are left to Parquet."""
    for name, table in sections.items():
        if name not in leave:
            keys = [c for c, t in table.dtypes if t in ("string", "int", "bigint")] or table.columns[:1]
            write_ordered(table.withColumn("study_id", F.lit(study_id)), f"{path}/{name}", keys, mode)


def write_quality(report: DataFrame, missing: DataFrame, distributions: DataFrame, spreads: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The quality report of a parsed source: row accounting, missing fields, distributions and spreads."""
    for name, table, keys in (("rows", report, ["rows_seen"]), ("missing", missing, ["field"]), ("distributions", distributions, ["field", "value"]), ("spreads", spreads, ["field"])):
        write_ordered(table, f"{path}/{name}", keys, mode)


def manifest(digests: DataFrame, events: DataFrame, name: str, version: str, source: str) -> DataFrame:
    """One row: id, files with digests, counts, labels, time range."""
    files = digests.agg(F.array_sort(F.collect_list(F.struct(F.regexp_extract("file", r"([^/]+)$", 1).alias("relative_path"), "sha256", "size_bytes"))).alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256).alias("checksum"))
    labels = events.groupBy("ground_truth_label").agg(F.count("*").alias("n"), F.min("observed_at").alias("a"), F.max("observed_at").alias("b"))
    totals = labels.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ground_truth_label", "n")))).alias("label_distribution"), F.sum("n").alias("record_count"), F.min("a").alias("observed_start"), F.max("b").alias("observed_end"))
    return files.crossJoin(totals).select(manifest_id(F.lit(name), F.lit(version), F.col("checksum")).alias("manifest_id"), F.lit(name).alias("dataset_name"), F.lit(version).alias("dataset_version"), F.lit(source).alias("source"), "files", "record_count", "label_distribution", "observed_start", "observed_end")  # one row each
