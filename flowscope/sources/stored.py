"""Stored tables and artifacts that are read back: features and study results; JSON records are read by ``records``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import contracts
from ..schemas import FEATURES
from .lines import file_digests


def features(spark: SparkSession, path: str, version: str, scenarios: list[str] | None = None, sealed: tuple[str, ...] = (), raw_files: dict[str, str] | None = None) -> DataFrame:
    """event_id, scenario_id, ground_truth_label and the columns of a version, of the scenarios asked for; nothing else is read.

    Raises on a sealed scenario, on wrong feature columns (on null features as soon as they are read, without a pass of its own), and if a raw file that ``raw_files`` names for a scenario is missing.
    """
    contracts.guard_sealed_names([*(scenarios or []), path], list(sealed))
    stored = spark.read.parquet(path)
    rows = stored.select("event_id", "scenario_id", "ground_truth_label", *FEATURES[version])
    if scenarios is not None:
        rows = rows.where(F.col("scenario_id").isin(scenarios))
        if missing := [s for s in scenarios if raw_files is not None and s not in raw_files]:
            raise FileNotFoundError(f"no raw file is named for {', '.join(missing)}")
    for name, raw in (raw_files or {}).items():
        if scenarios is None or name in scenarios:
            spark.read.format("binaryFile").load(raw)  # fails here if there is none
    rows = contracts.feature_contract(rows, FEATURES[version])
    return contracts.guard_sealed(rows, list(sealed)) if sealed else rows


def provenance(spark: SparkSession, rows: DataFrame, raw_files: dict[str, str]) -> DataFrame:
    """scenario_id, source_path, source_checksum, source_size_bytes and label counts of stored features."""
    named = spark.createDataFrame([(s, p.rsplit("/", 1)[-1]) for s, p in raw_files.items()], "scenario_id string, name string")
    digests = file_digests(spark, list(raw_files.values())).select(F.col("file").alias("source_path"), F.regexp_extract("file", "([^/]+)$", 1).alias("name"), F.col("sha256").alias("source_checksum"), F.col("size_bytes").alias("source_size_bytes"))
    return label_counts(rows).join(named.join(digests, "name").drop("name"), "scenario_id")


def label_counts(rows: DataFrame) -> DataFrame:
    """Rows of each scenario, in all, known, unknown, and by label."""
    label = F.col("ground_truth_label")
    return rows.groupBy("scenario_id").agg(F.count("*").alias("accepted_rows"), F.count_if(label != "unknown").alias("known_rows"), *[F.count_if(label == x).alias(f"{x}_rows") for x in ("unknown", "benign", "malicious")])


def wanted_features(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored features of the wanted (event_id, scenario_id) alone; raises unless each of them has one row."""
    return contracts.same_ids(rows, wanted)


def study_metrics(artifact: DataFrame) -> DataFrame:
    """model, scenario_id, metric, value of study artifacts (``value`` holds one JSON document): models, their scenarios, their metrics."""
    kind = "struct<models: map<string, struct<scenarios: map<string, map<string, double>>>>>"
    models = artifact.select(F.explode(F.from_json("value", kind)["models"]).alias("model", "m"))
    return models.select("model", F.explode("m.scenarios").alias("scenario_id", "s")).select("model", "scenario_id", F.explode("s").alias("metric", "value"))


def study_cases(artifact: DataFrame, version: str, sealed: tuple[str, ...] = ()) -> DataFrame:
    """event_id, scenario_id, caught_by of the cases that study artifacts list; raises on another feature version or a sealed scenario."""
    kind = "struct<feature_version: string, validation_scenarios: array<string>, training_scenarios: array<string>, cases: array<struct<event_id: string, scenario_id: string, caught_by: array<string>>>>"
    held = artifact.select(F.from_json("value", kind).alias("a")).select("a.*")
    for r in held.select("feature_version", "validation_scenarios", "training_scenarios").collect():  # a row an artifact
        if r["feature_version"] != version:
            raise ValueError(f"feature_version must be {version}, not {r['feature_version']}")
        if not r["validation_scenarios"]:
            raise ValueError("the artifact names no validation scenario")
        contracts.guard_sealed_names([*r["validation_scenarios"], *(r["training_scenarios"] or [])], list(sealed))
    return held.select(F.explode("cases").alias("c")).select("c.*")


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """``value``: each file of a study's results, as one JSON document."""
    return spark.read.text(path, wholetext=True)
