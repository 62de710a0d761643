"""Data contracts: each row with the list of rules that it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parsing import strip

SEMVER, SHA256 = r"^\d+\.\d+\.\d+$", r"^[0-9a-f]{64}$"


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``rows`` with ``violations``: names of the checks that are false (null passes)."""
    return rows.withColumn("violations", F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items()])))


def between(name: str, low: float | None = None, high: float | None = None) -> Column:
    c = F.lit(True)
    c = c & (F.col(name) >= low) if low is not None else c
    return c & (F.col(name) <= high) if high is not None else c


def filled(name: str) -> Column:
    return F.col(name).isNotNull() & (F.length(strip(F.col(name))) > 0)


def event_checks(expected_id: Column | None = None) -> dict[str, Column]:
    counts = ["network_bytes", "orig_bytes", "packet_count", "session_duration_seconds"]
    out = {f"{c}_negative": between(c, 0) for c in counts} | {f"{c}_range": between(c, 0, 65535) for c in ("src_port", "dst_port")}
    out |= {f"{c}_empty": F.col(c).isNull() | filled(c) for c in ("protocol", "connection_state", "flow_direction", "source_src_address", "source_dst_address")}
    out |= {"source_event_id_empty": filled("source_event_id"), "observed_at_missing": F.col("observed_at").isNotNull(), "label_value": F.col("ground_truth_label").isin("benign", "malicious", "unknown")}
    if expected_id is not None:
        out["event_id_mismatch"] = F.col("event_id") == expected_id
    return out


def label_checks() -> dict[str, Column]:
    known = F.col("ground_truth_label") != "unknown"
    return {"known_label_without_source": ~known | F.col("label_source").isNotNull(), "unknown_label_with_category": known | F.col("attack_category").isNull()}


def detection_checks() -> dict[str, Column]:
    return {"score_range": between("score", 0, 1), "no_rule": filled("rule_id"), "no_evidence": F.size("evidence") > 0, "severity_value": F.col("severity").isin("informational", "low", "medium", "high", "critical")}


def manifest_checks() -> dict[str, Column]:
    start, end = F.col("observed_start"), F.col("observed_end")
    return {"absolute_path": ~F.exists("files", lambda f: f["relative_path"].startswith("/")), "checksum": F.forall("files", lambda f: f["sha256"].rlike(SHA256)), "one_sided_range": start.isNull() == end.isNull(), "range_order": start <= end, "label_sum": F.aggregate(F.map_values("label_distribution"), F.lit(0).cast("long"), lambda a, x: a + x) <= F.col("record_count")}


def feature_contract(features: DataFrame, names: list[str]) -> DataFrame:
    """``features``; raises unless the feature columns are there in order, as doubles, and fails as soon as one that is read is null.

    Each column carries its own check, so that the table is read once and only the columns that are asked for.
    """
    held = [c for c in features.columns if c in set(names)]
    if held != names or any(t != "double" for c, t in features.dtypes if c in set(names)):
        raise ValueError("feature columns are missing, out of order, or no doubles")
    return features.withColumns({c: F.coalesce(F.col(c), F.raise_error(F.lit(f"features must not be null: {c}")).cast("double")) for c in names})


def guard_sealed(rows: DataFrame, sealed: list[str]) -> DataFrame:
    """``rows``, failing as soon as one belongs to a sealed scenario."""
    return rows.where(F.assert_true(~F.col("scenario_id").isin(sealed), F.lit("sealed scenario")).isNull())


def guard_one_scenario(rows: DataFrame) -> DataFrame:
    if rows.select("scenario_id").distinct().limit(2).count() > 1:
        raise ValueError("more than one scenario")
    return rows


def guard_sealed_names(names: list[str], sealed: list[str]) -> list[str]:
    """``names`` (scenarios, paths, or entries of an artifact); raises if one holds the name of a sealed scenario."""
    held = [n for n in names for s in sealed if s in n.replace("\\", "/").split("/") or s == n or f"{s}_" in n or f"={s}" in n]
    if held:
        raise ValueError(f"sealed scenario: {held[0]}")
    return names


def guard_training(rows: DataFrame, label: str = "ground_truth_label") -> DataFrame:
    """``rows``; raises unless they hold known rows of both classes."""
    held = {r[0] for r in rows.where(F.col(label) != "unknown").select(label).distinct().collect()}  # two at most
    if held != {"benign", "malicious"}:
        raise ValueError("training needs both classes")
    return rows


def guard_classes(good: int, bad: int, odd: int = 0) -> None:
    """Raises unless counts of known rows show both classes and no other."""
    if not good or not bad or odd:
        raise ValueError("training needs both classes")


def guard_splits(splits: dict[str, DataFrame], label: str = "ground_truth_label") -> None:
    """Raises if a split has no known row."""
    for name, rows in splits.items():
        if rows.where(F.col(label) != "unknown").isEmpty():
            raise ValueError(f"the {name} split has no known rows")


def guard_scores(scores: DataFrame, column: str = "score") -> DataFrame:
    """``scores``, failing as soon as one is null, no number, or outside [0, 1]."""
    c = F.col(column)
    good = F.coalesce((c >= 0) & (c <= 1) & ~F.isnan(c), F.lit(False))
    return scores.where(F.assert_true(good, F.lit("scores must lie between 0 and 1")).isNull())


def same_ids(rows: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = ("event_id", "scenario_id")) -> DataFrame:
    """``rows`` of the wanted keys; raises unless these are the same keys, each once."""
    kept = rows.join(wanted.select(*keys), list(keys), "left_semi")
    counts = kept.agg(F.count("*").alias("rows"), F.count_distinct(*keys).alias("keys")).first()
    asked = wanted.select(*keys).distinct().count()
    if not counts["rows"] == counts["keys"] == asked:
        raise ValueError(f"{counts['rows']} rows of {counts['keys']} ids for {asked} wanted ids")
    return kept


def drift(reference: DataFrame, candidate: DataFrame, columns: list[str], key: str = "event_id") -> DataFrame:
    """key, feature, before, after: where features that two versions share differ (nulls are equal)."""
    a = reference.select(F.col(key).alias("_key"), F.struct(*columns).alias("_a"))
    both = candidate.select(key, F.struct(*columns).alias("_b")).join(a, F.col(key) == F.col("_key"))
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col("_a")[c].cast("double").alias("before"), F.col("_b")[c].cast("double").alias("after")) for c in columns])
    return both.select(key, F.explode(each).alias("d")).select(key, "d.*").where(~F.col("before").eqNullSafe(F.col("after")))


def guard_drift(reference: DataFrame, candidate: DataFrame, columns: list[str]) -> None:
    """Raises if a feature that two versions share differs."""
    odd = drift(reference, candidate, columns).limit(1).collect()
    if odd:
        raise ValueError(f"{odd[0]['feature']} differs between the versions for {odd[0][0]}")
