"""Deterministic rules: each is a predicate and the evidence that it shows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import detection_id
from ..schemas import RULE_VERSION

# Limits of the rules.
HIGH_VOLUME_BYTES = 10_000_000
LONG_LIVED_SECONDS = 300.0
LONG_LIVED_BYTES = 1_000_000
ICMP_BURST_PACKETS = 100


@dataclass(frozen=True)
class Rule:
    """``evidence``: (field, predicate) pairs; the field's value is shown as JSON."""

    name: str
    condition: Column
    evidence: tuple[tuple[str, str], ...]


def flow_rules() -> list[Rule]:
    """The rules on columns of flows; more can be given beside them."""
    icmp = F.lower("protocol") == "icmp"
    return [
        Rule("high_volume_flow", F.col("network_bytes") >= HIGH_VOLUME_BYTES, (("network_bytes", f">= {HIGH_VOLUME_BYTES}"),)),
        Rule("long_lived_high_volume_flow", (F.col("session_duration_seconds") >= LONG_LIVED_SECONDS) & (F.col("network_bytes") >= LONG_LIVED_BYTES), (("session_duration_seconds", f">= {LONG_LIVED_SECONDS}"), ("network_bytes", f">= {LONG_LIVED_BYTES}"))),
        Rule("icmp_packet_burst", icmp & (F.col("packet_count") >= ICMP_BURST_PACKETS), (("protocol", "== icmp"), ("packet_count", f">= {ICMP_BURST_PACKETS}"))),
    ]


def detections(flows: DataFrame, rules: list[Rule] | None = None, detector: str = "flow_rules", version: str = RULE_VERSION) -> DataFrame:
    """One row for each rule that fires on a flow, with its evidence. Labels are never read."""
    def fired(rule: Rule) -> Column:
        shown = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("observed_value"), F.lit(p).alias("predicate")) for f, p in rule.evidence])
        return F.when(rule.condition, F.struct(F.lit(rule.name).alias("rule_id"), shown.alias("evidence")))

    hits = flows.select("event_id", F.explode(F.array_compact(F.array(*[fired(r) for r in rules or flow_rules()]))).alias("hit"))
    return hits.select(
        detection_id(F.col("event_id"), F.lit(detector), F.lit(version), F.col("hit.rule_id")).alias("detection_id"),
        "event_id", F.lit(detector).alias("detector_name"), F.lit(version).alias("detector_version"), F.lit("rule").alias("detector_type"),
        F.lit("medium").alias("severity"), F.lit(1.0).alias("score"), F.col("hit.rule_id").alias("rule_id"), F.col("hit.evidence").alias("evidence"),
    )


def flags(flows: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Every flow with whether any rule fires, and the score 1.0 or 0.0."""
    any_ = None
    for r in rules or flow_rules():
        c = F.coalesce(r.condition, F.lit(False))
        any_ = c if any_ is None else any_ | c
    return flows.select("event_id", any_.alias("flag"), any_.cast("double").alias("score"))


def flags_from_features(features: DataFrame) -> DataFrame:
    """The rules on stored features. Logarithms round, so bytes and packets are rounded to 6 places: a flow at a limit is flagged."""
    bytes_ = F.round(F.expm1("log_total_bytes"), 6)
    packets = F.round(F.expm1("log_packet_count"), 6)
    hit = (bytes_ >= HIGH_VOLUME_BYTES) | ((F.col("duration_seconds") >= LONG_LIVED_SECONDS) & (bytes_ >= LONG_LIVED_BYTES)) | ((F.col("protocol_icmp") == 1) & (packets >= ICMP_BURST_PACKETS))
    return features.select("event_id", hit.alias("flag"), hit.cast("double").alias("score"))
