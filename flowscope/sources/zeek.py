"""Zeek connection logs: tab-separated rows whose columns a directive of the file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import parsing as P
from ..functions.ids import event_id
from ..schemas import EVENT_VERSION, ZEEK_EVENTS
from ..store import made_once, measured
from .binetflow import conform
from .lines import numbered_lines, require_accepted

MESSAGES = {"invalid_encoding": "row is not UTF-8", "malformed_row": "row has the wrong number of fields", "missing_fields": "no field names stand before the row", "invalid_record": "a field is missing or out of range", "duplicate_source_record": "row repeats an earlier record"}
_COUNTS = ["orig_bytes", "resp_bytes", "missed_bytes", "orig_pkts", "resp_pkts"]


def directives(lines: DataFrame) -> DataFrame:
    """The separator and field names that each directive line leaves in force."""
    d = lines.where(F.col("value").startswith("#separator") | F.col("value").startswith("#fields"))
    body = P.strip(F.regexp_replace("value", "^#separator", ""))
    sep = F.when(F.col("value").startswith("#separator"), F.when(body.rlike(r"^\\x[0-9a-fA-F]{2}$"), F.char(F.conv(F.substring(body, 3, 2), 16, 10).cast("int"))).when(F.length(body) == 1, body).otherwise("\t"))
    w = Window.partitionBy("file").orderBy("line_no")
    d = d.withColumn("sep", F.coalesce(F.last(sep, ignorenulls=True).over(w), F.lit("\t")))
    names = F.regexp_replace("value", r"^#fields\s*", "")
    by = F.when(names.contains(F.col("sep")), F.split(names, F.concat(F.lit("\\Q"), F.col("sep"), F.lit("\\E")))).otherwise(F.split(P.strip(names), r"\s+"))
    fields = F.when(F.col("value").startswith("#fields"), by)
    return d.select("file", "line_no", "sep", F.last(fields, ignorenulls=True).over(w).alias("fields"), F.coalesce(F.lead("line_no").over(w), F.lit(2**62)).alias("until"))


def parse(spark: SparkSession, path: str | list[str], scenario: str | None, ingested_at: str, dataset: str = "zeek", version: str = "1", transformation: str = "1.0.0", strict_text: bool = False, fail_on_rejects: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted events, issues, classified rows. With ``strict_text`` a file that is not UTF-8 fails the job; with ``fail_on_rejects`` any issue does."""
    lines = numbered_lines(spark, path, strict_text)
    # a few rows a file, each with the lines for which it is in force: lines of later splits find theirs without a shuffle of lines
    ruled = measured(directives(lines).select(F.col("file").alias("of"), F.col("line_no").alias("since"), "until", "sep", "fields"), "directives")
    body = lines.where(~F.col("value").startswith("#") & (P.strip(F.col("value")) != ""))
    rows = body.join(ruled, (F.col("file") == F.col("of")) & (F.col("line_no") > F.col("since")) & (F.col("line_no") < F.col("until")), "left").drop("of", "since", "until")
    values = F.split("value", F.concat(F.lit("\\Q"), F.coalesce("sep", F.lit("\t")), F.lit("\\E")), -1)
    rows = rows.withColumn("v", values).withColumn("shape", F.when(~F.col("decoded"), "invalid_encoding").when(F.col("fields").isNull(), "missing_fields").when(F.size("fields") != F.size("v"), "malformed_row")).withColumn("_back", F.reverse("fields"))
    rows = made_once(rows)  # each step's columns are read many times by the next
    # the last column of a name counts, where a name is repeated; position 0 (no such column) gives null
    place = lambda name: F.size("fields") - F.nullif(F.array_position("_back", name), F.lit(0)).cast("int")
    get = lambda name: P.clean(F.when(F.col("shape").isNull(), F.get("v", place(name))), P.ZEEK_MISSING, stripped=False)
    rows = rows.withColumns({f"raw_{n}": get(n) for n in ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service", "duration", "conn_state", "history", "tunnel_parents", "label", "detailed-label", *_COUNTS]} )
    rows = made_once(rows.drop("_back"))
    r = lambda n: F.col(f"`raw_{n}`")
    rows = rows.withColumns(
        {
            "observed_at": P.from_epoch(P.to_float(r("ts"))), "src_ip": P.to_ip(r("id.orig_h")), "dst_ip": P.to_ip(r("id.resp_h")), "src_port": P.to_int(r("id.orig_p")), "dst_port": P.to_int(r("id.resp_p")),
            "session_duration_seconds": P.to_float(r("duration")), **{f"n_{n}": P.to_int(r(n)) for n in _COUNTS},
        }
    )
    rows = made_once(rows)
    wrong = lambda raw, made: F.coalesce((r(raw).isNotNull() & F.col(made).isNull()) | (F.col(made) < 0), F.lit(False))
    bad = F.col("observed_at").isNull()
    for raw, made in (("id.orig_p", "src_port"), ("id.resp_p", "dst_port"), ("duration", "session_duration_seconds"), *[(n, f"n_{n}") for n in _COUNTS]):
        bad |= wrong(raw, made)
    for raw, made in (("id.orig_h", "src_ip"), ("id.resp_h", "dst_ip")):
        bad |= r(raw).isNotNull() & F.col(made).isNull()
    for port in ("src_port", "dst_port"):
        bad |= F.coalesce(F.col(port) > 65535, F.lit(False))
    source_id = F.coalesce(r("uid"), F.concat(F.lit("line-"), F.col("line_no").cast("string")))
    rows = rows.withColumn("bad", bad).withColumn("source_event_id", source_id)
    valid = F.col("shape").isNull() & ~F.col("bad")
    again = F.row_number().over(Window.partitionBy("file", "source_event_id", valid).orderBy("line_no")) > 1
    rows = rows.withColumn("issue_type", F.coalesce("shape", F.when(F.col("bad"), "invalid_record"), F.when(again & valid, "duplicate_source_record")))
    label = P.zeek_label(r("label"), r("detailed-label"))
    category = F.coalesce(r("detailed-label"), r("label"))
    parents = F.when(r("tunnel_parents").isNotNull(), F.filter(F.split(r("tunnel_parents"), ","), lambda x: x != ""))
    made = {
        "event_id": event_id(F.lit("iot23"), F.lit(dataset), F.lit(scenario), F.lit(version), F.col("source_event_id")), "source_type": F.lit("iot23"), "source_dataset": F.lit(dataset), "scenario_id": F.lit(scenario),
        "dataset_version": F.lit(version), "raw_payload_reference": F.col("file"), "schema_version": F.lit(EVENT_VERSION), "ingested_at": F.lit(ingested_at).cast("timestamp"), "event_type": F.lit("network_connection"),
        "session_id": r("uid"), "protocol": r("proto"), "service": r("service"), "connection_state": r("conn_state"), "history": r("history"), "tunnel_parents": F.to_json(F.coalesce(parents, F.array().cast("array<string>"))),
        "orig_bytes": F.col("n_orig_bytes"), "resp_bytes": F.col("n_resp_bytes"), "missed_bytes": F.col("n_missed_bytes"), "orig_packets": F.col("n_orig_pkts"), "resp_packets": F.col("n_resp_pkts"),
        "network_bytes": P.total(F.col("n_orig_bytes"), F.col("n_resp_bytes")), "packet_count": P.total(F.col("n_orig_pkts"), F.col("n_resp_pkts")), "ground_truth_label": label,
        "label_source": F.when(label != "unknown", "source_label"), "attack_category": F.when(label != "unknown", category), "adapter_name": F.lit("zeek_conn"), "adapter_version": F.lit("1.0.0"),
        "transformation_version": F.lit(transformation), "quality_flags": F.lit("[]"),
    }
    events = conform(rows.where("issue_type IS NULL").withColumns(made), ZEEK_EVENTS)
    none = lines.select("file").distinct().join(ruled.where("fields IS NOT NULL").select(F.col("of").alias("file")).distinct(), "file", "left_anti").select("file", F.lit(1).cast("long").alias("line_no"), F.lit("missing_fields").alias("issue_type"))
    text_of = F.create_map(*[x for k, v in MESSAGES.items() for x in (F.lit(k), F.lit(v))])
    issues = rows.where("issue_type IS NOT NULL").select("file", "line_no", "issue_type").unionByName(none).withColumn("message", text_of[F.col("issue_type")])
    return events, require_accepted(issues) if fail_on_rejects else issues, rows


def render(flows: DataFrame, fields: list[str]) -> DataFrame:
    """Flows as tab-separated lines of ``fields``, by event_id."""
    t = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    known = F.col("ground_truth_label")
    cells = {
        "ts": F.format_string("%.6f", F.unix_micros(F.col("observed_at").cast("timestamp")) / 1e6), "uid": F.concat(F.lit("C"), F.col("event_id").cast("string")), "id.orig_p": t("src_port"), "id.resp_p": t("dst_port"), "proto": t("protocol"),
        "duration": t("session_duration_seconds"), "orig_bytes": t("orig_bytes"), "resp_bytes": t("network_bytes"), "orig_pkts": t("packet_count"), "conn_state": t("connection_state"),
        "label": F.when(known == "malicious", "Malicious").when(known == "benign", "Benign").otherwise("-"), "detailed-label": F.when(known == "malicious", "C&C").otherwise("-"),
    }
    return flows.select("event_id", F.concat_ws("\t", *[cells.get(f, F.lit("-")) for f in fields]).alias("value"))


def source_labels(rows: DataFrame) -> DataFrame:
    """Accepted rows of each label that the source gives: the detailed one, else the plain one."""
    label = F.coalesce("`raw_detailed-label`", "raw_label")
    return rows.where("issue_type IS NULL").where(label.isNotNull()).groupBy(label.alias("source_label")).agg(F.count("*").alias("n"))
