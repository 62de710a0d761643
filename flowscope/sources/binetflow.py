"""Argus bidirectional flow text: one CSV record a physical line, accepted or rejected with one issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import parsing as P
from ..functions.ids import event_id
from ..schemas import BINETFLOW_EVENTS, EVENT_VERSION
from ..store import measured
from .lines import numbered_lines, require_accepted

# The header of the format.
FIELDS = ["StartTime", "Dur", "Proto", "SrcAddr", "Sport", "Dir", "DstAddr", "Dport", "State", "sTos", "dTos", "TotPkts", "TotBytes", "SrcBytes", "Label"]
MESSAGES = {"invalid_encoding": "row is not UTF-8", "malformed_row": "row has the wrong number of fields or broken quotes", "bad_header": "header is not that of the format", "duplicate_source_record": "row repeats an earlier row", "invalid_record": "a field is missing or out of range"}
#: One field: quoted text with doubled quotes, or text that does not begin with a quote.
_FIELD = r',("(?:[^"]|"")*"[^,]*|[^,"][^,]*|)'


def split_csv(line: Column) -> Column:
    """Fields of a strict single CSV line; null for an unterminated quote."""
    led = F.concat(F.lit(","), line)
    quoted = F.regexp_extract_all(led, F.lit(_FIELD), F.lit(1))
    undo = F.transform(quoted, lambda x: F.when(x.startswith('"'), F.replace(F.regexp_replace(F.regexp_replace(x, r'^"', ""), r'"([^"]*)$', "$1"), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.when(~line.contains('"'), F.split(line, ",", -1)).when(led.rlike(f"^(?:{_FIELD})+$".replace(r',("', r',(?:"')), undo)


def classify(lines: DataFrame) -> DataFrame:
    """Lines of files with fields, missing counts and issue; blank lines are skipped, headers checked by file."""
    rows = lines.where(P.strip(F.col("value")) != "")
    head = rows.where("line_no = 1").select("file", (F.transform(F.split("value", ","), P.strip) == F.array(*[F.lit(f) for f in FIELDS])).alias("good"))
    rows = rows.join(measured(head, "headers"), "file", "left").withColumn("good", F.coalesce("good", F.lit(False))).where("NOT (line_no = 1)")
    rows = rows.withColumn("f", split_csv(F.col("value")))
    rows = rows.withColumn("shape", F.when(~F.col("good"), "bad_header").when(~F.col("decoded"), "invalid_encoding").when(F.col("f").isNull() | (F.size("f") != len(FIELDS)), "malformed_row"))
    shaped = F.col("shape").isNull()
    field = lambda i: F.when(shaped, P.clean(F.get("f", F.lit(i)), P.FLOW_MISSING))
    rows = rows.select("file", "line_no", "shape", *[field(i).alias(name) for i, name in enumerate(FIELDS)], F.when(shaped, F.sha2(F.array_join(F.transform("f", P.strip), "\x1f"), 256)).otherwise(F.concat(F.lit("line-"), F.col("line_no").cast("string"))).alias("print"))
    # a broken line has a print of its own
    return rows.withColumn("again", F.row_number().over(Window.partitionBy("file", "print").orderBy("line_no")) > 1)


def parse(spark: SparkSession, path: str | list[str], scenario: Column | str, ingested_at: str, dataset: str = "flows", version: str = "1", zone: str = "Europe/Prague", adapter: str = "binetflow", transformation: str = "1.0.0", strict_text: bool = False, fail_on_rejects: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted events, issues (file, line_no, issue_type, message), and classified rows for counts.

    With ``strict_text`` a file that is not UTF-8 fails the job; with ``fail_on_rejects`` any issue does.
    """
    lines = numbered_lines(spark, path, strict_text)
    rows = classify(lines)
    number = {"src_port": P.to_port(F.col("Sport")), "dst_port": P.to_port(F.col("Dport")), "orig_bytes": P.to_int(F.col("SrcBytes")), "network_bytes": P.to_int(F.col("TotBytes")), "packet_count": P.to_int(F.col("TotPkts")), "source_tos": P.to_int(F.col("sTos")), "destination_tos": P.to_int(F.col("dTos")), "session_duration_seconds": P.to_float(F.col("Dur"))}
    raw = {"src_port": "Sport", "dst_port": "Dport", "orig_bytes": "SrcBytes", "network_bytes": "TotBytes", "packet_count": "TotPkts", "source_tos": "sTos", "destination_tos": "dTos", "session_duration_seconds": "Dur"}
    top = {"src_port": 65535, "dst_port": 65535, "source_tos": 255, "destination_tos": 255}
    rows = rows.withColumns(number).withColumn("observed_at", P.to_utc(F.col("StartTime"), zone))
    bad = F.col("observed_at").isNull() | F.col("Label").isNull()
    for name, column in raw.items():
        bad |= F.coalesce((F.col(column).isNotNull() & F.col(name).isNull()) | (F.col(name) < 0), F.lit(False))
        if name in top:
            bad |= F.coalesce(F.col(name) > top[name], F.lit(False))
    issue = F.coalesce("shape", F.when(F.col("again"), "duplicate_source_record").when(bad, "invalid_record"))
    rows = rows.withColumn("issue_type", issue)
    scenario = F.lit(scenario) if isinstance(scenario, str) else scenario
    label = P.flow_label(F.col("Label"))
    source_id = F.concat(F.lit("line-"), F.col("line_no").cast("string"))
    text = {"protocol": "Proto", "connection_state": "State", "flow_direction": "Dir", "source_src_address": "SrcAddr", "source_dst_address": "DstAddr", "source_label": "Label"}
    made = {
        "event_id": event_id(F.lit("ctu13"), F.lit(dataset), scenario, F.lit(version), source_id), "source_type": F.lit("ctu13"), "source_dataset": F.lit(dataset), "scenario_id": scenario,
        "dataset_version": F.lit(version), "source_event_id": source_id, "raw_payload_reference": F.col("file"), "schema_version": F.lit(EVENT_VERSION), "ingested_at": F.lit(ingested_at).cast("timestamp"),
        "event_type": F.lit("network_flow"), "session_id": source_id, "src_ip": P.to_ip(F.col("SrcAddr")), "dst_ip": P.to_ip(F.col("DstAddr")), **{k: F.col(v) for k, v in text.items()},
        "ground_truth_label": label, "label_source": F.lit("source_label"), "attack_category": F.when(label != "unknown", F.col("Label")), "adapter_name": F.lit(adapter), "adapter_version": F.lit("1.0.0"),
        "transformation_version": F.lit(transformation), "quality_flags": F.to_json(F.array(F.lit(f"source_timestamp_timezone_assumed:{zone}"))),
    }
    events = conform(rows.where("issue_type IS NULL").withColumns(made), BINETFLOW_EVENTS)
    text_of = F.create_map(*[x for k, v in MESSAGES.items() for x in (F.lit(k), F.lit(v))])
    issues = rows.where("issue_type IS NOT NULL").select("file", "line_no", "issue_type")
    heads = lines.where("line_no = 1").where(~F.coalesce(F.transform(F.split("value", ","), P.strip) == F.array(*[F.lit(f) for f in FIELDS]), F.lit(False))).select("file", "line_no", F.lit("bad_header").alias("issue_type"))
    issues = issues.unionByName(heads).withColumn("message", text_of[F.col("issue_type")])
    return events, require_accepted(issues) if fail_on_rejects else issues, rows


def conform(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of a stored schema, in order; null where a source has none."""
    wanted = [c.rsplit(" ", 1) for c in schema.split(", ")]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in wanted])


def quality(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """Row accounting: seen, accepted, rejected (all issues), duplicates, time range."""
    seen = rows.agg(F.count("*").alias("rows_seen"), F.count_if(F.col("issue_type").isNull()).alias("accepted"), F.count_if(F.col("issue_type") == "duplicate_source_record").alias("duplicates"), F.min(F.when(F.col("issue_type").isNull(), F.col("observed_at"))).alias("observed_start"), F.max(F.when(F.col("issue_type").isNull(), F.col("observed_at"))).alias("observed_end"))
    return seen.crossJoin(issues.agg(F.count("*").alias("rejected")))  # one row each


def missing_counts(rows: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """Missing values of each field over all well-formed rows, rejected ones too."""
    sums = rows.where("shape IS NULL").agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in fields])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("missing")) for f in fields])).alias("m")).select("m.*")


def distributions(events: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of the values of each column, nulls left out."""
    each = events.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("d")).select("d.*")
    return each.where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n"))


def spreads(events: DataFrame, columns: list[str]) -> DataFrame:
    """Smallest, largest and mean value of each column, where it has any."""
    each = events.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("x")) for c in columns])).alias("d")).select("d.*")
    return each.where("x IS NOT NULL").groupBy("field").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"))


def render(flows: DataFrame) -> DataFrame:
    """Flows as lines of the format, by event_id; texts with commas or quotes are quoted."""
    def t(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit("-"))
        return F.when(text.rlike('[,"]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    label = F.when(F.col("ground_truth_label") == "malicious", "flow=From-Botnet-1").when(F.col("ground_truth_label") == "benign", "flow=From-Normal-1").otherwise("flow=Background")
    cells = [F.date_format("observed_at", "yyyy/MM/dd HH:mm:ss.SSSSSS"), t("session_duration_seconds"), t("protocol"), t("source_src_address"), t("src_port"), t("flow_direction"), t("source_dst_address"), t("dst_port"), t("connection_state"), F.lit("0"), F.lit("-"), t("packet_count"), t("network_bytes"), t("orig_bytes"), label]
    return flows.select("event_id", F.concat_ws(",", *cells).alias("value"))
