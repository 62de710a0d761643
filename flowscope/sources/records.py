"""Strict reading of nested JSON records (canonical events, detections): a record is a variant that is walked by path, with keys, types and values checked at every depth.

A field that is wrong gives a violation of its own: ``<field>_missing``, ``_null``, ``_type``, ``_empty``, ``_value``, ``_range``, ``_length``, ``_address``,
``_without_zone``, and ``<object>_unknown_key``. Whole numbers may be written with zero decimals or as digits in text, as the schema's lax numbers allow,
and truth values count as 1 and 0; texts are texts only, and are stripped. Times are ISO texts. A key given twice makes a record no JSON.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import event_id
from ..functions.parsing import made_with, strip, to_ip

ZONE = r"(?i)(Z|[+-]\d{2}:?\d{2})$"


@dataclass(frozen=True)
class Field:
    """``kind``: text, whole, number, time, address, texts, object or any; ``path`` within the record."""

    path: str
    kind: str = "text"
    required: bool = False
    nullable: bool = True
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] = ()
    pattern: str | None = None
    longest: int | None = None

    @property
    def name(self) -> str:
        return self.path.rsplit(".", 1)[-1]

def _text(raw: Column, kind: Column) -> Column:
    return F.when(kind == "STRING", strip(F.try_variant_get(raw, "$", "string")))


def _number(raw: Column, kind: Column) -> Column:
    real = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(real, F.try_variant_get(raw, "$", "double")).when(kind == "BOOLEAN", F.try_variant_get(raw, "$", "boolean").cast("double")).otherwise(_text(raw, kind).try_cast("double"))


def _whole(raw: Column, kind: Column) -> Column:
    number, text = _number(raw, kind), _text(raw, kind)
    exact = F.when(kind == "BIGINT", F.try_variant_get(raw, "$", "long")).when(text.rlike(r"^[+-]?\d{1,18}$"), text.try_cast("long"))
    return F.coalesce(exact, F.when((number == F.floor(number)) & (F.abs(number) < 2.0**63), number.try_cast("long")))


def _time(raw: Column, kind: Column) -> Column:
    text = _text(raw, kind)
    return F.try_to_timestamp(F.when(text.rlike(ZONE), F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")))


def _texts(raw: Column, kind: Column) -> Column:
    return F.when(kind.startswith("ARRAY"), F.transform(F.try_variant_get(raw, "$", "array<variant>"), lambda v: F.nullif(_text(v, F.schema_of_variant(v)), F.lit(""))))


_VALUES = {"text": _text, "number": _number, "whole": _whole, "time": _time, "address": lambda raw, kind: to_ip(_text(raw, kind)), "texts": _texts, "object": lambda raw, kind: raw, "any": lambda raw, kind: raw}


def _made(rows: DataFrame) -> DataFrame:
    """``rows`` whose columns are made once: what reads them further on reads them, and doesn't make them again."""
    return rows.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*")


class Walked:
    """Records with ``_value``, ``_json`` (whether one is an object), and arrays ``_raw`` and ``_kinds``: each field's variant and its type."""

    def __init__(self, lines: DataFrame, value: str, fields: list[Field]):
        self.fields = {f.path: i for i, f in enumerate(fields)}
        self.listed = fields
        # exploded, so that a record is parsed once and not for every field taken from it
        rows = lines.select(F.col(value).alias("_value"), F.explode(F.array(F.struct(F.try_parse_json(F.col(value)).alias("v")))).alias("_p")).select("_value", F.col("_p.v").alias("_v"))
        rows = rows.select("_value", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)).alias("_json"), "_v", F.array(*[F.try_variant_get("_v", f"$.{f.path}", "variant") for f in fields]).alias("_raw"))
        self.rows = _made(_made(rows).withColumn("_kinds", F.transform("_raw", F.schema_of_variant)))

    def value(self, path: str) -> Column:
        """A field's value, null where it is not of its kind."""
        i = self.fields[path]
        return _VALUES[self.listed[i].kind](F.col("_raw")[i], F.col("_kinds")[i])

    def is_object(self, path: str) -> Column:
        return F.coalesce(F.col("_kinds")[self.fields[path]].startswith("OBJECT"), F.lit(False))

    def unknown_key(self, of: str, allowed: Column) -> Column:
        """The violation of an object with a key that is not allowed, else null."""
        keys = F.map_keys(F.try_variant_get("_v", f"$.{of}" if of else "$", "map<string,variant>"))
        return F.when(F.size(F.array_except(keys, allowed)) > 0, F.lit(f"{of}_unknown_key" if of else "unknown_key"))

    def broken(self, must: Column) -> Column:
        """Violations of all fields, by one rule for all; ``must``: an array that tells of each field whether it has to be there."""
        absent = F.lit(None)
        spec = F.array(*[
            F.struct(F.lit(f.name).alias("name"), F.lit(f.kind).alias("kind"), F.lit(f.nullable).alias("nullable"), (F.lit(float(f.low)) if f.low is not None else absent.cast("double")).alias("low"),
                     F.lit(float("inf") if f.high is None else float(f.high)).alias("high"), F.array(*[F.lit(v) for v in f.values]).cast("array<string>").alias("values"), F.lit(f.pattern).cast("string").alias("pattern"),
                     F.lit(f.longest or 1 << 30).alias("longest"))
            for f in self.listed
        ])

        def found(raw: Column, i: Column, text: Column) -> Column:
            s, kind = F.get(F.col("_spec"), i), F.get(F.col("_kinds"), i)
            what, here = s["kind"], kind != "VOID"
            number, time, texts = _number(raw, kind), _time(raw, kind), _texts(raw, kind)
            own = F.when(what.isin("text", "time", "address"), kind == "STRING").when(what == "object", kind.startswith("OBJECT")).when(what == "texts", kind.startswith("ARRAY")).when(what == "whole", _whole(raw, kind).isNotNull()).when(what == "number", number.isNotNull()).otherwise(True)
            plain = (what == "text") & (F.size(s["values"]) == 0) & s["pattern"].isNull()
            wrong = (F.size(s["values"]) > 0) & ~F.array_contains(s["values"], text) | ~F.rlike(text, s["pattern"])
            checks = {
                "null": ~here & ~s["nullable"], "type": here & ~own, "empty": plain & (F.length(text) == 0),
                "value": F.coalesce(text.isNotNull() & wrong, F.lit(False)) | F.coalesce((what == "texts") & F.exists(texts, lambda t: t.isNull()), F.lit(False)) | F.coalesce((what == "time") & text.rlike(ZONE) & time.isNull(), F.lit(False)),
                "length": F.char_length(text) > s["longest"], "without_zone": (what == "time") & ~text.rlike(ZONE),
                "range": what.isin("whole", "number") & s["low"].isNotNull() & own & ((number < s["low"]) | (number > s["high"]) | F.isnan(number)),
            }
            return F.array_compact(F.array(*[F.when(c, F.concat(s["name"], F.lit(f"_{k}"))) for k, c in checks.items()]))

        def of(raw: Column, i: Column) -> Column:
            # most fields of a record are not there, and need one check only
            missing = F.when(F.get(must, i), F.array(F.concat(F.get(F.col("_spec"), i)["name"], F.lit("_missing")))).otherwise(F.array().cast("array<string>"))
            return F.when(raw.isNull(), missing).otherwise(made_with(_text(raw, F.get(F.col("_kinds"), i)), lambda text: found(raw, i, text)))

        self.rows = _made(self.rows).withColumn("_spec", spec)
        return F.flatten(F.transform("_raw", of))

    def addresses(self) -> list[Column]:
        """Violations of addresses, which need more than the JVM."""
        out = []
        for f in self.listed:
            if f.kind == "address":
                i = self.fields[f.path]
                out.append(F.when(_text(F.col("_raw")[i], F.col("_kinds")[i]).isNotNull() & self.value(f.path).isNull(), F.lit(f"{f.name}_address")))
        return out

    def judged(self, broken: Column, more: list[Column]) -> DataFrame:
        """``violations``: those of fields and ``more`` (null where there is none); of what is no object only that."""
        return _made(self.rows.withColumn("violations", F.when(F.col("_json"), F.concat(broken, F.array_compact(F.array(*more)))).otherwise(F.array(F.lit("not_json")))))


def names(fields) -> Column:
    return F.array(*[F.lit(f.name) for f in fields]) if fields else F.array().cast("array<string>")


# -- canonical events --

# Sources, labels, kinds of details and the fields of each.
SOURCE_TYPES = ("ctu13", "iot23", "cowrie", "dshield", "external_scanner", "synthetic")
LABELS = ("benign", "malicious", "unknown")
VERSION, SHA256 = r"^\d+\.\d+\.\d+$", r"(?i)^[0-9a-f]{64}$"
UUID = r"(?i)^(urn:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"

_must = {"required": True, "nullable": False}
TOP = [
    Field("schema_version", nullable=False, pattern=VERSION), Field("event_id", pattern=UUID), Field("source", "object", **_must), Field("observed_at", "time", **_must), Field("ingested_at", "time", **_must),
    Field("event_type", **_must), Field("session_id"), Field("details", "object"), Field("ground_truth_label", nullable=False, values=LABELS), Field("label_source"), Field("attack_category"),
    Field("provenance", "object", **_must),
]
SOURCE = [
    Field("source.source_type", values=SOURCE_TYPES, **_must), Field("source.source_dataset", **_must), Field("source.scenario_id"), Field("source.dataset_version", **_must),
    Field("source.source_event_id", **_must), Field("source.raw_payload_reference", **_must), Field("source.raw_checksum", pattern=SHA256),
]
PROVENANCE = [
    Field("provenance.adapter_name", **_must), Field("provenance.adapter_version", pattern=VERSION, **_must), Field("provenance.transformation_version", pattern=VERSION, **_must),
    Field("provenance.processed_at", "time", **_must), Field("provenance.quality_flags", "texts", nullable=False),
]
_KIND = Field("details.kind", nullable=False, values=("network", "ctu13_flow", "authentication", "command", "http", "generic"))
_NETWORK = [
    Field("details.src_ip", "address"), Field("details.dst_ip", "address"), Field("details.src_port", "whole", low=0, high=65535), Field("details.dst_port", "whole", low=0, high=65535),
    *[Field(f"details.{c}") for c in ("protocol", "service", "connection_state", "history")], Field("details.tunnel_parents", "texts", nullable=False),
    *[Field(f"details.{c}", "whole", low=0) for c in ("orig_bytes", "resp_bytes", "missed_bytes", "orig_packets", "resp_packets", "network_bytes", "packet_count")],
    Field("details.session_duration_seconds", "number", low=0),
]
_FLOW = [
    Field("details.source_src_address"), Field("details.source_dst_address"), Field("details.flow_direction"), Field("details.source_tos", "whole", low=0, high=255), Field("details.destination_tos", "whole", low=0, high=255),
    Field("details.source_label", nullable=False),
]
_METHOD = Field("details.method")
_LOGIN = [Field("details.username"), Field("details.outcome", nullable=False, values=("success", "failure", "unknown"))]
_COMMAND = [Field("details.command", nullable=False, longest=8192)]
_HTTP = [Field("details.request_path", longest=4096), Field("details.user_agent", longest=2048)]
_GENERIC = [Field("details.fields", "object", nullable=False)]
DETAILS = {"network": _NETWORK, "ctu13_flow": [*_NETWORK, *_FLOW], "authentication": [*_LOGIN, _METHOD], "command": _COMMAND, "http": [*_HTTP, _METHOD], "generic": _GENERIC}
#: Fields that details of a kind must have.
NEEDED = {"details.source_label": "ctu13_flow", "details.command": "command"}


def canonical_events(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Valid events and rejected records (``value``, violations) of canonical event JSON, one record a row; what needs both reads ``judged_events`` once."""
    rows = judged_events(lines, value)
    good = F.size("violations") == 0
    return rows.where(good).drop("_value", "violations"), rows.where(~good).select(F.col("_value").alias(value), "violations")


def judged_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """``_value``, violations, and the columns of an event, which are null where there are violations; a row for each record.

    A record that gives no event_id gets the one of its source reference; one that gives another is rejected. Events have the fields of network flows as columns,
    lists as JSON text, and ``details_kind``; details of other kinds are ``details_json``.
    """
    inner = [_KIND, *_NETWORK, *_FLOW, *_LOGIN, _METHOD, *_COMMAND, *_HTTP, *_GENERIC]
    w = Walked(lines, value, [*TOP, *SOURCE, *PROVENANCE, *inner])
    made = event_id(*[w.value(f"source.{c}") for c in ("source_type", "source_dataset", "scenario_id", "dataset_version", "source_event_id")])
    # what the checks across fields and the output share
    w.rows = w.rows.withColumns({"_made": made, "_kind": w.value("details.kind"), "_given": w.value("event_id"), "_label": F.coalesce(w.value("ground_truth_label"), F.lit("unknown"))})
    w.rows = _made(w.rows)
    within = {"source": w.is_object("source"), "details": w.is_object("details"), "provenance": w.is_object("provenance")}
    must = []
    for f in w.listed:
        parent = f.path.partition(".")[0] if "." in f.path else None
        needed = F.coalesce(F.col("_kind") == NEEDED[f.path], F.lit(False)) if f.path in NEEDED else F.lit(f.required or f is _KIND)
        must.append(needed & within[parent] if parent else needed)
    w.rows = w.rows.withColumn("_must", F.array(*must))
    allowed = F.coalesce(*[F.when(F.col("_kind") == k, F.concat(F.array(F.lit("kind")), names(f))) for k, f in DETAILS.items()])
    digits = F.lower(F.regexp_replace("_given", r"(?i)urn:uuid:|[{}-]", ""))
    more = [
        w.unknown_key("", names(TOP)), w.unknown_key("source", names(SOURCE)), w.unknown_key("provenance", names(PROVENANCE)), w.unknown_key("details", allowed), *w.addresses(),
        F.when(F.col("_given").rlike(UUID) & (digits != F.replace("_made", F.lit("-"), F.lit(""))), F.lit("event_id_mismatch")),
        F.when((F.col("_label") != "unknown") & w.value("label_source").isNull(), F.lit("known_label_without_source")),
        F.when((F.col("_label") == "unknown") & w.value("attack_category").isNotNull(), F.lit("unknown_label_with_category")),
    ]
    checked = w.judged(w.broken(F.col("_must")), more)
    plain = lambda fields, *left: {f.name: w.value(f.path) for f in fields if f.name not in left}
    listed = lambda path: F.to_json(F.coalesce(w.value(path), F.array().cast("array<string>")))
    details = F.col("_raw")[w.fields["details"]]
    event = {
        "event_id": F.col("_made"), **plain(SOURCE, "raw_checksum"), "raw_checksum": F.lower(w.value("source.raw_checksum")),
        "schema_version": F.coalesce(w.value("schema_version"), F.lit("1.0.0")), **{c: w.value(c) for c in ("observed_at", "ingested_at", "event_type", "session_id")},
        "details_kind": F.col("_kind"), **plain([*_NETWORK, *_FLOW], "tunnel_parents"), "tunnel_parents": listed("details.tunnel_parents"),
        "details_json": F.when(~F.col("_kind").isin("network", "ctu13_flow"), F.to_json(details)), "ground_truth_label": F.col("_label"), "label_source": w.value("label_source"), "attack_category": w.value("attack_category"),
        **plain(PROVENANCE, "quality_flags"), "quality_flags": listed("provenance.quality_flags"),
    }
    return checked.select("_value", "violations", *[F.when(F.size("violations") == 0, c).alias(k) for k, c in event.items()])


# -- detections --

# Kinds and severities of detections.
DETECTOR_TYPES = ("rule", "statistical", "ml", "external_scanner")
SEVERITIES = ("informational", "low", "medium", "high", "critical")
DETECTION = [
    Field("schema_version", nullable=False, pattern=VERSION), Field("detection_id", pattern=UUID, **_must), Field("event_id", **_must), Field("detector_type", values=DETECTOR_TYPES, **_must),
    Field("detector_name", **_must), Field("detector_version", pattern=VERSION, **_must), Field("severity", values=SEVERITIES, **_must), Field("score", "number", low=0, high=1, **_must),
    Field("triggered_rules", "texts", **_must), Field("supporting_evidence", "any", **_must), Field("created_at", "time", **_must), Field("note", **_must),
]
_EVIDENCE = ("field", "observed_value", "predicate")


def detections(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Valid detections and rejected records (``value``, violations) of detection JSON, one record a row.

    Evidence is an array of (field, observed_value as JSON, predicate), and each piece needs all three and no more.
    """
    w = Walked(lines, value, DETECTION)
    evidence = w.fields["supporting_evidence"]
    pieces = F.when(F.col("_kinds")[evidence].startswith("ARRAY"), F.try_variant_get(F.col("_raw")[evidence], "$", "array<map<string,variant>>"))
    w.rows = w.rows.withColumns({"_pieces": pieces, "_rules": w.value("triggered_rules")})
    text = lambda v: _text(v, F.schema_of_variant(v))
    filled = lambda v: F.coalesce(F.length(text(v)) > 0, F.lit(False))
    keys = F.array(*[F.lit(k) for k in _EVIDENCE])
    whole = lambda e: F.coalesce((F.size(e) == 3) & (F.size(F.array_except(F.map_keys(e), keys)) == 0) & filled(e["field"]) & filled(e["predicate"]), F.lit(False))
    unless = lambda c, name: F.when(~F.coalesce(c, F.lit(False)), F.lit(name))
    more = [w.unknown_key("", names(DETECTION)), unless(F.size("_rules") > 0, "no_rule"), unless(F.size("_pieces") > 0, "no_evidence"), unless(F.forall("_pieces", whole), "evidence_incomplete")]
    checked = w.judged(w.broken(F.array(*[F.lit(f.required) for f in DETECTION])), more)
    shown = F.transform("_pieces", lambda e: F.struct(text(e["field"]).alias("field"), F.to_json(e["observed_value"]).alias("observed_value"), text(e["predicate"]).alias("predicate")))
    plain = [f for f in DETECTION if f.kind not in ("texts", "any")]
    good = checked.where(F.size("violations") == 0).select(*[w.value(f.path).alias(f.name) for f in plain], F.col("_rules").alias("triggered_rules"), shown.alias("supporting_evidence"))
    return good, checked.where(F.size("violations") > 0).select(F.col("_value").alias(value), "violations")
