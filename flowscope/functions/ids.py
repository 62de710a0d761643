"""Deterministic ids: UUID version 5 as a column expression."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F

#: Namespaces are parameters; these defaults derive from neutral names.
EVENTS = uuid.uuid5(uuid.NAMESPACE_DNS, "flowscope.events")
DETECTIONS = uuid.uuid5(uuid.NAMESPACE_DNS, "flowscope.detections")
MANIFESTS = uuid.uuid5(uuid.NAMESPACE_DNS, "flowscope.manifests")


def uuid5(name: Column, namespace: uuid.UUID) -> Column:
    """The UUID of ``name`` (UTF-8) in ``namespace``: SHA-1 with version 5 and the RFC variant."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def event_id(source_type: Column, dataset: Column, scenario: Column, version: Column, source_event_id: Column, namespace: uuid.UUID = EVENTS) -> Column:
    return uuid5(F.to_json(F.array(source_type, dataset, scenario, version, source_event_id), {"ignoreNullFields": "false"}), namespace)


def detection_id(event: Column, detector: Column, version: Column, rule: Column, namespace: uuid.UUID = DETECTIONS) -> Column:
    return uuid5(F.to_json(F.array(event.cast("string"), detector, version, rule)), namespace)


def manifest_id(name: Column, version: Column, checksum: Column, namespace: uuid.UUID = MANIFESTS) -> Column:
    return uuid5(F.concat_ws("|", name, version, checksum), namespace)
