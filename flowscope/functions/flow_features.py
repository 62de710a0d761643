"""Features of one flow: 26 numbers without nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HTTP_PORTS = [80, 443, 8080]


def number(condition: Column) -> Column:
    """1.0 where true, 0.0 where false or null."""
    return F.coalesce(condition.cast("double"), F.lit(0.0))


def missing(name: str) -> Column:
    return F.col(name).isNull().cast("double")


def log_or_zero(value: Column) -> Column:
    return F.coalesce(F.log1p(value), F.lit(0.0))


def asymmetry() -> tuple[Column, Column]:
    """Share of bytes that the source sent, and whether it is unknown."""
    known = (F.col("network_bytes") > 0) & F.col("orig_bytes").isNotNull()
    return F.when(known, F.col("orig_bytes") / F.col("network_bytes")).otherwise(0.0), F.when(known, 0.0).otherwise(1.0)


def flow_features() -> dict[str, Column]:
    protocol, direction = F.lower("protocol"), F.col("flow_direction")
    out = {"duration_seconds": F.coalesce("session_duration_seconds", F.lit(0.0)), "duration_missing": missing("session_duration_seconds")}
    for name, column in (("total_bytes", "network_bytes"), ("packet_count", "packet_count"), ("source_bytes", "orig_bytes")):
        out |= {f"log_{name}": log_or_zero(F.col(column)), f"{name}_missing": missing(column)}
    for side in ("src", "dst"):
        out |= {f"{side}_port_well_known": number(F.col(f"{side}_port") <= 1023), f"{side}_port_missing": missing(f"{side}_port")}
    out |= {"dst_port_http": number(F.col("dst_port").isin(HTTP_PORTS)), "dst_port_dns": number(F.col("dst_port") == 53)}
    for flag in ("tcp", "udp", "icmp"):
        out[f"protocol_{flag}"] = number(protocol == flag)
    out |= {"protocol_other": number(~protocol.isin("tcp", "udp", "icmp")), "protocol_missing": missing("protocol")}
    for flag, sign in (("forward", "->"), ("reverse", "<-"), ("bidirectional", "<->")):
        out[f"direction_{flag}"] = number(direction == sign)
    out |= {"direction_other": number(~direction.isin("->", "<-", "<->")), "direction_missing": missing("flow_direction")}
    return out | {"state_length": F.coalesce(F.length("connection_state"), F.lit(0)).cast("double"), "state_missing": missing("connection_state")}


def with_flow_features(flows: DataFrame) -> DataFrame:
    return flows.withColumns(flow_features())
