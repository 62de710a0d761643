"""Fixed column lists and versions of the stored tables."""

from __future__ import annotations

EVENT_VERSION = "1.0.0"
RULE_VERSION = "1.0.0"

# Names and order of the stored features.
FLOW_FEATURES = [
    "duration_seconds", "duration_missing", "log_total_bytes", "total_bytes_missing", "log_packet_count", "packet_count_missing",
    "log_source_bytes", "source_bytes_missing", "src_port_well_known", "src_port_missing", "dst_port_well_known", "dst_port_missing",
    "dst_port_http", "dst_port_dns", "protocol_tcp", "protocol_udp", "protocol_icmp", "protocol_other", "protocol_missing",
    "direction_forward", "direction_reverse", "direction_bidirectional", "direction_other", "direction_missing", "state_length", "state_missing",
]
BEHAVIORAL_FEATURES = [
    *FLOW_FEATURES,
    "prior_source_connections_60s", "prior_unique_destinations_300s", "prior_unique_destination_ports_300s",
    "source_traffic_asymmetry", "source_traffic_asymmetry_missing", "prior_repeated_short_connections_300s",
]
CAUSAL_FEATURES = [
    *BEHAVIORAL_FEATURES,
    "prior_source_connections_300s", "prior_unique_destinations_60s", "prior_unique_destination_ports_60s", "prior_unique_protocols_300s",
    "prior_destination_reuse_300s", "prior_destination_port_reuse_300s", "prior_short_connections_60s", "log_prior_total_bytes_300s",
    "prior_total_bytes_300s_missing", "log_prior_packet_count_300s", "prior_packet_count_300s_missing",
    "log_seconds_since_prior_source_flow", "seconds_since_prior_source_flow_missing",
]
FEATURES = {"1.0.0": FLOW_FEATURES, "1.1.0": BEHAVIORAL_FEATURES, "1.2.0": CAUSAL_FEATURES}
# Groups that an ablation leaves out.
FEATURE_GROUPS = {
    "connection_rate": ["prior_source_connections_60s"],
    "destination_diversity": ["prior_unique_destinations_300s"],
    "destination_port_diversity": ["prior_unique_destination_ports_300s"],
    "traffic_asymmetry": ["source_traffic_asymmetry", "source_traffic_asymmetry_missing"],
    "repeated_short_connections": ["prior_repeated_short_connections_300s"],
}

# Columns of the stored events, with Spark types.
_HEAD = "event_id string, source_type string, source_dataset string, scenario_id string, dataset_version string, source_event_id string, raw_payload_reference string, raw_checksum string, schema_version string, observed_at timestamp, ingested_at timestamp, event_type string, session_id string, src_ip string, dst_ip string, "
_BODY = "src_port long, dst_port long, protocol string, service string, connection_state string, history string, tunnel_parents string, orig_bytes long, resp_bytes long, missed_bytes long, orig_packets long, resp_packets long, network_bytes long, packet_count long, session_duration_seconds double, "
_TAIL = "ground_truth_label string, label_source string, attack_category string, adapter_name string, adapter_version string, transformation_version string, quality_flags string"
BINETFLOW_EVENTS = _HEAD + "source_src_address string, source_dst_address string, " + _BODY + "flow_direction string, source_tos long, destination_tos long, source_label string, " + _TAIL
ZEEK_EVENTS = _HEAD + _BODY + _TAIL
